"""Live market messages with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import sinks

EVENTS = ("last_trade_price", "price_change", "market_resolved")
MESSAGE = "struct<event_type:string,type:string,market:string,asset_id:string,wallet:string,side:string,outcome:string,price:string,size:string,ts:timestamp,id:bigint>"


def parse_messages(frames: DataFrame, value: str = "value") -> DataFrame:
    """One row for each message of a frame, an object or an array of them; unreadable frames give none."""
    text = F.ltrim(F.col(value).cast("string"))
    whole = F.when(text.startswith("["), text).when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    out = frames.select(F.explode(F.from_json(whole, f"array<{MESSAGE}>")).alias("m")).filter(F.col("m").isNotNull())
    return out.select(F.coalesce("m.event_type", "m.type").alias("event_type"), *(f"m.{c}" for c in ("market", "asset_id", "wallet", "side", "outcome", "id")), F.col("m.price").try_cast("double").alias("price"), F.col("m.size").try_cast("double").alias("size"), "m.ts")


def filter_events(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("event_type").isin(*EVENTS) & F.col("market").isNotNull() & F.col("ts").isNotNull())


#: Times that a market's batch keeps in memory; more are put into the state store in pieces of one gap.
HELD = 1 << 20


class Throttle(StatefulProcessor):
    """Lets one time through for each gap of a market.

    A market's batch arrives in pieces.  Times are sorted into spans of one gap; where they are too many, the spans' pieces wait in
    the state store.  Then the spans are gone through in order, and only one of them is in memory.  What stays
    is the time that was let through last."""

    def __init__(self, gap_us: int, held: int = HELD) -> None:
        self.gap, self.most = gap_us, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")
        self.waiting = handle.getMapState("waiting", "span long, piece int", "times binary")

    def _put_away(self, spans: dict[int, list[np.ndarray]], away: dict[int, int]) -> None:
        for span, parts in spans.items():
            piece = away.get(span, 0)
            self.waiting.updateValue((span, piece), (np.concatenate(parts).tobytes(),))
            away[span] = piece + 1
        spans.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans: dict[int, list[np.ndarray]] = {}
        away: dict[int, int] = {}
        held = 0
        for frame in rows:
            us = np.sort(frame["us"].to_numpy(dtype=np.int64))
            span = us // self.gap
            starts = np.flatnonzero(np.r_[True, span[1:] != span[:-1]]) if us.size else np.zeros(0, dtype=int)
            for part in np.split(us, starts[1:]):
                if part.size:
                    spans.setdefault(int(part[0] // self.gap), []).append(part)
            held += us.size
            if held > self.most:
                self._put_away(spans, away)
                held = 0
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for span in sorted(spans.keys() | away.keys()):
            parts = spans.pop(span, [])
            for piece in range(away.get(span, 0)):
                parts.append(np.frombuffer(self.waiting.getValue((span, piece))[0], dtype=np.int64))
                self.waiting.removeKey((span, piece))
            times = np.sort(np.concatenate(parts))
            while (i := int(np.searchsorted(times, times[0] if last is None else last + self.gap))) < times.size:
                last = int(times[i])
                out.append(last)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"market": [key[0]] * len(out), "us": out})

    def close(self) -> None:
        pass


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def throttle(messages: DataFrame, gap_seconds: float) -> DataFrame:
    """``market, ts`` of the messages let through: one for each market and ``gap_seconds`` of event time, in time order
    within a batch.  Sets the session's state store to the one that keeps state on disk."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    keyed = messages.select("market", F.unix_micros("ts").alias("us"))
    passed = keyed.groupBy("market").transformWithStateInPandas(Throttle(round(gap_seconds * 1e6)), "market string, us long", "append", "none")
    return passed.select("market", F.timestamp_micros("us").alias("ts"))


def flow_5m(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Signed flow by market, wallet and 5-minute window, with a watermark for late rows."""
    signed = F.when(F.upper("side") == "BUY", 1.0).otherwise(-1.0) * F.col("price") * F.col("size")
    rows = messages.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes").alias("w"), "market", "wallet").agg(F.sum(signed).alias("flow"), F.count("*").alias("n"))
    return rows.select("market", "wallet", F.col("w.start").alias("bucket"), "flow", "n")


TRADE = "market_id string, wallet string, side string, asset string, outcome string, price double, size double, usdc double, ts timestamp_ntz, seq long"


def message_trades(messages: DataFrame) -> DataFrame:
    """Messages as trades of the wallet operators."""
    return messages.select(
        F.col("market").alias("market_id"), "wallet", "side", F.col("asset_id").alias("asset"), "outcome", "price", "size",
        (F.col("price") * F.col("size")).alias("usdc"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"),
    )


class MarketState:
    """What a stream knows of its markets, below ``path``: their trades, one folder for each batch and market, and the latest
    snapshot of each market.

    A batch adds its own trades and reads those of the markets that it touched, no others.  A batch that is run again after
    a failure writes its folder again, so nothing counts twice."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _batch(self, number: int) -> str:
        return f"{self.path}/trades/batch={number}"

    def merge(self, trades: DataFrame, number: int) -> DataFrame:
        """Adds a batch; returns its trades as written."""
        n = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = trades.repartition(n, "market_id", F.pmod(F.xxhash64("wallet", "seq"), F.lit(4)))
        dealt.write.mode("overwrite").partitionBy("market_id").option("compression", "zstd").parquet(self._batch(number))
        return trades.sparkSession.read.schema(TRADE).parquet(self._batch(number))

    def trades_of(self, markets: DataFrame) -> DataFrame:
        """All trades of these markets; folders of others are not read."""
        held = markets.sparkSession.read.schema(f"{TRADE}, batch long").parquet(f"{self.path}/trades")
        return held.join(markets.select("market_id"), "market_id", "left_semi").drop("batch")

    def snapshots(self, spark: SparkSession) -> DataFrame:
        return sinks.read_snapshot(spark, f"{self.path}/snapshots")

    def due(self, touched: DataFrame, gap_seconds: float) -> DataFrame:
        """Of ``market_id, last``, the markets that have no snapshot from the ``gap_seconds`` before."""
        try:
            seen = self.snapshots(touched.sparkSession).select("market_id", "refreshed_at")
        except FileNotFoundError:
            return touched
        known = touched.join(seen, "market_id", "left")
        passed = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("refreshed_at").cast("timestamp"))) >= gap_seconds * 1e6
        return known.filter(F.col("refreshed_at").isNull() | passed | F.lit(gap_seconds <= 0)).drop("refreshed_at")


def snapshot_stream(messages: DataFrame, state: MarketState, snapshot: Callable[[DataFrame], DataFrame], gap_seconds: float, checkpoint: str) -> DataStreamWriter:
    """Merges every micro-batch into the state and gives each touched market that is due a new snapshot, made by ``snapshot`` from
    all its trades.  The new one replaces the stored one."""

    def each(batch: DataFrame, number: int) -> None:
        fresh = state.merge(message_trades(batch), number)
        touched = fresh.groupBy("market_id").agg(F.max("ts").alias("last"))
        due = state.due(touched, gap_seconds)
        if due.isEmpty():
            return
        made = snapshot(state.trades_of(due)).join(due, "market_id").withColumnRenamed("last", "refreshed_at")
        sinks.upsert_snapshot(made.withColumn("batch", F.lit(number).cast("long")), f"{state.path}/snapshots", "market_id", "batch")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def every_minute(writer: DataStreamWriter) -> DataStreamWriter:
    return writer.trigger(processingTime="1 minute")


def first_batch(writer: DataStreamWriter, timeout: int = 120) -> StreamingQuery:
    """Starts a stream with its trigger, waits for what is there to be done, and stops it."""
    import time

    query, end = writer.start(), time.time() + timeout
    try:
        while query.lastProgress is None or not query.recentProgress:
            if query.exception() is not None:
                raise query.exception()
            if time.time() > end:
                raise TimeoutError("the stream's first batch did not end in time")
            time.sleep(0.2)
    finally:
        query.stop()
    return query


def drain(writer: DataStreamWriter, timeout: int | None = None) -> StreamingQuery:
    """Runs a stream over what is there and waits for its end, for at most ``timeout`` seconds if they are given; what is there may be
    of any size."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError("the stream did not end in time")
    return query
