"""Running values by segment, snapshots of several writers, manifests, and the market state."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lots
from tidemark.operators import evaluate as E
from tidemark.operators.scan import SegmentedScan, hour_of, range_edges, range_of
from tidemark.params import Params
from tidemark.sources import sinks
from tidemark.sources.scratch import scratch
from tidemark.streaming import stream as Z

DAY = datetime(2024, 1, 1)


def plain_scan(rows):
    """(number, total, peak, lag, lead, first, last_known) by key, in plain Python."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total, peak, known = 0, None, None
        for i, r in enumerate(mine):
            total += r[3] or 0
            peak = r[3] if peak is None else peak if r[3] is None else max(peak, r[3])
            known = r[3] if r[3] is not None else known
            out[r[2]] = (i + 1, total, peak, mine[i - 1][3] if i else None, mine[i + 1][3] if i + 1 < len(mine) else None, mine[0][3], known)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_scan_that_cuts_only_large_keys_equals_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), DAY + timedelta(minutes=rng.randint(0, 60 * 9)), i, rng.choice([None, rng.randint(-5, 9)])) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v long")
    v = F.col("v")
    for large in (0, 40, 1000):
        scan = SegmentedScan(df, ["k"], hour_of(F.col("ts")), ["ts", "id"], large).number("n").total("sum", v).peak("top", v).lag("before", v).lead("after", v).first("start", v).last_known("known", v)
        assert {r.id: tuple(r)[4:] for r in scan.rows().collect()} == plain_scan(rows)


@pytest.mark.parametrize("seed", range(3))
def test_segmented_scan_equals_a_plain_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), DAY + timedelta(minutes=rng.randint(0, 60 * 9)), i, rng.choice([None, rng.randint(-5, 9)])) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v long")
    v = F.col("v")
    scan = SegmentedScan(df, ["k"], hour_of(F.col("ts")), ["ts", "id"]).number("n").total("sum", v).peak("top", v).lag("before", v).lead("after", v).first("start", v).last_known("known", v)
    got = {r.id: tuple(r)[4:] for r in scan.rows().collect()}
    assert got == plain_scan(rows)


def test_no_task_holds_a_whole_key(spark):
    rows = [("hot", DAY + timedelta(minutes=i), i, 1) for i in range(60 * 48)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = SegmentedScan(df, ["k"], hour_of(F.col("ts")), ["ts", "id"]).number("n").rows()
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == len(rows) and max(sizes) < len(rows) * 0.6


def test_ranges_grow_with_the_column(spark):
    df = spark.createDataFrame([(f"{i:03}",) for i in range(300)] + [(None,)], "k string")
    edges = range_edges(df, "k", 8)
    got = [r.r for r in df.select("k", range_of("k", edges).alias("r")).orderBy(F.col("k").asc_nulls_first()).collect()]
    assert got[0] is None and got[1:] == sorted(got[1:]) and len(set(got[1:])) == 8
    assert range_edges(df.limit(0), "k") == []


@pytest.mark.parametrize("key", ["long", "string"])
def test_one_tied_score(spark, key):
    rng = random.Random(2)
    rows = [(i if key == "long" else f"{i:04}", rng.randint(0, 1), 0.5 if i % 10 else 0.7) for i in range(500)]
    got = {r.key: (r.tp, r.fp) for r in E.cumulative_tp_fp(spark.createDataFrame(rows, f"key {key}, label int, probability double"), "key").collect()}
    tp = fp = 0
    for k, label, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        tp, fp = tp + label, fp + 1 - label
        assert got[k] == (tp, fp)


def test_fifo_over_days_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(lots, "ROWS", 5)
    rng = random.Random(9)
    rows = [("m", "w", rng.choice(["BUY", "BUY", "SELL"]), "a", rng.randint(1, 99) / 100, rng.choice([0.1, 0.3, 2.0, 7.7]), DAY + timedelta(minutes=rng.randint(0, 6000)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "market_id string, wallet string, side string, asset string, price double, size double, ts timestamp_ntz, seq long")
    held, want = [], {}
    for r in sorted(rows, key=lambda r: (r[6], r[7])):
        size = round(r[5] * 10)
        if r[2] == "BUY":
            held.append([size, r[4]])
            continue
        while size and held:
            n = min(size, held[0][0])
            want[held[0][1], r[4]] = want.get((held[0][1], r[4]), 0) + n
            held[0][0] -= n
            size -= n
            if not held[0][0]:
                held.pop(0)
    got = {}
    for r in lots.fifo_lot_match(df).collect():
        got[r.buy_price, r.sell_price] = got.get((r.buy_price, r.sell_price), 0) + r.matched_size * 10
    assert got == pytest.approx(want)


# ---- snapshots and manifests


def test_writers_at_once_lose_no_key(spark):
    path = scratch(spark, "race")

    def write(i):
        rows = spark.createDataFrame([(f"own{i}", i, i), ("shared", i, i)], "k string, version int, writer int")
        sinks.upsert_snapshot(rows, path, "k", "version")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(6)))
    got = {r.k: r.version for r in sinks.read_snapshot(spark, path).collect()}
    assert got == {"shared": 5} | {f"own{i}": i for i in range(6)}


def test_a_snapshot_that_is_not_there(spark):
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, scratch(spark, "nothing"))


def test_an_unfinished_version_is_left_aside(spark, monkeypatch):
    path = scratch(spark, "dead")
    row = spark.createDataFrame([("a", 1)], "k string, version int")
    sinks.upsert_snapshot(row, path, "k", "version")
    at, fs = sinks._fs(spark, f"{path}/current/000000002")
    fs.create(at, False).close()  # its writer died before it named a folder
    waited = sinks._markers
    monkeypatch.setattr(sinks, "_markers", lambda spark, path: waited(spark, path, 0.2))
    assert [r.k for r in sinks.read_snapshot(spark, path).collect()] == ["a"]
    sinks.upsert_snapshot(spark.createDataFrame([("b", 1)], "k string, version int"), path, "k", "version")
    assert sorted(r.k for r in sinks.read_snapshot(spark, path).collect()) == ["a", "b"]


@pytest.mark.parametrize("by", [None, "d"])
def test_a_manifest_is_observed_by_the_write(spark, by):
    path = scratch(spark, "observed")
    rows = spark.range(100).select(F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit(DAY)).alias("t"), (F.col("id") % 3).alias("d"), "id")
    stage = sinks.write_stage(rows, "s", path, "t", Params(), by)
    m = sinks.read_manifests(spark, path).first()
    assert (m.stage, m.row_count, m.min_time, m.max_time) == ("s", 100, DAY, DAY + timedelta(minutes=99)) and stage.count() == 100
    empty = scratch(spark, "observed-empty")
    sinks.write_stage(rows.limit(0), "e", empty, "t", Params())
    assert sinks.read_manifests(spark, empty).first().row_count == 0


# ---- the market state


def trade(i, market, minute):
    return (market, f"w{i % 3}", "BUY", f"{market}-0", "Yes", 0.5, float(i), float(i) / 2, DAY + timedelta(minutes=minute), i)


def test_a_batch_run_again_counts_once_and_reads_only_its_markets(spark):
    state = Z.MarketState(scratch(spark, "state"))
    first = spark.createDataFrame([trade(i, m, i) for i in range(6) for m in "ab"], Z.TRADE)
    state.merge(first, 0)
    state.merge(first, 0)
    state.merge(spark.createDataFrame([trade(9, "a", 9)], Z.TRADE), 1)
    a = state.trades_of(spark.createDataFrame([("a",)], "market_id string"))
    assert a.count() == 7 and {r.market_id for r in a.collect()} == {"a"}
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(market_id" in plan


def test_due_markets(spark):
    state = Z.MarketState(scratch(spark, "due"))
    touched = spark.createDataFrame([("a", DAY), ("b", DAY + timedelta(seconds=5))], "market_id string, last timestamp_ntz")
    assert state.due(touched, 10).count() == 2
    seen = spark.createDataFrame([("a", DAY - timedelta(seconds=10), 0), ("b", DAY, 0)], "market_id string, refreshed_at timestamp_ntz, batch int")
    sinks.upsert_snapshot(seen, f"{state.path}/snapshots", "market_id", "batch")
    assert [r.market_id for r in state.due(touched, 10).collect()] == ["a"]
    assert state.due(touched, 0).count() == 2


class Held:
    """A state handle in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):  # noqa: N802
        return self

    def getMapState(self, *_):  # noqa: N802
        held = self.map

        class Map:
            updateValue = staticmethod(held.__setitem__)  # noqa: N815
            getValue = staticmethod(held.__getitem__)  # noqa: N815
            removeKey = staticmethod(held.pop)  # noqa: N815

        return Map

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("most", [0, 7, 1 << 20])
def test_throttle_in_pieces_equals_one_sorted_list(most):
    rng = random.Random(3)
    state = Held()
    throttle = Z.Throttle(50, most)
    throttle.init(state)
    last, want, got = None, [], []
    for _ in range(3):
        times = [rng.randint(0, 2000) for _ in range(80)]
        for t in sorted(times):
            if last is None or t - last >= 50:
                want.append(t)
                last = t
        frames = [pd.DataFrame({"us": times[i : i + 9]}) for i in range(0, 80, 9)]
        for out in throttle.handleInputRows(("m",), iter([pd.DataFrame({"us": []}), *frames]), None):
            got += list(out["us"])
        assert state.map == {}
    assert got == want
