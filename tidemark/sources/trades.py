"""Trade sources: schemas, scans, and the trade view over an event table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = {"timestamp", "block_number"}
_DOUBLE = {"price", "token_amount", "usd_amount"}
_COLUMNS = (
    "timestamp", "datetime", "block_number", "transaction_hash", "contract", "event_id", "event_slug", "event_title", "market_id", "condition_id",
    "question", "nonusdc_side", "maker", "taker", "maker_direction", "taker_direction", "price", "token_amount", "usd_amount", "asset_id", "order_hash",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in _LONG else T.DoubleType() if c in _DOUBLE else T.StringType()) for c in _COLUMNS])


def scan_trades(source: DataFrame) -> DataFrame:
    """The 21 raw columns with their types; missing ones are null."""
    return source.select(*((F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA), *(["trade_time"] if "trade_time" in source.columns else []))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return scan_trades(spark.read.parquet(path))


def scan_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A hive-partitioned stage folder with its partition columns as strings."""
    return spark.read.option("basePath", path).option("recursiveFileLookup", "false").parquet(path)


def scan_time_range(trades: DataFrame, start: datetime | None, end: datetime | None, column: str = "timestamp") -> DataFrame:
    """Half-open filter on raw epoch seconds: start <= t < end."""
    for bound, keep in ((start, lambda s: F.col(column) >= s), (end, lambda s: F.col(column) < s)):
        if bound is not None:
            trades = trades.filter(keep(int((bound - datetime(1970, 1, 1)).total_seconds())))
    return trades


def scan_time_range_closed(trades: DataFrame, start: int, end: int, column: str = "timestamp") -> DataFrame:
    return trades.filter(F.col(column).between(start, end))


def union_time_slices(trades: DataFrame, slices: list[tuple[int, int]], column: str = "timestamp") -> DataFrame:
    """Several closed time ranges by one scan; a row that is in two of them comes twice."""
    hits = F.array_compact(F.array(*(F.when(F.col(column).between(a, b), F.lit(i)) for i, (a, b) in enumerate(slices))))
    within = F.lit(False)
    for a, b in slices:
        within = within | F.col(column).between(a, b)
    return trades.filter(within).withColumn("slice", F.explode(hits))


def event_trades(events: DataFrame) -> DataFrame:
    """Fills derived from an event table (``event_id, ts, user_id, event_type, value, props``)."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    c = F.round(F.col("value") * 100).cast("long")
    e = events.withColumn("k", k).withColumn("c", c)
    price = (F.col("c") % 99 + 1) / F.lit(100.0)
    return e.select(
        F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts")).alias("timestamp"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.col("event_id").cast("long").alias("block_number"),
        F.concat(F.lit("tx"), "event_id").alias("transaction_hash"),
        F.lit("exchange").alias("contract"),
        F.concat(F.lit("ev-"), "event_type").alias("event_id"),
        F.concat(F.lit("slug-"), "event_type").alias("event_slug"),
        F.concat(F.lit("Title "), "event_type").alias("event_title"),
        F.col("event_type").alias("market_id"),
        F.concat(F.lit("c-"), "event_type").alias("condition_id"),
        F.concat(F.lit("Will it "), "event_type").alias("question"),
        F.when(F.col("k") % 2 == 0, "token1").otherwise("token2").alias("nonusdc_side"),
        F.concat(F.lit("u"), "user_id").alias("maker"),
        F.when(F.col("k") % 10 == 0, F.lit("0xC1")).otherwise(F.concat(F.lit("u"), (F.col("user_id") + F.col("k")) % 40)).alias("taker"),
        F.when(F.col("k") % 3 == 0, "SELL").otherwise("Buy").alias("maker_direction"),
        F.when(F.col("k") == 7, "n/a").when(F.col("k") % 3 == 0, " bid ").otherwise("-short").alias("taker_direction"),
        price.alias("price"),
        (F.col("c") * 10000).cast("double").alias("token_amount"),
        (F.col("c") * 10000 * price).alias("usd_amount"),
        F.concat(F.col("event_type"), F.lit("-"), (F.col("k") % 2).cast("string")).alias("asset_id"),
        F.concat(F.lit("o"), "event_id").alias("order_hash"),
        F.col("ts").alias("trade_time"),
    )
