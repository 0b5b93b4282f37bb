"""Fixed-width windows of user-market streams, and leakage-safe splits by time.

A row knows its number in the stream, so it is sent to the block of windows that it may belong to, and few rows
to two of them; a block's rows are put in order once and cut into its windows.  No array is built for the
windows that the stride drops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compact_time, micros
from ..params import FEATURES, Params
from .percentile import exact_percentiles
from .rolling import ORDER, READ, trailing_features, user_market_stream
from .scan import SegmentedScan, hour_of

SPLITS = ("train", "validation", "test")
#: Window starts that meet in one row while windows are made, at least.
LEAST_BLOCK = 64
#: Streams of more rows are cut by hours.
LARGE_STREAM = 100_000


def feature_vector(features: tuple[str, ...]) -> Column:
    """The features as one array<double>, in the given order; unknown names raise."""
    unknown = [f for f in features if f not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    return F.array(*(F.col(f).cast("double") for f in features))


def sequence_row_number(rows: DataFrame) -> DataFrame:
    """``seq``, a row's number in its (user, market) stream."""
    return SegmentedScan(rows, ["user", "market_id"], hour_of(F.col("trade_time")), list(ORDER)).number("seq").rows()


def is_window_end(seq: Column, length: int, stride: int) -> Column:
    return (seq >= length) & ((seq - length) % stride == 0)


def collect_windows(enriched: DataFrame, length: int, stride: int, features: tuple[str, ...]) -> DataFrame:
    """``user, market_id, seq, start_ts, end_ts, features, label`` of complete windows on the stride; ``seq``
    is the number of the window's last row, whose label it has."""
    # rows meet by blocks of window starts: a row goes to its own block, and near the end of a window to the one before
    block = stride * -(-max(LEAST_BLOCK, 4 * length) // stride)
    at = lambda seq: F.floor(seq / block)
    cut = enriched.select("user", "market_id", "seq", "trade_time", "label", feature_vector(features).alias("vector"))
    spread = cut.withColumn("block", F.explode(F.sequence(at(F.greatest(F.col("seq") - length, F.lit(0))), at(F.col("seq") - 1))))
    # features have a list of their own, so that they and all they are made of go where nothing reads them
    blocks = spread.groupBy("user", "market_id", "block").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("seq", "trade_time", "label"))).alias("rows"),
        F.sort_array(F.collect_list(F.struct("seq", "vector"))).alias("vectors"),
    )
    full = F.least(F.floor((F.col("n") - length) / stride), F.lit(block // stride - 1)).cast("int")
    ends = blocks.filter(F.col("n") >= length).withColumn("first", F.explode(F.sequence(F.lit(0), full * stride, F.lit(stride))))
    end = F.get("rows", F.col("first") + (length - 1))
    return ends.select(
        "user", "market_id", end["seq"].alias("seq"), F.get("rows", "first")["trade_time"].alias("start_ts"), end["trade_time"].alias("end_ts"),
        F.slice(F.col("vectors.vector"), F.col("first") + 1, length).alias("features"), end["label"].alias("label"),
    )


def window_id(end_ts: Column, seq: Column) -> Column:
    return F.concat_ws(":", "user", "market_id", compact_time(end_ts), F.lpad(seq.cast("string"), 8, "0"))


def time_cutoffs(rows: DataFrame, time: str, params: Params) -> DataFrame:
    """One row ``train_cutoff, validation_cutoff``: interpolated quantiles of epoch seconds.

    Times differ little against their size, so they are bucketed by their distance from the first one."""
    seconds = rows.select((micros(F.col(time)) / 1e6).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    first = seconds.agg(F.min("t").alias("t0"))
    shares = {"train_cutoff": params.train_ratio, "validation_cutoff": params.train_ratio + params.validation_ratio}
    found = exact_percentiles(seconds.crossJoin(F.broadcast(first)).select((F.col("t") - F.col("t0")).alias("d"), "n"), [], "d", shares, "n")
    return found.crossJoin(F.broadcast(first)).select(*((F.col(c) + F.col("t0")).alias(c) for c in shares))


def split_cutoffs(labeled: DataFrame, params: Params) -> DataFrame:
    return time_cutoffs(labeled, "trade_time", params)


def window_split_cutoffs(labeled: DataFrame, params: Params) -> DataFrame:
    return _cutoffs_of_ends(sequence_row_number(labeled), params)


def _cutoffs_of_ends(numbered: DataFrame, params: Params) -> DataFrame:
    return time_cutoffs(numbered.filter(is_window_end(F.col("seq"), params.window, params.stride)), "trade_time", params)


def split_of(start: Column, end: Column, train: Column, validation: Column, purge_minutes: int, embargo_minutes: int) -> Column:
    """The split of a window with start and end in epoch seconds; null: too near to a cutoff."""
    if not purge_minutes and not embargo_minutes:
        return F.when(end <= train, "train").when(end <= validation, "validation").otherwise("test")
    purge, embargo = purge_minutes * 60.0, embargo_minutes * 60.0
    return (
        F.when(end <= train - purge, "train")
        .when((start >= train + embargo) & (end <= validation - purge), "validation")
        .when(start >= validation + embargo, "test")
    )


def assign_split(windows: DataFrame, cutoffs: DataFrame, params: Params) -> DataFrame:
    """Windows with their ``split``; those without one are dropped.  ``cutoffs`` has one row."""
    start, end = micros(F.col("start_ts")) / 1e6, micros(F.col("end_ts")) / 1e6
    out = windows.crossJoin(F.broadcast(cutoffs))
    split = split_of(start, end, F.col("train_cutoff"), F.col("validation_cutoff"), params.purge_minutes, params.embargo_minutes)
    return out.withColumn("split", split).filter(F.col("split").isNotNull()).drop("train_cutoff", "validation_cutoff")


def _named(windows: DataFrame, cutoffs: DataFrame, params: Params, names: tuple[str, str, str, str]) -> DataFrame:
    key, start, end, size = names
    out = assign_split(windows, cutoffs, params).withColumn(key, window_id(F.col("end_ts"), F.col("seq")))
    out = out.withColumn(size, F.lit(params.window)).withColumnRenamed("start_ts", start).withColumnRenamed("end_ts", end)
    return out.select(key, "user", "market_id", start, end, size, "features", "label", "split")


def streams(labeled: DataFrame, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Labelled rows with their place in their stream, and only the columns that windows are made of.  Streams read the labelled rows
    twice, and cut-offs and features both read the streams; ``kept`` may write either, so that they are made once."""
    rows = labeled.select(*READ, "side", "label")
    return kept(user_market_stream(kept(rows), LARGE_STREAM)) if kept else user_market_stream(rows)


def sequence_windows(labeled: DataFrame, params: Params, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Windows split at quantiles of all labelled rows."""
    rows = streams(labeled, kept)
    windows = collect_windows(trailing_features(rows), params.window, params.stride, params.features)
    return _named(windows, split_cutoffs(rows, params), params, ("sequence_id", "sequence_start_ts", "sequence_end_ts", "seq_len"))


def model_windows(labeled: DataFrame, params: Params, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Windows split at quantiles of the window ends."""
    rows = streams(labeled, kept)
    windows = collect_windows(trailing_features(rows), params.window, params.stride, params.features)
    return _named(windows, _cutoffs_of_ends(rows, params), params, ("window_id", "window_start_ts", "window_end_ts", "window_size"))


def ratio_cutoffs_by_index(rows: DataFrame, time: str, train_ratio: float, validation_ratio: float) -> DataFrame:
    """One row ``train_end, validation_end``: the elements ``max(0, int(n * ratio) - 1)`` of the sorted times.

    Counts by time are summed by second first; only seconds are put in one order.
    """
    counts = rows.groupBy(F.col(time).alias("t")).agg(F.count("*").alias("n"))
    seconds = counts.groupBy(F.date_trunc("hour", "t").alias("h")).agg(F.sum("n").alias("hn"))
    before = F.coalesce(F.sum("hn").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = seconds.withColumn("h_before", before)
    within = Window.partitionBy("h").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("h", F.date_trunc("hour", "t")).withColumn("upto", F.sum("n").over(within)).join(seconds, "h")
    placed = placed.withColumn("last", F.col("h_before") + F.col("upto")).withColumn("first", F.col("last") - F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    at = lambda ratio: F.greatest(F.lit(0), F.floor(F.col("total") * ratio).cast("long") - 1)
    placed = placed.crossJoin(F.broadcast(total))
    pick = lambda ratio: F.max(F.when((F.col("first") <= at(ratio)) & (at(ratio) < F.col("last")), F.col("t")))
    return placed.agg(pick(train_ratio).alias("train_end"), pick(train_ratio + validation_ratio).alias("validation_end"))


def split_summary(windows: DataFrame) -> DataFrame:
    label = F.col("label").cast("long")
    return windows.groupBy("split").agg(
        F.count("*").alias("row_count"), F.sum(label).alias("positive_rows"), (F.count("*") - F.sum(label)).alias("negative_rows"), F.avg(F.col("label").cast("double")).alias("positive_rate")
    )


def split_time_ranges(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").agg(F.min("window_end_ts").alias("min_window_end_ts"), F.max("window_end_ts").alias("max_window_end_ts"))


def window_shape(windows: DataFrame) -> DataFrame:
    width = F.size(F.element_at("features", 1))
    made = {"window_size": F.col("window_size"), "feature_rows": F.size("features"), "feature_width": width}
    return windows.agg(*(f(c).alias(f"{n}_{k}") for k, c in made.items() for n, f in (("min", F.min), ("max", F.max))))


def window_integrity(windows: DataFrame, length: int, width: int) -> DataFrame:
    """Ids in more than one split, and rows of the wrong shape."""
    overlap = windows.groupBy("window_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.count("*").alias("overlapping_window_ids"))
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    wrong = windows.agg(
        flag(F.col("window_size") != length).alias("wrong_window_size_rows"),
        flag(F.size("features") != length).alias("wrong_feature_row_count_rows"),
        flag((F.size("features") > 0) & (F.size(F.element_at("features", 1)) != width)).alias("wrong_feature_width_rows"),
    )
    return overlap.crossJoin(wrong)


