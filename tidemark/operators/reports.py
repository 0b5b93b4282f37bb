"""Reports over labelled trades: totals, balance, concentration, integrity, picks and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Written
from .percentile import exact_percentiles

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
TOP, SENT_CANDIDATES = 100, 100_000
#: What makes a data set unfit, or fit with weighting (fixed values).
LEAST_STREAMS, LEAST_WINDOWS, MOST_IMBALANCE, MOST_SHARE, MOST_DRIFT = 100, 1000, 2.0, 0.35, 0.15


def _positives() -> Column:
    return F.sum(F.col("label").cast("long"))


def usd_total(n: str = "usd_amount") -> Column:
    """Amounts have six places, so their sum is exact in any order."""
    return F.sum(F.col(n).cast("decimal(28,6)"))


def usd_mean(n: str = "usd_amount") -> Column:
    return usd_total(n).cast("double") / F.count(n)


def dataset_totals(labeled: DataFrame) -> DataFrame:
    """One row.  Rows are summed by user, market and asset first, so the chain runs once and the distinct counts
    expand those sums and not every row."""
    own = labeled.groupBy("user", "market_id", "asset_id").agg(
        F.count("*").alias("n"), _positives().alias("p"), F.min("trade_time").alias("a"), F.max("trade_time").alias("b"), F.sum(F.abs("markout_bps")).alias("bps"),
        F.count("markout_bps").alias("n_bps"), usd_total().alias("usd"), F.count("usd_amount").alias("n_usd"),
    )
    return own.agg(
        F.sum("n").alias("total_rows"), F.sum("p").alias("positive_rows"), (F.sum("n") - F.sum("p")).alias("negative_rows"), (F.sum("p") / F.sum("n")).alias("positive_rate"),
        F.min("a").alias("min_trade_time"), F.max("b").alias("max_trade_time"), (F.sum("bps") / F.sum("n_bps")).alias("avg_abs_markout_bps"), (F.sum("usd").cast("double") / F.sum("n_usd")).alias("avg_usd_amount"),
        F.count_distinct("user").alias("distinct_users"), F.count_distinct("market_id").alias("distinct_markets"), F.count_distinct("asset_id").alias("distinct_assets"),
    )


def class_ratios(labeled: DataFrame) -> DataFrame:
    t = labeled.agg(F.count("*").alias("n"), _positives().alias("p")).withColumn("q", F.col("n") - F.col("p"))
    return t.select(
        (1.0 - F.col("p") / F.col("n")).alias("negative_rate"),
        F.try_divide("p", "q").alias("positive_to_negative_ratio"),
        F.try_divide(F.greatest("p", "q"), F.least("p", "q")).alias("majority_to_minority_ratio"),
    )


def class_imbalance_ratio(labeled: DataFrame) -> DataFrame:
    t = labeled.agg(F.count("*").alias("n"), _positives().alias("p")).withColumn("q", F.col("n") - F.col("p"))
    ratio = F.when(F.least("p", "q") > 0, F.greatest("p", "q") / F.least("p", "q")).otherwise(F.lit(float("inf")))
    return t.select(ratio.alias("imbalance_ratio"))


def percentiles(labeled: DataFrame, columns: tuple[str, ...] = ("markout", "markout_bps", "usd_amount")) -> DataFrame:
    """Interpolated percentiles, one row for each column."""
    values = labeled.select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns))))
    return exact_percentiles(values, ["measure"], "x", PERCENTILES)


def balance(labeled: DataFrame, key: Column, name: str) -> DataFrame:
    return labeled.groupBy(key.alias(name)).agg(
        F.count("*").alias("row_count"), _positives().alias("positive_rows"), (F.count("*") - _positives()).alias("negative_rows"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"), F.avg(F.abs("markout_bps")).alias("avg_abs_markout_bps"), usd_mean().alias("avg_usd_amount"),
    )


def monthly_balance(labeled: DataFrame) -> DataFrame:
    return balance(labeled, F.date_format("trade_time", "yyyy-MM"), "month")


def daily_balance(labeled: DataFrame) -> DataFrame:
    return balance(labeled, F.date_format("trade_time", "yyyy-MM-dd"), "day")


def rate_range(balanced: DataFrame) -> DataFrame:
    return balanced.agg((F.max("positive_rate") - F.min("positive_rate")).alias("positive_rate_range"))


def concentration(labeled: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """Share of rows and of USD of the ``top`` keys; ties by key.  Two top-k sorts, no global window."""
    totals = labeled.groupBy(key).agg(F.count("*").alias("n"), F.sum("usd_amount").alias("usd"))
    whole = totals.agg(F.sum("n").alias("all_n"), F.sum("usd").alias("all_usd"))
    by_rows = totals.orderBy(F.col("n").desc_nulls_last(), F.col(key).asc_nulls_last()).limit(top).agg(F.sum("n").alias("top_n"))
    by_usd = totals.orderBy(F.col("usd").desc_nulls_last(), F.col(key).asc_nulls_last()).limit(top).agg(F.sum("usd").alias("top_usd"))
    return whole.crossJoin(by_rows).crossJoin(by_usd).select((F.col("top_n") / F.col("all_n")).alias(f"top_{top}_row_share"), (F.col("top_usd") / F.col("all_usd")).alias(f"top_{top}_usd_share"))


def stream_lengths(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("user", "market_id").agg(F.count("*").alias("stream_len"))


def stream_length_buckets(labeled: DataFrame) -> DataFrame:
    n = F.col("stream_len")
    bucket = F.when(n < 10, "001-009").when(n < 25, "010-024").when(n < 50, "025-049").when(n < 100, "050-099").otherwise("100+")
    return stream_lengths(labeled).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("stream_count"), F.avg("stream_len").alias("avg_stream_len"))


def window_estimates(labeled: DataFrame, length: int, stride: int) -> DataFrame:
    return estimates(stream_lengths(labeled), length, stride)


def estimates(streams: DataFrame, length: int, stride: int) -> DataFrame:
    n = F.col("stream_len")
    ok = n >= length
    total = lambda c: F.coalesce(F.sum(F.when(ok, c).otherwise(F.lit(0))), F.lit(0)).cast("long")
    return streams.agg(
        F.count("*").alias("stream_count"), total(F.lit(1)).alias("eligible_stream_count"), total(n - length + 1).alias("dense_window_count"),
        total(F.floor((n - length) / stride) + 1).alias("stride_window_count"),
    )


def duplicate_keys(labeled: DataFrame) -> DataFrame:
    groups = labeled.groupBy("user", "market_id", "trade_time", "role", "transaction_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("duplicate_key_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))


def label_integrity(labeled: DataFrame) -> DataFrame:
    return labeled.agg(
        F.count_if(F.col("future_trade_time") < F.col("target_time")).alias("invalid_future_time_rows"),
        F.count_if(F.col("label").isNull()).alias("null_label_rows"),
        F.count_if(F.col("markout_bps").isNull()).alias("null_markout_bps_rows"),
    )


def training_feasibility(labeled: DataFrame, length: int, stride: int) -> DataFrame:
    """One row with the verdict and what it rests on.  All of it comes from counts by user, market and month, one
    shuffle that every part reuses."""
    own = labeled.groupBy("user", "market_id", F.date_format("trade_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), _positives().alias("p"))

    def share(key: str) -> DataFrame:
        totals = own.groupBy(key).agg(F.sum("n").alias("n"))
        top = totals.orderBy(F.col("n").desc_nulls_last(), F.col(key).asc_nulls_last()).limit(TOP).agg(F.sum("n").alias("top"))
        return totals.agg(F.sum("n").alias("whole")).crossJoin(top).select((F.col("top") / F.col("whole")).alias(f"{key.removesuffix('_id')}_row_share"))

    months = own.groupBy("month").agg((F.sum("p") / F.sum("n")).alias("positive_rate"))
    totals = own.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).withColumn("q", F.col("n") - F.col("p"))
    ratio = F.when(F.least("p", "q") > 0, F.greatest("p", "q") / F.least("p", "q")).otherwise(F.lit(float("inf")))
    facts = (
        estimates(own.groupBy("user", "market_id").agg(F.sum("n").alias("stream_len")), length, stride)
        .crossJoin(totals.select(ratio.alias("imbalance_ratio")))
        .crossJoin(rate_range(months))
        .crossJoin(share("user"))
        .crossJoin(share("market_id"))
    )
    blocked = (F.col("eligible_stream_count") < LEAST_STREAMS) | (F.col("stride_window_count") < LEAST_WINDOWS)
    weigh = (F.col("imbalance_ratio") > MOST_IMBALANCE) | (F.col("user_row_share") > MOST_SHARE) | (F.col("market_row_share") > MOST_SHARE) | (F.col("positive_rate_range") > MOST_DRIFT)
    # verdicts (fixed values)
    verdict = F.when(blocked, "blocked_for_training").when(weigh, "feasible_with_weighting_or_sampling").otherwise("feasible_now")
    return facts.withColumn("verdict", verdict)


# ---- picks and their context

_KEY = ("transaction_hash", "user", "role")


def _pick(labeled: DataFrame, n: int, *order: Column) -> DataFrame:
    return labeled.orderBy(*order, F.col("usd_amount").desc_nulls_last(), F.col("trade_time").asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in _KEY)).limit(n)


def top_true_signals(labeled: DataFrame, n: int) -> DataFrame:
    return _pick(labeled.filter("label = 1"), n, F.col("markout_bps").desc_nulls_last())


def top_false_signals(labeled: DataFrame, n: int) -> DataFrame:
    return _pick(labeled.filter("label = 0"), n, F.col("markout_bps").asc_nulls_last())


def near_zero_signals(labeled: DataFrame, n: int) -> DataFrame:
    return _pick(labeled, n, F.abs("markout_bps").asc_nulls_last())


def signal_candidates(labeled: DataFrame, per_class: int, ambiguous: int) -> DataFrame:
    """The three picks in one list; a row that is in several of them stays in the first."""
    picks = (("true_signal", top_true_signals(labeled, per_class)), ("false_signal", top_false_signals(labeled, per_class)), ("near_zero", near_zero_signals(labeled, ambiguous)))
    every = None
    for priority, (name, rows) in enumerate(picks):
        rows = rows.withColumn("pick", F.lit(name)).withColumn("priority", F.lit(priority))
        every = rows if every is None else every.unionByName(rows)
    w = Window.partitionBy(*_KEY).orderBy("priority")
    return every.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "priority")


def top_trades_by_usd(prepared: DataFrame, n: int = 20) -> DataFrame:
    return prepared.orderBy(F.col("usd_amount").desc_nulls_last(), F.col("transaction_hash").asc()).limit(n)


def candidate_context(candidates: DataFrame, prepared: DataFrame, before_minutes: int, after_minutes: int) -> DataFrame:
    """Every candidate with the trades of its asset from ``before`` to ``after`` its time, bounds cut to
    whole seconds and included.  Candidates are sent to the trades if they are at most ``SENT_CANDIDATES``; more
    of them meet their trades by asset and day.
    """
    second = F.date_trunc("second", "trade_time").cast("timestamp_ntz")
    c = candidates.select(
        *(F.col(k).alias(f"c_{k}") for k in _KEY), F.col("asset_id").alias("c_asset"),
        F.timestamp_add("MINUTE", F.lit(-before_minutes), second).alias("lo"), F.timestamp_add("MINUTE", F.lit(after_minutes), second).alias("hi"),
    )
    p = prepared.select("asset_id", "trade_time", "price_yes", "usd_amount", F.col("transaction_hash").alias("context_tx"))
    c = Written(c, "candidates").rows  # their top-k runs once
    within = (F.col("asset_id") == F.col("c_asset")) & F.col("trade_time").between(F.col("lo"), F.col("hi"))
    if c.limit(SENT_CANDIDATES + 1).count() <= SENT_CANDIDATES:
        return p.join(F.broadcast(c), within).drop("c_asset", "lo", "hi")
    days = F.sequence(F.date_trunc("day", "lo").cast("timestamp_ntz"), F.date_trunc("day", "hi").cast("timestamp_ntz"), F.expr("INTERVAL 1 DAY"))
    c = c.withColumn("c_day", F.explode(days))
    p = p.withColumn("day", F.date_trunc("day", "trade_time").cast("timestamp_ntz"))
    return p.join(c, within & (F.col("day") == F.col("c_day"))).drop("c_asset", "lo", "hi", "day", "c_day")


def context_with_fallback(candidates: DataFrame, prepared: DataFrame, labeled: DataFrame, before_minutes: int, after_minutes: int) -> DataFrame:
    """The context, or distinct labelled rows for candidates without prepared ones.  Candidates are a few picks of all labelled rows and
    are read three times, so they are written once."""
    candidates = Written(candidates, "picks").rows
    keys = [f"c_{k}" for k in _KEY]
    columns = [*keys, "asset_id", "trade_time", "price_yes", "usd_amount"]
    found = candidate_context(candidates, prepared, before_minutes, after_minutes).select(*columns)
    renamed = candidates.select(*(F.col(k).alias(f"c_{k}") for k in _KEY), *(c for c in candidates.columns if c not in _KEY))
    missing = renamed.join(found.select(*keys).distinct(), keys, "left_anti")
    missing = missing.select(*(c for c in missing.columns if not c.startswith("c_")), *(F.col(f"c_{k}").alias(k) for k in _KEY))
    other = candidate_context(missing, labeled, before_minutes, after_minutes).select(*columns).distinct()
    return found.unionByName(other)


