"""Window tensors as nested arrays: flatten, summarise, transform, clip, standardise, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log1p_positive, signed_log1p
from .percentile import exact_percentiles

# How a feature is transformed, clipped and scaled by default (fixed values).
LOG1P = (
    "usd_amount", "time_delta_seconds", "market_age_seconds", "market_trade_count_1h", "market_volume_1h",
    "user_trade_count_1h", "user_market_trade_count_1h", "user_usd_volume_1h",
)
SIGNED_LOG1P = ("signed_token_amount", "user_signed_flow_1h")
UNSCALED = ("side", "role_is_maker")
CLIPPED = (
    "signed_token_amount", "usd_amount", "time_delta_seconds", "market_age_seconds", "market_trade_count_1h", "market_volume_1h",
    "user_trade_count_1h", "user_market_trade_count_1h", "user_signed_flow_1h", "user_usd_volume_1h",
)
CLIP_SHARES = (0.005, 0.995)
SUMMARIES = ("first", "last", "mean", "std", "min", "max", "delta", "last5_mean")
LEAST_SCALE = 1e-12


def transform_kind(feature: str) -> str:
    return "log1p" if feature in LOG1P else "signed_log1p" if feature in SIGNED_LOG1P else "identity"


def transform_value(feature: str, x: Column) -> Column:
    kind = transform_kind(feature)
    return log1p_positive(x) if kind == "log1p" else signed_log1p(x) if kind == "signed_log1p" else x


def flatten_window(features: Column) -> Column:
    return F.flatten(features)


def step_name(features: Sequence[str]) -> Column:
    """``feature__step_NN`` of the columns ``step`` and ``j``."""
    return F.format_string("%s__step_%02d", F.get(F.array(*map(F.lit, features)), F.col("j")), F.col("step"))


def flatten_long(windows: DataFrame, features: Sequence[str], key: str = "window_id") -> DataFrame:
    """One row for each value: its ``step`` and the feature's place ``j``, and the ``name`` that both make.  Whoever groups values
    does so by ``step, j`` and names the groups, since a name costs more than its value."""
    steps = windows.select(key, F.posexplode("features").alias("step", "vector"))
    values = steps.select(key, "step", F.posexplode("vector").alias("j", "value"))
    return values.select(key, "step", "j", step_name(features).alias("name"), "value")


def summary_names(features: Sequence[str]) -> list[str]:
    return [f"{f}__summary_{s}" for s in SUMMARIES for f in features]


def window_summary(features: Column, width: int) -> Column:
    """first, last, mean, population std, min, max, delta and mean of the last five, each for all features."""

    def at(j: int) -> Column:
        return F.transform(features, lambda row: row[j])

    def mean(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)

    def std(xs: Column) -> Column:
        m = mean(xs)
        # the mean is bound once as the only element of an array
        return F.transform(F.array(m), lambda mu: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)) / F.size(xs)))[0]

    first, last = (lambda j: F.element_at(features, 1)[j]), (lambda j: F.element_at(features, -1)[j])
    last5 = lambda j: F.slice(at(j), -F.least(F.lit(5), F.size(features)), F.least(F.lit(5), F.size(features)))
    made = (
        first, last, lambda j: mean(at(j)), lambda j: std(at(j)), lambda j: F.array_min(at(j)), lambda j: F.array_max(at(j)),
        lambda j: last(j) - first(j), lambda j: mean(last5(j)),
    )
    return F.array(*(f(j) for f in made for j in range(width)))


def augmented_vector(features: Column, width: int, with_summary: bool = True) -> Column:
    return F.concat(F.flatten(features), window_summary(features, width)) if with_summary else F.flatten(features)


def _per_feature(features: Column, names: Sequence[str], change) -> Column:
    return F.transform(features, lambda row: F.array(*(change(n, j, row[j]) for j, n in enumerate(names))))


def transform_features(features: Column, names: Sequence[str]) -> Column:
    return _per_feature(features, names, lambda n, j, x: transform_value(n, x))


def clip_features(features: Column, names: Sequence[str], lower: Column, upper: Column) -> Column:
    """Clips where clipping is on; ``lower`` and ``upper`` are arrays by feature."""
    return _per_feature(features, names, lambda n, j, x: _clipped(n, x, lower[j], upper[j]))


def _clipped(name: str, x: Column, lower: Column, upper: Column) -> Column:
    return F.least(F.greatest(x, lower), upper) if name in CLIPPED else x


def standardize_windows(windows: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """transform, clip, then (x - mean) / scale where scaling is on; ``stats`` is one row of arrays
    ``lower, upper, mean, scale``."""
    out = windows.crossJoin(F.broadcast(stats))

    def change(n: str, j: int, x: Column) -> Column:
        x = _clipped(n, transform_value(n, x), F.col("lower")[j], F.col("upper")[j])
        return x if n in UNSCALED else (x - F.col("mean")[j]) / F.col("scale")[j]

    scaled = _per_feature(F.col("features"), names, change)  # in one pass
    return out.withColumn("features", scaled).drop("lower", "upper", "mean", "scale")


def standardize_vector(vector: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(vector, mean, lambda x, m: x - m), scale, lambda x, s: x / s)


def steps_of(windows: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """One row for each value of each step: ``feature, position, x``."""
    steps = windows.select(*keep, F.posexplode("features").alias("position", "vector"))
    named = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(j).alias("j"), F.col("vector")[j].alias("x")) for j, n in enumerate(names)))
    return steps.select(*keep, "position", F.inline(named))


def transformed_steps(windows: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    return steps_of(windows.withColumn("features", transform_features(F.col("features"), names)), names, *keep)


def clip_bounds(train: DataFrame, names: Sequence[str], sample_windows: int | None = None, seed: int = 0, key: str = "window_id") -> DataFrame:
    """``feature, lower, upper`` (null where clipping is off) of transformed values, over all windows or over the
    ``sample_windows`` of smallest seeded hash."""
    if sample_windows is not None:
        train = train.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample_windows)
    values = transformed_steps(train, names).filter(F.col("feature").isin(*CLIPPED))
    return exact_percentiles(values, ["feature"], "x", dict(zip(("lower", "upper"), CLIP_SHARES)))


def scaler_fit(train: DataFrame, names: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """``feature, mean, scale`` over all steps; population scale, 1 where it is below 1e-12."""
    # a step is one row, and its features are columns: no row is made for each value
    steps = train.select(F.explode(transform_features(F.col("features"), names)).alias("v")).select(*(F.col("v")[j].alias(f"x{j}") for j in range(len(names))))
    if bounds is not None:
        of = lambda c, n: F.max(F.when(F.col("feature") == n, F.col(c)))
        row = bounds.agg(*(of(c, n).alias(f"{c}{j}") for j, n in enumerate(names) for c in ("lower", "upper")))
        clipped = lambda j: F.least(F.greatest(f"x{j}", f"lower{j}"), F.col(f"upper{j}"))
        steps = steps.crossJoin(F.broadcast(row)).select(*(F.when(F.col(f"lower{j}").isNull(), F.col(f"x{j}")).otherwise(clipped(j)).alias(f"x{j}") for j in range(len(names))))
    means = steps.agg(F.count("*").alias("n"), *(F.avg(x).alias(f"{m}{j}") for j in range(len(names)) for m, x in (("m", F.col(f"x{j}")), ("s", F.col(f"x{j}") * F.col(f"x{j}")))))
    made = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"m{j}").alias("mean"), _std(F.col(f"m{j}"), F.col(f"s{j}")).alias("std")) for j, n in enumerate(names)))
    found = means.filter("n > 0").select(F.inline(made))
    return found.select("feature", "mean", F.when(F.col("std") < LEAST_SCALE, 1.0).otherwise(F.col("std")).alias("scale"))


def _std(mean: Column, of_squares: Column) -> Column:
    return F.sqrt(F.greatest(of_squares - mean * mean, F.lit(0.0)))


def _moments(values: DataFrame, *keys: str) -> DataFrame:
    spread = _std(F.avg("x"), F.avg(F.col("x") * F.col("x")))
    return values.groupBy(*keys).agg(F.avg("x").alias("mean"), spread.alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def stats_row(scaler: DataFrame, bounds: DataFrame, names: Sequence[str]) -> DataFrame:
    """The statistics as one row of arrays, in feature order."""
    order = F.array_position(F.array(*map(F.lit, names)), F.col("feature"))
    every = scaler.join(bounds, "feature", "left").withColumn("j", order)
    rows = every.agg(F.sort_array(F.collect_list(F.struct("j", "lower", "upper", "mean", "scale"))).alias("r"))
    return rows.select("r.lower", "r.upper", "r.mean", "r.scale")


def feature_shift(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    """mean, std, min, max of every split and feature."""
    return _moments(steps_of(windows, names, "split"), "split", "feature")


def feature_shift_by_position(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    return _moments(steps_of(windows, names, "split"), "split", "feature", "position").select("split", "feature", "position", "mean", "std")


def drift_vs_train(stats: DataFrame) -> DataFrame:
    """Difference of the means of validation and test from train, by feature."""
    train = stats.filter("split = 'train'").select("feature", F.col("mean").alias("train_mean"))
    return stats.filter("split <> 'train'").join(F.broadcast(train), "feature").select("split", "feature", (F.col("mean") - F.col("train_mean")).alias("mean_delta"))


def feature_shift_report(windows: DataFrame, standardized: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raw and standardised mean deltas, and the delta of the positive rate, by split and feature."""
    rates = windows.groupBy("split").agg(F.avg(F.col("label").cast("double")).alias("rate"))
    base = rates.filter("split = 'train'").select(F.col("rate").alias("train_rate"))
    rates = rates.crossJoin(F.broadcast(base)).select("split", (F.col("rate") - F.col("train_rate")).alias("positive_rate_delta"))
    raw = drift_vs_train(feature_shift(windows, names)).withColumnRenamed("mean_delta", "raw_mean_delta")
    scaled = drift_vs_train(feature_shift(standardized, names)).withColumnRenamed("mean_delta", "preprocessed_mean_delta")
    return raw.join(scaled, ["split", "feature"]).join(F.broadcast(rates), "split")


def class_weights(train: DataFrame) -> DataFrame:
    """One row ``positives, negatives, pos_weight``: negatives / positives, 1 where a class is missing."""
    t = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positives"))
    t = t.withColumn("negatives", F.col("n") - F.col("positives"))
    weight = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("negatives") / F.col("positives")).otherwise(1.0)
    return t.select("positives", "negatives", weight.alias("pos_weight"))


def split_rows(windows: DataFrame, split: str) -> DataFrame:
    """One split, only what a trainer reads; an empty split has the same columns and no rows (a fit refuses it)."""
    return windows.filter(F.col("split") == split).select("window_id", "features", "label")


def shuffle_rows(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The same order for the same seed, however the rows are partitioned: by a digest of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key)


def shuffle_places(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``place``, a row's number in that order from 0 on.  Rows are numbered inside ranges of the digest, after
    the totals of the ranges before."""
    keyed = rows.withColumn("__d", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).withColumn("__b", F.substring("__d", 1, 3))
    totals = keyed.groupBy("__b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__d", key)) - 1
    placed = keyed.withColumn("__in", inside).join(F.broadcast(totals.select("__b", before.alias("__before"))), "__b")  # 4096 ranges
    return placed.withColumn("place", F.col("__before") + F.col("__in")).drop("__b", "__d", "__in", "__before")
