"""Reports over model runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields of run files and columns of the report (fixed values).
_CONFIG = "struct<seed: bigint, pooling: string, include_summary_features: boolean>"
_SUMMARY = (
    "model_name string, created_at_utc string, dataset_dir string, window_size bigint, feature_width bigint, feature_count bigint, feature_order array<string>, "
    f"model_config {_CONFIG}, training_config {_CONFIG}, hyperparameters {_CONFIG}, "
    "provenance struct<dataset_manifest_path: string, config_path: string, config_hash: string, git_sha: string, git_dirty: boolean>"
)
_SCORES = "struct<auc_roc: double, pr_auc: double, brier_score: double>"
_METRICS = f"best_epoch bigint, best_iteration bigint, best_iteration_1based bigint, validation {_SCORES}, test {_SCORES}"
_AT = "struct<threshold: double, accuracy: double, precision: double, recall: double, f1: double>"
_DIAGNOSTICS = (
    f"validation_threshold_sweep struct<best_by_metric: struct<accuracy: {_AT}, f1: {_AT}>>, "
    f"split_metrics_at_validation_best_thresholds struct<validation: struct<validation_best_accuracy: {_AT}, validation_best_f1: {_AT}>, test: struct<validation_best_accuracy: {_AT}, validation_best_f1: {_AT}>>"
)


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Files of that name in every run folder below ``root``; a folder ``name=<name>`` with part files will do too."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    at = f"^(.*)/(name=)?{name.replace('.', '[.]')}(/part-[^/]*)?$"
    return rows.withColumn("run_dir", F.regexp_extract(place, at, 1)).filter("run_dir <> ''")


def scan_run_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``summary.json`` of every run folder that also has ``metrics.json``, and ``diagnostics.json`` if there.

    A run without diagnostics has nulls there."""
    s = _read(spark, root, "summary.json", _SUMMARY)
    m = _read(spark, root, "metrics.json", _METRICS).withColumnsRenamed({"validation": "m_validation", "test": "m_test"})
    d = _read(spark, root, "diagnostics.json", _DIAGNOSTICS)
    return s.join(m, "run_dir").join(d, "run_dir", "left")


def model_leaderboard(artifacts: DataFrame) -> DataFrame:
    """The report over all runs; order it with ``leaderboard_order``."""
    config = lambda f: F.coalesce(*(F.when(F.col(c).isNotNull(), F.col(f"{c}.{f}")) for c in ("model_config", "training_config", "hyperparameters")))
    selectors = ("best_epoch", "best_iteration", "best_iteration_1based")
    best, at = "validation_threshold_sweep.best_by_metric", "split_metrics_at_validation_best_thresholds"
    return artifacts.select(
        "model_name", "created_at_utc", "run_dir", "window_size",
        F.coalesce("feature_width", F.when(F.col("feature_order").isNotNull(), F.size("feature_order"))).alias("feature_width"), "feature_count",
        config("seed").alias("seed"), config("pooling").alias("pooling"), config("include_summary_features").alias("include_summary_features"),
        F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in selectors)).alias("selector_name"), F.coalesce(*selectors).alias("selector_value"),
        *(F.col(f"m_{s}.{k}").alias(f"{s}_{k}") for s in ("validation", "test") for k in ("auc_roc", "pr_auc", "brier_score")),
        F.col(f"{best}.accuracy.threshold").alias("validation_best_accuracy_threshold"),
        F.col(f"{at}.validation.validation_best_accuracy.accuracy").alias("validation_best_accuracy"),
        F.col(f"{best}.f1.threshold").alias("validation_best_f1_threshold"),
        F.col(f"{at}.validation.validation_best_f1.f1").alias("validation_best_f1"),
        *(F.col(f"{at}.test.validation_best_accuracy.{k}").alias(f"test_{k}_at_validation_best_accuracy") for k in ("accuracy", "precision", "recall")),
        F.col(f"{at}.test.validation_best_f1.f1").alias("test_f1_at_validation_best_f1"),
        "dataset_dir", *(F.col(f"provenance.{k}").alias(k) for k in ("dataset_manifest_path", "config_path", "config_hash", "git_sha", "git_dirty")),
    )


def _best_first() -> list:
    return [
        F.col("validation_pr_auc").desc_nulls_last(), F.col("validation_auc_roc").desc_nulls_last(), (-F.col("validation_brier_score")).desc_nulls_last(),
        F.coalesce("created_at_utc", F.lit("")).desc(), F.col("run_dir").desc(),
    ]


def leaderboard_order(report: DataFrame) -> DataFrame:
    """By validation PR-AUC, AUC, smallest Brier and creation time, missing ones last."""
    return report.orderBy(*_best_first())


def leaderboard_places(report: DataFrame) -> DataFrame:
    """Adds ``place``, from 1 on, in that order.  A report has one row for each run, so one task orders them all."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(*_best_first())))


def top_runs_per_model(report: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("model_name").orderBy(*_best_first())
    return report.withColumn("run_rank", F.row_number().over(w)).filter(F.col("run_rank") <= n)


def systematic_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at evenly spaced places of an ordered table: index floor(i * total / n).

    Places come from counts by a coarse key first (the caller's order column must be numeric or a
    time), so that no task holds all rows.
    """
    counted = rows.groupBy(F.col(order).alias("__v")).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n").alias("__total"))
    bounds = counted.agg(F.min(F.col("__v").cast("double")).alias("lo"), F.max(F.col("__v").cast("double")).alias("hi"))
    coarse = counted.crossJoin(F.broadcast(bounds)).withColumn("__b", F.coalesce(F.floor(F.try_divide((F.col("__v").cast("double") - F.col("lo")) * 4096, F.col("hi") - F.col("lo"))), F.lit(0)))
    sums = coarse.groupBy("__b").agg(F.sum("__n").alias("bn"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bn").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = coarse.withColumn("inside", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(sums), "__b")
    placed = placed.select("__v", (F.col("before") + F.col("inside")).alias("__first")).crossJoin(F.broadcast(total))
    keyed = rows.join(placed, rows[order] == placed["__v"])
    tie = Window.partitionBy("__v").orderBy(*(c for c in rows.columns))
    keyed = keyed.withColumn("sample_index", F.col("__first") + F.row_number().over(tie) - 1)
    k = F.ceil(F.col("sample_index") * n / F.col("__total"))
    chosen = (F.floor(k * F.col("__total") / n) == F.col("sample_index")) & (k < n)
    return keyed.filter(chosen | (F.col("__total") <= n)).select(*rows.columns, "sample_index")


def dedupe_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every id."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
