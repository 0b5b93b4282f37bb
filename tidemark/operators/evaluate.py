"""Evaluation of scored rows (``key, label, probability`` and perhaps ``split``) as table jobs.

Ranks and running counts need one order of all scores.  Scores are counted first, put into ranges
by a hash-free bucket of the score, and each range adds the totals of the ranges before it; only
those totals, one row for each bucket, meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .percentile import exact_percentiles
from .scan import SegmentedScan, range_edges, range_of

BUCKETS = 1024
GRID = [0.05 + i * (0.95 - 0.05) / 18 for i in range(19)]
METRICS = ("accuracy", "precision", "recall", "f1")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, accuracy, f1 and predicted rate from tp, tn, fp, fn; 0 on zero denominators."""
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "predicted_positive_rate": _ratio(tp + fp, tp + tn + fp + fn)})
    return out.withColumn("f1", _ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _counts(predicted: Column) -> list[Column]:
    positive = F.col("label") == 1
    return [
        F.count_if(predicted & positive).alias("true_positive"), F.count_if(~predicted & ~positive).alias("true_negative"),
        F.count_if(predicted & ~positive).alias("false_positive"), F.count_if(~predicted & positive).alias("false_negative"),
    ]


def confusion_metrics(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(scores.groupBy(*by).agg(*_counts(F.col("probability") >= threshold)))


def _by_score(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct scores with counts, and the rows and positives that score lower."""
    counts = scores.groupBy(*by, "probability").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    counts = counts.withColumn("bucket", F.floor(F.col("probability") * BUCKETS))
    totals = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bpos"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"n_before": F.coalesce(F.sum("bn").over(before), F.lit(0)), "pos_before": F.coalesce(F.sum("bpos").over(before), F.lit(0))})
    within = Window.partitionBy(*by, "bucket").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"n_in": F.coalesce(F.sum("n").over(within), F.lit(0)), "pos_in": F.coalesce(F.sum("pos").over(within), F.lit(0))})
    joined = counts.join(F.broadcast(totals.drop("bn", "bpos")) if not by else totals.drop("bn", "bpos"), [*by, "bucket"])
    return joined.select(*by, "probability", "n", "pos", (F.col("n_before") + F.col("n_in")).alias("n_lower"), (F.col("pos_before") + F.col("pos_in")).alias("pos_lower"))


def average_rank(scores: DataFrame, key: str) -> DataFrame:
    """The rank by score, ties averaged."""
    ranks = _by_score(scores, []).select("probability", (F.col("n_lower") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
    return scores.select(key, "probability").join(ranks, "probability").select(key, "avg_rank")


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum AUC with averaged ties; 0.5 where a class is missing."""
    t = _by_score(scores, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * (F.col("n_lower") + (F.col("n") + 1) / 2.0)).alias("ranks")
    )
    p, q = F.col("p"), F.col("n") - F.col("p")
    return t.select(*by, F.when((p == 0) | (q == 0), 0.5).otherwise((F.col("ranks") - p * (p + 1) / 2.0) / (p * q)).alias("auc_roc"))


def cumulative_tp_fp(scores: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Running true and false positives by descending score, then key, as one order of all rows."""
    groups = _by_score(scores, by)
    whole = groups.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    # rows that score higher = all - lower - equal
    placed = groups.join(whole, list(by)) if by else groups.crossJoin(F.broadcast(whole))
    placed = placed.select(*by, "probability", (F.col("all_n") - F.col("n_lower") - F.col("n")).alias("n_higher"), (F.col("all_pos") - F.col("pos_lower") - F.col("pos")).alias("pos_higher"), "all_pos")
    rows = scores.select(*by, key, "label", "probability")
    # a score that many rows share is cut into ranges of the key
    scan = SegmentedScan(rows, [*by, "probability"], range_of(key, range_edges(rows, key)), [key])
    rows = scan.number("k").total("tp_in", F.col("label").cast("long")).rows()
    rows = rows.join(placed, [*by, "probability"])
    tp = F.col("pos_higher") + F.col("tp_in")
    return rows.select(*by, key, "label", tp.alias("tp"), (F.col("n_higher") + F.col("k") - tp).alias("fp"), "all_pos")


def average_precision(scores: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall gain by descending score (ties by key); 0 without positives."""
    steps = cumulative_tp_fp(scores, key, by)
    gain = F.when(F.col("label") == 1, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return steps.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(gain), F.max("all_pos")), F.lit(0.0)).alias("pr_auc"))


def brier(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    d = F.col("probability") - F.col("label")
    return scores.groupBy(*by).agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier_score"))


def log_loss_mean(scores: DataFrame, by: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest("probability", F.lit(eps)), F.lit(1 - eps))
    return scores.groupBy(*by).agg(F.avg(-(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))).alias("log_loss"))


def threshold_grid(spark, references: dict[str, float]) -> DataFrame:
    values = sorted({min(1.0, max(0.0, t)) for t in [*GRID, *references.values()]})
    return spark.createDataFrame([(t,) for t in values], "threshold double")


def at_thresholds(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and metrics of every group at every threshold (a table of some twenty rows).

    Scores are counted before they meet the thresholds, so the product is of distinct scores.
    """
    counts = scores.groupBy(*by, "probability").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    both = counts.crossJoin(F.broadcast(thresholds))
    hit = F.col("probability") >= F.col("threshold")
    total = lambda c, on: F.coalesce(F.sum(F.when(on, c)), F.lit(0))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    names = [c for c in thresholds.columns if c != "threshold"]
    return with_metrics(both.groupBy(*by, *names, "threshold").agg(
        total(pos, hit).alias("true_positive"), total(neg, ~hit).alias("true_negative"), total(neg, hit).alias("false_positive"), total(pos, ~hit).alias("false_negative"),
    ))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """``metric, threshold, value``: the best of each metric; ties to the nearest 0.5, then the lowest."""
    long = sweep.select("threshold", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.abs(F.col("threshold") - 0.5), F.col("threshold"))
    return long.withColumn("k", F.row_number().over(w)).filter("k = 1").select("metric", "threshold", "value")


def metrics_at_best(scores: DataFrame, best: DataFrame) -> DataFrame:
    """Thresholds that are best on validation, applied to every split."""
    return at_thresholds(scores, best.select("metric", "threshold"), ["split"])


def calibration_bins(scores: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins that hold rows; the last one is closed.  A bin is the number of inner edges at or below."""
    step = 1.0 / bins
    edges = [i * step for i in range(bins + 1)]
    index = sum((F.when(F.col("probability") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    out = scores.withColumn("bin_index", index).groupBy(*by, "bin_index").agg(
        F.count("*").alias("row_count"), F.avg("probability").alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("positive_rate")
    )
    edge = F.array(*map(F.lit, edges))
    return out.withColumns({"lower": F.get(edge, F.col("bin_index")), "upper": F.get(edge, F.col("bin_index") + 1)})


def array_summary(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, percentiles, max, mean and population std; zeros when empty."""
    names = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    mean = F.sum(F.col("x") * F.col("n")) / F.sum("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("x") * F.col("n")) / F.sum("n") - mean * mean))
    out = counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), mean.alias("mean"), spread.alias("std"))
    q = exact_percentiles(counts, by, "x", names, "n")
    out = out.join(q, list(by), "left") if by else out.crossJoin(q)  # one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(*by, "count", *map(zero, ("min", "max", "mean", "std", *names)))


def split_diagnostics(scores: DataFrame, key: str, references: dict[str, float]) -> DataFrame:
    """By split: summaries of probability and logit, PR-AUC, Brier, and F1 at the reference thresholds."""
    from ..functions.scalars import logit

    scores = scores.withColumn("logit", logit(F.col("probability")))
    pick = ("mean", "std", "p50")
    out = average_precision(scores, key, ["split"]).join(brier(scores, ["split"]), "split")
    for column in ("probability", "logit"):
        s = array_summary(scores, column, ["split"])
        out = out.join(s.select("split", *(F.col(c).alias(f"{column}_{c}") for c in pick)), "split")
    for name, t in references.items():
        out = out.join(confusion_metrics(scores, t, ["split"]).select("split", F.col("f1").alias(f"f1_at_{name}")), "split")
    return out


def predictions(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
