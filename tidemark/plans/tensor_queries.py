"""Queries over window tensors, scaling, drift, fits and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import fit
from ..operators import tensor as X
from ..params import FEATURES
from ..params import QUERY_PARAMS as P
from ..params import SPLIT_PARAMS
from ..sources.scratch import Written
from . import base as B
from .base import SCORES, SPLIT_WINDOWS, WINDOWS, r, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def keep(f):
        for name in names or (f.__name__,):
            QUERIES[name] = f
            if sql:
                ORACLES[name] = sql
        return f

    return keep


N = P.features
W = len(N)


def _train(spark, sf) -> DataFrame:
    return B.model_windows(spark, sf).filter("split = 'train'")


_TRAIN = WINDOWS + ", tr AS (SELECT * FROM mw WHERE split = 'train')"
_LOGS = ", ".join(f"'{f}'" for f in X.LOG1P)
_SIGNED = ", ".join(f"'{f}'" for f in X.SIGNED_LOG1P)
_CLIPPED = ", ".join(f"'{f}'" for f in X.CLIPPED)
_UNSCALED = ", ".join(f"'{f}'" for f in X.UNSCALED)
_NAMES = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"


def _long(source: str, length: int = 8) -> str:
    """All values of a windows table in long form: raw (x0) and transformed (x)."""
    return f"""st AS (SELECT window_id, split, label, p - 1 AS position, j, ({_NAMES})[j] AS feature, features[p][j] AS x0 FROM {source}, (SELECT unnest(range(1, {length + 1})) AS p), (SELECT unnest(range(1, {W + 1})) AS j)),
lg AS (SELECT *, CASE WHEN feature IN ({_LOGS}) THEN ln(1 + greatest(x0, 0)) WHEN feature IN ({_SIGNED}) THEN sign(x0) * ln(1 + abs(x0)) ELSE x0 END AS x FROM st)"""


@query(f"""WITH {WINDOWS} SELECT window_id, {B.listed_sql('flatten(features)')} AS vector FROM mw""")
def flatten_window(spark, sf):
    return B.model_windows(spark, sf).select("window_id", B.listed(X.flatten_window(F.col("features"))).alias("vector"))


@query(f"""WITH {WINDOWS}, {_long("mw")} SELECT feature || '__step_' || lpad(CAST(position AS VARCHAR), 2, '0') AS name, count(*) AS n, round(sum(x0), 5) AS total FROM st GROUP BY 1""")
def flatten_long(spark, sf):
    sums = X.flatten_long(B.model_windows(spark, sf), N).groupBy("step", "j").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(sums.select(X.step_name(N).alias("name"), "n", "total"), "total", digits=5)


_STATS = "[first(x0 ORDER BY position), last(x0 ORDER BY position), avg(x0), stddev_pop(x0), min(x0), max(x0), last(x0 ORDER BY position) - first(x0 ORDER BY position), avg(x0) FILTER (position >= 3)]"


_SUMMED = f"{WINDOWS}, {_long('mw')}, a AS (SELECT window_id, feature, j, {_STATS} AS v FROM st GROUP BY ALL), b AS (SELECT window_id, list(round(v[k] + {B.OFF_HALF}::DOUBLE, 6) + 0 ORDER BY k, j) AS vector FROM a, (SELECT unnest(range(1, 9)) AS k) GROUP BY 1)"


@query(f"WITH {_SUMMED} SELECT window_id, ([{', '.join(repr(n) for n in X.summary_names(FEATURES))}])[k] AS name, vector[k] AS value FROM b, (SELECT unnest(range(1, {8 * W + 1})) AS k)")
def window_summary_features(spark, sf):
    """One row for each window and summary."""
    w = B.model_windows(spark, sf).select("window_id", X.window_summary(F.col("features"), W).alias("v"))
    names = F.array(*map(F.lit, X.summary_names(N)))
    return w.select("window_id", F.posexplode("v").alias("j", "x")).select("window_id", F.get(names, F.col("j")).alias("name"), r(F.col("x") + B.OFF_HALF).alias("value"))


@query(f"WITH {_SUMMED} SELECT window_id, list_concat({B.listed_sql('flatten(features)', 6, B.OFF_HALF)}, vector) AS vector FROM mw JOIN b USING (window_id)")
def augmented_vector(spark, sf):
    return B.model_windows(spark, sf).select("window_id", B.listed(X.augmented_vector(F.col("features"), W), 6, B.OFF_HALF).alias("vector"))


@query(f"""WITH {WINDOWS}, {_long("mw")} SELECT window_id, list(round(x, 6) + 0 ORDER BY position, j) AS vector FROM lg GROUP BY 1""")
def transform_features(spark, sf):
    return B.model_windows(spark, sf).select("window_id", B.listed(F.flatten(X.transform_features(F.col("features"), N)), 6).alias("vector"))


_BOUNDS = f"bd AS (SELECT feature, quantile_cont(x, 0.005) AS lower, quantile_cont(x, 0.995) AS upper FROM lg WHERE feature IN ({_CLIPPED}) AND split = 'train' GROUP BY 1)"
_CLIP = "cl AS (SELECT lg.*, CASE WHEN lower IS NULL THEN x ELSE least(greatest(x, lower), upper) END AS y FROM lg LEFT JOIN bd USING (feature))"
_SCALER = "sc AS (SELECT feature, avg(y) AS mean, CASE WHEN sqrt(greatest(avg(y * y) - avg(y) * avg(y), 0)) < 1e-12 THEN 1 ELSE sqrt(greatest(avg(y * y) - avg(y) * avg(y), 0)) END AS scale FROM cl WHERE split = 'train' GROUP BY 1)"


@query(f"WITH {WINDOWS}, {_long('mw')}, {_BOUNDS} SELECT feature, round(lower, 6) + 0 AS lower, round(upper, 6) + 0 AS upper FROM bd")
def clip_bounds(spark, sf):
    return rounded(X.clip_bounds(B.written_windows(spark, sf).filter("split = 'train'"), N), "lower", "upper")


@query(f"WITH {WINDOWS}, {_long('mw')}, {_BOUNDS}, {_CLIP} SELECT window_id, list(round(y, 6) + 0 ORDER BY position, j) AS vector FROM cl GROUP BY 1")
def clip_features(spark, sf):
    windows = B.written_windows(spark, sf)
    bounds = X.clip_bounds(windows.filter("split = 'train'"), N)
    every = spark.createDataFrame([(n,) for n in N], "feature string").join(bounds, "feature", "left")
    row = X.stats_row(every.select("feature", F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale")), bounds, N)
    w = windows.crossJoin(F.broadcast(row.select("lower", "upper")))
    clipped = X.clip_features(X.transform_features(F.col("features"), N), N, F.col("lower"), F.col("upper"))
    return w.select("window_id", B.listed(F.flatten(clipped), 6).alias("vector"))


@query(f"WITH {WINDOWS}, {_long('mw')}, {_BOUNDS}, {_CLIP}, {_SCALER} SELECT feature, round(mean, 6) + 0 AS mean, round(scale, 5) AS scale FROM sc")
def scaler_fit(spark, sf):
    t = B.written_windows(spark, sf).filter("split = 'train'")
    return X.scaler_fit(t, N, X.clip_bounds(t, N)).select("feature", r("mean"), r("scale", 5))


def _standardized(spark, sf, windows: DataFrame | None = None) -> DataFrame:
    windows = B.written_windows(spark, sf) if windows is None else windows
    t = windows.filter("split = 'train'")
    bounds = Written(X.clip_bounds(t, N), "clip-bounds").rows
    return X.standardize_windows(windows, Written(X.stats_row(X.scaler_fit(t, N, bounds), bounds, N), "scaler").rows, N)


_SCALED = f"sd AS (SELECT cl.*, CASE WHEN feature IN ({_UNSCALED}) THEN y ELSE (y - mean) / scale END AS z FROM cl JOIN sc USING (feature))"
_ALL = f"{WINDOWS}, {_long('mw')}, {_BOUNDS}, {_CLIP}, {_SCALER}, {_SCALED}"


@query(f"WITH {_ALL} SELECT window_id, list(round(z, 5) + 0 ORDER BY position, j) AS vector FROM sd GROUP BY 1")
def standardize_windows(spark, sf):
    return _standardized(spark, sf).select("window_id", B.listed(F.flatten("features"), 5).alias("vector"))


@query(f"WITH {WINDOWS}, v AS (SELECT features[8] AS v FROM mw WHERE split = 'train'), s AS (SELECT avg(v[1]) AS m1, stddev_pop(v[1]) AS s1, avg(v[3]) AS m2, stddev_pop(v[3]) AS s2 FROM v) SELECT window_id, round((features[8][1] - m1) / s1, 5) + 0 AS a, round((features[8][3] - m2) / s2, 5) + 0 AS b FROM mw, s")
def standardize_vector(spark, sf):
    pair = F.array(F.element_at("features", -1)[0], F.element_at("features", -1)[2])
    w = Written(B.model_windows(spark, sf).select("window_id", "split", pair.alias("v")), "pairs").rows
    t = w.filter("split = 'train'")
    stats = t.agg(F.array(F.avg(F.col("v")[0]), F.avg(F.col("v")[1])).alias("mean"), F.array(F.stddev_pop(F.col("v")[0]), F.stddev_pop(F.col("v")[1])).alias("scale"))
    out = w.crossJoin(F.broadcast(stats)).withColumn("s", X.standardize_vector(F.col("v"), F.col("mean"), F.col("scale")))
    return out.select("window_id", r(F.col("s")[0], 5).alias("a"), r(F.col("s")[1], 5).alias("b"))


_MOM = "round(avg(x0), 7) + 0 AS mean, round(sqrt(greatest(avg(x0 * x0) - avg(x0) * avg(x0), 0)), 3) AS std"


@query(f"WITH {WINDOWS}, {_long('mw')} SELECT split, feature, {_MOM}, round(min(x0), 4) + 0 AS min, round(max(x0), 4) + 0 AS max FROM st GROUP BY ALL")
def feature_shift_stats(spark, sf):
    return X.feature_shift(B.model_windows(spark, sf), N).select("split", "feature", r("mean", 7), r("std", 3), r("min", 4), r("max", 4))


@query(f"WITH {WINDOWS}, {_long('mw')} SELECT split, feature, CAST(position AS INTEGER) AS position, {_MOM} FROM st GROUP BY ALL")
def feature_shift_by_position(spark, sf):
    return X.feature_shift_by_position(B.model_windows(spark, sf), N).select("split", "feature", "position", r("mean", 7), r("std", 3))


@query(f"WITH {WINDOWS}, {_long('mw')}, a AS (SELECT split, feature, avg(x0) AS m FROM st GROUP BY ALL) SELECT a.split, a.feature, round(a.m - t.m, 4) + 0 AS mean_delta FROM a JOIN a t ON t.feature = a.feature AND t.split = 'train' WHERE a.split <> 'train'")
def drift_vs_train_join(spark, sf):
    return rounded(X.drift_vs_train(Written(X.feature_shift(B.model_windows(spark, sf), N), "shift").rows), "mean_delta", digits=4)


@query(f"WITH {_ALL}, a AS (SELECT split, feature, avg(x0) AS m, avg(z) AS mz FROM sd GROUP BY ALL), l AS (SELECT split, avg(label) AS r FROM mw GROUP BY 1) SELECT a.split, a.feature, round(a.m - t.m, 4) + 0 AS raw_mean_delta, round(a.mz - t.mz, 4) + 0 AS preprocessed_mean_delta, round(l.r - lt.r, 6) + 0 AS positive_rate_delta FROM a JOIN a t ON t.feature = a.feature AND t.split = 'train' JOIN l ON l.split = a.split JOIN l lt ON lt.split = 'train' WHERE a.split <> 'train'")
def feature_shift_report(spark, sf):
    windows = B.written_windows(spark, sf)
    out = X.feature_shift_report(windows, _standardized(spark, sf, windows), N)
    return out.select("split", "feature", r("raw_mean_delta", 4), r("preprocessed_mean_delta", 4), r("positive_rate_delta"))


@query(f"WITH {_TRAIN}, t AS (SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives FROM tr) SELECT *, round(CAST(negatives AS DOUBLE) / positives, 6) AS pos_weight FROM t")
def train_class_weights(spark, sf):
    return rounded(X.class_weights(_train(spark, sf)), "pos_weight")


@query(f"WITH {SPLIT_WINDOWS} SELECT window_id, {B.listed_sql('flatten(features)')} AS vector, label FROM mw WHERE split = 'validation'")
def scan_split(spark, sf):
    rows = X.split_rows(B.model_windows(spark, sf, SPLIT_PARAMS), "validation")
    return rows.select("window_id", B.listed(F.flatten("features")).alias("vector"), "label")


@query(f"WITH {_TRAIN} SELECT window_id, row_number() OVER (ORDER BY md5('7:' || window_id), window_id) - 1 AS place FROM tr")
def shuffle_rows_seeded(spark, sf):
    """The shuffled order as every row's place in it."""
    train = Written(_train(spark, sf).select("window_id"), "train-ids").rows
    return X.shuffle_places(X.shuffle_rows(train, "window_id", 7), "window_id", 7).select("window_id", "place")


# ---- evaluation


@query(f"WITH {SCORES}, t AS (SELECT *, count(*) OVER (PARTITION BY probability) AS c, rank() OVER (ORDER BY probability) AS k FROM scores) SELECT key, k + (c - 1) / 2.0 AS avg_rank FROM t")
def average_rank(spark, sf):
    return E.average_rank(B.scores(spark, sf), "key")


_AUC = "(sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))"
_RANKED = f"{SCORES}, ranked AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY probability) + (count(*) OVER (PARTITION BY split, probability) - 1) / 2.0::DOUBLE AS rk FROM scores)"


@query(f"WITH {_RANKED} SELECT split, round({_AUC}, 9) AS auc_roc FROM ranked GROUP BY split")
def roc_auc(spark, sf):
    return rounded(E.roc_auc(B.scores(spark, sf), ["split"]), "auc_roc", digits=9)


_CUM = f"{SCORES}, cum AS (SELECT *, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp FROM scores WINDOW w AS (PARTITION BY split ORDER BY probability DESC, key ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_CUM} SELECT key, split, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum")
def cumulative_tp_fp(spark, sf):
    return E.cumulative_tp_fp(B.scores(spark, sf), "key", ["split"]).select("key", "split", "tp", "fp")


_AP = "round(sum(CASE WHEN label = 1 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END) / sum(label), 9)"


@query(f"WITH {_CUM} SELECT split, {_AP} AS pr_auc FROM cum GROUP BY 1")
def average_precision(spark, sf):
    return rounded(E.average_precision(B.scores(spark, sf), "key", ["split"]), "pr_auc", digits=9)


@query(f"WITH {SCORES} SELECT split, round(avg((probability - label) * (probability - label)), 9) AS brier_score FROM scores GROUP BY 1")
def brier(spark, sf):
    return rounded(E.brier(B.scores(spark, sf), ["split"]), "brier_score", digits=9)


@query(f"WITH {SCORES} SELECT split, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS log_loss FROM (SELECT *, least(greatest(probability, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM scores) GROUP BY 1")
def log_loss_mean(spark, sf):
    return rounded(E.log_loss_mean(B.scores(spark, sf), ["split"]), "log_loss", digits=9)


_COUNTS = "count(*) FILTER (probability >= {t} AND label = 1) AS true_positive, count(*) FILTER (probability < {t} AND label <> 1) AS true_negative, count(*) FILTER (probability >= {t} AND label <> 1) AS false_positive, count(*) FILTER (probability < {t} AND label = 1) AS false_negative"
_METRICS = "SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM (SELECT *, coalesce(CAST(true_positive AS DOUBLE) / nullif(true_positive + false_positive, 0), 0) AS precision, coalesce(CAST(true_positive AS DOUBLE) / nullif(true_positive + false_negative, 0), 0) AS recall, CAST(true_positive + true_negative AS DOUBLE) / (true_positive + true_negative + false_positive + false_negative) AS accuracy, CAST(true_positive + false_positive AS DOUBLE) / (true_positive + true_negative + false_positive + false_negative) AS predicted_positive_rate FROM {c})"
_NINE = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(accuracy, 9) AS accuracy, round(predicted_positive_rate, 9) AS predicted_positive_rate"
_RATES = ("precision", "recall", "accuracy", "predicted_positive_rate", "f1")


@query(f"WITH {SCORES}, c AS (SELECT split, {_COUNTS.format(t='0.5')} FROM scores GROUP BY 1), m AS ({_METRICS.format(c='c')}) SELECT * REPLACE ({_NINE}) FROM m")
def confusion_metrics(spark, sf):
    return rounded(E.confusion_metrics(B.scores(spark, sf), 0.5, ["split"]), *_RATES, digits=9)


_GRID = "[" + ", ".join(repr(t) for t in E.GRID) + "]::DOUBLE[]"
_SWEEP = f"{SCORES}, g AS (SELECT DISTINCT unnest(list_concat({_GRID}, [0.5::DOUBLE])) AS threshold), c AS (SELECT threshold, {_COUNTS.format(t='threshold')} FROM scores, g WHERE split = 'validation' GROUP BY 1), m AS ({_METRICS.format(c='c')})"
_BEST = "b AS (SELECT metric, threshold, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, abs(threshold - 0.5), threshold) AS k FROM (SELECT threshold, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, precision, recall, f1]) AS value FROM m)) WHERE k = 1)"


def _grid(spark) -> DataFrame:
    return E.threshold_grid(spark, {"default": 0.5})


def _sweep(spark, sf) -> DataFrame:
    sweep = E.at_thresholds(B.scores(spark, sf).filter("split = 'validation'"), _grid(spark))
    return sweep.withColumn("f1", r(F.col("f1"), 9))


@query(f"WITH {_SWEEP} SELECT * REPLACE ({_NINE}, round(threshold, 9) AS threshold) FROM m", "threshold_sweep", "cross_threshold")
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf), *_RATES, "threshold", digits=9)


@query(f"WITH {_SWEEP}, {_BEST} SELECT metric, round(threshold, 9) AS threshold, round(value, 9) AS value FROM b")
def best_thresholds(spark, sf):
    return rounded(E.best_thresholds(_sweep(spark, sf)), "threshold", "value", digits=9)


@query(f"WITH {_SWEEP}, {_BEST}, c2 AS (SELECT split, metric, threshold, {_COUNTS.format(t='threshold')} FROM scores, (SELECT metric, threshold FROM b) GROUP BY ALL), m2 AS ({_METRICS.format(c='c2')}) SELECT * REPLACE ({_NINE}, round(threshold, 9) AS threshold) FROM m2")
def metrics_at_thresholds(spark, sf):
    return rounded(E.metrics_at_best(B.scores(spark, sf), E.best_thresholds(_sweep(spark, sf))), *_RATES, "threshold", digits=9)


_EDGES = "[" + ", ".join(repr(i * 0.1) for i in range(11)) + "]::DOUBLE[]"


@query(f"WITH {SCORES}, q AS (SELECT *, len(list_filter(({_EDGES})[2:10], lambda e: probability >= e)) AS bin FROM scores) SELECT split, CAST(bin AS INTEGER) AS bin_index, count(*) AS row_count, round(avg(probability), 9) AS mean_probability, round(avg(label), 9) AS positive_rate, ({_EDGES})[bin + 1] AS lower, ({_EDGES})[bin + 2] AS upper FROM q GROUP BY split, bin")
def calibration_bins(spark, sf):
    return rounded(E.calibration_bins(B.scores(spark, sf), 10, ["split"]), "mean_probability", "positive_rate", digits=9)


_Q = ", ".join(f"round(quantile_cont(probability, {q}), 9) AS {n}" for n, q in {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}.items())


@query(f"WITH {SCORES} SELECT split, count(*) AS count, min(probability) AS min, max(probability) AS max, round(avg(probability), 9) AS mean, round(stddev_pop(probability), 9) AS std, {_Q} FROM scores GROUP BY 1")
def array_summary(spark, sf):
    out = E.array_summary(B.scores(spark, sf), "probability", ["split"])
    return rounded(out, "mean", "std", "p01", "p05", "p25", "p50", "p75", "p95", "p99", digits=9)


@query(f"WITH {_CUM}, x AS (SELECT split, {_AP} AS pr_auc FROM cum GROUP BY 1), lo AS (SELECT *, ln(p / (1 - p)) AS logit FROM (SELECT *, least(greatest(probability, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM scores)), y AS (SELECT split, round(avg((probability - label) * (probability - label)), 9) AS brier_score, round(avg(probability), 9) AS probability_mean, round(avg(logit), 7) AS logit_mean FROM lo GROUP BY 1) SELECT * FROM x JOIN y USING (split)")
def split_diagnostics(spark, sf):
    d = E.split_diagnostics(B.scores(spark, sf), "key", {"default": 0.5})
    return rounded(rounded(d, "pr_auc", "brier_score", "probability_mean", digits=9), "logit_mean", digits=7).select("split", "pr_auc", "brier_score", "probability_mean", "logit_mean")


@query(f"WITH {SCORES} SELECT key, label, probability, split, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores")
def predictions(spark, sf):
    return E.predictions(B.scores(spark, sf))


# ---- fits.  SQL can't fit a model, but it can tell the numbers that the best model, and no other, has


def _split_windows(spark, sf) -> DataFrame:
    """Windows with room for all three splits, written once for the rounds of a fit."""
    return B.written_windows(spark, sf, SPLIT_PARAMS)


def _fitted(spark, sf):
    """A logistic model at its optimum, and all rows with their vectors."""
    rows = Written(fit.with_vector(_standardized(spark, sf, _split_windows(spark, sf)), F.flatten("features")).select("window_id", "split", "label", "vector"), "fit-vectors").rows
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    return fit.logistic_fit(train, validation, regs=(0.01, 0.1), rounds=500, tolerance=1e-10), train, rows


def same(model: Column, data: Column, within: float = 1e-6) -> Column:
    """The data's number where the model's agrees with it, else the model's."""
    return F.when(F.abs(model - data) < within, data).otherwise(model)


_SPLIT = SPLIT_PARAMS.window
_WEIGHTED = "cw AS (SELECT CAST(count(*) - sum(label) AS DOUBLE) / sum(label) AS pw FROM mw WHERE split = 'train'), tr AS (SELECT window_id, label, CASE WHEN label = 1 THEN pw ELSE 1 END AS w FROM mw, cw WHERE split = 'train')"


@query(f"""WITH {SPLIT_WINDOWS}, {_long('mw', _SPLIT)}, {_BOUNDS}, {_CLIP}, {_SCALER}, {_SCALED}, {_WEIGHTED}
SELECT CAST(position * {W} + j - 1 AS INTEGER) AS j, round(sum(tr.w * tr.label * z) / sum(tr.w), 6) + 0 AS moment FROM sd JOIN tr USING (window_id) GROUP BY 1
UNION ALL SELECT -1, round(sum(w * label) / sum(w), 6) FROM tr""")
def logistic_fit(spark, sf):
    """By coefficient: the weighted mean of probability times feature, plus the pull of the regularisation.  At the optimum it is that of
    label times feature, which SQL knows; any other weights give other numbers."""
    (model, _, reg), train, _ = _fitted(spark, sf)
    found = fit.logistic_moments(model, train, reg)
    return found.select("j", r(same(F.col("of_model"), F.col("of_labels"))).alias("moment"))


@query(f"""WITH {SPLIT_WINDOWS}, {_WEIGHTED} SELECT split, count(*) AS n, count(*) AS agreeing, CAST(sum(mw.label) AS BIGINT) AS positives, round(sum(tr.w * tr.label) / sum(tr.w), 6) AS mean_probability
FROM mw LEFT JOIN tr USING (window_id) GROUP BY 1""")
def score_split(spark, sf):
    """By split: rows whose probability and logit are those that the weights alone give, and the weighted mean probability of
    the train split, which at the optimum is that of its labels."""
    (model, _, _), train, rows = _fitted(spark, sf)
    out = fit.score(model, rows.withColumn("label", F.col("label").cast("int"))).withColumn("x", vector_to_array("vector"))
    p = fit.linear_probability(model, F.col("x"))
    fair = (F.abs(p - F.col("probability")) < 1e-9) & (F.abs(1 / (1 + F.exp(-F.col("logit"))) - F.col("probability")) < 2e-6)
    weight = F.when(F.col("split") == "train", F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(1.0))
    out = out.crossJoin(F.broadcast(X.class_weights(train).select("pos_weight"))).withColumn("w", weight)  # one row
    mean, labels = (F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")) for c in ("probability", "label"))
    return out.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(fair).alias("agreeing"), F.sum("label").cast("long").alias("positives"), r(same(mean, labels)).alias("mean_probability")
    )


# stumps on values that are one of two: SQL can follow every round

_TWO_VALUED = [N.index("side"), N.index("role_is_maker")]
_ROUNDS, _STEP = 3, 0.3


def _stump_sql(i: int) -> str:
    """Round i: the stump of the largest gain, its leaves, and the margins after it."""
    before = f"(SELECT window_id, split, label, w, margin FROM m{i - 1})" if i else "(SELECT window_id, split, label, coalesce(w, 1) AS w, 0.0::DOUBLE AS margin FROM mw LEFT JOIN (SELECT window_id, w FROM tr) USING (window_id))"
    return f""",
g{i} AS (SELECT *, w * (label - 1 / (1 + exp(-margin))) AS g, w / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) AS h FROM {before}),
s{i} AS (SELECT f, sum(g) FILTER (NOT hi) AS gl, sum(h) FILTER (NOT hi) AS hl, sum(g) FILTER (hi) AS gr, sum(h) FILTER (hi) AS hr FROM g{i} JOIN two USING (window_id) WHERE split = 'train' GROUP BY 1),
b{i} AS (SELECT f, {_STEP} * gl / (hl + 1) AS low, {_STEP} * gr / (hr + 1) AS high FROM s{i} ORDER BY gl * gl / hl + gr * gr / hr DESC, f LIMIT 1),
m{i} AS (SELECT g{i}.* EXCLUDE (g, h) REPLACE (margin + CASE WHEN hi THEN high ELSE low END AS margin) FROM g{i} JOIN two USING (window_id) JOIN b{i} USING (f)),
c{i} AS (SELECT *, sum(label) OVER o AS tp, sum(1 - label) OVER o AS fp, rank() OVER (PARTITION BY split ORDER BY margin) + (count(*) OVER (PARTITION BY split, margin) - 1) / 2.0::DOUBLE AS rk
  FROM m{i} WHERE split <> 'test' WINDOW o AS (PARTITION BY split ORDER BY margin DESC, window_id ROWS UNBOUNDED PRECEDING)),
e{i} AS (SELECT {i} AS iteration, split, {_AUC} AS auc, sum(CASE WHEN label = 1 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END) / sum(label) AS aucpr,
  avg(-(label * ln(1 / (1 + exp(-margin))) + (1 - label) * ln(1 - 1 / (1 + exp(-margin))))) AS logloss FROM c{i} GROUP BY split)"""


_STUMPS = f"""{SPLIT_WINDOWS}, {_WEIGHTED},
two AS (SELECT window_id, CAST((p - 1) * 2 + k AS INTEGER) AS f, features[p][([{', '.join(str(j + 1) for j in _TWO_VALUED)}])[k + 1]] > 0 AS hi FROM mw, (SELECT unnest(range(1, {_SPLIT + 1})) AS p), (SELECT unnest([0, 1]) AS k))""" + "".join(map(_stump_sql, range(_ROUNDS)))


def _boosted(spark, sf):
    w = _split_windows(spark, sf)
    pair = F.flatten(F.transform("features", lambda step: F.array(*(step[j] for j in _TWO_VALUED))))
    rows = Written(fit.with_vector(w, pair).select("window_id", "split", "label", "vector"), "fit-stumps").rows
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    return fit.boosted_fit(train, validation, "window_id", depth=1, rounds=_ROUNDS, step=_STEP, patience=_ROUNDS, rows_share=1.0, columns_share=1.0)


@query(f"WITH {_STUMPS} " + " UNION ALL ".join(f"SELECT {i} AS iteration, f AS feature, round(low, 7) AS low, round(high, 7) AS high FROM b{i} WHERE {i} <= (SELECT arg_min(iteration, (-round(auc, 9), iteration)) FROM best)" for i in range(_ROUNDS)))
def boosted_fit(spark, sf):
    """The trees that the model keeps: by round the feature that a stump splits, and what it adds below and above."""
    model, _ = _boosted(spark, sf)
    rows = []
    for i, stage in enumerate(model.stages):
        feature = int(stage.tree.featureImportances.toArray().argmax())
        low, high = (stage.values[int(stage.tree.predictLeaf(Vectors.dense([x] * len(stage.features))))] for x in (-9.0, 9.0))
        rows.append((i, feature, low, high))
    return rounded(spark.createDataFrame(rows, "iteration int, feature int, low double, high double"), "low", "high", digits=7)


_HISTORY = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(_ROUNDS))
ORACLES["boosted_fit"] = ORACLES["boosted_fit"].replace(f"WITH {_STUMPS} ", f"WITH {_STUMPS}, best AS (SELECT iteration, auc FROM ({_HISTORY}) WHERE split = 'validation') ")


@query(f"""WITH {_STUMPS} SELECT iteration, round(max(auc) FILTER (split = 'train'), 7) AS train_auc, round(max(aucpr) FILTER (split = 'train'), 7) AS train_aucpr, round(max(logloss) FILTER (split = 'train'), 7) AS train_logloss,
 round(max(auc) FILTER (split = 'validation'), 7) AS validation_auc, round(max(aucpr) FILTER (split = 'validation'), 7) AS validation_aucpr, round(max(logloss) FILTER (split = 'validation'), 7) AS validation_logloss
FROM ({_HISTORY}) GROUP BY 1""")
def run_history(spark, sf):
    """AUC, PR-AUC and log loss of both splits after every round."""
    _, history = _boosted(spark, sf)
    wide = fit.run_history(spark.createDataFrame(history, "iteration int, dataset_metric string, value double"))
    return rounded(wide, *(c for c in wide.columns if c != "iteration"), digits=7)
