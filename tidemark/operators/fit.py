"""Classifiers on windows, fitted by Spark ML: logistic regression, and trees boosted in stages."""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Written
from .evaluate import average_precision, log_loss_mean, roc_auc
from .tensor import class_weights

#: Rounds of boosting after which the running margins are written, so that plans don't grow with the rounds.
CUT_EVERY = 8


def with_vector(rows: DataFrame, vector: Column) -> DataFrame:
    return rows.withColumn("vector", array_to_vector(vector))


def with_weight(train: DataFrame) -> DataFrame:
    """Positives weigh negatives / positives."""
    weights = class_weights(train).select("pos_weight")
    return train.crossJoin(F.broadcast(weights)).withColumn("weight", F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(1.0)).drop("pos_weight")


def both_classes(train: DataFrame, validation: DataFrame) -> None:
    """Raises where a fit would be judged by nothing: without a class in ``train``, or without rows in ``validation``."""
    found = class_weights(train).first()
    for name, n in (("positive", found.positives), ("negative", found.negatives)):
        if not n:
            raise ValueError(f"the train split has no {name} labels")
    if validation.isEmpty():
        raise ValueError("the validation split has no rows")


def score(model, rows: DataFrame) -> DataFrame:
    """``probability`` of the positive class and ``logit``."""
    out = model.transform(rows)
    p = vector_to_array("probability")[1]
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return out.select(*rows.columns, p.alias("probability"), F.ln(clipped / (1 - clipped)).alias("logit"))


def _auc(scores: DataFrame) -> float:
    return float(roc_auc(scores.select("label", "probability")).first()[0])


# ---- logistic regression


def logistic_fit(train: DataFrame, validation: DataFrame, regs: Iterable[float] = (0.0, 0.01, 0.1), rounds: int = 50, tolerance: float = 1e-6) -> tuple[LogisticRegressionModel, float, float]:
    """Class-weighted logistic regression with L2; the regularisation is chosen by validation AUC, the first of the best.
    Rows need ``vector`` (standardised) and ``label``.  Returns model, AUC and regularisation."""
    both_classes(train, validation)
    train = with_weight(train).withColumn("label", F.col("label").cast("double"))
    best = None
    for reg in regs:
        model = LogisticRegression(featuresCol="vector", weightCol="weight", regParam=reg, maxIter=rounds, tol=tolerance, standardization=False).fit(train)
        auc = _auc(score(model, validation))
        if best is None or auc > best[1]:
            best = (model, auc, reg)
    return best


def linear_probability(model: LogisticRegressionModel, vector: Column) -> Column:
    """The probability from the weights alone, for an array<double>."""
    weights = F.array(*(F.lit(float(x)) for x in model.coefficients.toArray()))
    dot = F.aggregate(F.zip_with(vector, weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-dot))


def logistic_moments(model: LogisticRegressionModel, train: DataFrame, reg: float) -> DataFrame:
    """``j, of_labels, of_model``: weighted means of label times feature, and of probability times feature plus the pull of
    the regularisation; j = -1 is the intercept, whose feature is 1.

    The two are equal for every j just where the weighted loss plus L2 has its least value; their difference is the gradient."""
    rows = with_weight(train).withColumn("x", vector_to_array("vector"))
    rows = rows.select("label", "weight", "x", linear_probability(model, F.col("x")).alias("p"))
    rows = rows.select("label", "weight", "p", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"))).alias("j", "v"))
    means = rows.groupBy((F.col("j") - 1).alias("j")).agg(*((F.sum(F.col("weight") * F.col(c) * F.col("v")) / F.sum("weight")).alias(n) for c, n in (("label", "of_labels"), ("p", "of_model"))))
    pull = F.array(F.lit(0.0), *(F.lit(reg * float(x)) for x in model.coefficients.toArray()))
    return means.withColumn("of_model", F.col("of_model") + F.get(pull, F.col("j") + 1))


# ---- boosting


@dataclass(frozen=True)
class Stage:
    """One tree: the features it sees, its leaves, and what each leaf adds to the margin."""

    features: tuple[int, ...]
    tree: DecisionTreeRegressionModel
    values: tuple[float, ...]


@dataclass(frozen=True)
class Boosted:
    """Trees up to the best round.  ``fitted``: how many were fitted before the fit stopped."""

    stages: tuple[Stage, ...]
    fitted: int
    best_round: int

    def margins(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("margin", F.lit(0.0))
        for stage in self.stages:
            out = add_stage(out, stage)
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """``probability`` and ``logit``."""
        p = 1 / (1 + F.exp(-F.col("margin")))
        return self.margins(rows).select(*rows.columns, p.alias("probability"), F.col("margin").alias("logit"))


def _sliced(rows: DataFrame, features: tuple[int, ...]) -> DataFrame:
    return VectorSlicer(inputCol="vector", outputCol="__seen", indices=list(features)).transform(rows)


def add_stage(rows: DataFrame, stage: Stage) -> DataFrame:
    """Rows with the stage's leaf value added to ``margin``."""
    values = F.array(*map(F.lit, stage.values))
    out = stage.tree.transform(_sliced(rows, stage.features))
    return out.withColumn("margin", F.col("margin") + F.get(values, F.col("__leaf").cast("int"))).select(*rows.columns)


def _gradients(rows: DataFrame) -> DataFrame:
    """First and second derivatives of the weighted loss in the margin, with their signs turned."""
    p = F.least(F.greatest(1 / (1 + F.exp(-F.col("margin"))), F.lit(1e-9)), F.lit(1 - 1e-9))
    out = rows.withColumns({"__g": F.col("weight") * (F.col("label") - p), "__h": F.col("weight") * p * (1 - p)})
    return out.withColumn("__step", F.col("__g") / F.col("__h"))


def fit_stage(rows: DataFrame, features: tuple[int, ...], depth: int, bins: int, step: float, l2: float, l1: float, least_gain: float, seed: int) -> Stage:
    """A tree on the Newton steps of ``rows``, weighted by the second derivatives, so that its splits are those of the largest
    gain G**2 / H; a leaf adds ``step`` * soft(G, l1) / (H + l2).  Leaves are summed by one aggregation of at most 2**depth rows."""
    seen = _sliced(_gradients(rows), features)
    tree = DecisionTreeRegressor(
        featuresCol="__seen", labelCol="__step", weightCol="__h", predictionCol="__tree", leafCol="__leaf", maxDepth=depth, maxBins=bins, minInfoGain=least_gain, seed=seed, cacheNodeIds=False
    ).fit(seen)
    sums = {int(r[0]): (r.g, r.h) for r in tree.transform(seen).groupBy("__leaf").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h")).collect()}
    values = [0.0] * (max(sums, default=0) + 1)
    for leaf, (g, h) in sums.items():
        soft = max(0.0, abs(g) - l1) * (1 if g > 0 else -1)
        values[leaf] = step * soft / (h + l2)
    return Stage(features, tree, tuple(values))


def evaluated(scores: DataFrame, key: str) -> dict[str, float]:
    """AUC, PR-AUC and log loss of every split, in one job: ``train_auc`` and so on; rounded, so that sums of another order give the
    same value."""
    parts = roc_auc(scores, ["split"]).join(average_precision(scores, key, ["split"]), "split").join(log_loss_mean(scores, ["split"]), "split")
    return {f"{r.split}_{n}": round(float(v), 12) for r in parts.collect() for n, v in (("auc", r.auc_roc), ("aucpr", r.pr_auc), ("logloss", r.log_loss))}


def boosted_fit(
    train: DataFrame, validation: DataFrame, key: str, depth: int = 8, rounds: int = 400, step: float = 0.05, patience: int = 30, bins: int = 256,
    rows_share: float = 0.8, columns_share: float = 0.8, l2: float = 1.0, l1: float = 0.0, least_gain: float = 0.0, seed: int = 7,
) -> tuple[Boosted, list[tuple[int, str, float]]]:
    """Boosted trees with class weights, one tree a round.

    After every round both splits are judged; the fit ends when the validation AUC has not grown for ``patience`` rounds, and
    no further tree is fitted.  The model keeps the trees up to the best round.  ``vector, label`` and a unique ``key`` are
    needed.  Rows of a round are drawn by a hash of key and round, and features by the round's seed, so a lost executor
    draws the same again.  Margins are carried from round to round and written every few rounds.

    Returns the model and the history: (round, split_metric, value).
    """
    both_classes(train, validation)
    keep = [key, "vector", "label", "weight"]
    rows = with_weight(train).select(*keep, F.lit("train").alias("split")).union(validation.withColumn("weight", F.lit(1.0)).select(*keep, F.lit("validation").alias("split")))
    state = Written(rows.withColumns({"label": F.col("label").cast("double"), "margin": F.lit(0.0)}), "boosting")
    current = state.rows
    width = current.select(F.size(vector_to_array("vector"))).first()[0]
    history: list[tuple[int, str, float]] = []
    stages: list[Stage] = []
    best, best_round = -1.0, 0
    for i in range(rounds):
        rng = random.Random(seed * 1_000_003 + i)
        features = tuple(sorted(rng.sample(range(width), max(1, round(width * columns_share)))))
        drawn = current.filter("split = 'train'")
        if rows_share < 1:
            drawn = drawn.filter(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(1 << 20)) < int(rows_share * (1 << 20)))
        stages.append(fit_stage(drawn, features, depth, bins, step, l2, l1, least_gain, seed + i))
        current = add_stage(current, stages[-1])
        if (i + 1) % CUT_EVERY == 0:
            before, state = state, Written(current, "boosting")
            before.drop()
            current = state.rows
        found = evaluated(current.withColumn("probability", 1 / (1 + F.exp(-F.col("margin")))), key)
        history += [(i, name, value) for name, value in sorted(found.items())]
        if found["validation_auc"] > best:
            best, best_round = found["validation_auc"], i
        elif i - best_round >= patience:
            break
    state.drop()
    return Boosted(tuple(stages[: best_round + 1]), len(stages), best_round), history


def run_history(history: DataFrame) -> DataFrame:
    """``iteration, dataset_metric, value`` in wide form, a row for each round."""
    return history.groupBy("iteration").pivot("dataset_metric").agg(F.first("value"))
