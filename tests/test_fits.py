"""The fitted models themselves."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import fit
from tidemark.operators import tensor as X

ROW = "window_id string, split string, label int, features array<double>"


def made(spark, n, separable, seed=1, width=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(width)]
        edge = x[0] + (0.5 * x[1] if width > 1 else 0)
        label = int(edge > 0) if separable else int(rng.random() < 1 / (1 + math.exp(-1.5 * edge)))
        rows.append((f"w{i}", "validation" if i % 3 == 0 else "train", label, x))
    df = fit.with_vector(spark.createDataFrame(rows, ROW), F.col("features")).persist()
    return df.filter("split = 'train'"), df.filter("split = 'validation'"), rows


def test_the_logistic_fit_is_at_its_optimum(spark):
    train, validation, rows = made(spark, 400, False)
    model, auc, reg = fit.logistic_fit(train, validation, regs=(0.01, 0.1), rounds=500, tolerance=1e-12)
    moments = fit.logistic_moments(model, train, reg).orderBy("j").collect()
    assert [m.j for m in moments] == [-1, 0, 1, 2]
    assert all(abs(m.of_labels - m.of_model) < 1e-6 for m in moments)
    x = np.array([r[3] for r in rows if r[1] == "train"])
    y = np.array([r[2] for r in rows if r[1] == "train"])
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    gradient = (w * (p - y)) @ x / w.sum() + reg * model.coefficients.toArray()
    assert np.abs(gradient).max() < 1e-6 and abs((w * (p - y)).sum() / w.sum()) < 1e-6
    assert auc > 0.75


def test_other_weights_are_seen(spark):
    train, validation, _ = made(spark, 200, False)
    model, _, reg = fit.logistic_fit(train, validation, regs=(0.05,), rounds=500, tolerance=1e-12)

    class Moved:
        coefficients = type(model.coefficients)(model.coefficients.toArray() + np.array([0.01, 0, 0]))
        intercept = model.intercept

    off = [abs(m.of_labels - m.of_model) for m in fit.logistic_moments(Moved, train, reg).collect()]
    assert max(off) > 1e-4


def test_probabilities_follow_from_the_weights(spark):
    train, validation, _ = made(spark, 200, False)
    model, _, _ = fit.logistic_fit(train, validation, regs=(0.05,))
    out = fit.score(model, validation).withColumn("again", fit.linear_probability(model, vector_to_array("vector")))
    assert out.filter("abs(probability - again) > 1e-12").count() == 0


def test_boosting_stops_when_nothing_is_gained(spark):
    train, validation, _ = made(spark, 300, True, width=1)
    model, history = fit.boosted_fit(train, validation, "window_id", depth=2, rounds=40, step=0.5, patience=2, rows_share=1.0, columns_share=1.0)
    aucs = [v for _, name, v in history if name == "validation_auc"]
    assert model.fitted == len(aucs) == model.best_round + 3 < 40  # two rounds without a gain after the best one
    assert len(model.stages) == model.best_round + 1 and aucs[model.best_round] == max(aucs) and aucs.index(max(aucs)) == model.best_round
    scored = model.score(validation)
    assert fit._auc(scored) == pytest.approx(max(aucs))


def test_boosting_lowers_the_loss_and_repeats(spark):
    train, validation, _ = made(spark, 300, False, seed=4)
    how = {"depth": 2, "rounds": 10, "step": 0.3, "patience": 10, "rows_share": 0.7, "columns_share": 0.67}
    model, history = fit.boosted_fit(train, validation, "window_id", **how)
    loss = [v for _, name, v in history if name == "train_logloss"]
    assert loss[-1] < loss[0] < math.log(2) + 0.05
    assert history == fit.boosted_fit(train, validation, "window_id", **how)[1]
    assert {len(s.features) for s in model.stages} == {2}
    # margins carried through written tables are those of the trees alone
    again = model.score(validation)
    assert again.filter("probability <= 0 or probability >= 1").count() == 0


def test_first_leaves_are_newton_steps(spark):
    rows = [(f"w{i}", "train", int(i % 4 == 0 or i >= 30), [float(i >= 30)]) for i in range(40)]
    train = fit.with_vector(spark.createDataFrame(rows, ROW), F.col("features"))
    state = fit.with_weight(train).withColumns({"label": F.col("label").cast("double"), "margin": F.lit(0.0)})
    stage = fit.fit_stage(state, (0,), 1, 256, 0.3, 1.0, 0.0, 0.0, 7)
    y = np.array([r[2] for r in rows])
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    high = np.arange(40) >= 30
    want = sorted(0.3 * (w * (y - 0.5))[m].sum() / ((w * 0.25)[m].sum() + 1) for m in (high, ~high))
    assert sorted(stage.values) == pytest.approx(want)
    got = fit.add_stage(state, stage).select("window_id", "margin").collect()
    assert {round(r.margin, 9) for r in got} == {round(v, 9) for v in want}


def test_fits_refuse_missing_splits_and_classes(spark):
    train, validation, _ = made(spark, 60, True)
    for fitted in (lambda t, v: fit.logistic_fit(t, v), lambda t, v: fit.boosted_fit(t, v, "window_id")):
        with pytest.raises(ValueError, match="validation"):
            fitted(train, validation.limit(0))
        with pytest.raises(ValueError, match="negative"):
            fitted(train.filter("label = 1"), validation)
        with pytest.raises(ValueError, match="positive"):
            fitted(train.filter("label = 0"), validation)


def test_an_empty_split_is_typed(spark):
    w = spark.createDataFrame([("a", "train", 1, [[1.0]])], "window_id string, split string, label int, features array<array<double>>")
    empty = X.split_rows(w, "validation")
    assert empty.count() == 0 and empty.columns == ["window_id", "features", "label"]


@pytest.mark.parametrize("bounded", [False, True])
def test_scaler_makes_no_row_for_each_value(spark, bounded):
    names = ("price_yes", "side", "usd_amount")
    rng = random.Random(3)
    tensors = [[[rng.random(), 1.0, rng.uniform(-1, 50)] for _ in range(4)] for _ in range(30)]
    w = spark.createDataFrame([(f"w{i}", t) for i, t in enumerate(tensors)], "window_id string, features array<array<double>>")
    bounds = spark.createDataFrame([("usd_amount", 0.5, 2.0)], "feature string, lower double, upper double") if bounded else None
    out = X.scaler_fit(w, names, bounds)
    x = np.array(tensors).reshape(-1, 3)
    x[:, 2] = np.log1p(np.maximum(x[:, 2], 0))
    if bounded:
        x[:, 2] = np.clip(x[:, 2], 0.5, 2.0)
    scale = x.std(axis=0)
    scale[1] = 1.0
    got = {r.feature: (r.mean, r.scale) for r in out.collect()}
    assert got == {n: (pytest.approx(x[:, j].mean()), pytest.approx(scale[j])) for j, n in enumerate(names)}
    assert X.scaler_fit(w.filter("false"), names, bounds).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan.split("Aggregate")[-1]  # values are columns below the aggregate


def test_windows_are_standardised_in_one_pass(spark):
    names = ("price_yes", "side", "usd_amount")
    w = spark.createDataFrame([("a", [[0.5, 1.0, math.e - 1], [0.1, -1.0, -4.0]])], "window_id string, features array<array<double>>")
    stats = spark.createDataFrame([([None, None, 0.25], [None, None, 0.75], [0.3, 9.0, 0.5], [0.2, 9.0, 0.5])], "lower array<double>, upper array<double>, mean array<double>, scale array<double>")
    out = X.standardize_windows(w, stats, names)
    assert out.first().features == [pytest.approx([1.0, 1.0, 0.5]), pytest.approx([-1.0, -1.0, -0.5])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
