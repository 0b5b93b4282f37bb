from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lots, pairs
from tidemark.operators import evaluate as E
from tidemark.operators import tensor as X

DAY = datetime(2024, 1, 1)
TRADES = "market_id string, wallet string, side string, asset string, price double, size double, ts timestamp_ntz, seq long"


@pytest.mark.parametrize("seed", range(4))
def test_fifo_equals_a_simulation(spark, seed):
    rng = random.Random(seed)
    rows = [("m", rng.choice("xy"), rng.choice(["BUY", "SELL"]), rng.choice("pq"), rng.randint(1, 99) / 100, float(rng.randint(1, 9)), DAY + timedelta(minutes=rng.randint(0, 30)), i) for i in range(80)]
    got = {r.wallet: r.realized_bps for r in lots.realized_markout_by_wallet(spark.createDataFrame(rows, TRADES)).collect()}
    sums: dict[str, list[float]] = {}
    for wallet in "xy":
        for asset in "pq":
            open_lots: list[list[float]] = []
            for r in sorted((r for r in rows if r[1] == wallet and r[3] == asset), key=lambda r: (r[6], r[7])):
                if r[2] == "BUY":
                    open_lots.append([r[5], r[4]])
                    continue
                left = r[5]
                while left > 0 and open_lots:
                    n = min(left, open_lots[0][0])
                    open_lots[0][0] -= n
                    left -= n
                    s = sums.setdefault(wallet, [0.0, 0.0])
                    s[0] += n * open_lots[0][1]
                    s[1] += (r[4] / open_lots[0][1] - 1) * 10000 * n * open_lots[0][1]
                    if open_lots[0][0] <= 0:
                        open_lots.pop(0)
    assert got.keys() == sums.keys()
    for wallet, (notional, weighted) in sums.items():
        assert got[wallet] == pytest.approx(weighted / notional)


def test_pair_blocks_lose_no_pair(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        first = DAY + timedelta(minutes=rng.randint(0, 600))
        rows.append(("m", f"w{i:02}", first, first + timedelta(minutes=rng.randint(0, 90)) if rng.random() < 0.6 else None, rng.uniform(0.1, 50), rng.choice(["Yes", "No"]), DAY - timedelta(hours=rng.randint(0, 900)) if rng.random() < 0.7 else None))
    w = spark.createDataFrame(rows, "market_id string, wallet string, first_ts timestamp_ntz, first_sell_ts timestamp_ntz, total_usdc double, dominant_outcome string, first_seen timestamp_ntz")
    got = {(r.left_wallet, r.right_wallet): r.score for r in pairs.pair_scores(w).collect()}
    near = lambda a, b, most: 1 - min(1, abs((a - b).total_seconds()) / most) if a and b else 0
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            score = 100 * (0.3 * near(a[2], b[2], 900) + 0.2 * (a[5] == b[5]) + 0.18 * (1 - abs(a[4] - b[4]) / max(a[4], b[4], 1)) + 0.17 * near(a[6], b[6], 604800) + 0.15 * near(a[3], b[3], 1800))
            if score >= 35:
                want[(a[1], b[1])] = score
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def _wallet_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        first = DAY + timedelta(minutes=rng.randint(0, 900))
        left = first + timedelta(minutes=rng.randint(0, 300)) if rng.random() < 0.6 else None
        seen = DAY - timedelta(hours=rng.choice([0, 1, 100, 300, 301])) if rng.random() < 0.8 else None
        rows.append(("m", f"w{i:02}", first, left, rng.choice([0.0, 0.5, 7.25, 8.0, 30.0]), rng.choice(["Yes", "No", None]), seen))
    return rows


_WALLETS = "market_id string, wallet string, first_ts timestamp_ntz, first_sell_ts timestamp_ntz, total_usdc double, dominant_outcome string, first_seen timestamp_ntz"


@pytest.mark.parametrize("most", [3, 4096])
def test_full_cells_lose_no_pair_and_none_counts_twice(spark, monkeypatch, most):
    """Equal ages and sizes make full marks without an outcome; outcomes, exits and ages may be unknown."""
    monkeypatch.setattr(pairs, "MOST_IN_CELL", most)
    w = spark.createDataFrame(_wallet_rows(90, 3), _WALLETS)
    sides = w.toDF("m", *(f"l_{c}" for c in w.columns[1:])).join(w.toDF("m", *(f"r_{c}" for c in w.columns[1:])), "m").filter("l_wallet < r_wallet")
    every = sides.select(F.col("m").alias("market_id"), F.col("l_wallet").alias("left_wallet"), F.col("r_wallet").alias("right_wallet"))
    want = sorted((r.left_wallet, r.right_wallet, r.score) for r in pairs.pair_scores(w, every).collect())
    got = sorted((r.left_wallet, r.right_wallet, r.score) for r in pairs.pair_scores(w).collect())
    assert len(want) > 500 and got == want


def test_pairs_are_not_shuffled(spark):
    """Pairs are as many as the square of wallets: shuffled to be told apart and joined with their sides they filled the disk."""
    w = spark.createDataFrame(_wallet_rows(30, 4), _WALLETS)
    plan = pairs.with_reasons(pairs.pair_scores(w))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    before = plan[: plan.index("SortMergeJoin")]
    assert not any(step in before for step in ("Exchange", "Aggregate", "HashJoin"))


def test_auc_of_a_separable_set(spark):
    s = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.4), (3, 1, 0.6), (4, 1, 0.9)], "key long, label int, probability double")
    assert E.roc_auc(s).first()[0] == 1.0
    assert E.average_precision(s, "key").first()[0] == 1.0
    one = s.filter("label = 1")
    assert E.roc_auc(one).first()[0] == 0.5
    assert E.average_precision(s.filter("label = 0"), "key").first()[0] == 0.0


def test_average_precision_with_ties(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 5) / 5) for i in range(50)]
    got = E.average_precision(spark.createDataFrame(rows, "key long, label int, probability double"), "key").first()[0]
    tp = fp = 0
    total = 0.0
    for _, label, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        tp, fp = tp + label, fp + 1 - label
        total += label * tp / (tp + fp)
    assert got == pytest.approx(total / tp)


def test_window_summary(spark):
    w = spark.createDataFrame([([[1.0, 10.0], [3.0, 14.0], [5.0, 18.0]],)], "features array<array<double>>")
    v = w.select(X.window_summary(F.col("features"), 2).alias("v")).first().v
    assert v[:4] == [1, 10, 5, 18] and len(v) == 16
    assert v[4:8] == pytest.approx([3, 14, 1.6329932, 3.2659863])


def test_scaler(spark):
    w = spark.createDataFrame([("a", [[1.0, 10.0], [3.0, 14.0]]), ("b", [[5.0, 18.0], [7.0, 22.0]])], "window_id string, features array<array<double>>")
    got = {r.feature: (r.mean, r.scale) for r in X.scaler_fit(w, ("price_yes", "market_price_mean_1h")).collect()}
    assert got["price_yes"] == pytest.approx((4, 2.236068), abs=1e-6)
    assert got["market_price_mean_1h"] == pytest.approx((16, 4.472136), abs=1e-6)


def _crowd(n, spread_s, seed, known=0.6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        first = DAY + timedelta(microseconds=rng.randint(0, int(spread_s * 1e6)))
        sell = first + timedelta(seconds=rng.randint(0, 5400)) if rng.random() < known else None
        seen = DAY - timedelta(hours=rng.randint(0, 900)) if rng.random() < known else None
        rows.append(("m", rng.choice("abw") * rng.randint(1, 3) + str(i), first, sell, rng.choice([0.0, 0.4, rng.uniform(0.1, 3), rng.uniform(1, 50)]), rng.choice(["Yes", "No"]), seen))
    return rows


def _scores(rows):
    near = lambda a, b, most: 1 - min(1, abs((a - b).total_seconds()) / most) if a and b else 0
    out = []
    rows = sorted(rows, key=lambda r: r[1])
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            score = 100 * (0.3 * near(a[2], b[2], 900) + 0.2 * (a[5] == b[5]) + 0.18 * (1 - abs(a[4] - b[4]) / max(a[4], b[4], 1)) + 0.17 * near(a[6], b[6], 604800) + 0.15 * near(a[3], b[3], 1800))
            if score >= 35:
                out.append((-round(score, 2), f"{a[1]}|{b[1]}"))
    return sorted(out)[:20]


WALLET = "market_id string, wallet string, first_ts timestamp_ntz, first_sell_ts timestamp_ntz, total_usdc double, dominant_outcome string, first_seen timestamp_ntz"


@pytest.mark.parametrize("n, spread, known", [(2, 10, 0.5), (30, 40000, 0.5), (60, 3000, 0.7), (200, 900, 0.0), (300, 600, 0.9), (400, 7200, 0.3)])
def test_best_pairs_are_those_of_all_pairs(spark, n, spread, known):
    rows = _crowd(n, spread, n, known)
    twin = rows[0]
    rows += [("m", f"t{'w' * (i % 3)}{i}", *twin[2:]) for i in range(n // 4)]
    got = [(-r.score, r.pair_key) for r in pairs.best_pairs(spark.createDataFrame(rows, WALLET)).orderBy("pair_rank").collect()]
    want = _scores(rows)
    assert [k for _, k in got] == [k for _, k in want]
    assert [x for x, _ in got] == pytest.approx([x for x, _ in want])


def test_the_pair_search_stays_below_all_pairs(spark):
    made = []
    for n in (500, 2000):
        w = spark.createDataFrame(_crowd(n, 900, 1, 0.5), WALLET)
        made.append(pairs.search_candidates(w, pairs.loss_bounds(w)).count())
    assert made[0] < 500 * 499 / 2 / 4 and made[1] < 8 * made[0]  # all pairs grow 16 times


def test_twins_do_not_multiply(spark):
    row = _crowd(1, 10, 3, 1.0)[0]
    rows = [("m", f"{i:05}", *row[2:]) for i in range(3000)]
    w = spark.createDataFrame(rows, WALLET)
    assert pairs.without_twins(w, 20).count() <= 60
    assert [r.pair_key for r in pairs.best_pairs(w).orderBy("pair_rank").collect()] == [f"00000|{i:05}" for i in range(1, 21)]


def test_pair_score_and_evidence_tell_of_all_pairs(spark, sf):
    """They told of the twenty best of a market only."""
    from tidemark.plans import wallet_queries as Q

    scored, evidence = Q.pair_score(spark, sf), Q.pair_evidence(spark, sf)
    assert scored.groupBy("market_id").count().agg({"count": "max"}).first()[0] > 20
    every = {(x.market_id, x.left_wallet, x.right_wallet) for x in Q.QUERIES["wallet_pair_join"](spark, sf).collect()}
    assert {(x.market_id, x.left_wallet, x.right_wallet) for x in scored.collect()} == every
    assert {(x.market_id, *x.pair_key.split("|")) for x in evidence.collect()} == every


def test_steps_of_lots_are_made_once(spark, sf):
    """Each scan reads its rows twice: four of them one on the other made the work of a snapshot many times over."""
    from tidemark.plans import base as B
    from tidemark.plans import wallet_queries as Q

    trades = B.written(B.wallet_trades(spark, sf))
    metrics, _ = Q.analysed(trades, B.profiles(spark, sf))
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert "__in_next" in plan
    assert "__in_cb" not in plan and "__in_over" not in plan
    got, want = (sorted(map(tuple, lots.realized_markout_by_wallet(trades, kept).collect())) for kept in (B.written, lambda rows: rows))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(a[2] == pytest.approx(b[2]) for a, b in zip(got, want))
