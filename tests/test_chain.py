from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain, reports, rolling, windows
from tidemark.operators.asof import asof_forward
from tidemark.params import Params
from tidemark.sources import trades as T

from . import goldens

LOOSE = Params(horizon_minutes=5, max_future_lag_seconds=None, min_abs_bps=0.0, window=2, stride=1, train_ratio=0.5, validation_ratio=0.25, test_ratio=0.25, purge_minutes=0, embargo_minutes=0)


def labeled(raw, params=LOOSE):
    return chain.label_user_trades(chain.prepare_trades(raw, params), params)


def test_forward_prices_and_labels(spark):
    rows = labeled(goldens.four(spark)).filter("role = 'maker'").orderBy("trade_time").collect()
    assert [(round(r.price_yes, 4), round(r.future_price_yes, 4), round(r.markout, 4), r.label) for r in rows] == [(0.4, 0.55, 0.15, 1), (0.55, 0.45, -0.1, 0), (0.45, 0.6, 0.15, 1)]
    taker = labeled(goldens.four(spark)).filter("role = 'taker'").orderBy("trade_time").first()
    assert (round(taker.markout, 4), taker.label) == (-0.15, 0)


def test_stale_and_near_zero_rows_go(spark):
    params = Params(window=2, stride=1)
    rows = labeled(goldens.stale(spark), params).collect()
    assert len(rows) == 2 and {r.future_lag_seconds for r in rows} == {0.0}


def test_model_windows(spark):
    features = ("price_yes", "signed_token_amount", "usd_amount", "side", "role_is_maker", "time_delta_seconds", "market_age_seconds")
    params = Params(**{**LOOSE.__dict__, "features": features})
    rows = windows.model_windows(labeled(goldens.six(spark), params).filter("role = 'maker'"), params).orderBy("window_id").collect()
    assert rows[0].features == [pytest.approx([0.4, 1.0, 0.4, 1, 1, 0, 0]), pytest.approx([0.55, 1.5, 0.825, 1, 1, 300, 300])]
    assert rows[0].label == 0
    both = windows.model_windows(labeled(goldens.six(spark), params), params)
    assert {r.split: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 4, "validation": 2, "test": 2}


def test_trailing_features(spark):
    params = Params(**{**LOOSE.__dict__, "features": ("user_market_trade_count_1h", "user_usd_volume_1h", "user_trade_count_1h", "user_signed_flow_1h")})
    rows = windows.collect_windows(rolling.enrich(labeled(goldens.four(spark))), 2, 1, params.features).filter("user = 'user-a'").orderBy("seq").collect()
    assert rows[0].features == [pytest.approx([1.0, 0.4, 1.0, 1.0]), pytest.approx([2.0, 1.225, 2.0, 2.5])]


def test_report_rows(spark):
    roles = [("user-a", "user-b", "BUY", "SELL")] * 4 + [("user-b", "user-a", "BUY", "SELL")] * 2
    raw = goldens.raw_trades(spark, [0.40, 0.55, 0.45, 0.60, 0.58, 0.62], [1e6, 1.5e6, 1.2e6, 0.9e6, 1.1e6, 0.8e6], [4e5, 8.25e5, 5.4e5, 5.4e5, 6.38e5, 4.96e5], roles)
    rows = labeled(raw)
    assert rows.count() == 10
    assert {r.label for r in reports.signal_candidates(rows, 2, 2).collect()} == {0, 1}
    assert reports.duplicate_keys(rows).first().duplicate_key_count == 0
    w = windows.model_windows(rows, LOOSE)
    assert windows.window_integrity(w, 2, 16).first().overlapping_window_ids == 0


def test_params_are_checked():
    for bad in ({"train_ratio": 0.5}, {"window": 0}, {"purge_minutes": -1}, {"features": ("nothing",)}):
        with pytest.raises(ValueError):
            Params(**bad)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    day = datetime(2024, 1, 1)
    quotes = [(rng.choice("ab"), day + timedelta(minutes=rng.randrange(0, 4000, 7)), i, float(i)) for i in range(120)]
    probes = [(rng.choice("abc"), day + timedelta(minutes=rng.randrange(0, 5000)), i) for i in range(150)]
    q = spark.createDataFrame(quotes, "k string, t timestamp_ntz, n int, v double")
    p = spark.createDataFrame(probes, "k string, t timestamp_ntz, i int")
    got = {r.i: r.v for r in asof_forward(p, q, "k", F.col("t"), F.col("t"), {"v": F.col("v")}, [F.col("n")], bucket_seconds=3600).collect()}
    for k, t, i in probes:
        later = [(qt, n, v) for qk, qt, n, v in quotes if qk == k and qt >= t]
        assert got[i] == (min(later)[2] if later else None)


def test_order_of_input_does_not_matter(spark, sf):
    from tidemark.plans import base as B

    one = B.labeled(spark, sf)
    other = chain.label_user_trades(chain.prepare_trades(B.trades(spark, sf).repartition(7, "maker"), B.P), B.P)
    key = F.xxhash64("transaction_hash", "role", "future_trade_time", "label")
    assert one.agg(F.bit_xor(key)).first() == other.agg(F.bit_xor(key)).first()


def test_no_window_crosses_a_split(spark, sf):
    from tidemark.plans import base as B

    w = B.model_windows(spark, sf)
    end = {r.split: (r.a, r.b) for r in w.groupBy("split").agg(F.min("window_start_ts").alias("a"), F.max("window_end_ts").alias("b")).collect()}
    if {"train", "validation"} <= set(end):
        assert end["train"][1] < end["validation"][0]


def test_time_range_is_half_open(spark):
    raw = goldens.four(spark)
    assert T.scan_time_range(raw, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 10)).count() == 2
    assert T.scan_time_range_closed(raw, goldens.START, goldens.START + 600).count() == 3


def test_trailing_features_are_running_frames_and_right_at_their_bounds(spark):
    """A frame that is gone through anew for each row made the time of a full hour quadratic."""
    import random
    import statistics
    from datetime import datetime, timedelta

    draw, start = random.Random(3), datetime(2024, 1, 1)
    hour = 3_600_000_000
    times = [draw.choice((0, 1, 7)) * hour + draw.choice((0, 1, hour // 2, hour - 1, draw.randrange(hour))) for _ in range(120)]
    data = [(f"u{draw.randrange(3)}", f"m{draw.randrange(2)}", start + timedelta(microseconds=t), i, f"t{i}", f"o{i}", "maker", draw.choice((None, draw.random())), draw.random(), draw.uniform(-9, 9)) for i, t in enumerate(times)]
    kinds = "user string, market_id string, trade_time timestamp_ntz, block_number long, transaction_hash string, order_hash string, role string, usd_amount double, price_yes double, signed_token_amount double"
    found = rolling.trailing_features(spark.createDataFrame(data, kinds))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan and str(hour) not in "".join(x[:90] for x in plan.split("specifiedwindowframe")[1:])
    of = {r.block_number: r for r in found.collect()}
    assert len(of) == len(data)
    for row in data:
        frame = [x for x in data if timedelta(0) <= row[2] - x[2] <= timedelta(hours=1)]
        market, user = [x for x in frame if x[1] == row[1]], [x for x in frame if x[0] == row[0]]
        prices, amount = [x[8] for x in market], lambda rows: sum(x[7] or 0.0 for x in rows)
        first = min(market, key=lambda x: x[2:7])[8]
        r = of[row[3]]
        got = (r.market_trade_count_1h, r.market_volume_1h, r.market_price_mean_1h, r.market_price_std_1h, r.market_price_return_1h, r.user_trade_count_1h, r.user_market_trade_count_1h, r.user_signed_flow_1h, r.user_usd_volume_1h)
        wanted = (len(market) / 2, amount(market) / 2, statistics.fmean(prices), statistics.pstdev(prices), row[8] - first, len(user), sum(x[1] == row[1] for x in user), sum(x[9] for x in user), amount(user))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, wanted)), (row, got, wanted)


def enriched_rows(spark, sizes):
    """Streams of these sizes with all columns of windows; a feature says user and place."""
    from tidemark.params import FEATURES

    day = datetime(2024, 1, 1)
    rows = [(f"u{u}", "m", i + 1, day + timedelta(minutes=i), (i * 7 + u) % 2, float(1000 * u + i)) for u, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "user string, market_id string, seq int, trade_time timestamp_ntz, label int, price_yes double")
    return rows, df.withColumns({f: F.lit(0.0) for f in FEATURES if f != "price_yes"})


@pytest.mark.parametrize("length, stride", [(3, 1), (8, 4), (2, 5), (1, 1), (50, 16), (20, 7)])
def test_windows_from_blocks_equal_brute_force(spark, length, stride):
    sizes = (0, 1, 2, 7, 8, 64, 65, 66, 71, 72, 130, 200, 201, 202, 409)
    rows, df = enriched_rows(spark, sizes)
    got = sorted((r.user, r.seq, r.start_ts, r.end_ts, r.label, tuple(x[0] for x in r.features)) for r in windows.collect_windows(df, length, stride, ("price_yes",)).collect())
    wanted = []
    for u in range(len(sizes)):
        mine = [r for r in rows if r[0] == f"u{u}"]
        for s in range(0, len(mine) - length + 1, stride):
            w = mine[s : s + length]
            wanted.append((f"u{u}", w[-1][2], w[0][3], w[-1][3], w[-1][4], tuple(x[5] for x in w)))
    assert got == sorted(wanted)


def test_windows_without_features_need_no_trailing_hour(spark, sf):
    from tidemark.plans import base as B

    for made in (windows.split_summary, windows.split_time_ranges):
        plan = made(B.model_windows(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" in plan and "__a_" not in plan and "vector" not in plan


def test_long_values_are_named_by_group_and_not_one_by_one(spark, sf):
    from tidemark.operators import tensor
    from tidemark.plans.tensor_queries import flatten_long

    w = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0]])], "window_id string, features array<array<double>>")
    got = {(r.step, r.j, r.name, r.value) for r in tensor.flatten_long(w, ("x", "y")).collect()}
    assert got == {(0, 0, "x__step_00", 1.0), (0, 1, "y__step_00", 2.0), (1, 0, "x__step_01", 3.0), (1, 1, "y__step_01", 4.0)}
    plan = flatten_long(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Aggregate [step", 1)[1].split("\n", 1)[1]
    assert "step_" in plan and "step_" not in below


def test_later_parts_of_frames_are_made_of_own_rows_alone(spark, sf):
    from tidemark.plans import base as B

    out = rolling.trailing_features(B.labeled(spark, sf))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.strip(" :+-") for line in plan.splitlines() if "Window [" in line or "Filter (__late" in line or "Generate explode([0,1])" in line]
    kinds = ["own" if s.startswith("Filter") else "sent" if s.startswith("Generate") else "early" if "DESC NULLS LAST" in s else "late" for s in steps]
    runs = [k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]]
    assert runs[:8] == ["late", "own", "early", "sent"] * 2  # from the result down: users, markets, then the labels


def test_candidates_with_a_fallback_are_picked_once(spark, sf):
    from tidemark.plans import base as B

    made, prepared = B.labeled(spark, sf), B.prepared(spark, sf)
    picked = reports.signal_candidates(made, 3, 3).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    once = picked.mapInArrow(counted, picked.schema)
    found = reports.context_with_fallback(once, prepared.filter("market_id <> 'click'"), made, 120, 60)
    assert found.count() > 0
    assert seen.value == picked.count()
