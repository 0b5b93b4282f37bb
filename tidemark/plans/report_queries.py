"""Queries of the reports over labelled trades, picks, and the notebook's summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.leaderboard import dedupe_by_id, systematic_sample
from ..params import QUERY_PARAMS as P
from . import base as B
from .base import BASE, r, rounded

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


_RATE = "round(avg(label), 6) AS positive_rate"
_USD = "CAST(sum(CAST(usd_amount AS DECIMAL(28, 6))) AS DOUBLE) / count(usd_amount)"
_BALANCE = f"count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_rows, CAST(count(*) - sum(label) AS BIGINT) AS negative_rows, {_RATE}, round(avg(abs(markout_bps)), 6) AS avg_abs_markout_bps, round({_USD}, 6) AS avg_usd_amount"


@query(f"""WITH {BASE} SELECT count(*) AS total_rows, CAST(sum(label) AS BIGINT) AS positive_rows, CAST(count(*) - sum(label) AS BIGINT) AS negative_rows, {_RATE}, count(DISTINCT "user") AS distinct_users, count(DISTINCT market_id) AS distinct_markets, count(DISTINCT asset_id) AS distinct_assets, min(trade_time) AS min_trade_time, max(trade_time) AS max_trade_time, round(avg(abs(markout_bps)), 6) AS avg_abs_markout_bps, round({_USD}, 6) AS avg_usd_amount FROM labeled""")
def dataset_totals(spark, sf):
    return rounded(reports.dataset_totals(B.labeled(spark, sf)), "positive_rate", "avg_abs_markout_bps", "avg_usd_amount")


@query(f"""WITH {BASE}, t AS (SELECT count(*) AS n, CAST(sum(label) AS DOUBLE) AS p FROM labeled) SELECT round(1 - p / n, 6) AS negative_rate, round(p / nullif(n - p, 0), 6) AS positive_to_negative_ratio, round(greatest(p, n - p) / nullif(least(p, n - p), 0), 6) AS majority_to_minority_ratio FROM t""")
def class_ratios(spark, sf):
    return rounded(reports.class_ratios(B.labeled(spark, sf)), "negative_rate", "positive_to_negative_ratio", "majority_to_minority_ratio")


@query(f"""WITH {BASE}, t AS (SELECT count(*) AS n, CAST(sum(label) AS DOUBLE) AS p FROM labeled) SELECT round(greatest(p, n - p) / least(p, n - p), 6) AS imbalance_ratio FROM t""")
def class_imbalance_ratio(spark, sf):
    return rounded(reports.class_imbalance_ratio(B.labeled(spark, sf)), "imbalance_ratio")


_PCT = ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS {n}" for n, q in reports.PERCENTILES.items())


@query("WITH " + BASE + " " + " UNION ALL ".join(f"SELECT '{c}' AS measure, {_PCT.format(c=c)} FROM labeled" for c in ("markout", "markout_bps", "usd_amount")))
def percentiles(spark, sf):
    return rounded(reports.percentiles(B.labeled(spark, sf)), *reports.PERCENTILES)


@query(f"WITH {BASE} SELECT strftime(trade_time, '%Y-%m') AS month, {_BALANCE} FROM labeled GROUP BY 1", "label_monthly_balance", "monthly_balance")
def label_monthly_balance(spark, sf):
    """The flagship: scan, clean, as-of join, unpivot, label, filter, balance by month."""
    return rounded(reports.monthly_balance(B.labeled(spark, sf)), "positive_rate", "avg_abs_markout_bps", "avg_usd_amount")


@query(f"WITH {BASE} SELECT strftime(trade_time, '%Y-%m-%d') AS day, {_BALANCE} FROM labeled GROUP BY 1", "daily_balance")
def daily_balance(spark, sf):
    """By day too, since the driver's events cover one month."""
    return rounded(reports.daily_balance(B.labeled(spark, sf)), "positive_rate", "avg_abs_markout_bps", "avg_usd_amount")


@query(f"WITH {BASE} SELECT round(max(x) - min(x), 6) AS positive_rate_range FROM (SELECT avg(label) AS x FROM labeled GROUP BY strftime(trade_time, '%Y-%m-%d'))", "monthly_rate_range")
def monthly_rate_range(spark, sf):
    return rounded(reports.rate_range(reports.daily_balance(B.labeled(spark, sf))), "positive_rate_range")


def _concentration(key: str, top: int) -> str:
    return f"""WITH {BASE}, t AS (SELECT {key} AS k, count(*) AS n, sum(usd_amount) AS usd FROM labeled GROUP BY 1),
 x AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS a, row_number() OVER (ORDER BY usd DESC, k) AS b FROM t)
 SELECT round(CAST(sum(n) FILTER (a <= {top}) AS DOUBLE) / sum(n), 6) AS top_{top}_row_share, round(sum(usd) FILTER (b <= {top}) / sum(usd), 6) AS top_{top}_usd_share FROM x"""


@query(_concentration('"user"', 100))
def user_concentration(spark, sf):
    return rounded(reports.concentration(B.labeled(spark, sf), "user"), "top_100_row_share", "top_100_usd_share")


@query(_concentration("market_id", 2))
def market_concentration(spark, sf):
    return rounded(reports.concentration(B.labeled(spark, sf), "market_id", 2), "top_2_row_share", "top_2_usd_share")


@query(f"""WITH {BASE}, s AS (SELECT count(*) AS n FROM labeled GROUP BY "user", market_id) SELECT CASE WHEN n < 10 THEN '001-009' WHEN n < 25 THEN '010-024' WHEN n < 50 THEN '025-049' WHEN n < 100 THEN '050-099' ELSE '100+' END AS bucket, count(*) AS stream_count, round(avg(n), 6) AS avg_stream_len FROM s GROUP BY 1""")
def stream_length_buckets(spark, sf):
    return rounded(reports.stream_length_buckets(B.labeled(spark, sf)), "avg_stream_len")


_EST = """SELECT count(*) AS stream_count, count(*) FILTER (n >= 8) AS eligible_stream_count, CAST(sum(CASE WHEN n >= 8 THEN n - 7 ELSE 0 END) AS BIGINT) AS dense_window_count, CAST(sum(CASE WHEN n >= 8 THEN floor((n - 8) / 4) + 1 ELSE 0 END) AS BIGINT) AS stride_window_count FROM s"""


@query(f"""WITH {BASE}, s AS (SELECT count(*) AS n FROM labeled GROUP BY "user", market_id) {_EST}""")
def window_estimates(spark, sf):
    return reports.window_estimates(B.labeled(spark, sf), P.window, P.stride)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Some rows twice, so that there is something to find."""
    return rows.unionByName(rows.filter("block_number % 10 = 3"))


_REP = f"{BASE}, rep AS (SELECT * FROM labeled UNION ALL SELECT * FROM labeled WHERE block_number % 10 = 3)"


@query(f"""WITH {_REP}, d AS (SELECT count(*) AS n FROM rep GROUP BY "user", market_id, trade_time, role, transaction_hash HAVING count(*) > 1) SELECT count(*) AS duplicate_key_count, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_row_count FROM d""")
def duplicate_keys(spark, sf):
    return reports.duplicate_keys(_with_repeats(B.labeled(spark, sf)))


@query(f"WITH {BASE} SELECT count(*) FILTER (future_trade_time < target_time) AS invalid_future_time_rows, count(*) FILTER (label IS NULL) AS null_label_rows, count(*) FILTER (markout_bps IS NULL) AS null_markout_bps_rows FROM labeled")
def label_integrity(spark, sf):
    return reports.label_integrity(B.labeled(spark, sf))


@query(f"""WITH {BASE}, s AS (SELECT count(*) AS n FROM labeled GROUP BY "user", market_id), e AS ({_EST}), t AS (SELECT count(*) AS n, CAST(sum(label) AS DOUBLE) AS p FROM labeled),
 u AS (SELECT CAST(sum(n) FILTER (a <= 100) AS DOUBLE) / sum(n) AS x FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, "user") AS a FROM labeled GROUP BY "user")),
 m AS (SELECT CAST(sum(n) FILTER (a <= 100) AS DOUBLE) / sum(n) AS y FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, market_id) AS a FROM labeled GROUP BY market_id)),
 d AS (SELECT max(x) - min(x) AS z FROM (SELECT avg(label) AS x FROM labeled GROUP BY strftime(trade_time, '%Y-%m')))
SELECT eligible_stream_count, stride_window_count, round(greatest(p, n - p) / least(p, n - p), 6) AS imbalance_ratio, round(x, 6) AS user_row_share, round(y, 6) AS market_row_share, round(z, 6) AS positive_rate_range,
 CASE WHEN eligible_stream_count < 100 OR stride_window_count < 1000 THEN 'blocked_for_training' WHEN greatest(p, n - p) / least(p, n - p) > 2 OR x > 0.35 OR y > 0.35 OR z > 0.15 THEN 'feasible_with_weighting_or_sampling' ELSE 'feasible_now' END AS verdict FROM e, t, u, m, d""")
def training_feasibility(spark, sf):
    out = reports.training_feasibility(B.labeled(spark, sf), P.window, P.stride).drop("stream_count", "dense_window_count")
    return rounded(out, "imbalance_ratio", "user_row_share", "market_row_share", "positive_rate_range")


# ---- picks and context

_PICK = 'transaction_hash, "user", role, round(markout_bps, 6) AS markout_bps'
_TIES = 'usd_amount DESC, trade_time, transaction_hash, "user", role'
_TRUE = f"SELECT * FROM labeled WHERE label = 1 ORDER BY markout_bps DESC, {_TIES} LIMIT 25"
_FALSE = f"SELECT * FROM labeled WHERE label = 0 ORDER BY markout_bps, {_TIES} LIMIT 25"
_ZERO = f"SELECT * FROM labeled ORDER BY abs(markout_bps), {_TIES} LIMIT 25"


def _picked(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("transaction_hash", "user", "role", "markout_bps"), "markout_bps")


@query(f"WITH {BASE} SELECT {_PICK} FROM ({_TRUE})")
def top_true_signals(spark, sf):
    return _picked(reports.top_true_signals(B.labeled(spark, sf), 25))


@query(f"WITH {BASE} SELECT {_PICK} FROM ({_FALSE})")
def top_false_signals(spark, sf):
    return _picked(reports.top_false_signals(B.labeled(spark, sf), 25))


@query(f"WITH {BASE} SELECT {_PICK} FROM ({_ZERO})")
def near_zero_signals(spark, sf):
    return _picked(reports.near_zero_signals(B.labeled(spark, sf), 25))


_CAND = f"""cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_hash, "user", role ORDER BY priority) AS kk FROM (
 SELECT *, 'true_signal' AS pick, 0 AS priority FROM ({_TRUE}) UNION ALL SELECT *, 'false_signal', 1 FROM ({_FALSE}) UNION ALL SELECT *, 'near_zero', 2 FROM ({_ZERO}))) WHERE kk = 1)"""


@query(f"""WITH {BASE}, {_CAND} SELECT pick, {_PICK} FROM cand""")
def dedupe_candidates_by_priority(spark, sf):
    out = reports.signal_candidates(B.labeled(spark, sf), 25, 25)
    return rounded(out.select("pick", "transaction_hash", "user", "role", "markout_bps"), "markout_bps")


@query(f"WITH {BASE} SELECT transaction_hash, round(usd_amount, 6) AS usd_amount FROM prepared ORDER BY prepared.usd_amount DESC, transaction_hash LIMIT 20")
def top_trades_by_usd(spark, sf):
    return rounded(reports.top_trades_by_usd(B.prepared(spark, sf), 20).select("transaction_hash", "usd_amount"), "usd_amount")


_SLICE = "date_trunc('second', c.trade_time) - INTERVAL 120 MINUTE AND date_trunc('second', c.trade_time) + INTERVAL 60 MINUTE"


@query(f"""WITH {BASE}, {_CAND} SELECT c.transaction_hash AS c_transaction_hash, c."user" AS c_user, c.role AS c_role, p.asset_id, p.trade_time, round(p.price_yes, 6) AS price_yes, round(p.usd_amount, 6) AS usd_amount, p.transaction_hash AS context_tx
FROM cand c JOIN prepared p ON p.asset_id = c.asset_id AND p.trade_time BETWEEN {_SLICE}""", "candidate_context_join", "context_slice")
def candidate_context_join(spark, sf):
    c = reports.signal_candidates(B.labeled(spark, sf), 25, 25)
    return rounded(reports.candidate_context(c, B.prepared(spark, sf), 120, 60), "price_yes", "usd_amount")


@query(f"""WITH {BASE}, {_CAND}, base AS (SELECT * FROM prepared WHERE market_id <> 'click'),
found AS (SELECT c.transaction_hash AS c_transaction_hash, c."user" AS c_user, c.role AS c_role, p.asset_id, p.trade_time, p.price_yes, p.usd_amount FROM cand c JOIN base p ON p.asset_id = c.asset_id AND p.trade_time BETWEEN {_SLICE}),
missing AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.c_transaction_hash = c.transaction_hash AND f.c_user = c."user" AND f.c_role = c.role)),
other AS (SELECT DISTINCT c.transaction_hash AS c_transaction_hash, c."user" AS c_user, c.role AS c_role, p.asset_id, p.trade_time, p.price_yes, p.usd_amount FROM missing c JOIN labeled p ON p.asset_id = c.asset_id AND p.trade_time BETWEEN {_SLICE})
SELECT * REPLACE (round(price_yes, 6) AS price_yes, round(usd_amount, 6) AS usd_amount) FROM (SELECT * FROM found UNION ALL SELECT * FROM other)""", "context_fallback", "distinct_context")
def context_fallback(spark, sf):
    labeled = B.labeled(spark, sf)
    prepared = B.prepared(spark, sf).filter("market_id <> 'click'")
    return rounded(reports.context_with_fallback(reports.signal_candidates(labeled, 25, 25), prepared, labeled, 120, 60), "price_yes", "usd_amount")


# ---- summaries of the notebook and the data description


@query(f"""WITH {BASE} SELECT "user", role, count(transaction_hash) AS n_trades, round(avg(markout), 9) + 0 AS avg_markout, round(median(markout), 9) + 0 AS median_markout, round(avg(markout_bps), 9) AS avg_markout_bps, round(avg(CASE WHEN markout > 0 THEN 1 ELSE 0 END), 9) AS positive_markout_rate, round(avg(usd_amount), 9) AS avg_usd_amount FROM labeled GROUP BY ALL""")
def user_markout_summary(spark, sf):
    out = B.labeled(spark, sf).groupBy("user", "role").agg(
        F.count("transaction_hash").alias("n_trades"), F.avg("markout").alias("avg_markout"), F.percentile("markout", F.lit(0.5)).alias("median_markout"), F.avg("markout_bps").alias("avg_markout_bps"),
        F.avg((F.col("markout") > 0).cast("double")).alias("positive_markout_rate"), F.avg("usd_amount").alias("avg_usd_amount"),
    ).orderBy(F.col("avg_markout_bps").desc_nulls_last(), F.col("positive_markout_rate").desc(), F.col("n_trades").desc(), "user", "role")
    return rounded(out, "avg_markout", "median_markout", "avg_markout_bps", "positive_markout_rate", "avg_usd_amount", digits=9)


@query(f"WITH {BASE} SELECT event_id, round(sum(usd_amount), 9) AS volume, count(DISTINCT maker) AS makers FROM prepared GROUP BY 1 ORDER BY sum(usd_amount) DESC, event_id LIMIT 10")
def event_volume(spark, sf):
    p = B.prepared(spark, sf)
    out = p.groupBy("event_id").agg(F.sum("usd_amount").alias("volume"), F.count_distinct("maker").alias("makers"))
    return rounded(out.orderBy(F.col("volume").desc(), "event_id").limit(10), "volume")


@query(f"WITH {BASE} SELECT strftime(trade_time, '%Y-%m-%d') AS period, round(sum(usd_amount), 6) AS volume FROM prepared GROUP BY 1 ORDER BY sum(usd_amount) DESC, 1 LIMIT 2")
def monthly_volume_top(spark, sf):
    out = B.prepared(spark, sf).groupBy(F.date_format("trade_time", "yyyy-MM-dd").alias("period")).agg(F.sum("usd_amount").alias("volume"))
    return rounded(out.orderBy(F.col("volume").desc(), "period").limit(2), "volume")


@query(f"WITH {BASE} SELECT event_id, count(*) AS n FROM prepared GROUP BY 1")
def event_value_counts(spark, sf):
    return B.prepared(spark, sf).groupBy("event_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_id")


_NET = f"""{BASE}, net AS (SELECT "user", market_id, sum(signed_token_amount) AS net FROM labeled GROUP BY ALL)"""


@query(f"""WITH {_NET} SELECT "user", market_id, round(net, 6) + 0 AS net_position, CASE WHEN round(net, 6) > 0 THEN 'long' WHEN round(net, 6) < 0 THEN 'short' ELSE 'flat' END AS stance FROM net""")
def net_position(spark, sf):
    out = B.labeled(spark, sf).groupBy("user", "market_id").agg(r(F.sum("signed_token_amount")).alias("net_position"))
    return out.withColumn("stance", F.when(F.col("net_position") > 0, "long").when(F.col("net_position") < 0, "short").otherwise("flat"))


@query(f"""WITH {_NET}, mk AS (SELECT "user", avg(CASE WHEN role = 'maker' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS maker_share FROM labeled GROUP BY 1), ab AS (SELECT "user", avg(abs(net)) AS mean_abs FROM net GROUP BY 1)
SELECT "user", round(maker_share, 6) AS maker_share, round(mean_abs, 6) AS mean_abs_net, CASE WHEN round(maker_share, 6) > 0.7 AND round(mean_abs, 6) < 10 THEN 'market_maker' WHEN round(maker_share, 6) < 0.3 THEN 'directional' ELSE 'mixed' END AS strategy FROM mk JOIN ab USING ("user")""")
def strategy_class(spark, sf):
    labeled = B.labeled(spark, sf)
    share = labeled.groupBy("user").agg(r(F.avg((F.col("role") == "maker").cast("double"))).alias("maker_share"))
    net = labeled.groupBy("user", "market_id").agg(F.sum("signed_token_amount").alias("net")).groupBy("user").agg(r(F.avg(F.abs("net"))).alias("mean_abs_net"))
    kind = F.when((F.col("maker_share") > 0.7) & (F.col("mean_abs_net") < 10), "market_maker").when(F.col("maker_share") < 0.3, "directional").otherwise("mixed")
    return share.join(net, "user").withColumn("strategy", kind)


@query(f"""WITH {BASE}, o AS (SELECT transaction_hash, row_number() OVER (ORDER BY block_number) - 1 AS i, count(*) OVER () AS n FROM prepared) SELECT transaction_hash, i AS sample_index FROM o WHERE i IN (SELECT CAST(floor(k * n::DOUBLE / 50) AS BIGINT) FROM range(50) t(k))""")
def systematic_sample_rows(spark, sf):
    return systematic_sample(B.prepared(spark, sf).select("transaction_hash", "block_number"), "block_number", 50).select("transaction_hash", "sample_index")


QUERIES["systematic_sample"] = QUERIES.pop("systematic_sample_rows")
ORACLES["systematic_sample"] = ORACLES.pop("systematic_sample_rows")


@query(f"WITH {BASE} SELECT maker, arg_min(transaction_hash, block_number) AS first_tx FROM prepared GROUP BY 1", "dedupe_by_id")
def dedupe_rows(spark, sf):
    return dedupe_by_id(B.prepared(spark, sf), "maker", "block_number").select("maker", F.col("transaction_hash").alias("first_tx"))


@query(f"""WITH {_REP} SELECT DISTINCT asset_id, trade_time, round(price_yes, 6) AS price_yes FROM rep""")
def distinct_rows(spark, sf):
    return rounded(_with_repeats(B.labeled(spark, sf)).select("asset_id", "trade_time", "price_yes"), "price_yes").distinct()


