"""Tables that the registered queries derive from the driver's, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, windows
from ..params import QUERY_PARAMS as P
from ..params import SPLIT_PARAMS, Params
from ..sources.scratch import Written
from ..sources.trades import event_trades


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that sums of another order give the same value; halves as the checking engine does it, by
    scaling, adding a half and cutting."""
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = float(10**digits)
    big = F.abs(col) * scale
    out = F.when(big < 4e15, F.signum(col) * F.floor(big + 0.5) / scale).otherwise(col)
    out = F.when(out == 0, F.lit(0.0)).otherwise(out)
    return out.alias(c) if isinstance(c, str) else out


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(F.col(n), digits) for n in names})


#: Means of eight values often lie halfway between two roundings, where the last bit of a sum decides; so much
#: added before rounding moves them off.
OFF_HALF = 3.7e-8


def listed(values: Column, digits: int = 7, add: float = 0.0) -> Column:
    """All values of an array, each rounded."""
    return F.transform(values, lambda x: r(x + add, digits))


def trades(spark, sf) -> DataFrame:
    return event_trades(table(spark, sf, "events"))


def prepared(spark, sf) -> DataFrame:
    return chain.prepare_trades(trades(spark, sf), P)


def labeled(spark, sf) -> DataFrame:
    return chain.label_user_trades(prepared(spark, sf), P)


def model_windows(spark, sf, params: Params = P) -> DataFrame:
    return windows.model_windows(labeled_for_windows(spark, sf), params, written)


#: What labels and windows read of a prepared trade.
_TRADE = ("trade_time", "price_yes", "asset_id", *chain.TIE, "token_amount", "usd_amount", "market_id", "maker", "taker", "maker_direction", "taker_direction")


def labeled_for_windows(spark, sf) -> DataFrame:
    """Labelled rows without the texts of their markets."""
    return chain.label_user_trades(prepared(spark, sf).select(*_TRADE), P)


def written(rows: DataFrame) -> DataFrame:
    return Written(rows, "rows").rows


def written_windows(spark, sf, params: Params = P, *columns: str) -> DataFrame:
    """Windows for queries that read them more than once."""
    return Written(model_windows(spark, sf, params).select(*(columns or ("window_id", "split", "label", "features"))), "windows").rows


def scores(spark, sf) -> DataFrame:
    """Scored rows: ``key, label, probability, split``."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = table(spark, sf, "labels").join(d, "doc_id")
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test")
    return both.select(F.col("doc_id").alias("key"), F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("probability"), split.alias("split"))


# ---- wallet surveillance


def _fills(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    e = e.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long")).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return e.withColumn("price", (F.col("c") % 99 + 1) / F.lit(100.0)).withColumn("size", F.col("c") / F.lit(100.0))


def wallet_trades(spark, sf) -> DataFrame:
    return _fills(spark, sf).select(
        F.col("event_type").alias("market_id"), F.concat(F.lit("u"), "user_id").alias("wallet"), F.when(F.col("k") % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        F.concat("event_type", F.lit("-"), (F.col("k") % 2).cast("string")).alias("asset"), F.when(F.col("k") % 2 == 0, "Yes").otherwise("No").alias("outcome"),
        "price", "size", (F.col("price") * F.col("size")).alias("usdc"), "ts", F.col("event_id").alias("seq"),
    )


def markets_of(trades: DataFrame) -> DataFrame:
    """Facts of the markets that these wallet trades are of."""
    m = trades.groupBy("market_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    resolved = F.length("market_id") % 2 == 0
    none = F.lit(None).cast("timestamp_ntz")
    return m.select(
        "market_id", (~resolved).alias("active"), resolved.alias("closed"), resolved.alias("resolved"), F.when(resolved, "Yes").alias("resolution"),
        F.timestamp_add("HOUR", F.lit(1), F.col("last")).alias("close_time"), none.alias("end_date"), none.alias("resolution_date"), (F.col("n") * 10.0).alias("open_interest"),
    )


def books_of(trades: DataFrame) -> DataFrame:
    b = trades.groupBy("asset").agg(F.count("*").alias("n"))
    return b.select("asset", ((F.col("n") % 10) / 100.0).alias("spread"), (F.col("n") * 5.0).alias("bid_depth_usd"), (F.col("n") * 3.0).alias("ask_depth_usd"))


def markets(spark, sf) -> DataFrame:
    return markets_of(wallet_trades(spark, sf))


def books(spark, sf) -> DataFrame:
    return books_of(wallet_trades(spark, sf))


def profiles(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    seen = F.timestamp_add("HOUR", -(F.col("c_custkey") * 7 % 400), F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'"))
    return c.select(F.concat(F.lit("u"), "c_custkey").alias("wallet"), (F.col("c_nationkey") + 1).alias("total_markets_traded"), seen.alias("first_seen"))


def holders(spark, sf) -> DataFrame:
    t = wallet_trades(spark, sf).groupBy("market_id", "wallet").agg(F.count("*").alias("n"))
    return t.select("market_id", "wallet", (-F.col("n")).alias("place"))


# ---- the same in SQL

BASE = """
ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events),
trades AS (
  SELECT ts AS trade_time, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime,
    event_id AS block_number, 'tx' || event_id AS transaction_hash, 'exchange' AS contract, 'ev-' || event_type AS event_id,
    'slug-' || event_type AS event_slug, 'Title ' || event_type AS event_title, event_type AS market_id,
    'c-' || event_type AS condition_id, 'Will it ' || event_type AS question,
    CASE WHEN k % 2 = 0 THEN 'token1' ELSE 'token2' END AS nonusdc_side, 'u' || user_id AS maker,
    CASE WHEN k % 10 = 0 THEN '0xC1' ELSE 'u' || ((user_id + k) % 40) END AS taker,
    CASE WHEN k % 3 = 0 THEN 'SELL' ELSE 'Buy' END AS maker_direction,
    CASE WHEN k = 7 THEN 'n/a' WHEN k % 3 = 0 THEN ' bid ' ELSE '-short' END AS taker_direction,
    CAST(c % 99 + 1 AS DOUBLE) / 100 AS price, CAST(c * 10000 AS DOUBLE) AS token_amount,
    c * 10000 * (CAST(c % 99 + 1 AS DOUBLE) / 100) AS usd_amount, event_type || '-' || (k % 2) AS asset_id, 'o' || event_id AS order_hash
  FROM ev),
prepared AS (
  SELECT * REPLACE (token_amount / 1e6 AS token_amount, usd_amount / 1e6 AS usd_amount),
    CASE WHEN lower(nonusdc_side) = 'token2' THEN 1.0::DOUBLE - price ELSE price END AS price_yes, strftime(trade_time, '%Y-%m') AS year_month
  FROM trades WHERE price IS NOT NULL AND asset_id IS NOT NULL AND lower(taker) NOT IN ('0xc1')),
quotes AS (SELECT asset_id AS q_asset, trade_time AS future_trade_time, price_yes AS future_price_yes FROM prepared),
priced AS (
  SELECT t.*, q.future_trade_time, q.future_price_yes, epoch(q.future_trade_time) - epoch(t.target_time) AS future_lag_seconds
  FROM (SELECT *, trade_time + INTERVAL 60 MINUTE AS target_time FROM prepared) t
  ASOF LEFT JOIN quotes q ON t.asset_id = q.q_asset AND t.target_time <= q.future_trade_time),
unpivoted AS (
  SELECT *, maker AS "user", 'maker' AS role, maker_direction AS direction FROM priced
  UNION ALL SELECT *, taker AS "user", 'taker' AS role, taker_direction AS direction FROM priced),
sided AS (
  SELECT *, CASE WHEN lower(trim(direction)) IN ('buy', 'bid', 'b', 'long') THEN 1 WHEN lower(trim(direction)) IN ('sell', 'ask', 's', 'short') THEN -1
    WHEN contains(lower(direction), 'buy') OR contains(lower(direction), 'bid') OR starts_with(trim(direction), '+') THEN 1
    WHEN contains(lower(direction), 'sell') OR contains(lower(direction), 'ask') OR starts_with(trim(direction), '-') THEN -1 END AS side
  FROM unpivoted),
scored_rows AS (
  SELECT *, side * token_amount AS signed_token_amount, side * (future_price_yes - price_yes) AS markout,
    CASE WHEN price_yes <> 0 THEN side * (future_price_yes / price_yes - 1.0::DOUBLE) * 10000 END AS markout_bps,
    CASE WHEN side * (future_price_yes - price_yes) > 0 THEN 1 ELSE 0 END AS label
  FROM sided),
labeled AS (SELECT * FROM scored_rows WHERE side IS NOT NULL AND future_price_yes IS NOT NULL AND abs(markout_bps) >= 5)"""

ENRICHED = (
    BASE
    + """,
enriched AS (
  SELECT *, row_number() OVER um AS seq, coalesce((epoch_us(trade_time) - epoch_us(lag(trade_time) OVER um)) / 1e6::DOUBLE, 0.0) AS time_delta_seconds,
    (epoch_us(trade_time) - epoch_us(first_value(trade_time) OVER um)) / 1e6::DOUBLE AS market_age_seconds, CASE WHEN role = 'maker' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS role_is_maker,
    CAST(count(*) OVER mh AS DOUBLE) / 2 AS market_trade_count_1h, coalesce(sum(usd_amount) OVER mh / 2, 0) AS market_volume_1h,
    coalesce(avg(price_yes) OVER mh, price_yes, 0) AS market_price_mean_1h, coalesce(stddev_pop(price_yes) OVER mh, 0) AS market_price_std_1h,
    coalesce(price_yes - first_value(price_yes) OVER mh, 0) AS market_price_return_1h, CAST(count(*) OVER uh AS DOUBLE) AS user_trade_count_1h,
    CAST(count(*) OVER umh AS DOUBLE) AS user_market_trade_count_1h, coalesce(sum(signed_token_amount) OVER uh, 0) AS user_signed_flow_1h,
    coalesce(sum(usd_amount) OVER uh, 0) AS user_usd_volume_1h
  FROM labeled
  WINDOW um AS (PARTITION BY "user", market_id ORDER BY trade_time, block_number, transaction_hash, order_hash, role),
    mh AS (PARTITION BY market_id ORDER BY trade_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
    uh AS (PARTITION BY "user" ORDER BY trade_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
    umh AS (PARTITION BY "user", market_id ORDER BY trade_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))"""
)

_VECTOR = "[price_yes, signed_token_amount, usd_amount, side, role_is_maker, time_delta_seconds, market_age_seconds, market_trade_count_1h, market_volume_1h, market_price_mean_1h, market_price_std_1h, market_price_return_1h, user_trade_count_1h, user_market_trade_count_1h, user_signed_flow_1h, user_usd_volume_1h]"

def windows_sql(p: Params, cut: str = "win_cut", name: str = "mw") -> str:
    """Windows with their split, in a table of this ``name``."""
    n, hours = p.window, p.purge_minutes * 60
    second = p.train_ratio + p.validation_ratio
    return (
        ENRICHED
        + f""",
windowed AS (
  SELECT "user", market_id, min(trade_time) OVER f AS start_ts, trade_time AS end_ts, seq, list(CAST({_VECTOR} AS DOUBLE[])) OVER f AS features, label
  FROM enriched WINDOW f AS (PARTITION BY "user", market_id ORDER BY trade_time, block_number, transaction_hash, order_hash, role ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
kept AS (SELECT * FROM windowed WHERE seq >= {n} AND (seq - {n}) % {p.stride} = 0 AND len(features) = {n}),
seq_cut AS (SELECT quantile_cont(epoch(trade_time), {p.train_ratio}) AS c1, quantile_cont(epoch(trade_time), {second}) AS c2 FROM labeled),
win_cut AS (SELECT quantile_cont(epoch(end_ts), {p.train_ratio}) AS c1, quantile_cont(epoch(end_ts), {second}) AS c2 FROM kept),
{name} AS (
  SELECT * FROM (
    SELECT kept.*, concat_ws(':', "user", market_id, strftime(end_ts, '%Y%m%d%H%M%S'), lpad(CAST(seq AS VARCHAR), 8, '0')) AS window_id, {n} AS window_size,
      start_ts AS window_start_ts, end_ts AS window_end_ts,
      CASE WHEN epoch(end_ts) <= c1 - {hours} THEN 'train' WHEN epoch(start_ts) >= c1 + {hours} AND epoch(end_ts) <= c2 - {hours} THEN 'validation'
        WHEN epoch(start_ts) >= c2 + {hours} THEN 'test' END AS split
    FROM kept, {cut}) WHERE split IS NOT NULL)"""
    )


def listed_sql(values: str, digits: int = 7, add: float = 0.0) -> str:
    return f"list_transform({values}, lambda x: round(x + {add}::DOUBLE, {digits}) + 0)"


WINDOWS = windows_sql(P)
SEQUENCES = windows_sql(P, "seq_cut", "sw")
SPLIT_WINDOWS = windows_sql(SPLIT_PARAMS)

SCORES = """
scores AS (
  SELECT l.doc_id AS key, l.quality AS label, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS probability,
    CASE WHEN l.doc_id % 3 = 0 THEN 'train' WHEN l.doc_id % 3 = 1 THEN 'validation' ELSE 'test' END AS split
  FROM labels l JOIN documents d USING (doc_id))"""

WALLETS = """
fills AS (
  SELECT *, CAST(c % 99 + 1 AS DOUBLE) / 100 AS price, CAST(c AS DOUBLE) / 100 AS size
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events)),
wt AS (
  SELECT event_type AS market_id, 'u' || user_id AS wallet, CASE WHEN k % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, event_type || '-' || (k % 2) AS asset,
    CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END AS outcome, price, size, price * size AS usdc, ts, event_id AS seq FROM fills),
mk AS (
  SELECT event_type AS market_id, length(event_type) % 2 = 1 AS active, length(event_type) % 2 = 0 AS closed, length(event_type) % 2 = 0 AS resolved,
    CASE WHEN length(event_type) % 2 = 0 THEN 'Yes' END AS resolution, max(ts) + INTERVAL 1 HOUR AS close_time, count(*) * 10.0::DOUBLE AS open_interest
  FROM events GROUP BY event_type),
bk AS (SELECT asset, CAST(count(*) % 10 AS DOUBLE) / 100 AS spread, count(*) * 5.0::DOUBLE AS bid_depth_usd, count(*) * 3.0::DOUBLE AS ask_depth_usd FROM wt GROUP BY asset),
pf AS (SELECT 'u' || c_custkey AS wallet, c_nationkey + 1 AS total_markets_traded, TIMESTAMP '2024-01-02' - to_hours(CAST(c_custkey * 7 % 400 AS BIGINT)) AS first_seen FROM customer),
hd AS (SELECT market_id, wallet, -count(*) AS place FROM wt GROUP BY ALL),
ctx AS (
  SELECT market_id, wallet, sum(usdc) AS total_usdc, max(usdc) AS max_usdc, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS trade_count,
    count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, min(ts) FILTER (side = 'SELL') AS first_sell_ts,
    avg(abs(price - 0.5) * 2) AS odds_extremity FROM wt GROUP BY ALL),
dom_o AS (SELECT market_id, wallet, outcome AS dominant_outcome, usd AS dominant_outcome_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY market_id, wallet ORDER BY usd DESC, seen, seen_seq) AS n FROM (
    SELECT market_id, wallet, outcome, sum(usdc) AS usd, min(ts) AS seen, arg_min(seq, ts) AS seen_seq FROM wt GROUP BY ALL)) WHERE n = 1),
dom_a AS (SELECT market_id, wallet, asset AS dominant_asset, usd AS dominant_asset_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY market_id, wallet ORDER BY usd DESC, seen, seen_seq) AS n FROM (
    SELECT market_id, wallet, asset, sum(usdc) AS usd, min(ts) AS seen, arg_min(seq, ts) AS seen_seq FROM wt GROUP BY ALL)) WHERE n = 1),
flow AS (SELECT market_id, wallet, floor(epoch(ts) / 300) AS bucket, sum(CASE WHEN side = 'BUY' THEN usdc ELSE -usdc END) AS f FROM wt GROUP BY ALL),
mflow AS (SELECT market_id, bucket, abs(sum(f)) AS mf FROM flow GROUP BY ALL),
share AS (SELECT market_id, wallet, max(CASE WHEN mf > 0 THEN least(1.0::DOUBLE, abs(f) / mf) ELSE 0 END) AS flow_share FROM flow JOIN mflow USING (market_id, bucket) GROUP BY ALL),
vol AS (SELECT market_id, avg(v) AS realized_volatility FROM (
  SELECT market_id, asset, coalesce(avg(CASE WHEN p > 0 THEN abs(price / p - 1) END), 0) AS v FROM (
    SELECT *, lag(price) OVER (PARTITION BY market_id, asset ORDER BY ts, seq) AS p FROM wt) GROUP BY ALL) GROUP BY ALL),
pct AS (SELECT market_id, quantile_cont(usdc, 0.5) AS median_usdc, quantile_cont(usdc, 0.95) AS p95_usdc FROM wt GROUP BY ALL),
wv AS (SELECT ctx.*, dominant_outcome, first_seen FROM ctx JOIN dom_o USING (market_id, wallet) LEFT JOIN pf USING (wallet)),
allp AS (
  SELECT l.market_id, l.wallet AS left_wallet, r.wallet AS right_wallet,
    1 - least(1.0::DOUBLE, abs(epoch(l.first_ts) - epoch(r.first_ts)) / 900) AS entry_score, CASE WHEN l.dominant_outcome = r.dominant_outcome THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_outcome,
    1 - abs(l.total_usdc - r.total_usdc) / greatest(l.total_usdc, r.total_usdc, 1.0::DOUBLE) AS size_score,
    CASE WHEN l.first_seen IS NOT NULL AND r.first_seen IS NOT NULL THEN 1 - least(1.0::DOUBLE, abs(epoch(l.first_seen) - epoch(r.first_seen)) / 604800) ELSE 0 END AS age_score,
    CASE WHEN l.first_sell_ts IS NOT NULL AND r.first_sell_ts IS NOT NULL THEN 1 - least(1.0::DOUBLE, abs(epoch(l.first_sell_ts) - epoch(r.first_sell_ts)) / 1800) ELSE 0 END AS exit_score
  FROM wv l JOIN wv r ON l.market_id = r.market_id AND l.wallet < r.wallet),
pairs AS (SELECT *, 100 * (0.3::DOUBLE * entry_score + 0.2::DOUBLE * same_outcome + 0.18::DOUBLE * size_score + 0.17::DOUBLE * age_score + 0.15::DOUBLE * exit_score) AS raw FROM allp),
scored_pairs AS (SELECT *, round(raw, 2) AS score, left_wallet || '|' || right_wallet AS pair_key FROM pairs WHERE raw >= 35),
top_pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY score DESC, pair_key) AS pair_rank FROM scored_pairs) WHERE pair_rank <= 20),
rollup AS (SELECT market_id, wallet, max(score) AS max_pair_score, count(*) FILTER (score >= 60) AS linked_wallets FROM (
  SELECT market_id, score, unnest([left_wallet, right_wallet]) AS wallet FROM top_pairs) GROUP BY ALL),
run AS (
  SELECT *, sum(CASE WHEN side = 'BUY' THEN size ELSE 0 END) OVER w AS cb, sum(CASE WHEN side = 'SELL' THEN size ELSE 0 END) OVER w AS cs
  FROM wt WINDOW w AS (PARTITION BY market_id, wallet, asset ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
met AS (SELECT *, cs - greatest(0, max(cs - cb) OVER (PARTITION BY market_id, wallet, asset ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS ms FROM run),
met2 AS (SELECT *, coalesce(lag(ms) OVER (PARTITION BY market_id, wallet, asset ORDER BY ts, seq), 0) AS ms0 FROM met),
lots AS (
  SELECT b.market_id, b.wallet, b.asset, b.price AS buy_price, s.price AS sell_price, least(b.cb, s.ms) - greatest(b.cb - b.size, s.ms0) AS matched_size
  FROM met2 b JOIN met2 s ON b.market_id = s.market_id AND b.wallet = s.wallet AND b.asset = s.asset AND b.side = 'BUY' AND s.side = 'SELL'
    AND s.ms > s.ms0 + 1e-12 AND b.cb - b.size < s.ms AND s.ms0 < b.cb WHERE least(b.cb, s.ms) - greatest(b.cb - b.size, s.ms0) > 1e-12),
realized AS (SELECT market_id, wallet, sum((sell_price / buy_price - 1) * 10000 * matched_size * buy_price) / sum(matched_size * buy_price) AS realized_bps FROM lots GROUP BY ALL)"""
