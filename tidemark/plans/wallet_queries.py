"""Queries of the wallet surveillance and the markouts by horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lots, pairs, wallets
from ..sources.scratch import Written
from . import base as B
from .base import WALLETS, r, rounded

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


@query(f"WITH {WALLETS} SELECT market_id, CASE WHEN active AND NOT closed AND NOT resolved THEN 'live' ELSE 'post_event' END AS mode FROM mk")
def market_mode(spark, sf):
    return wallets.market_mode(B.markets(spark, sf)).select("market_id", "mode")


@query(f"WITH {WALLETS} SELECT market_id, close_time AS deadline FROM mk")
def market_deadline(spark, sf):
    return wallets.market_deadline(B.markets(spark, sf)).select("market_id", "deadline")


@query(f"WITH {WALLETS} SELECT seq, CASE WHEN resolved THEN CASE WHEN lower(trim(resolution)) = lower(trim(outcome)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS price FROM wt JOIN mk USING (market_id)")
def settlement_price(spark, sf):
    t = B.wallet_trades(spark, sf).join(B.markets(spark, sf).select("market_id", "resolved", "resolution"), "market_id")
    return t.select("seq", wallets.settlement_price(F.col("resolved"), F.col("resolution"), F.col("outcome")).alias("price"))


@query(f"WITH {WALLETS} SELECT market_id, wallet, round(total_usdc, 6) AS total_usdc, round(max_usdc, 6) AS max_usdc, first_ts, last_ts, trade_count, buys, sells FROM ctx")
def wallet_context(spark, sf):
    out = wallets.wallet_context(B.wallet_trades(spark, sf)).drop("first_sell_ts", "odds_extremity")
    return rounded(out, "total_usdc", "max_usdc")


@query(f"WITH {WALLETS} SELECT market_id, wallet, first_sell_ts FROM ctx")
def first_sell_time(spark, sf):
    return wallets.first_sell_time(B.wallet_trades(spark, sf))


@query(f"WITH {WALLETS} SELECT market_id, wallet, dominant_outcome, round(dominant_outcome_usd, 6) AS dominant_outcome_usd FROM dom_o")
def dominant_outcome(spark, sf):
    return rounded(wallets.dominant(B.wallet_trades(spark, sf), "outcome"), "dominant_outcome_usd")


@query(f"WITH {WALLETS} SELECT market_id, wallet, dominant_asset, round(dominant_asset_usd, 6) AS dominant_asset_usd FROM dom_a")
def dominant_asset(spark, sf):
    return rounded(wallets.dominant(B.wallet_trades(spark, sf), "asset"), "dominant_asset_usd")


@query(f"WITH {WALLETS} SELECT market_id, round(median_usdc, 6) AS median_usdc, round(p95_usdc, 6) AS p95_usdc FROM pct")
def market_trade_percentile(spark, sf):
    return rounded(wallets.market_trade_percentiles(B.wallet_trades(spark, sf)), "median_usdc", "p95_usdc")


@query(f"WITH {WALLETS} SELECT market_id, wallet, round(flow_share, 6) AS flow_share FROM share")
def flow_share_5m(spark, sf):
    return rounded(wallets.flow_share(B.wallet_trades(spark, sf)), "flow_share")


@query(f"WITH {WALLETS} SELECT market_id, round(realized_volatility, 6) AS realized_volatility FROM vol")
def realized_volatility(spark, sf):
    return rounded(wallets.realized_volatility(B.wallet_trades(spark, sf)), "realized_volatility")


def _asset_books(spark, sf) -> DataFrame:
    return B.wallet_trades(spark, sf).select("market_id", "asset").distinct().join(B.books(spark, sf), "asset")


@query(f"WITH {WALLETS} SELECT market_id, round(avg(spread * 10000), 6) AS average_spread_bps FROM (SELECT DISTINCT market_id, asset FROM wt) JOIN bk USING (asset) GROUP BY 1")
def average_spread_bps(spark, sf):
    return rounded(wallets.average_spread_bps(_asset_books(spark, sf)), "average_spread_bps")


@query(f"WITH {WALLETS} SELECT market_id, wallet, total_markets_traded, first_seen FROM ctx LEFT JOIN pf USING (wallet)")
def wallet_profile_join(spark, sf):
    t = B.wallet_trades(spark, sf).select("market_id", "wallet").distinct()
    return t.join(B.profiles(spark, sf), "wallet", "left").select("market_id", "wallet", "total_markets_traded", "first_seen")


@query(f"WITH {WALLETS} SELECT market_id, wallet, dominant_asset, spread, bid_depth_usd, ask_depth_usd FROM dom_a LEFT JOIN bk ON asset = dominant_asset")
def wallet_book_join(spark, sf):
    d = wallets.dominant(B.wallet_trades(spark, sf), "asset").drop("dominant_asset_usd")
    return d.join(B.books(spark, sf).withColumnRenamed("asset", "dominant_asset"), "dominant_asset", "left").select("market_id", "wallet", "dominant_asset", "spread", "bid_depth_usd", "ask_depth_usd")


# ---- pairs


def _vectors(spark, sf, trades: DataFrame | None = None) -> DataFrame:
    return wallets.pair_inputs(B.wallet_trades(spark, sf) if trades is None else trades, B.profiles(spark, sf))


def _best(spark, sf) -> DataFrame:
    return pairs.best_pairs(Written(_vectors(spark, sf), "wallets").rows)


def _all_pairs(spark, sf) -> DataFrame:
    return pairs.pair_scores(Written(_vectors(spark, sf), "wallets").rows)


PARTS = ("entry_score", "same_outcome", "size_score", "age_score", "exit_score")
_PARTS = ", ".join(f"round({c}, 3) + 0 AS {c}" for c in PARTS)


@query(f"WITH {WALLETS} SELECT market_id, left_wallet, right_wallet, round(raw, 2) AS score FROM pairs WHERE raw >= 35")
def wallet_pair_join(spark, sf):
    """All pairs of at least 35 points."""
    return _all_pairs(spark, sf).select("market_id", "left_wallet", "right_wallet", r("score", 2))


@query(f"WITH {WALLETS} SELECT market_id, left_wallet, right_wallet, score, {_PARTS} FROM scored_pairs")
def pair_score(spark, sf):
    """All pairs of at least 35 points, and what their scores are made of."""
    return _all_pairs(spark, sf).select("market_id", "left_wallet", "right_wallet", r("score", 2), *(r(c, 3) for c in PARTS))


@query(f"""WITH {WALLETS} SELECT market_id, pair_key, list_filter([CASE WHEN entry_score >= 0.7 THEN 'Entered the market in a tight time window.' END, CASE WHEN same_outcome = 1 THEN 'Built exposure on the same outcome.' END,
 CASE WHEN age_score >= 0.7 THEN 'Observed account ages are unusually close.' END, CASE WHEN exit_score >= 0.7 THEN 'Exits were synchronized.' END], lambda x: x IS NOT NULL) AS evidence FROM scored_pairs""")
def pair_evidence(spark, sf):
    """The reasons of all pairs of at least 35 points."""
    return pairs.with_reasons(_all_pairs(spark, sf)).select("market_id", "pair_key", "evidence")


@query(f"WITH {WALLETS} SELECT market_id, pair_key, score, CAST(pair_rank AS INTEGER) AS pair_rank FROM top_pairs")
def top_pairs(spark, sf):
    return _best(spark, sf).select("market_id", "pair_key", r("score", 2), "pair_rank")


@query(f"WITH {WALLETS} SELECT market_id, wallet, max_pair_score, linked_wallets FROM rollup")
def pair_rollup(spark, sf):
    return wallets.pair_rollup(_best(spark, sf))


@query(f"WITH {WALLETS} SELECT market_id, wallet, coalesce(max_pair_score, 0) AS max_pair_score, round(coalesce(flow_share, 0), 6) AS flow_share, round(realized_bps, 4) + 0 AS realized_bps FROM ctx LEFT JOIN rollup USING (market_id, wallet) LEFT JOIN share USING (market_id, wallet) LEFT JOIN realized USING (market_id, wallet)")
def pair_rollup_join(spark, sf):
    t = B.wallet_trades(spark, sf)
    out = wallets.wallet_context(t).select("market_id", "wallet")
    for part in (wallets.pair_rollup(_best(spark, sf)), wallets.flow_share(t), lots.realized_markout_by_wallet(t)):
        out = out.join(part, ["market_id", "wallet"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select("market_id", "wallet", zero("max_pair_score").alias("max_pair_score"), r(zero("flow_share")).alias("flow_share"), r("realized_bps", 4))


# ---- lots and markouts


@query(f"WITH {WALLETS} SELECT market_id, wallet, asset, buy_price, sell_price, round(matched_size, 6) AS matched_size FROM lots WHERE round(matched_size, 6) > 0")
def fifo_lot_match(spark, sf):
    return rounded(lots.fifo_lot_match(B.wallet_trades(spark, sf)), "matched_size").filter("matched_size > 0")


@query(f"WITH {WALLETS} SELECT market_id, wallet, round(realized_bps, 4) + 0 AS realized_bps FROM realized")
def realized_markout_by_wallet(spark, sf):
    return rounded(lots.realized_markout_by_wallet(B.wallet_trades(spark, sf)), "realized_bps", digits=4)


def _history(spark, sf) -> DataFrame:
    return B.wallet_trades(spark, sf).select("asset", "ts", "price")


_FUTURE = """fut AS (SELECT t.*, coalesce(h.price, l.price) AS future FROM (SELECT *, ts + INTERVAL {m} MINUTE AS target FROM wt) t
 ASOF LEFT JOIN (SELECT asset, ts, price FROM wt) h ON t.asset = h.asset AND t.target <= h.ts LEFT JOIN (SELECT asset, arg_max(price, ts) AS price FROM wt GROUP BY 1) l ON l.asset = t.asset)"""
_BPS = "(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) * (future / price - 1) * 10000"
_WEIGHTED = f"round(sum({_BPS} * n) / sum(n), 4) + 0 AS weighted_bps, count(future) AS matched_trades, count(*) AS trade_count"


@query(f"WITH {WALLETS}, {_FUTURE.format(m=240)} SELECT seq, future FROM fut")
def price_history_forward_or_last(spark, sf):
    t = B.wallet_trades(spark, sf).withColumn("target", F.timestamp_add("MINUTE", F.lit(240), F.col("ts")))
    return wallets.price_forward_or_last(t, _history(spark, sf)).select("seq", "future")


_HORIZON_SQL = " UNION ALL ".join(
    f"SELECT market_id, wallet, {_WEIGHTED}, '{name}' AS horizon FROM (SELECT *, CASE WHEN future IS NOT NULL THEN greatest(price * size, usdc, 1.0::DOUBLE) END AS n FROM f_{name}) GROUP BY 1, 2"
    for name in wallets.HORIZONS
)
_SETTLED = "f_to_resolution AS (SELECT wt.*, CASE WHEN resolved THEN CASE WHEN resolution = outcome THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS future FROM wt JOIN mk USING (market_id))"
_AHEAD = ", ".join(_FUTURE.format(m=minutes).replace("fut AS", f"f_{name} AS") for name, minutes in wallets.HORIZONS.items() if minutes)


@query(f"WITH {WALLETS}, {_AHEAD}, {_SETTLED} {_HORIZON_SQL}", "horizon_markout_by_wallet", "horizon_wallet_order")
def horizon_markout_by_wallet(spark, sf):
    out = wallets.horizon_markouts(B.markets(spark, sf), B.wallet_trades(spark, sf), _history(spark, sf))
    return rounded(wallets.horizon_wallet_order(out), "weighted_bps", digits=4)


# ---- metrics and scores


def analysed(trades: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of all wallets and the best pairs of all markets.  Trades, pairs, what both rest on and the steps of lots are written once, so
    the dozen parts of a score don't read and parse the source again."""
    best = Written(pairs.best_pairs(Written(wallets.pair_inputs(trades, profiles), "wallets").rows), "pairs").rows
    made = wallets.wallet_metrics(B.markets_of(trades), trades, profiles, B.books_of(trades), best, lots.realized_markout_by_wallet(trades, B.written))
    return made, best


def snapshot_of(trades: DataFrame, profiles: DataFrame) -> DataFrame:
    """Snapshots of the markets of these trades."""
    metrics, best = analysed(trades, profiles)
    scored = Written(wallets.score_wallets(metrics), "scored").rows
    return wallets.market_snapshot(B.markets_of(trades), trades, scored, best, B.books_of(trades))


def _metrics(spark, sf) -> DataFrame:
    return analysed(Written(B.wallet_trades(spark, sf), "trades").rows, B.profiles(spark, sf))[0]


_PAYOUT = """pay AS (SELECT market_id, wallet, coalesce(avg(least(1.0::DOUBLE, greatest(0.0::DOUBLE, g / 0.5))), 0) AS payout_score FROM (
 SELECT *, (CASE WHEN side = 'BUY' THEN e - price ELSE price - e END) / greatest(price, 0.01::DOUBLE) AS g FROM (
 SELECT wt.*, CASE WHEN resolved THEN CASE WHEN resolution = outcome THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS e FROM wt JOIN mk USING (market_id))) GROUP BY 1, 2)"""
_C = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
_MET = f"""{_PAYOUT}, met_all AS (
 SELECT c.market_id, c.wallet, c.first_ts, CASE WHEN active AND NOT closed AND NOT resolved THEN 'live' ELSE 'post_event' END AS mode,
  1 - {_C.format(x='(epoch(close_time) - epoch(c.first_ts)) / 259200')} AS timingAnomaly,
  {_C.format(x='max_usdc / greatest(p95_usdc * 1.25, 1.0::DOUBLE)')} AS marketSizeAnomaly,
  {_C.format(x='max_usdc / greatest(total_usdc / trade_count, median_usdc, 1.0::DOUBLE)')} AS walletSizeAnomaly,
  0.4::DOUBLE * {_C.format(x='max_usdc / greatest(ask_depth_usd, bid_depth_usd, 1.0::DOUBLE)')} + 0.35::DOUBLE * {_C.format(x='max_usdc / greatest(open_interest * 0.05::DOUBLE, 1.0::DOUBLE)')} + 0.25::DOUBLE * odds_extremity AS oddsDepthOiPressure,
  {_C.format(x='flow_share')} AS orderFlowPressure,
  {_C.format(x='dominant_outcome_usd / greatest(total_usdc, 1.0::DOUBLE)')} AS directionalConcentration,
  0.6::DOUBLE * (1 - {_C.format(x='spread / 0.12')}) + 0.4::DOUBLE * {_C.format(x='realized_volatility / 0.06')} AS spreadVolatilityRegime,
  0.45::DOUBLE * CASE WHEN total_markets_traded IS NOT NULL THEN 1 - {_C.format(x='CAST(total_markets_traded - 1 AS DOUBLE) / 20')} ELSE 0.2 END
   + 0.3::DOUBLE * CASE WHEN first_seen IS NOT NULL THEN 1 - {_C.format(x='greatest((epoch(c.first_ts) - epoch(first_seen)) / 3600, 0) / 72')} ELSE 0.2 END
   + 0.25::DOUBLE * {_C.format(x='max_usdc / greatest(p95_usdc * 1.5, 1.0::DOUBLE)')} AS newWalletShock,
  {_C.format(x='coalesce(max_pair_score, 0) / 100')} AS linkedWalletCoordination,
  CASE WHEN realized_bps IS NOT NULL THEN {_C.format(x='greatest(realized_bps, 0) / 5000')} ELSE payout_score END AS realizedMarkout
 FROM ctx c JOIN mk USING (market_id) JOIN dom_o USING (market_id, wallet) JOIN dom_a USING (market_id, wallet) LEFT JOIN bk ON asset = dominant_asset LEFT JOIN pf ON pf.wallet = c.wallet
  JOIN pct USING (market_id) JOIN vol USING (market_id) LEFT JOIN share ON share.market_id = c.market_id AND share.wallet = c.wallet LEFT JOIN rollup ON rollup.market_id = c.market_id AND rollup.wallet = c.wallet
  LEFT JOIN realized ON realized.market_id = c.market_id AND realized.wallet = c.wallet LEFT JOIN pay ON pay.market_id = c.market_id AND pay.wallet = c.wallet)"""

for _name, _metric in (
    ("timing_anomaly", "timingAnomaly"), ("market_size_anomaly", "marketSizeAnomaly"), ("wallet_size_anomaly", "walletSizeAnomaly"), ("odds_depth_oi_pressure", "oddsDepthOiPressure"),
    ("order_flow_pressure", "orderFlowPressure"), ("directional_concentration", "directionalConcentration"), ("spread_volatility_regime", "spreadVolatilityRegime"), ("new_wallet_shock", "newWalletShock"),
    ("linked_wallet_coordination", "linkedWalletCoordination"), ("realized_markout_metric", "realizedMarkout"),
):
    def _one(spark, sf, metric=_metric) -> DataFrame:
        return _metrics(spark, sf).select("market_id", "wallet", r(F.col(metric), 7).alias("value"))

    QUERIES[_name] = _one
    ORACLES[_name] = f"WITH {WALLETS}, {_MET} SELECT market_id, wallet, round({_metric}, 7) + 0 AS value FROM met_all"

_W = {k: v[1:] for k, v in wallets.METRICS.items()}
_TOTAL = {"live": sum(v[0] for v in _W.values()), "post": sum(v[1] for v in _W.values())}
_CONTRIB = " + ".join(f"CAST(round({k} * CASE WHEN mode = 'live' THEN {a} ELSE {b} END, 4) AS DECIMAL(18, 4))" for k, (a, b) in _W.items())
_SCORED = f"{_MET}, raw_score AS (SELECT *, CAST({_CONTRIB} AS DOUBLE) / (CASE WHEN mode = 'live' THEN {_TOTAL['live']} ELSE {_TOTAL['post']} END) * 100 AS s FROM met_all)"


def _scored(spark, sf) -> DataFrame:
    return wallets.score_wallets(_metrics(spark, sf))


def _two(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18, 8)), 2) AS DOUBLE)"


_LIVE, _POST = "CASE WHEN mode = 'live' THEN s ELSE s * 0.92::DOUBLE END", "CASE WHEN mode = 'live' THEN s * 0.88::DOUBLE ELSE s END"
_SCORES = f"{_two('s')} AS combined_score, {_two(_LIVE)} AS live_score, {_two(_POST)} AS post_event_score"


@query(f"WITH {WALLETS}, {_SCORED} SELECT market_id, wallet, {_SCORES} FROM raw_score")
def weighted_wallet_score(spark, sf):
    return rounded(_scored(spark, sf).select("market_id", "wallet", "combined_score", "live_score", "post_event_score"), "combined_score", "live_score", "post_event_score", digits=2)


_IDS = "[" + ", ".join(f"'{k}'" for k in wallets.METRICS) + "]"
_LABELS = "[" + ", ".join(f"'{v[0]}'" for v in wallets.METRICS.values()) + "]"
_VALUES = "[" + ", ".join(wallets.METRICS) + "]"
_WEIGHTS = "CASE WHEN mode = 'live' THEN [" + ", ".join(str(a) for a, _ in _W.values()) + "] ELSE [" + ", ".join(str(b) for _, b in _W.values()) + "] END"
_STRUCTS = f"{_MET}, ms AS (SELECT market_id, wallet, mode, k, ({_IDS})[k] AS id, ({_LABELS})[k] AS label, ({_VALUES})[k] AS raw, ({_WEIGHTS})[k] AS weight FROM met_all, (SELECT unnest(range(1, {len(_W) + 1})) AS k))"


@query(f"WITH {WALLETS}, {_STRUCTS} SELECT market_id, wallet, id, label, round(raw, 7) + 0 AS raw, CAST(weight AS INTEGER) AS weight, round(raw, 4) + 0 AS normalized, round(raw * weight, 4) + 0 AS contribution FROM ms")
def metric_struct(spark, sf):
    """One row for each metric of a wallet."""
    out = _scored(spark, sf).select("market_id", "wallet", F.inline("metrics"))
    return out.select("market_id", "wallet", "id", "label", r("raw", 7), "weight", r("normalized", 4), r("contribution", 4))


@query(f"""WITH {WALLETS}, {_STRUCTS}, strong AS (SELECT *, row_number() OVER (PARTITION BY market_id, wallet ORDER BY round(raw * weight, 4) DESC, k) AS n FROM ms WHERE round(raw, 4) >= 0.65 AND weight > 0),
said AS (SELECT market_id, wallet, list(label || CASE WHEN id = 'realizedMarkout' AND mode <> 'live' THEN ' lit up after the market closed.' ELSE '.' END ORDER BY n) AS reasons FROM strong WHERE n <= 3 GROUP BY 1, 2)
SELECT market_id, wallet, coalesce(reasons, []) AS reasons FROM met_all LEFT JOIN said USING (market_id, wallet)""")
def wallet_reasons(spark, sf):
    return _scored(spark, sf).select("market_id", "wallet", "reasons")


_TOP = f"{_SCORED}, tw AS (SELECT * FROM (SELECT market_id, wallet, {_two('s')} AS combined_score, row_number() OVER (PARTITION BY market_id ORDER BY {_two('s')} DESC, first_ts, wallet) AS k FROM raw_score) WHERE k <= 15)"


@query(f"WITH {WALLETS}, {_TOP} SELECT market_id, wallet, combined_score, CAST(k AS INTEGER) AS wallet_rank FROM tw")
def top_wallets(spark, sf):
    return wallets.top_wallets(_scored(spark, sf)).select("market_id", "wallet", r("combined_score", 2), "wallet_rank")


@query(f"WITH {WALLETS} SELECT market_id, seq, CAST(k AS INTEGER) AS recent_rank FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts DESC, seq DESC) AS k FROM wt) WHERE k <= 20")
def recent_trades(spark, sf):
    return wallets.recent_trades(B.wallet_trades(spark, sf)).select("market_id", "seq", "recent_rank")


@query(f"""WITH {WALLETS}, a AS (SELECT market_id, wallet, k FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY usdc DESC, ts, seq) AS k FROM wt) WHERE k <= 20),
 b AS (SELECT market_id, wallet, k + 20 AS k FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY place, wallet) AS k FROM hd) WHERE k <= 10),
 c AS (SELECT market_id, wallet, min(k) AS priority FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT market_id, wallet, CAST(priority AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY priority) AS n FROM c) WHERE n <= 25""")
def interesting_wallets(spark, sf):
    return wallets.interesting_wallets(B.wallet_trades(spark, sf), B.holders(spark, sf)).select("market_id", "wallet", "priority")


SNAPSHOT = f"""{_TOP},
 a AS (SELECT market_id, list(wallet ORDER BY k) AS suspicious_wallets, list(combined_score ORDER BY k) AS scores FROM tw GROUP BY 1),
 b AS (SELECT market_id, list(pair_key ORDER BY pair_rank) AS linked_pairs FROM top_pairs GROUP BY 1),
 c AS (SELECT market_id, list(wallet || ' ' || side ORDER BY k) AS recent_trades FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts DESC, seq DESC) AS k FROM wt) WHERE k <= 20 GROUP BY 1)
SELECT market_id, CASE WHEN active AND NOT closed AND NOT resolved THEN 'live' ELSE 'post_event' END AS mode, n AS trade_count, w AS wallet_count, round(v, 2) AS total_volume_usdc, round(realized_volatility, 4) AS realized_volatility, suspicious_wallets, scores, linked_pairs, recent_trades
FROM mk JOIN (SELECT market_id, count(*) AS n, count(DISTINCT wallet) AS w, sum(usdc) AS v FROM wt GROUP BY 1) USING (market_id) JOIN vol USING (market_id) LEFT JOIN a USING (market_id) LEFT JOIN b USING (market_id) LEFT JOIN c USING (market_id)"""


def snapshot_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "market_id", "mode", "trade_count", "wallet_count", r("total_volume_usdc", 2), r("realized_volatility", 4), F.col("suspicious_wallets.wallet").alias("suspicious_wallets"),
        B.listed(F.col("suspicious_wallets.combined_score"), 2).alias("scores"), F.col("linked_pairs.pair_key").alias("linked_pairs"),
        F.transform("recent_trades", lambda x: F.concat_ws(" ", x["wallet"], x["side"])).alias("recent_trades"),
    )


@query(f"WITH {WALLETS}, {SNAPSHOT}")
def market_snapshot(spark, sf):
    return snapshot_columns(snapshot_of(Written(B.wallet_trades(spark, sf), "trades").rows, B.profiles(spark, sf)))
