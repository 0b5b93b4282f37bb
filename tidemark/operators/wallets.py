"""Wallet surveillance for all markets at once.

Tables: ``markets`` (a row for each), ``trades`` (market_id, wallet, side BUY/SELL, asset, outcome, price, size,
usdc, ts, seq), ``profiles`` (wallet, total_markets_traded, first_seen), ``books`` (asset, spread, bid_depth_usd,
ask_depth_usd).  ``seq`` orders trades of one time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, entry_bps, micros
from .percentile import exact_percentiles
from .scan import SegmentedScan, hour_of

# Metrics: label, live weight, post-event weight (fixed values).
METRICS = {
    "timingAnomaly": ("Pre-event Timing", 16, 14),
    "marketSizeAnomaly": ("Market-Relative Size", 12, 10),
    "walletSizeAnomaly": ("Wallet-Relative Size", 8, 8),
    "oddsDepthOiPressure": ("Odds / Depth / OI Pressure", 12, 10),
    "orderFlowPressure": ("Order-Flow Pressure", 10, 9),
    "directionalConcentration": ("Directional Concentration", 8, 8),
    "spreadVolatilityRegime": ("Spread / Volatility Regime", 6, 5),
    "newWalletShock": ("New Wallet / First-Trade Shock", 8, 8),
    "linkedWalletCoordination": ("Linked Wallet Coordination", 10, 10),
    "realizedMarkout": ("Realized / Resolved Markout", 0, 18),
}
HOURS_72, FLOW_BUCKET = 72 * 3600, "5 minutes"
LINKED = 60.0


def seconds(c: str | Column) -> Column:
    return micros(F.col(c) if isinstance(c, str) else c) / 1e6


def market_mode(markets: DataFrame) -> DataFrame:
    live = F.coalesce("active", F.lit(False)) & ~F.coalesce("closed", F.lit(False)) & ~F.coalesce("resolved", F.lit(False))
    return markets.withColumn("mode", F.when(live, "live").otherwise("post_event"))


def market_deadline(markets: DataFrame) -> DataFrame:
    """The first of close, end and resolution time that is there."""
    return markets.withColumn("deadline", F.coalesce("close_time", "end_date", "resolution_date"))


def settlement_price(resolved: Column, resolution: Column, outcome: Column) -> Column:
    known = resolved & (F.trim(resolution) != "")
    return F.when(known, F.when(F.lower(F.trim(resolution)) == F.lower(F.trim(outcome)), 1.0).otherwise(0.0))


def dominant(trades: DataFrame, column: str) -> DataFrame:
    """The outcome or asset with most USD of every wallet; the one seen first wins ties."""
    totals = trades.groupBy("market_id", "wallet", column).agg(F.sum("usdc").alias("usd"), F.min(F.struct("ts", "seq")).alias("seen"))
    best = F.min_by(F.struct(F.col(column).alias("value"), "usd"), F.struct((-F.col("usd")).alias("usd"), "seen"))
    return totals.groupBy("market_id", "wallet").agg(best.alias("b")).select("market_id", "wallet", F.col("b.value").alias(f"dominant_{column}"), F.col("b.usd").alias(f"dominant_{column}_usd"))


def wallet_context(trades: DataFrame) -> DataFrame:
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    return trades.groupBy("market_id", "wallet").agg(
        F.sum("usdc").alias("total_usdc"), F.max("usdc").alias("max_usdc"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("trade_count"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.min(F.when(sell, F.col("ts"))).alias("first_sell_ts"),
        F.avg(F.abs(F.col("price") - 0.5) * 2).alias("odds_extremity"),
    )


def first_sell_time(trades: DataFrame) -> DataFrame:
    return trades.groupBy("market_id", "wallet").agg(F.min(F.when(F.col("side") == "SELL", F.col("ts"))).alias("first_sell_ts"))


def market_trade_percentiles(trades: DataFrame) -> DataFrame:
    """Interpolated median and p95 of trade USD by market, from counts by value."""
    q = exact_percentiles(trades.select("market_id", "usdc"), ["market_id"], "usdc", {"median_usdc": 0.5, "p95_usdc": 0.95})
    return q.select("market_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median_usdc", "p95_usdc")))


def flow_share(trades: DataFrame) -> DataFrame:
    """The largest share of a wallet in the signed flow of a market's 5-minute bucket, at most 1.

    A market bucket is the sum of its wallets' buckets, so trades are shuffled once."""
    signed = F.when(F.col("side") == "BUY", F.col("usdc")).otherwise(-F.col("usdc"))
    bucket = F.floor(micros(F.col("ts")) / 300_000_000)
    own = trades.groupBy("market_id", bucket.alias("bucket"), "wallet").agg(F.sum(signed).alias("flow"))
    market = own.groupBy("market_id", "bucket").agg(F.abs(F.sum("flow")).alias("market_flow"))
    share = F.when(F.col("market_flow") > 0, clamp(F.abs("flow") / F.col("market_flow"))).otherwise(0.0)
    return own.join(market, ["market_id", "bucket"]).groupBy("market_id", "wallet").agg(F.max(share).alias("flow_share"))


def realized_volatility(trades: DataFrame) -> DataFrame:
    """Mean over a market's assets of the mean absolute return between trades."""
    rows = trades.select("market_id", "asset", "ts", "seq", "price")
    steps = SegmentedScan(rows, ["market_id", "asset"], hour_of(F.col("ts")), ["ts", "seq"]).lag("before", F.col("price")).rows()
    steps = steps.withColumn("r", F.when(F.col("before") > 0, F.abs(F.col("price") / F.when(F.col("before") > 0, F.col("before")) - 1)))
    assets = steps.groupBy("market_id", "asset").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("v"))
    return assets.groupBy("market_id").agg(F.avg("v").alias("realized_volatility"))


def average_spread_bps(books: DataFrame, key: str = "market_id") -> DataFrame:
    return books.groupBy(key).agg(F.avg(F.col("spread") * 10000).alias("average_spread_bps"))


def pair_inputs(trades: DataFrame, profiles: DataFrame) -> DataFrame:
    """What pairs are scored by: one row for each wallet of a market."""
    context = wallet_context(trades).join(dominant(trades, "outcome"), ["market_id", "wallet"]).join(profiles, "wallet", "left")
    return context.select("market_id", "wallet", "first_ts", "first_sell_ts", "total_usdc", "dominant_outcome", "first_seen")


def pair_rollup(pairs: DataFrame) -> DataFrame:
    """By wallet: the best pair score, and the number of pairs at 60 or more."""
    both = pairs.select("market_id", "score", F.explode(F.array("left_wallet", "right_wallet")).alias("wallet"))
    return both.groupBy("market_id", "wallet").agg(F.max("score").alias("max_pair_score"), F.count_if(F.col("score") >= LINKED).alias("linked_wallets"))


def wallet_metrics(markets: DataFrame, trades: DataFrame, profiles: DataFrame, books: DataFrame, pairs: DataFrame, realized: DataFrame) -> DataFrame:
    """All metrics of every wallet, normalised to 0..1, with what they rest on."""
    w = wallet_context(trades)
    for part in (dominant(trades, "outcome"), dominant(trades, "asset"), flow_share(trades), payout_score(markets, trades), pair_rollup(pairs), realized):
        w = w.join(part, ["market_id", "wallet"], "left")
    w = w.join(profiles, "wallet", "left")
    w = w.join(books.select(F.col("asset").alias("dominant_asset"), "spread", "bid_depth_usd", "ask_depth_usd", F.lit(True).alias("has_book")), "dominant_asset", "left")
    facts = market_deadline(market_mode(markets)).select("market_id", "mode", "deadline", "open_interest", "resolved")
    facts = facts.join(market_trade_percentiles(trades), "market_id", "left").join(realized_volatility(trades), "market_id", "left")
    w = w.join(facts, "market_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    top = lambda *cs: F.greatest(*cs, F.lit(1.0))
    has = F.coalesce("has_book", F.lit(False))
    depth = F.when(has, clamp(F.col("max_usdc") / top(F.col("ask_depth_usd"), F.col("bid_depth_usd")))).otherwise(0.0)
    oi = F.when(F.col("open_interest") > 0, clamp(F.col("max_usdc") / top(F.col("open_interest") * 0.05))).otherwise(0.0)
    gap = F.greatest((seconds("first_ts") - seconds("first_seen")) / 3600, F.lit(0.0))
    novelty = F.when(F.col("total_markets_traded").isNotNull(), 1 - clamp((F.col("total_markets_traded") - 1) / 20)).otherwise(0.2)
    fresh = F.when(F.col("first_seen").isNotNull(), 1 - clamp(gap / 72)).otherwise(0.2)
    shock = clamp(F.col("max_usdc") / top(F.col("p95_usdc") * 1.5))
    made = {
        "timingAnomaly": F.when(F.col("deadline").isNull(), 0.0).otherwise(1 - clamp((seconds("deadline") - seconds("first_ts")) / HOURS_72)),
        "marketSizeAnomaly": clamp(F.col("max_usdc") / top(F.col("p95_usdc") * 1.25)),
        "walletSizeAnomaly": clamp(F.col("max_usdc") / top(F.col("total_usdc") / F.col("trade_count"), F.col("median_usdc"))),
        "oddsDepthOiPressure": 0.4 * depth + 0.35 * oi + 0.25 * F.col("odds_extremity"),
        "orderFlowPressure": clamp(zero("flow_share")),
        "directionalConcentration": clamp(F.col("dominant_outcome_usd") / top(F.col("total_usdc"))),
        "spreadVolatilityRegime": 0.6 * F.when(F.col("spread").isNull(), 0.5).otherwise(1 - clamp(F.col("spread") / 0.12)) + 0.4 * clamp(zero("realized_volatility") / 0.06),
        "newWalletShock": 0.45 * novelty + 0.3 * fresh + 0.25 * shock,
        "linkedWalletCoordination": clamp(zero("max_pair_score") / 100),
        "realizedMarkout": F.when(F.col("realized_bps").isNotNull(), clamp(F.greatest("realized_bps", F.lit(0.0)) / 5000)).otherwise(zero("payout_score")),
    }
    return w.withColumns(made).withColumn("linked_wallets", F.coalesce("linked_wallets", F.lit(0)))


def payout_score(markets: DataFrame, trades: DataFrame) -> DataFrame:
    """Mean payout of a wallet's trades at the resolution, 0..1; 0 where the market is not resolved."""
    m = markets.select("market_id", "resolved", "resolution")
    t = trades.join(m, "market_id")
    end = settlement_price(F.col("resolved"), F.col("resolution"), F.col("outcome"))
    gain = F.when(F.col("side") == "BUY", end - F.col("price")).otherwise(F.col("price") - end) / F.greatest(F.col("price"), F.lit(0.01))
    return t.groupBy("market_id", "wallet").agg(F.coalesce(F.avg(clamp(gain / 0.5)), F.lit(0.0)).alias("payout_score"))


def score_wallets(metrics: DataFrame) -> DataFrame:
    """Adds ``metrics`` (array of structs), ``combined_score``, ``live_score``, ``post_event_score`` and ``reasons``."""
    live = F.col("mode") == "live"

    def one(name: str) -> Column:
        label, on, off = METRICS[name]
        weight = F.when(live, F.lit(on)).otherwise(F.lit(off))
        return F.struct(
            F.lit(name).alias("id"), F.lit(label).alias("label"), F.col(name).alias("raw"), weight.alias("weight"), F.round(F.col(name), 4).alias("normalized"), F.round(F.col(name) * weight, 4).alias("contribution")
        )

    out = metrics.withColumn("metrics", F.array(*map(one, METRICS)))
    # contributions have four places, so their sum is exact, and scores are rounded as decimals, halves up
    total = lambda f: F.aggregate(F.col("metrics"), F.lit(0).cast("decimal(28,4)"), lambda a, m: (a + m[f].cast("decimal(28,4)")).cast("decimal(28,4)")).cast("double")
    two = lambda c: F.round(c.cast("decimal(18,8)"), 2).cast("double")
    out = out.withColumn("__score", total("contribution") / total("weight") * 100)
    # strongest first; metrics of equal contribution keep their order
    strong = F.filter("metrics", lambda m: (m["normalized"] >= 0.65) & (m["weight"] > 0))
    ranked = F.array_sort(F.transform(strong, lambda m, i: F.struct((-m["contribution"]).alias("c"), i.alias("i"), m["label"].alias("label"), m["id"].alias("id"))))
    # ends of the reasons (fixed values)
    after = lambda m: F.when((m["id"] == "realizedMarkout") & ~live, " lit up after the market closed.").otherwise(".")
    return out.withColumns(
        {
            "combined_score": two(F.col("__score")),
            "live_score": two(F.when(live, F.col("__score")).otherwise(F.col("__score") * 0.92)),
            "post_event_score": two(F.when(live, F.col("__score") * 0.88).otherwise(F.col("__score"))),
            "reasons": F.transform(F.slice(ranked, 1, 3), lambda m: F.concat(m["label"], after(m))),
        }
    ).drop("__score")


def top_wallets(scored: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("market_id").orderBy(F.col("combined_score").desc(), F.col("first_ts"), F.col("wallet"))
    return scored.withColumn("wallet_rank", F.row_number().over(w)).filter(F.col("wallet_rank") <= n)


def recent_trades(trades: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("market_id").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return trades.withColumn("recent_rank", F.row_number().over(w)).filter(F.col("recent_rank") <= n)


def interesting_wallets(trades: DataFrame, holders: DataFrame, n_trades: int = 20, n_holders: int = 10, most: int = 25) -> DataFrame:
    """Wallets of the largest trades, then the first holders; the first occurrence counts."""
    t = trades.withColumn("k", F.row_number().over(Window.partitionBy("market_id").orderBy(F.col("usdc").desc(), F.col("ts"), F.col("seq")))).filter(F.col("k") <= n_trades)
    h = holders.withColumn("k", F.row_number().over(Window.partitionBy("market_id").orderBy("place", "wallet"))).filter(F.col("k") <= n_holders)
    both = t.select("market_id", "wallet", "k").union(h.select("market_id", "wallet", F.col("k") + n_trades))
    first = both.groupBy("market_id", "wallet").agg(F.min("k").alias("priority"))
    w = Window.partitionBy("market_id").orderBy("priority")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def market_snapshot(markets: DataFrame, trades: DataFrame, scored: DataFrame, pairs: DataFrame, books: DataFrame) -> DataFrame:
    """One row for each market: its best wallets, pairs, latest trades and signals."""
    gather = lambda df, rank, *cols: df.groupBy("market_id").agg(F.sort_array(F.collect_list(F.struct(rank, *cols))).alias("x"))
    wallets = gather(top_wallets(scored), "wallet_rank", "wallet", "combined_score", "reasons").withColumnRenamed("x", "suspicious_wallets")
    linked = gather(pairs, "pair_rank", "pair_key", "score").withColumnRenamed("x", "linked_pairs")
    recent = gather(recent_trades(trades), "recent_rank", "wallet", "side", "usdc", "ts").withColumnRenamed("x", "recent_trades")
    facts = trades.groupBy("market_id").agg(F.count("*").alias("trade_count"), F.round(F.sum("usdc"), 2).alias("total_volume_usdc"))
    facts = facts.join(trades.select("market_id", "wallet").distinct().groupBy("market_id").agg(F.count("*").alias("wallet_count")), "market_id")
    assets = trades.select("market_id", "asset").distinct().join(books, "asset")
    out = market_mode(markets).select("market_id", "mode", "open_interest").join(facts, "market_id", "left")
    out = out.join(average_spread_bps(assets), "market_id", "left").join(realized_volatility(trades), "market_id", "left")
    for part in (wallets, linked, recent):
        out = out.join(part, "market_id", "left")
    return out.withColumns({"average_spread_bps": F.round("average_spread_bps", 2), "realized_volatility": F.round("realized_volatility", 4)})


# ---- markouts by horizon

HORIZONS = {"5m": 5, "30m": 30, "1h": 60, "4h": 240, "to_resolution": None}


def horizon_markouts(markets: DataFrame, trades: DataFrame, history: DataFrame, horizons: dict[str, int | None] = HORIZONS) -> DataFrame:
    """Notional-weighted bps by wallet and ``horizon``; ``history`` is (asset, ts, price).  The price is the first at or after the
    horizon, or else the last one there is; without minutes it is that of the settlement.

    A trade is sent to one as-of join with the targets of all its horizons, so quotes are shuffled once."""
    ahead = [(name, minutes) for name, minutes in horizons.items() if minutes is not None]
    columns = ["market_id", "wallet", "asset", "side", "outcome", "price", "size", "usdc"]
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(m).alias("minutes")) for n, m in ahead))).alias("at") if ahead else None
    out = None
    if ahead:
        probes = trades.select(*columns, "ts", at).select(*columns, "at.horizon", F.timestamp_add("MINUTE", F.col("at.minutes"), F.col("ts")).alias("target"))
        out = price_forward_or_last(probes, history).select(*columns, "horizon", "future")
    for name in (n for n, m in horizons.items() if m is None):
        settled = trades.select(*columns).join(markets.select("market_id", "resolved", "resolution"), "market_id")
        settled = settled.select(*columns, F.lit(name).alias("horizon"), settlement_price(F.col("resolved"), F.col("resolution"), F.col("outcome")).alias("future"))
        out = settled if out is None else out.unionByName(settled)
    notional = F.when(F.col("future").isNotNull(), F.greatest(F.col("price") * F.col("size"), F.col("usdc"), F.lit(1.0)))
    bps = entry_bps(F.col("price"), F.col("future"), F.col("side"))
    return out.groupBy("market_id", "wallet", "horizon").agg(
        F.try_divide(F.sum(bps * notional), F.sum(notional)).alias("weighted_bps"), F.count("future").alias("matched_trades"), F.count("*").alias("trade_count")
    )


def price_forward_or_last(probes: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``future``: the asset's first price at or after ``target``, else its last price, else null."""
    from .asof import asof_forward

    found = asof_forward(probes, history, "asset", F.col("target"), F.col("ts"), {"__ahead": F.col("price")}, [F.col("price")])
    last = history.filter(F.col("ts").isNotNull()).groupBy("asset").agg(F.max_by("price", F.struct("ts", "price")).alias("__last"))
    return found.join(last, "asset", "left").withColumn("future", F.coalesce("__ahead", "__last")).drop("__ahead", "__last")


def horizon_wallet_order(result: DataFrame) -> DataFrame:
    return result.orderBy(F.col("weighted_bps").desc_nulls_last(), "market_id", "wallet")
