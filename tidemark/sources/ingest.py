"""JSON payloads (a string column) to typed rows, with field-name fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_time_ms, number, string_list


def field(payload: str | Column, *names: str) -> Column:
    """The first of the fields that is there, as text."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.coalesce(*(F.get_json_object(p, f"$.{n}") for n in names))


def text(payload: str | Column, *names: str) -> Column:
    return F.coalesce(field(payload, *names), F.lit(""))


def _flag(payload: str, name: str) -> Column:
    return F.coalesce(field(payload, name), F.lit("")).isin("true", "1")


def ingest_trades(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Trades with a wallet and a side of BUY or SELL; other payloads are dropped."""
    p = payload
    out = rows.select(
        F.lower(text(p, "proxyWallet", "user", "walletAddress")).alias("wallet"), F.upper(text(p, "side")).alias("side"), text(p, "asset", "asset_id").alias("asset"),
        text(p, "conditionId", "condition_id").alias("condition_id"), text(p, "outcome").alias("outcome"), number(field(p, "outcomeIndex", "outcome_index")).alias("outcome_index"),
        number(field(p, "price")).alias("price"), number(field(p, "size")).alias("size"),
        F.when(field(p, "usdcSize", "usdc_size", "usd_amount").isNotNull(), number(field(p, "usdcSize", "usdc_size", "usd_amount"))).otherwise(number(field(p, "size")) * number(field(p, "price"))).alias("usdc_size"),
        any_time_ms(field(p, "timestamp", "occurredAt", "occurred_at")).alias("timestamp_ms"), text(p, "transactionHash", "transaction_hash").alias("transaction_hash"),
    )
    return out.filter((F.col("wallet") != "") & F.col("side").isin("BUY", "SELL"))


def ingest_holders(rows: DataFrame, payload: str = "payload") -> DataFrame:
    out = rows.select(
        F.lower(text(payload, "holder", "user", "proxyWallet")).alias("wallet"), text(payload, "asset", "asset_id").alias("asset"),
        number(field(payload, "balance", "amount", "size")).alias("amount"), number(field(payload, "outcomeIndex", "outcome_index")).alias("outcome_index"),
    )
    return out.filter(F.col("wallet") != "")


def ingest_markets(rows: DataFrame, payload: str = "payload", event: str = "event") -> DataFrame:
    """Markets with the fields of their event as fallback; list fields may be JSON text or arrays."""
    p, e = payload, event
    prices = string_list(field(p, "outcomePrices"))
    return rows.select(
        text(p, "id", "marketId", "conditionId").alias("market_id"),
        F.coalesce(field(p, "slug"), field(e, "slug"), F.lit("")).alias("market_slug"),
        text(p, "conditionId", "condition_id").alias("condition_id"),
        F.coalesce(field(p, "eventId", "event_id"), field(e, "id"), F.lit("")).alias("event_id"),
        F.coalesce(field(e, "title"), field(p, "title", "question"), F.lit("")).alias("event_title"),
        F.coalesce(field(p, "question", "title"), field(e, "title"), F.lit("")).alias("question"),
        _flag(p, "active").alias("active"), _flag(p, "closed").alias("closed"), _flag(p, "resolved").alias("resolved"),
        field(p, "resolution", "outcome").alias("resolution"),
        field(p, "endDate").alias("end_date"), field(p, "closeTime").alias("close_time"), field(p, "resolutionDate").alias("resolution_date"),
        string_list(field(p, "outcomes", "outcomeNames")).alias("outcomes"),
        F.transform(prices, lambda x: number(x)).alias("outcome_prices"),
        string_list(field(p, "clobTokenIds", "clob_token_ids")).alias("token_ids"),
        field(p, "volume").try_cast("double").alias("volume"), field(p, "liquidity").try_cast("double").alias("liquidity"),
    )


_LEVELS = "array<struct<price:string,size:string>>"


def ingest_books(rows: DataFrame, payload: str = "payload", asset: str = "asset") -> DataFrame:
    """Best bid and ask, midpoint, spread and depth in USD of order-book levels."""
    side = lambda n: F.coalesce(F.from_json(field(payload, n), _LEVELS), F.array().cast(_LEVELS))
    out = rows.select(asset, side("bids").alias("bids"), side("asks").alias("asks"))
    best = lambda n: F.when(F.size(n) > 0, number(F.get(n, 0)["price"]))
    depth = lambda n: F.aggregate(n, F.lit(0.0), lambda a, x: a + number(x["price"]) * number(x["size"]))
    out = out.select(asset, best("bids").alias("best_bid"), best("asks").alias("best_ask"), depth("bids").alias("bid_depth_usd"), depth("asks").alias("ask_depth_usd"))
    return out.withColumns({"midpoint": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.col("best_ask") - F.col("best_bid")}).withColumn("last_trade_price", F.col("midpoint"))


def ingest_price_history(rows: DataFrame, payload: str = "payload", asset: str = "asset") -> DataFrame:
    """Points (asset, time in ms, price) with a positive time."""
    points = F.from_json(field(payload, "history"), "array<struct<t:string,timestamp:string,time:string,p:string,price:string>>")
    out = rows.select(asset, F.explode(points).alias("x"))
    ms = F.coalesce(any_time_ms(F.coalesce("x.t", "x.timestamp", "x.time")), F.lit(0))
    return out.select(asset, ms.alias("timestamp_ms"), number(F.coalesce("x.p", "x.price")).alias("price")).filter((F.col("timestamp_ms") > 0) & ~F.isnan("price"))


def ingest_profiles(rows: DataFrame, traded: str = "traded", activity: str = "activity", wallet: str = "wallet") -> DataFrame:
    """Number of markets (a number, or an object with count or total) and time of the first activity."""
    scalar = F.col(traded).try_cast("double")
    thing = F.when(F.ltrim(traded).startswith("{"), number(field(traded, "count", "total")))
    first = F.get_json_object(activity, "$[0]")
    return rows.select(wallet, F.coalesce(scalar, thing).alias("total_markets_traded"), any_time_ms(field(first, "timestamp", "occurredAt", "occurred_at")).alias("first_seen_ms"))


def ingest_open_interest(rows: DataFrame, payload: str = "payload", key: str = "condition_id") -> DataFrame:
    """A number, or an object with openInterest, oi or value."""
    thing = F.when(F.ltrim(payload).startswith("{"), field(payload, "openInterest", "oi", "value").try_cast("double"))
    return rows.select(key, F.coalesce(F.col(payload).try_cast("double"), thing).alias("open_interest"))


def select_event_market(markets: DataFrame, wanted: DataFrame) -> DataFrame:
    """One market of each event.  ``wanted``: event_id, market_slug, label (either may be null).

    The exact slug first; else among label matches, if there are any; in the best status group with
    token ids; the earliest date, then the highest volume plus liquidity.
    """
    from pyspark.sql import Window

    from ..functions.scalars import contains_in_any, plain_words

    m = markets.join(wanted.select("event_id", F.col("market_slug").alias("want_slug"), F.col("label").alias("want_label")), "event_id")
    label = plain_words(F.col("want_label"))
    hit = (label != "") & contains_in_any([plain_words(F.col(c)) for c in ("slug", "question", "title")], label)
    tokens = F.size("token_ids") > 0
    active, closed, resolved = (F.coalesce(c, F.lit(False)) for c in ("active", "closed", "resolved"))
    group = F.when(tokens & active & ~closed & ~resolved, 0).when(tokens & active & ~closed, 1).when(tokens & ~resolved, 2).when(tokens, 3).otherwise(4)
    m = m.withColumns({
        "__exact": F.when(F.col("slug") == F.col("want_slug"), 0).otherwise(1), "__label": F.when(hit, 0).otherwise(1), "__group": group,
        "__date": F.coalesce("close_time", "end_date", "resolution_date"), "__worth": F.coalesce("volume", F.lit(0.0)) + F.coalesce("liquidity", F.lit(0.0)),
    })
    w = Window.partitionBy("event_id").orderBy("__exact", "__label", "__group", F.col("__date").asc_nulls_last(), F.col("__worth").desc(), F.col("market_id"))
    return m.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(*markets.columns)
