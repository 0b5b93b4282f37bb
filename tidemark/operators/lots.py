"""FIFO matching of sells with open buys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entry_bps
from .scan import SegmentedScan, hour_of

#: Quantities: exact sums of up to 10**15.
EXACT = "decimal(28, 12)"
#: Edges of a key that a range of its quantity holds.
ROWS = 4096


def fifo_lot_match(trades: DataFrame, kept: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Matches of (market, wallet, asset): ``buy_price, sell_price, matched_size``.

    Quantities are laid end to end: a buy covers [bought before, bought with it), and a sell covers the
    stretch of sold quantity that stock allowed.  Sells beyond the stock match nothing:
    sold so far = cs - max(0, max over rows to date of (cs - cb)).  Both sides tile a line, so the starts of
    buys and sells are put in one order, and every stretch between two of them belongs to the last buy and
    the last sell before it.

    Sums, that maximum and what came last are carried from hour to hour of a key, and then from range to range of
    its quantity, so the trades of a key are spread over many tasks.  Quantities are added as decimals of twelve places.

    Each scan reads its rows twice, and they rest on the scan before, so every one of them doubles the work; ``kept`` may write what the
    next one reads, so that it is made once.
    """
    keys = ["market_id", "wallet", "asset"]
    buy = F.col("side") == "BUY"
    size, none = F.col("__size"), F.lit(0).cast(EXACT)
    rows = trades.select(*keys, "side", "price", "ts", "seq", F.col("size").cast(EXACT).alias("__size"))
    order = ["ts", "seq"]
    hours = hour_of(F.col("ts"))
    t = SegmentedScan(rows, keys, hours, order).total("cb", F.when(buy, size), EXACT).total("cs", F.when(~buy, size), EXACT).rows()
    t = kept(t)
    t = SegmentedScan(t, keys, hours, order).peak("over", F.col("cs") - F.col("cb")).rows()
    t = kept(t.withColumn("ms", (F.col("cs") - F.greatest(none, F.col("over"))).cast(EXACT)).drop("cs", "over"))
    t = SegmentedScan(t, keys, hours, order).lag("before", F.col("ms")).rows().withColumn("before", F.coalesce("before", none))
    edges = t.filter(buy | (F.col("ms") > F.col("before"))).select(
        *keys, "ts", "seq", F.when(buy, F.col("cb") - size).otherwise(F.col("before")).cast(EXACT).alias("at"), F.when(buy, F.col("price")).alias("buy"), F.when(~buy, F.col("price")).alias("sell"),
        F.when(buy, F.col("cb")).alias("bought"), F.when(~buy, F.col("ms")).alias("sold"),
    )
    edges = kept(edges)
    # ranges of a key's quantity that hold about ROWS edges each, if they are spread evenly
    sizes = edges.groupBy(*keys).agg((F.max("at").cast("double") * ROWS / F.count("*")).alias("__width"))
    edges = _same_key(edges, sizes, keys)
    place = F.floor(F.try_divide(F.col("at").cast("double"), F.col("__width")))
    scan = SegmentedScan(edges, keys, F.coalesce(place, F.lit(0)), ["at", "ts", "seq"])
    scan.lead("next", F.col("at"))
    for name in ("buy", "sell", "bought", "sold"):
        scan.last_known(f"last_{name}", F.col(name))
    # a stretch ends at the next start, or where the last buy or sell ends
    found = scan.rows().withColumn("matched_size", F.least("next", "last_bought", "last_sold") - F.col("at"))
    found = found.filter("last_buy is not null and last_sell is not null and matched_size > 0")
    return found.select(*keys, F.col("last_buy").alias("buy_price"), F.col("last_sell").alias("sell_price"), F.col("matched_size").cast("double"))


def _same_key(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their key; a hot key's rows are split by AQE, as its facts are one row."""
    renamed = facts.select(F.struct(*keys).alias("__key"), "__width")
    return rows.withColumn("__key", F.struct(*keys)).join(renamed, "__key").drop("__key")


def realized_markout_by_wallet(trades: DataFrame, kept: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Notional-weighted bps over a wallet's matches; wallets without one have no row."""
    m = fifo_lot_match(trades, kept)
    notional = F.col("matched_size") * F.col("buy_price")
    bps = entry_bps(F.col("buy_price"), F.col("sell_price"), F.lit("BUY"))
    return m.groupBy("market_id", "wallet").agg(F.try_divide(F.sum(bps * notional), F.sum(notional)).alias("realized_bps"))
