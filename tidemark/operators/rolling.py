"""Trailing features of labelled rows.

A frame of one hour needs rows of the same and of the hour before.  So every row is also sent to the
next hour's bucket of its key, as context, and windows run inside (key, hour).  A hot market is
spread over its hours and each row is shuffled at most twice.  Inside a bucket a frame is the end of the
hour before and the beginning of its own hour; both are running frames, one from late to early and one from early
to late, so each is one pass however many rows an hour has, and the two parts are put together row by row.
Their bounds are exact in micros: ``t - 1h <= x <= t``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, role_flag
from .chain import TIE
from .scan import SegmentedScan, hour_of

HOUR = 3_600_000_000
#: The order of rows of one stream.
ORDER = ("trade_time", *TIE, "role")
#: Everything that the trailing features read; other columns of a row travel once.
READ = ("user", "market_id", "trade_time", *TIE, "role", "usd_amount", "price_yes", "signed_token_amount")


class Trailing:
    """An aggregate of a frame from its two parts: ``parts`` makes running aggregates of the rows that a condition picks, and
    ``whole`` puts those of the earlier and of the later part together."""

    def __init__(self, parts: Callable[[Column], dict[str, Column]], whole: Callable[[dict[str, Column], dict[str, Column]], Column]) -> None:
        self.parts, self.whole = parts, whole


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def count() -> Trailing:
    return Trailing(lambda on: {"n": F.count_if(on)}, lambda a, b: a["n"] + b["n"])


def total(c: str) -> Trailing:
    """Null where no value is known."""
    return Trailing(lambda on: {"s": F.sum(F.when(on, F.col(c)))}, lambda a, b: F.coalesce(a["s"] + b["s"], a["s"], b["s"]))


def mean(c: str) -> Trailing:
    parts = lambda on: {"n": F.count(F.when(on, F.col(c))), "s": F.sum(F.when(on, F.col(c)))}
    return Trailing(parts, lambda a, b: F.try_divide(_or_zero(a["s"]) + _or_zero(b["s"]), a["n"] + b["n"]))


def spread(c: str) -> Trailing:
    """The population standard deviation; those of the parts and the distance of their means make that of the whole."""

    def parts(on: Column) -> dict[str, Column]:
        x = F.when(on, F.col(c))
        return {"n": F.count(x), "m": F.avg(x), "v": F.var_pop(x)}

    def whole(a: dict[str, Column], b: dict[str, Column]) -> Column:
        n, far = a["n"] + b["n"], a["m"] - b["m"]
        both = a["n"] * a["v"] + b["n"] * b["v"] + far * far * a["n"] * b["n"] / n
        return F.when(b["n"] == 0, F.sqrt(a["v"])).when(a["n"] == 0, F.sqrt(b["v"])).otherwise(F.sqrt(both / n))

    return Trailing(parts, whole)


def earliest(c: str) -> Trailing:
    """The value of the frame's first row."""
    place = F.struct("trade_time", *TIE, "role")
    return Trailing(lambda on: {"f": F.min_by(F.struct(F.col(c).alias("v")), F.when(on, place))}, lambda a, b: F.coalesce(a["f"], b["f"])["v"])


def trailing(rows: DataFrame, keys: list[str], made: dict[str, Trailing], finer: dict[str, dict[str, Trailing]] | None = None) -> DataFrame:
    """Adds ``made``, aggregates over the trailing hour of ``keys``; ``finer``: by one more column those of ``keys`` and this
    column, from the same shuffle."""
    columns = rows.columns
    at = rows.withColumn("__t", micros(F.col("trade_time"))).withColumn("__hour", F.floor(F.col("__t") / HOUR))
    # where a row stands in a bucket: in its own at its time, in the next one at the time until which it counts
    sent = at.withColumn("__late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"__bucket": F.col("__hour") + F.col("__late"), "__at": F.col("__t") + F.col("__late") * HOUR})
    own = F.col("__late") == 0
    sent = sent.withColumns({c: F.when(own, F.col(c)) for c in columns if c not in READ})
    groups = {(): made, **{(c,): m for c, m in (finer or {}).items()}}
    # the later parts are made of a bucket's own rows alone, so the others go before them
    for side, on, column in (("a", ~own, F.col("__at").desc()), ("b", own, F.col("__at").asc())):
        for more, aggregates in groups.items():
            frame = Window.partitionBy(*keys, *more, "__bucket").orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            sent = sent.withColumns({f"__{side}_{name}_{k}": c.over(frame) for name, what in aggregates.items() for k, c in what.parts(on).items()})
        sent = sent.filter(own)
    every = {name: what for aggregates in groups.values() for name, what in aggregates.items()}
    of = lambda side, name, what: {k: F.col(f"__{side}_{name}_{k}") for k in what.parts(own)}
    whole = {name: what.whole(of("a", name, what), of("b", name, what)) for name, what in every.items()}
    return sent.withColumns(whole).select(*columns, *(n for n in every if n not in columns))


def market_hour(rows: DataFrame) -> DataFrame:
    """Market features; counts and volumes are halved, since a trade has two rows."""
    out = trailing(
        rows,
        ["market_id"],
        {"__n": count(), "__v": total("usd_amount"), "__m": mean("price_yes"), "market_price_std_1h": spread("price_yes"), "__f": earliest("price_yes")},
    )
    return out.withColumns(
        {
            "market_trade_count_1h": F.col("__n") / 2.0,
            "market_volume_1h": F.coalesce(F.col("__v") / 2.0, F.lit(0.0)),
            "market_price_mean_1h": F.coalesce("__m", "price_yes", F.lit(0.0)),
            "market_price_std_1h": F.coalesce("market_price_std_1h", F.lit(0.0)),
            "market_price_return_1h": F.coalesce(F.col("price_yes") - F.col("__f"), F.lit(0.0)),
        }
    ).drop("__n", "__v", "__m", "__f")


_USER = {"user_trade_count_1h": count(), "__s": total("signed_token_amount"), "__v": total("usd_amount")}
_USER_MARKET = {"user_market_trade_count_1h": count()}


def _of_user(out: DataFrame) -> DataFrame:
    out = out.withColumn("user_trade_count_1h", F.col("user_trade_count_1h").cast("double"))
    return out.withColumn("user_signed_flow_1h", F.coalesce("__s", F.lit(0.0))).withColumn("user_usd_volume_1h", F.coalesce("__v", F.lit(0.0))).drop("__s", "__v")


def _of_user_market(out: DataFrame) -> DataFrame:
    return out.withColumn("user_market_trade_count_1h", F.col("user_market_trade_count_1h").cast("double"))


def user_hour(rows: DataFrame) -> DataFrame:
    return _of_user(trailing(rows, ["user"], _USER))


def user_market_hour(rows: DataFrame) -> DataFrame:
    return _of_user_market(trailing(rows, ["user", "market_id"], _USER_MARKET))


def user_market_stream(rows: DataFrame, large: int | None = None) -> DataFrame:
    """``seq`` (row number), ``time_delta_seconds`` and ``market_age_seconds`` of (user, market); the age counts
    from the first row of that pair, as its name does not say.  ``large``: see ``SegmentedScan``."""
    t = micros(F.col("trade_time"))
    scan = SegmentedScan(rows, ["user", "market_id"], hour_of(F.col("trade_time")), list(ORDER), large)
    out = scan.number("seq").lag("__before", t).first("__start", t).rows()
    return out.withColumns(
        {
            "time_delta_seconds": F.coalesce((t - F.col("__before")) / 1e6, F.lit(0.0)),
            "market_age_seconds": (t - F.col("__start")) / 1e6,
            "role_is_maker": role_flag(F.col("role")),
        }
    ).drop("__before", "__start")


def price_return(trades: DataFrame) -> DataFrame:
    """``price_return``: the price against that of the market's trade before; null for its first one."""
    scan = SegmentedScan(trades, ["market_id"], hour_of(F.col("trade_time")), ["trade_time", "block_number"])
    return scan.lag("__price", F.col("price_yes")).rows().withColumn("price_return", F.try_divide("price_yes", "__price") - 1).drop("__price")


def enrich(labeled: DataFrame) -> DataFrame:
    """All trailing features and the stream columns.  The latter come first: their operator reads its rows twice."""
    return trailing_features(user_market_stream(labeled))


def trailing_features(rows: DataFrame) -> DataFrame:
    """The features of the trailing hour; those of a user and of a user in a market come from one shuffle."""
    return _of_user_market(_of_user(trailing(market_hour(rows), ["user"], _USER, {"market_id": _USER_MARKET})))
