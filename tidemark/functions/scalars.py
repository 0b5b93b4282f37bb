"""Column functions: prices, sides, times, text and number coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for the two directions (fixed values).
BUY_WORDS = ("buy", "bid", "b", "long")
SELL_WORDS = ("sell", "ask", "s", "short")


def yes_price(price: Column, side: Column, trim: bool = False) -> Column:
    """``1 - price`` for token2, else the price."""
    side = F.coalesce(side, F.lit(""))
    return F.when(F.lower(F.trim(side) if trim else side) == "token2", 1.0 - price).otherwise(price)


def direction_side(direction: Column) -> Column:
    """1 for buy words, -1 for sell words, else null; buy words are asked first."""
    word = F.lower(F.trim(F.coalesce(direction, F.lit(""))))
    buys = word.isin(*BUY_WORDS) | word.contains("buy") | word.contains("bid") | word.startswith("+")
    sells = word.isin(*SELL_WORDS) | word.contains("sell") | word.contains("ask") | word.startswith("-")
    return F.when(word.isin(*BUY_WORDS), 1).when(word.isin(*SELL_WORDS), -1).when(buys, 1).when(sells, -1)


def role_flag(role: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(role, F.lit("")))) == "maker", 1.0).otherwise(0.0)


def scaled(amount: Column, decimals: int) -> Column:
    return amount.cast("double") / F.lit(float(10**decimals))


def markout(price: Column, future: Column, side: Column) -> Column:
    return side * (future - price)


def markout_bps(price: Column, future: Column, side: Column) -> Column:
    """Null where the price is 0 or null."""
    return F.when(price != 0, side * (future / price - 1.0) * 10000.0)


def binary_label(value: Column) -> Column:
    return F.when(value > 0, 1).otherwise(0)


def entry_bps(entry: Column, future: Column, side: Column) -> Column:
    """0 for an entry price of 0 or less; SELL turns the sign."""
    sign = F.when(side == "BUY", 1.0).otherwise(-1.0)
    return F.when(entry <= 0, 0.0).otherwise(sign * (future / entry - 1.0) * 10000.0)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def trade_time(datetime: Column, epoch: Column) -> Column:
    """The parsed text, or else the epoch seconds, as a zone-less timestamp."""
    parsed = F.try_to_timestamp(datetime, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(parsed, from_micros(epoch.cast("long") * 1_000_000))


def from_micros(value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", value, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def epoch_of_any_unit(value: Column) -> Column:
    """Microseconds of a numeric time in s, ms, us or ns, told by its magnitude."""
    v = value.cast("long")
    return F.when(v > 10**17, F.floor(v / 1000)).when(v > 10**14, v).when(v > 10**11, v * 1000).otherwise(v * 1_000_000).cast("long")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log1p_positive(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clamp(p, eps, 1.0 - eps)
    return F.ln(p / (1.0 - p))


def number(value: Column, default: float = 0.0) -> Column:
    """A number from anything: blank or unreadable text gives the default."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def string_list(value: Column) -> Column:
    """A JSON array of strings; anything else gives an empty list."""
    return F.when(F.ltrim(value).startswith("["), F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def any_time_ms(value: Column) -> Column:
    """Milliseconds of a number in seconds or milliseconds, or of a readable time text; else null."""
    n = value.try_cast("double")
    text = F.floor(micros(F.try_to_timestamp(F.replace(F.replace(value, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))).cast("timestamp_ntz")) / 1000)
    return F.when(n.isNotNull(), F.floor(F.when(n > 1e12, n).otherwise(n * 1000))).otherwise(text).cast("long")


def plain_words(value: Column) -> Column:
    """Lower case, everything but letters and digits a single space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def contains_in_any(values: Sequence[Column], part: Column) -> Column:
    found = F.lit(False)
    for value in values:
        found = found | F.contains(value, part)
    return found


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def path_part(path: Column, name: str) -> Column:
    """The value of ``name=value`` in a path, or null."""
    return F.nullif(F.regexp_extract(path, f"{name}=([^/]+)", 1), F.lit(""))


def slug(value: Column, length: int = 48) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-")), 1, length)
