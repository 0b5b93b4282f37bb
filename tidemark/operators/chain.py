"""The batch chain: clean, attach the forward price, one row per participant, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import Params
from .asof import asof_forward

#: The order of trades of one instant.
TIE = ("block_number", "transaction_hash", "order_hash")


def filter_valid_trades(trades: DataFrame, contract_takers: tuple[str, ...]) -> DataFrame:
    """Price and asset present, taker known and not a contract."""
    return trades.filter(F.col("price").isNotNull() & F.col("asset_id").isNotNull() & ~F.lower("taker").isin(*contract_takers))


def prepare_trades(trades: DataFrame, params: Params) -> DataFrame:
    """Cleaned trades with ``price_yes``, scaled amounts, ``trade_time`` and ``year_month``."""
    time = F.col("trade_time") if "trade_time" in trades.columns else S.trade_time(F.col("datetime"), F.col("timestamp"))
    return filter_valid_trades(trades, params.contract_takers).withColumns(
        {
            "price_yes": S.yes_price(F.col("price"), F.col("nonusdc_side")),
            "token_amount": S.scaled(F.col("token_amount"), params.amount_decimals),
            "usd_amount": S.scaled(F.col("usd_amount"), params.amount_decimals),
            "trade_time": time,
            "year_month": S.month_key(time),
        }
    )


def asof_forward_price(prepared: DataFrame, horizon_minutes: int) -> DataFrame:
    """Adds ``target_time, future_trade_time, future_price_yes, future_lag_seconds``: the first price of the
    asset at or after the horizon; nulls where there is none."""
    rows = prepared.filter(F.col("trade_time").isNotNull() & F.col("price_yes").isNotNull())
    probes = rows.withColumn("target_time", F.timestamp_add("MINUTE", F.lit(horizon_minutes), F.col("trade_time")))
    found = asof_forward(
        probes, rows, "asset_id", F.col("target_time"), F.col("trade_time"),
        {"future_trade_time": F.col("trade_time"), "future_price_yes": F.col("price_yes")}, [F.col(c) for c in TIE],
    )
    return found.withColumn("future_lag_seconds", (S.micros(F.col("future_trade_time")) - S.micros(F.col("target_time"))) / 1e6)


def maker_taker_unpivot(trades: DataFrame) -> DataFrame:
    """Two rows for each trade, with ``user, role, direction`` of the maker and of the taker."""
    sides = F.array(*(F.struct(F.col(r).alias("user"), F.lit(r).alias("role"), F.col(f"{r}_direction").alias("direction")) for r in ("maker", "taker")))
    rest = [c for c in trades.columns if c not in ("maker", "taker", "maker_direction", "taker_direction")]
    return trades.select(*rest, F.inline(sides))


def with_labels(rows: DataFrame) -> DataFrame:
    side = S.direction_side(F.col("direction"))
    return rows.withColumn("side", side).withColumns(
        {
            "signed_token_amount": F.col("side") * F.col("token_amount"),
            "markout": S.markout(F.col("price_yes"), F.col("future_price_yes"), F.col("side")),
            "markout_bps": S.markout_bps(F.col("price_yes"), F.col("future_price_yes"), F.col("side")),
            "label": S.binary_label(S.markout(F.col("price_yes"), F.col("future_price_yes"), F.col("side"))),
        }
    )


def label_quality(max_future_lag_seconds: float | None, min_abs_bps: float) -> Column:
    """Rows to keep.  Without a least bps, rows whose bps is null stay."""
    keep = F.col("side").isNotNull() & F.col("future_price_yes").isNotNull()
    if max_future_lag_seconds is not None:
        keep = keep & (F.col("future_lag_seconds") <= max_future_lag_seconds)
    if min_abs_bps > 0:
        keep = keep & (F.abs("markout_bps") >= min_abs_bps)
    return keep


def label_user_trades(prepared: DataFrame, params: Params) -> DataFrame:
    rows = maker_taker_unpivot(asof_forward_price(prepared, params.horizon_minutes))
    return with_labels(rows).filter(label_quality(params.max_future_lag_seconds, params.min_abs_bps))
