"""Small fixtures with known results."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidemark.sources.trades import RAW_SCHEMA

START = 1704067200


def raw_trades(spark, prices, tokens, usd, roles=None, minutes=None):
    """Fills of one market five minutes apart; ``roles``: (maker, taker, maker side, taker side) by row."""
    rows = []
    for i, (price, token, dollar) in enumerate(zip(prices, tokens, usd)):
        at = START + 60 * (minutes[i] if minutes else 5 * i)
        maker, taker, md, td = roles[i] if roles else ("user-a", "user-b", "BUY", "SELL")
        when = (datetime(1970, 1, 1) + timedelta(seconds=at)).strftime("%Y-%m-%d %H:%M:%S")
        rows.append(
            (at, when, i + 1, f"tx{i + 1}", "exchange", "event-1", "e", "E", "market-1", "c1", "Q?", "token1", maker, taker, md, td, price, token, dollar, "asset-1", f"o{i + 1}")
        )
    return spark.createDataFrame(rows, RAW_SCHEMA)


def four(spark):
    return raw_trades(spark, [0.40, 0.55, 0.45, 0.60], [1e6, 1.5e6, 1.2e6, 0.9e6], [4e5, 8.25e5, 5.4e5, 5.4e5])


def stale(spark):
    return raw_trades(spark, [0.5, 0.5002, 0.7, 0.8], [1e6] * 4, [5e5, 5.002e5, 7e5, 8e5], minutes=[0, 5, 10, 25])


def six(spark):
    return raw_trades(spark, [0.40, 0.55, 0.45, 0.60, 0.58, 0.62], [1e6, 1.5e6, 1.2e6, 0.9e6, 1.1e6, 0.8e6], [4e5, 8.25e5, 5.4e5, 5.4e5, 6.38e5, 4.96e5])
