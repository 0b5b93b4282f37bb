"""Queries of the batch chain: scans, cleaning, as-of, labels, rolling features, windows, splits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chain, rolling, windows
from ..params import QUERY_PARAMS as P
from ..sources import trades as T
from . import base as B
from .base import BASE, ENRICHED, SEQUENCES, WINDOWS, r, rounded, table

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


KEY = ("transaction_hash", "role")

# ---- scans and filters


@query(f"WITH {BASE} SELECT timestamp, datetime, block_number, transaction_hash, contract, event_id, event_slug, event_title, market_id, condition_id, question, nonusdc_side, maker, taker, maker_direction, taker_direction, price, token_amount, round(usd_amount, 6) AS usd_amount, asset_id, order_hash FROM trades")
def scan_trades(spark, sf):
    return rounded(T.scan_trades(B.trades(spark, sf)).drop("trade_time"), "usd_amount")


@query(f"WITH {BASE} SELECT transaction_hash, timestamp FROM trades WHERE timestamp >= 1704844800 AND timestamp < 1705449600")
def scan_time_range(spark, sf):
    return T.scan_time_range(B.trades(spark, sf), datetime(2024, 1, 10), datetime(2024, 1, 17)).select("transaction_hash", "timestamp")


@query(f"WITH {BASE} SELECT transaction_hash, timestamp FROM trades WHERE timestamp BETWEEN 1704844800 AND 1705449600")
def scan_time_range_closed(spark, sf):
    return T.scan_time_range_closed(B.trades(spark, sf), 1704844800, 1705449600).select("transaction_hash", "timestamp")


@query(f"WITH {BASE} SELECT transaction_hash, 0 AS slice FROM trades WHERE timestamp BETWEEN 1704067200 AND 1704153600 UNION ALL SELECT transaction_hash, 1 FROM trades WHERE timestamp BETWEEN 1704844800 AND 1704931200 UNION ALL SELECT transaction_hash, 2 FROM trades WHERE timestamp BETWEEN 1704900000 AND 1705017600")
def union_time_slices(spark, sf):
    return T.union_time_slices(B.trades(spark, sf), [(1704067200, 1704153600), (1704844800, 1704931200), (1704900000, 1705017600)]).select("transaction_hash", "slice")


@query(f"WITH {BASE} SELECT transaction_hash, taker FROM trades WHERE price IS NOT NULL AND asset_id IS NOT NULL AND lower(taker) NOT IN ('0xc1')")
def filter_valid_trades(spark, sf):
    return chain.filter_valid_trades(B.trades(spark, sf), P.contract_takers).select("transaction_hash", "taker")


@query(f"WITH {BASE} SELECT transaction_hash, round(price_yes, 6) AS price_yes, round(token_amount, 6) AS token_amount, round(usd_amount, 6) AS usd_amount, year_month FROM prepared", "prepare_trades", "normalize_yes_price", "scale_amounts", "year_month")
def prepare_trades(spark, sf):
    return rounded(B.prepared(spark, sf).select("transaction_hash", "price_yes", "token_amount", "usd_amount", "year_month"), "price_yes", "token_amount", "usd_amount")


@query(f"WITH {BASE} SELECT transaction_hash, CASE WHEN timestamp % 5 = 0 THEN make_timestamp(timestamp * 1000000) ELSE strptime(datetime, '%Y-%m-%d %H:%M:%S') END AS parsed_time FROM trades")
def derive_trade_time(spark, sf):
    text = F.when(F.col("timestamp") % 5 == 0, "not a time").otherwise(F.col("datetime"))
    return B.trades(spark, sf).select("transaction_hash", S.trade_time(text, F.col("timestamp")).alias("parsed_time"))


@query(f"WITH {BASE} SELECT transaction_hash, timestamp * 1000000 AS micros FROM trades")
def infer_epoch_unit(spark, sf):
    t = F.col("timestamp")
    unit = F.col("block_number") % 4
    raw = F.when(unit == 0, t).when(unit == 1, t * 1000).when(unit == 2, t * 1_000_000).otherwise(t * 1_000_000_000)
    return B.trades(spark, sf).select("transaction_hash", S.epoch_of_any_unit(raw).alias("micros"))


# ---- joins


_PRICED = "transaction_hash, future_trade_time, round(future_price_yes, 6) AS future_price_yes, round(future_lag_seconds, 6) AS future_lag_seconds"


@query(f"WITH {BASE} SELECT {_PRICED} FROM priced", "asof_forward_price", "asof_forward_price_groups")
def asof_forward_price(spark, sf):
    out = chain.asof_forward_price(B.prepared(spark, sf), P.horizon_minutes)
    return rounded(out.select("transaction_hash", "future_trade_time", "future_price_yes", "future_lag_seconds"), "future_price_yes", "future_lag_seconds")


@query(f"""WITH {BASE}, m AS (SELECT event_type AS market_id, max(user_id) AS top_user FROM events WHERE event_type <> 'view' GROUP BY event_type)
SELECT transaction_hash, market_id, top_user FROM prepared LEFT JOIN m USING (market_id)""")
def market_lookup_join(spark, sf):
    m = table(spark, sf, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("market_id")).agg(F.max("user_id").alias("top_user"))
    return B.prepared(spark, sf).join(m, "market_id", "left").select("transaction_hash", "market_id", "top_user")


@query(f"""WITH {BASE} SELECT transaction_hash, "user", role, direction FROM unpivoted""")
def maker_taker_unpivot(spark, sf):
    return chain.maker_taker_unpivot(B.prepared(spark, sf)).select("transaction_hash", "user", "role", "direction")


# ---- labels


@query(f"""WITH {BASE} SELECT transaction_hash, role, direction, CAST(side AS INTEGER) AS side, CASE WHEN role = 'maker' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS role_is_maker FROM sided""", "direction_to_side", "encode_role")
def direction_to_side(spark, sf):
    out = chain.maker_taker_unpivot(B.prepared(spark, sf))
    return out.select(*KEY, "direction", S.direction_side(F.col("direction")).alias("side"), S.role_flag(F.col("role")).alias("role_is_maker"))


@query(f"""WITH {BASE} SELECT transaction_hash, role, "user", side, round(signed_token_amount, 6) AS signed_token_amount, round(markout, 6) AS markout, round(markout_bps, 6) AS markout_bps, label FROM labeled""", "label_user_trades", "signed_amount", "markout", "label_binary", "filter_label_quality")
def label_user_trades(spark, sf):
    out = B.labeled(spark, sf).select(*KEY, "user", "side", "signed_token_amount", "markout", "markout_bps", "label")
    return rounded(out, "signed_token_amount", "markout", "markout_bps")


@query(f"""WITH {BASE} SELECT transaction_hash, round(future_lag_seconds, 6) AS lag, role FROM scored_rows WHERE side IS NOT NULL AND future_price_yes IS NOT NULL AND future_lag_seconds <= 600""")
def filter_label_lag(spark, sf):
    rows = chain.with_labels(chain.maker_taker_unpivot(chain.asof_forward_price(B.prepared(spark, sf), P.horizon_minutes)))
    return rows.filter(chain.label_quality(600.0, 0.0)).select("transaction_hash", r(F.col("future_lag_seconds")).alias("lag"), "role")


@query(f"""WITH {BASE} SELECT transaction_hash, "user" FROM labeled WHERE role = 'taker'""")
def taker_only(spark, sf):
    return B.labeled(spark, sf).filter("role = 'taker'").select("transaction_hash", "user")


@query(f"""WITH {BASE} SELECT transaction_hash, 'BUY' AS direction, round(CASE WHEN maker_direction = 'SELL' THEN -token_amount ELSE token_amount END, 6) AS token_amount FROM prepared""")
def unified_buy_amount(spark, sf):
    sell = F.upper("maker_direction") == "SELL"
    return B.prepared(spark, sf).select("transaction_hash", F.lit("BUY").alias("direction"), r(F.when(sell, -F.col("token_amount")).otherwise(F.col("token_amount"))).alias("token_amount"))


# ---- rolling features


def _feature(*names: str) -> str:
    columns = ", ".join(f"round({n}, 6) + 0 AS {n}" for n in names)
    return f"WITH {ENRICHED} SELECT transaction_hash, role, {columns} FROM enriched"


def _enriched(make, *names: str):
    def run(spark, sf) -> DataFrame:
        return rounded(make(B.labeled(spark, sf)).select(*KEY, *names), *names)

    return run


for _name, _make, _columns in (
    ("user_market_lag_delta", rolling.user_market_stream, ["time_delta_seconds"]),
    ("market_age_seconds", rolling.user_market_stream, ["market_age_seconds"]),
    ("market_count_1h", rolling.market_hour, ["market_trade_count_1h"]),
    ("market_volume_1h", rolling.market_hour, ["market_volume_1h"]),
    ("market_price_mean_1h", rolling.market_hour, ["market_price_mean_1h"]),
    ("market_price_std_1h", rolling.market_hour, ["market_price_std_1h"]),
    ("market_price_return_1h", rolling.market_hour, ["market_price_return_1h"]),
    ("user_count_1h", rolling.user_hour, ["user_trade_count_1h"]),
    ("user_market_count_1h", rolling.user_market_hour, ["user_market_trade_count_1h"]),
    ("user_signed_flow_1h", rolling.user_hour, ["user_signed_flow_1h"]),
    ("user_usd_volume_1h", rolling.user_hour, ["user_usd_volume_1h"]),
):
    QUERIES[_name] = _enriched(_make, *_columns)
    ORACLES[_name] = _feature(*_columns)


@query(f"WITH {ENRICHED} SELECT transaction_hash, role, seq FROM enriched")
def sequence_row_number(spark, sf):
    return windows.sequence_row_number(B.labeled(spark, sf)).select(*KEY, F.col("seq").cast("long"))


@query(f"""WITH {BASE} SELECT transaction_hash, round(price_yes / lag(price_yes) OVER (PARTITION BY market_id ORDER BY trade_time, block_number) - 1, 6) + 0 AS price_return FROM prepared""")
def price_return(spark, sf):
    return rolling.price_return(B.prepared(spark, sf)).select("transaction_hash", r("price_return"))


# ---- windows and splits


def _values() -> Column:
    return B.listed(F.flatten("features")).alias("features")


_VALUES = f"{B.listed_sql('flatten(features)')} AS features"


@query(f"""WITH {WINDOWS} SELECT "user", market_id, seq, start_ts, {_VALUES}, len(features) AS n, label FROM kept""", "collect_window_features", "window_start", "window_stride_filter", "feature_vector")
def collect_window_features(spark, sf):
    out = windows.collect_windows(rolling.trailing_features(windows.streams(B.labeled_for_windows(spark, sf), B.written)), P.window, P.stride, P.features)
    return out.select("user", "market_id", F.col("seq").cast("long"), "start_ts", _values(), F.size("features").cast("long").alias("n"), "label")


@query(f"""WITH {SEQUENCES} SELECT window_id AS sequence_id, "user", market_id, start_ts AS sequence_start_ts, end_ts AS sequence_end_ts, window_size AS seq_len, {_VALUES}, label, split FROM sw""")
def sequence_windows(spark, sf):
    return windows.sequence_windows(B.labeled_for_windows(spark, sf), P, B.written).withColumn("features", _values())


@query(f"""WITH {WINDOWS} SELECT window_id, "user", market_id, window_start_ts, window_end_ts, window_size, {_VALUES}, label, split FROM mw""", "model_windows", "assign_split")
def model_windows(spark, sf):
    return B.model_windows(spark, sf).withColumn("features", _values())


@query(f"WITH {WINDOWS} SELECT round(c1, 3) AS train_cutoff, round(c2, 3) AS validation_cutoff FROM seq_cut")
def split_cutoffs(spark, sf):
    return rounded(windows.split_cutoffs(B.labeled(spark, sf), P), "train_cutoff", "validation_cutoff", digits=3)


@query(f"WITH {WINDOWS} SELECT round(c1, 3) AS train_cutoff, round(c2, 3) AS validation_cutoff FROM win_cut")
def window_split_cutoffs(spark, sf):
    return rounded(windows.window_split_cutoffs(B.labeled(spark, sf), P), "train_cutoff", "validation_cutoff", digits=3)


@query(f"""WITH {BASE}, o AS (SELECT trade_time, row_number() OVER (ORDER BY trade_time) - 1 AS i, count(*) OVER () AS n FROM prepared)
SELECT max(trade_time) FILTER (i = greatest(0, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) - 1)) AS train_end, max(trade_time) FILTER (i = greatest(0, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) - 1)) AS validation_end FROM o""")
def ratio_cutoffs_by_index(spark, sf):
    return windows.ratio_cutoffs_by_index(B.prepared(spark, sf), "trade_time", 0.6, 0.2)


@query(f"WITH {WINDOWS} SELECT split, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_rows, CAST(count(*) - sum(label) AS BIGINT) AS negative_rows, round(avg(label), 6) AS positive_rate FROM mw GROUP BY split")
def split_summary(spark, sf):
    return rounded(windows.split_summary(B.model_windows(spark, sf)), "positive_rate")


@query(f"WITH {WINDOWS} SELECT split, min(window_end_ts) AS min_window_end_ts, max(window_end_ts) AS max_window_end_ts FROM mw GROUP BY split")
def split_time_ranges(spark, sf):
    return windows.split_time_ranges(B.model_windows(spark, sf))


@query(f"WITH {WINDOWS} SELECT min(window_size) AS min_window_size, max(window_size) AS max_window_size, CAST(min(len(features)) AS INTEGER) AS min_feature_rows, CAST(max(len(features)) AS INTEGER) AS max_feature_rows, CAST(min(len(features[1])) AS INTEGER) AS min_feature_width, CAST(max(len(features[1])) AS INTEGER) AS max_feature_width FROM mw")
def window_shape(spark, sf):
    return windows.window_shape(B.model_windows(spark, sf))


@query(f"WITH {WINDOWS} SELECT (SELECT count(*) FROM (SELECT window_id FROM mw GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS overlapping_window_ids, count(*) FILTER (window_size <> 8) AS wrong_window_size_rows, count(*) FILTER (len(features) <> 8) AS wrong_feature_row_count_rows, count(*) FILTER (len(features) > 0 AND len(features[1]) <> 16) AS wrong_feature_width_rows FROM mw")
def window_integrity(spark, sf):
    return windows.window_integrity(B.written_windows(spark, sf, P, "window_id", "split", "window_size", "features"), P.window, len(P.features))


@query(f"""WITH {BASE} SELECT transaction_hash, row_number() OVER (PARTITION BY "user" ORDER BY trade_time, block_number, role) AS place, "user" FROM labeled""")
def user_time_sort(spark, sf):
    """Rows sorted by user and time; the place inside the user shows the order."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = B.labeled(spark, sf).repartitionByRange(n, "user").sortWithinPartitions("user", "trade_time", "block_number", "role")
    w = Window.partitionBy("user").orderBy("trade_time", "block_number", "role")
    return ordered.select("transaction_hash", F.row_number().over(w).cast("long").alias("place"), "user")


@query(f"""WITH {BASE} SELECT transaction_hash, lower(trim('  ' || market_id || ' ')) AS trimmed, concat_ws('-', market_id, NULL, asset_id) AS joined, lpad(CAST(block_number AS VARCHAR), 8, '0') AS padded,
 strftime(trade_time, '%Y%m%d%H%M%S') AS compact, round(ln(1 + greatest(usd_amount, 0)), 6) AS log_usd, round(sign(price - 0.5) * ln(1 + abs(price - 0.5)), 6) AS signed_log, round(1 / (1 + exp(-price)), 6) AS sig,
 round(ln(price / (1 - price)), 6) AS lgt, least(greatest(price, 0.2::DOUBLE), 0.8::DOUBLE) AS clamped, coalesce(TRY_CAST(substr(transaction_hash, 3) AS DOUBLE), -1) AS num,
 trim(regexp_replace(lower(event_title), '[^a-z0-9]+', ' ', 'g')) AS plain, least(maker, taker) || '|' || greatest(maker, taker) AS pair, regexp_extract('stride=' || (block_number % 9) || '/x', 'stride=([^/]+)', 1) AS part, substr(trim(regexp_replace(lower(event_title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 7) AS short,
 contains(event_title, market_id) AS has, CAST(block_number % 7 AS BIGINT) AS modulo, CAST(floor(usd_amount) AS BIGINT) AS floored, date_trunc('second', trade_time) + INTERVAL 5 MINUTE AS later FROM prepared""")
def scalar_functions(spark, sf):
    p = F.col("price")
    return B.prepared(spark, sf).select(
        "transaction_hash", F.lower(F.trim(F.concat(F.lit("  "), "market_id", F.lit(" ")))).alias("trimmed"), F.concat_ws("-", "market_id", F.lit(None).cast("string"), "asset_id").alias("joined"),
        F.lpad(F.col("block_number").cast("string"), 8, "0").alias("padded"), S.compact_time(F.col("trade_time")).alias("compact"), r(S.log1p_positive(F.col("usd_amount"))).alias("log_usd"),
        r(S.signed_log1p(p - 0.5)).alias("signed_log"), r(S.sigmoid(p)).alias("sig"), r(S.logit(p)).alias("lgt"), S.clamp(p, 0.2, 0.8).alias("clamped"),
        S.number(F.substring("transaction_hash", 3, 20), -1.0).alias("num"), S.plain_words(F.col("event_title")).alias("plain"), S.pair_key(F.col("maker"), F.col("taker")).alias("pair"),
        S.path_part(F.concat(F.lit("stride="), (F.col("block_number") % 9).cast("string"), F.lit("/x")), "stride").alias("part"), S.slug(F.col("event_title"), 7).alias("short"), S.contains_in_any([F.col("event_title")], F.col("market_id")).alias("has"),
        (F.col("block_number") % 7).alias("modulo"), F.floor("usd_amount").alias("floored"), (F.date_trunc("second", "trade_time").cast("timestamp_ntz") + F.expr("INTERVAL 5 MINUTES")).alias("later"),
    )


@query(f"""WITH {BASE} SELECT transaction_hash, round(CASE WHEN price - 0.3 <= 0 THEN 0 ELSE (CASE WHEN maker_direction = 'SELL' THEN -1 ELSE 1 END) * (0.5::DOUBLE / (price - 0.3) - 1) * 10000 END, 4) + 0 AS bps FROM prepared""")
def bps_from_prices(spark, sf):
    side = F.upper("maker_direction")
    return B.prepared(spark, sf).select("transaction_hash", r(S.entry_bps(F.col("price") - 0.3, F.lit(0.5), side), 4).alias("bps"))
