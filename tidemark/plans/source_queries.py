"""Queries of the JSON ingest, sinks, run reports and streams.

Payloads are made from the driver's tables; files go to a scratch folder that all workers share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leaderboard as L
from ..operators import run
from ..operators.reports import PERCENTILES
from ..params import QUERY_PARAMS as P
from ..sources import ingest, sinks
from ..sources import trades as T
from ..sources.scratch import Written, scratch
from ..streaming import stream as Z
from . import base as B
from .base import BASE, WALLETS, WINDOWS, r, rounded, table
from .report_queries import ORACLES as REPORTS
from .wallet_queries import SNAPSHOT, snapshot_columns, snapshot_of

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


# ---- JSON ingest


@query("""WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
SELECT 'U' || user_id AS w, CASE WHEN k % 3 = 0 THEN 'BUY' ELSE 'SELL' END AS side, event_type AS asset, CASE WHEN k % 2 = 0 THEN round(value, 6) ELSE 0 END AS price, 2.0::DOUBLE AS size,
 round(CASE WHEN k % 5 = 0 THEN value * 3 WHEN k % 2 = 0 THEN value * 2 ELSE 0 END, 6) AS usdc_size, 1700000000000 + event_id * 1000 AS timestamp_ms FROM e WHERE k % 7 <> 0""", "ingest_trades_json")
def ingest_trades_json(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    wallet = F.concat(F.lit("U"), "user_id")
    ms = F.lit(1_700_000_000_000) + F.col("event_id") * 1000
    payload = F.to_json(F.struct(
        F.when(F.col("k") % 4 == 0, wallet).alias("proxyWallet"), F.when(F.col("k") % 4 != 0, wallet).alias("user"),
        F.when(F.col("k") % 7 == 0, "HOLD").when(F.col("k") % 3 == 0, "buy").otherwise("Sell").alias("side"), F.col("event_type").alias("asset_id"),
        F.when(F.col("k") % 2 == 0, F.col("value").cast("string")).otherwise("n/a").alias("price"), F.lit("2").alias("size"),
        F.when(F.col("k") % 5 == 0, F.col("value") * 3).alias("usdc_size"), F.when(F.col("k") % 2 == 0, ms).otherwise(F.floor(ms / 1000)).alias("occurredAt"),
    ))
    out = ingest.ingest_trades(e.select(payload.alias("payload")))
    return out.select(F.upper("wallet").alias("w"), "side", "asset", r("price"), "size", r("usdc_size"), "timestamp_ms")


@query("SELECT 'h' || c_custkey AS wallet, 'a' || c_nationkey AS asset, round(c_acctbal, 4) AS amount FROM customer WHERE c_custkey % 5 <> 0")
def ingest_holders_json(spark, sf):
    c = table(spark, sf, "customer")
    holder = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("H"), "c_custkey"))
    payload = F.to_json(F.struct(holder.alias("holder"), F.concat(F.lit("a"), "c_nationkey").alias("asset"), F.col("c_acctbal").alias("balance")))
    return ingest.ingest_holders(c.select(payload.alias("payload"))).select("wallet", "asset", r("amount", 4))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS market_id, 'ev' || (p_partkey % 10) AS event_id, 'T' || (p_partkey % 10) AS event_title, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'T' || (p_partkey % 10) END AS question,
 p_partkey % 3 = 0 AS active, 2 AS n_outcomes, round(p_retailprice / 2000, 6) AS first_price, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS n_tokens, round(p_retailprice, 4) AS volume FROM part""")
def ingest_market_json(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    payload = F.to_json(F.struct(
        key.cast("string").alias("id"), F.when(key % 2 == 0, F.col("p_name")).alias("question"), (key % 3 == 0).alias("active"), F.lit('["Yes","No"]').alias("outcomes"),
        F.array((F.col("p_retailprice") / 2000).cast("string"), F.lit("0.5")).alias("outcomePrices"), F.when(key % 4 == 0, F.lit('["t1","t2"]')).otherwise("none").alias("clobTokenIds"), F.col("p_retailprice").alias("volume"),
    ))
    event = F.to_json(F.struct(F.concat(F.lit("ev"), key % 10).alias("id"), F.concat(F.lit("T"), key % 10).alias("title")))
    out = ingest.ingest_markets(p.select(payload.alias("payload"), event.alias("event")))
    return out.select("market_id", "event_id", "event_title", "question", "active", F.size("outcomes").alias("n_outcomes"), r(F.get("outcome_prices", 0)).alias("first_price"), F.size("token_ids").alias("n_tokens"), r("volume", 4))


@query("SELECT CAST(p_partkey AS VARCHAR) AS asset, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / 4000, 9) END AS best_bid, round(p_retailprice / 3000, 9) AS best_ask, CASE WHEN p_size % 5 <> 0 THEN round((p_retailprice / 4000 + p_retailprice / 3000) / 2, 9) END AS midpoint, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / 3000 - p_retailprice / 4000, 9) END AS spread, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / 4000 * p_size + 0.2, 9) ELSE 0 END AS bid_depth_usd, round(p_retailprice / 3000 * 7, 9) AS ask_depth_usd FROM part")
def ingest_book_json(spark, sf):
    p = table(spark, sf, "part")
    level = lambda price, size: F.struct(price.cast("string").alias("price"), size.cast("string").alias("size"))
    bids = F.when(F.col("p_size") % 5 != 0, F.array(level(F.col("p_retailprice") / 4000, F.col("p_size")), level(F.lit(0.1), F.lit(2))))
    payload = F.to_json(F.struct(bids.alias("bids"), F.array(level(F.col("p_retailprice") / 3000, F.lit(7))).alias("asks")))
    out = ingest.ingest_books(p.select(F.col("p_partkey").cast("string").alias("asset"), payload.alias("payload")))
    return rounded(out.select("asset", "best_bid", "best_ask", "midpoint", "spread", "bid_depth_usd", "ask_depth_usd"), "best_bid", "best_ask", "midpoint", "spread", "bid_depth_usd", "ask_depth_usd", digits=9)


@query("SELECT event_type AS asset, 1700000000000 + event_id * 1000 AS timestamp_ms, round(value, 6) AS price FROM events WHERE event_id % 3 <> 0")
def ingest_price_history_json(spark, sf):
    e = table(spark, sf, "events")
    t = F.when(F.col("event_id") % 3 != 0, F.lit(1_700_000_000) + F.col("event_id")).otherwise(F.lit(-5))
    one = F.struct(t.alias("t"), F.col("value").alias("p"))
    # a payload holds a few points: one history for each group of neighbouring events
    rows = e.groupBy(F.col("event_type").alias("asset"), F.floor(F.col("event_id") / 50)).agg(F.to_json(F.struct(F.collect_list(one).alias("history"))).alias("payload"))
    return rounded(ingest.ingest_price_history(rows), "price")


@query("SELECT 'u' || c_custkey AS wallet, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS total_markets_traded, CASE WHEN c_custkey % 4 <> 0 THEN 1700000000000 + c_custkey * 1000 END AS first_seen_ms FROM customer")
def ingest_profile_json(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    traded = F.when(k % 3 == 0, F.col("c_nationkey").cast("string")).when(k % 3 == 1, F.to_json(F.struct(F.col("c_nationkey").alias("total")))).otherwise("null")
    activity = F.when(k % 4 != 0, F.to_json(F.array(F.struct((F.lit(1_700_000_000) + k).alias("occurred_at"))))).otherwise("[]")
    return ingest.ingest_profiles(c.select(F.concat(F.lit("u"), k).alias("wallet"), traded.alias("traded"), activity.alias("activity")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS condition_id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE round(p_retailprice, 4) END AS open_interest FROM part")
def ingest_open_interest_json(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    payload = F.when(k % 3 == 0, F.col("p_retailprice").cast("string")).when(k % 3 == 1, F.to_json(F.struct(F.col("p_retailprice").alias("oi")))).otherwise("null")
    return rounded(ingest.ingest_open_interest(p.select(k.cast("string").alias("condition_id"), payload.alias("payload"))), "open_interest", digits=4)


@query("""WITH m AS (SELECT p_size AS event_id, p_partkey AS market_id, 's' || p_partkey AS slug, lower(p_name) AS question, p_partkey % 2 = 0 AS active, p_partkey % 5 = 0 AS closed, p_partkey % 7 = 0 AS resolved, p_partkey % 3 <> 0 AS tokens, TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 50 AS BIGINT)) AS d, p_retailprice AS worth,
 CASE WHEN p_size % 4 = 0 THEN (SELECT 's' || min(q.p_partkey) FROM part q WHERE q.p_size = part.p_size) END AS want FROM part),
g AS (SELECT *, CASE WHEN slug = want THEN 0 ELSE 1 END AS a, CASE WHEN tokens AND active AND NOT closed AND NOT resolved THEN 0 WHEN tokens AND active AND NOT closed THEN 1 WHEN tokens AND NOT resolved THEN 2 WHEN tokens THEN 3 ELSE 4 END AS b FROM m)
SELECT event_id, market_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY a, b, d, worth DESC, market_id) AS k FROM g) WHERE k = 1""")
def select_event_market(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    none = F.lit(None).cast("timestamp_ntz")
    m = p.select(
        F.col("p_size").alias("event_id"), k.alias("market_id"), F.concat(F.lit("s"), k).alias("slug"), F.lower("p_name").alias("question"), F.lit(None).cast("string").alias("title"),
        (k % 2 == 0).alias("active"), (k % 5 == 0).alias("closed"), (k % 7 == 0).alias("resolved"), F.when(k % 3 != 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("token_ids"),
        F.timestamp_add("HOUR", k % 50, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("close_time"), none.alias("end_date"), none.alias("resolution_date"), F.col("p_retailprice").alias("volume"), F.lit(0.0).alias("liquidity"),
    )
    first = p.groupBy(F.col("p_size").alias("event_id")).agg(F.min(k).alias("least"))
    wanted = first.select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("s"), "least")).alias("market_slug"), F.lit(None).cast("string").alias("label"))
    return ingest.select_event_market(m, wanted).select("event_id", "market_id")


# ---- sinks and what is read back


@query(f"WITH {BASE} SELECT transaction_hash, role, year_month FROM labeled", "sink_partitioned_parquet", "scan_dataset_glob")
def sink_partitioned_parquet(spark, sf):
    path = scratch(spark, "labeled")
    sinks.write_partitioned(B.labeled(spark, sf).withColumn("year_month", F.date_format("trade_time", "yyyy-MM")), path, "year_month")
    return T.scan_dataset(spark, path).select("transaction_hash", "role", F.col("year_month").cast("string"))


@query(f"WITH {BASE} SELECT transaction_hash, round(usd_amount, 6) AS usd_amount FROM prepared WHERE market_id <> 'view'", "sink_overwrite_guard", "sink_plain_parquet")
def sink_overwrite_guard(spark, sf):
    """The second write without ``overwrite`` is refused, the third one replaces the table."""
    path = scratch(spark, "prepared")
    rows = B.prepared(spark, sf).select("transaction_hash", "usd_amount", "market_id")
    sinks.write_parquet(rows, path)
    try:
        sinks.write_parquet(rows, path)
        raise AssertionError("an existing stage was overwritten")
    except Exception as e:
        if isinstance(e, AssertionError) or "PATH_ALREADY_EXISTS" not in str(e):
            raise
    sinks.write_parquet(rows.filter("market_id <> 'view'"), path, overwrite=True)
    return rounded(spark.read.parquet(path).select("transaction_hash", "usd_amount"), "usd_amount")


@query(f"WITH {BASE} SELECT 'labeled' AS stage, count(*) AS row_count, min(trade_time) AS min_time, max(trade_time) AS max_time FROM labeled")
def stage_manifest(spark, sf):
    """A stage is written with its manifest, a JSON file beside it, which is read back."""
    path = scratch(spark, "stage")
    sinks.write_stage(B.labeled(spark, sf), "labeled", path, "trade_time", P)
    return sinks.read_manifests(spark, path).select("stage", "row_count", "min_time", "max_time")


@query(f"WITH {BASE}, n AS (SELECT count(*) AS n, count(*) FILTER (role = 'maker') AS m FROM labeled) SELECT d AS dataset, d <> 'none' AS manifest_found, CASE WHEN d <> 'none' THEN n END AS manifest_row_count, CASE WHEN d = 'less' THEN m ELSE n END AS actual_row_count, CASE d WHEN 'same' THEN true WHEN 'less' THEN n = m END AS row_count_matches FROM n, (SELECT unnest(['same', 'less', 'none']) AS d)")
def manifest_consistency(spark, sf):
    """Three written stages: one as its manifest says, one cut after it was written, one without a manifest."""
    root, rows = scratch(spark, "stages"), B.labeled(spark, sf).select("trade_time", "role")
    for name in ("same", "less"):
        sinks.write_stage(rows, name, f"{root}/{name}", "trade_time", P)
    sinks.write_parquet(rows.filter("role = 'maker'"), f"{root}/less/data", overwrite=True)
    sinks.write_parquet(rows, f"{root}/none/data")
    found = sinks.manifest_consistency(sinks.actual_counts(spark, {n: f"{root}/{n}" for n in ("same", "less", "none")}), sinks.read_manifests(spark, f"{root}/*"))
    return found.withColumn("dataset", F.regexp_extract("dataset_dir", "[^/]+$", 0)).drop("dataset_dir")


@query(f"""WITH {WINDOWS} SELECT 'prepared' AS stage, count(*) AS row_count, min(trade_time) AS min_time, max(trade_time) AS max_time FROM prepared
 UNION ALL SELECT 'labeled', count(*), min(trade_time), max(trade_time) FROM labeled UNION ALL SELECT 'windows', count(*), min(window_end_ts), max(window_end_ts) FROM mw""")
def run_chain(spark, sf):
    """The chain as a run: three written stages, each read back by the next, with their manifests."""
    root = scratch(spark, "run")
    run.run_chain(B.trades(spark, sf), root, P)
    return sinks.read_manifests(spark, f"{root}/*").select("stage", "row_count", "min_time", "max_time")


#: Parts of the report: the query that has the same numbers, what names an item of a list, and the fields.
_BALANCE = ("row_count", "positive_rows", "negative_rows", "positive_rate", "avg_abs_markout_bps", "avg_usd_amount")
PARTS = {
    "dataset": ("dataset_totals", None, ("total_rows", *_BALANCE[1:], "distinct_users", "distinct_markets", "distinct_assets")),
    "class_ratios": ("class_ratios", None, ("negative_rate", "positive_to_negative_ratio", "majority_to_minority_ratio")),
    "monthly_balance": ("label_monthly_balance", "month", _BALANCE),
    "percentiles": ("percentiles", "measure", tuple(PERCENTILES)),
    "stream_lengths": ("stream_length_buckets", "bucket", ("stream_count", "avg_stream_len")),
    "windows": ("window_estimates", None, ("stream_count", "eligible_stream_count", "dense_window_count", "stride_window_count")),
    "label_integrity": ("label_integrity", None, ("invalid_future_time_rows", "null_label_rows", "null_markout_bps_rows")),
    "feasibility": ("training_feasibility", None, ("eligible_stream_count", "stride_window_count", "imbalance_ratio", "user_row_share", "market_row_share", "positive_rate_range")),
}


def _part_sql(part: str) -> str:
    name, item, fields = PARTS[part]
    names, values = ", ".join(f"'{f}'" for f in fields), ", ".join(f"CAST({f} AS DOUBLE)" for f in fields)
    return f"SELECT '{part}' AS part, {item or 'CAST(NULL AS VARCHAR)'} AS item, unnest([{names}]) AS field, unnest([{values}]) AS value FROM ({REPORTS[name]})"


@query(" UNION ALL ".join(map(_part_sql, PARTS)) + f" UNION ALL SELECT 'feasibility', verdict, 'verdict', NULL FROM ({REPORTS['training_feasibility']})")
def nested_report(spark, sf):
    """The whole analysis as one nested JSON document, read back; a row for each number, and the verdict."""
    path = scratch(spark, "analysis")
    report = run.analysis_report(Written(B.labeled(spark, sf), "labeled").rows, P)
    sinks.write_json_report(report, path)
    back = spark.read.schema(report.schema).option("timestampNTZFormat", sinks.TIME).json(path)
    out = back.select(F.lit("feasibility").alias("part"), F.col("feasibility.verdict").alias("item"), F.lit("verdict").alias("field"), F.lit(None).cast("double").alias("value"))
    for part, (_, item, fields) in PARTS.items():
        rows = back.select(F.col(part).alias("x")) if item is None else back.select(F.explode(part).alias("x"))
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("double").alias("value")) for f in fields))
        named = F.lit(None).cast("string") if item is None else F.col(f"x.{item}")
        out = out.unionByName(rows.select(F.lit(part).alias("part"), named.alias("item"), F.inline(pairs)))
    return rounded(out, "value")


@query(f"WITH {BASE} SELECT market_id, count(*) AS n FROM labeled GROUP BY 1")
def sink_json_report(spark, sf):
    path = scratch(spark, "report-json")
    sinks.write_json_report(B.labeled(spark, sf).groupBy("market_id").agg(F.count("*").alias("n")), path)
    return spark.read.schema("market_id string, n long").json(path)


@query(f"WITH {BASE} SELECT market_id, max(trade_time) AS last, count(*) AS n FROM labeled GROUP BY 1", "sink_csv_report", "scan_report_csv")
def sink_csv_report(spark, sf):
    path = scratch(spark, "report-csv")
    report = B.labeled(spark, sf).groupBy("market_id").agg(F.date_format(F.max("trade_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last"), F.count("*").alias("n"))
    sinks.write_csv_report(report, path)
    back = sinks.read_csv_report(spark, path, "market_id string, last string, n long")
    return back.select("market_id", F.to_timestamp_ntz("last", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("last"), "n")


@query("SELECT doc_id AS key, CASE WHEN n_chars % 1000 >= 500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)")
def sink_predictions(spark, sf):
    from ..operators.evaluate import predictions

    path = scratch(spark, "predictions")
    sinks.write_parquet(predictions(B.scores(spark, sf)), path)
    return spark.read.parquet(path).select("key", "prediction")


@query("SELECT event_type AS market, max(event_id) AS version FROM events GROUP BY 1")
def sink_snapshot_upsert(spark, sf):
    """Two writes by key: the later version of every market stays."""
    path = scratch(spark, "snapshots")
    e = table(spark, sf, "events").select(F.col("event_type").alias("market"), F.col("event_id").alias("version"))
    half = e.agg((F.max("version") / 2).alias("half")).first()[0]
    for part in (e.filter(F.col("version") <= half), e.filter(F.col("version") > half)):
        sinks.upsert_snapshot(part.groupBy("market").agg(F.max("version").alias("version")), path, "market", "version")
    return sinks.read_snapshot(spark, path)


# ---- run reports: runs are made from the windows of every market, so that they grow with the data


def _runs(spark, sf) -> DataFrame:
    """``summary, metrics, diagnostics`` as JSON, one run for each market; half of them tell their best iteration and not their best
    epoch, and only the others have diagnostics."""
    w = B.model_windows(spark, sf).groupBy("market_id").agg(F.count("*").alias("n"), F.avg("label").alias("rate"))
    six = lambda c: F.round(c, 6)
    rate, even = F.col("rate"), F.length("market_id") % 2 == 0
    path = lambda before, after="": F.concat(F.lit(before), "market_id", F.lit(after))
    digest = F.md5(F.col("market_id").cast("binary"))
    summary = F.struct(
        F.concat(F.lit("model-"), F.length("market_id") % 2).alias("model_name"), F.concat(F.lit("2024-01-0"), F.length("market_id") % 3 + 1, F.lit("T00:00:00")).alias("created_at_utc"),
        path("/data/").alias("dataset_dir"), F.lit(8).alias("window_size"), F.when(even, 5).alias("feature_width"), F.lit(16).alias("feature_count"), F.array(F.lit("a"), F.lit("b")).alias("feature_order"),
        F.struct(F.col("n").alias("seed"), F.lit("last").alias("pooling"), (F.col("n") % 2 == 0).alias("include_summary_features")).alias("training_config"),
        F.struct(
            path("/data/", "/manifest.json").alias("dataset_manifest_path"), path("configs/", ".toml").alias("config_path"), F.substring(digest, 1, 16).alias("config_hash"),
            digest.alias("git_sha"), (F.col("n") % 2 == 1).alias("git_dirty"),
        ).alias("provenance"),
    )
    scores = lambda x: F.struct(six(0.5 + x / 4).alias("auc_roc"), six(x).alias("pr_auc"), six(x * (1 - x)).alias("brier_score"))
    metrics = F.struct(F.when(even, 3).alias("best_epoch"), F.when(~even, 7).alias("best_iteration"), scores(rate).alias("validation"), scores(rate / 2).alias("test"))
    at = lambda k: F.struct(*(six(rate / (k + i)).alias(n) for i, n in enumerate(("threshold", "accuracy", "precision", "recall", "f1"))))
    both = lambda k: F.struct(at(k).alias("validation_best_accuracy"), at(k + 1).alias("validation_best_f1"))
    diagnostics = F.struct(
        F.struct(F.struct(at(1).alias("accuracy"), at(2).alias("f1")).alias("best_by_metric")).alias("validation_threshold_sweep"),
        F.struct(both(3).alias("validation"), both(5).alias("test")).alias("split_metrics_at_validation_best_thresholds"),
    )
    return w.select("market_id", *(F.to_json(c).alias(n) for n, c in (("summary", summary), ("metrics", metrics), ("diagnostics", F.when(even, diagnostics)))))


def _written_runs(spark, sf) -> str:
    """Writes every run as JSON files below run folders; one run has no metrics."""
    root = scratch(spark, "runs")
    files = F.array(*(F.struct(F.lit(f"{n}.json").alias("name"), F.col(n).alias("value")) for n in ("summary", "metrics", "diagnostics")))
    rows = _runs(spark, sf).select("market_id", F.inline(files)).filter("value is not null and (name = 'summary.json' or market_id <> 'view')")
    # the executors write each run's files to folders of their own; a run is named by its market
    rows.write.partitionBy("market_id", "name").text(root)
    return root


_REPORT = f"""WITH {WINDOWS}, w AS (SELECT market_id AS run, count(*) AS n, avg(label) AS rate, length(market_id) % 2 = 0 AS even FROM mw WHERE market_id <> 'view' GROUP BY ALL),
rep AS (SELECT run, 'model-' || (length(run) % 2) AS model_name, '2024-01-0' || (length(run) % 3 + 1) || 'T00:00:00' AS created_at_utc, 8 AS window_size, CASE WHEN even THEN 5 ELSE 2 END AS feature_width, 16 AS feature_count,
  n AS seed, 'last' AS pooling, n % 2 = 0 AS include_summary_features, CASE WHEN even THEN 'best_epoch' ELSE 'best_iteration' END AS selector_name, CASE WHEN even THEN 3 ELSE 7 END AS selector_value,
  round(0.5 + rate / 4, 6) AS validation_auc_roc, round(rate, 6) AS validation_pr_auc, round(rate * (1 - rate), 6) AS validation_brier_score,
  round(0.5 + rate / 8, 6) AS test_auc_roc, round(rate / 2, 6) AS test_pr_auc, round(rate / 2 * (1 - rate / 2), 6) AS test_brier_score,
  CASE WHEN even THEN round(rate, 6) END AS validation_best_accuracy_threshold, CASE WHEN even THEN round(rate / 4, 6) END AS validation_best_accuracy,
  CASE WHEN even THEN round(rate / 2, 6) END AS validation_best_f1_threshold, CASE WHEN even THEN round(rate / 8, 6) END AS validation_best_f1,
  CASE WHEN even THEN round(rate / 6, 6) END AS test_accuracy_at_validation_best_accuracy, CASE WHEN even THEN round(rate / 7, 6) END AS test_precision_at_validation_best_accuracy,
  CASE WHEN even THEN round(rate / 8, 6) END AS test_recall_at_validation_best_accuracy, CASE WHEN even THEN round(rate / 10, 6) END AS test_f1_at_validation_best_f1,
  '/data/' || run AS dataset_dir, '/data/' || run || '/manifest.json' AS dataset_manifest_path, 'configs/' || run || '.toml' AS config_path, substr(md5(run), 1, 16) AS config_hash, md5(run) AS git_sha, n % 2 = 1 AS git_dirty FROM w)"""
_BEST = "ORDER BY validation_pr_auc DESC, validation_auc_roc DESC, validation_brier_score, created_at_utc DESC, run DESC"


def _named(report: DataFrame) -> DataFrame:
    """The run's folder has another root every time."""
    return report.withColumn("run", F.regexp_extract("run_dir", "market_id=([^/]*)$", 1)).drop("run_dir")


@query(f"{_REPORT} SELECT *, CAST(row_number() OVER ({_BEST}) AS INTEGER) AS place FROM rep", "model_leaderboard", "leaderboard_order", "run_artifact_join")
def model_leaderboard(spark, sf):
    """All columns of the report, and each run's place in its order."""
    return _named(L.leaderboard_places(L.model_leaderboard(L.scan_run_artifacts(spark, _written_runs(spark, sf)))))


@query(f"""{_REPORT} SELECT run, model_name, window_size, seed, CASE WHEN selector_name = 'best_epoch' THEN 3 END AS best_epoch, CASE WHEN selector_name = 'best_iteration' THEN 7 END AS best_iteration,
 validation_best_accuracy_threshold IS NOT NULL AS has_diagnostics, git_sha FROM rep""")
def scan_run_artifacts(spark, sf):
    """What the run folders hold, before the report; a run without metrics is left out."""
    found = _named(L.scan_run_artifacts(spark, _written_runs(spark, sf)))
    return found.select(
        "run", "model_name", "window_size", F.col("training_config.seed").alias("seed"), "best_epoch", "best_iteration", F.col("validation_threshold_sweep").isNotNull().alias("has_diagnostics"), F.col("provenance.git_sha").alias("git_sha")
    )


@query(f"{_REPORT} SELECT model_name, dataset_dir, CAST(k AS INTEGER) AS run_rank FROM (SELECT *, row_number() OVER (PARTITION BY model_name {_BEST}) AS k FROM rep) WHERE k <= 2")
def top_runs_per_model(spark, sf):
    report = L.model_leaderboard(L.scan_run_artifacts(spark, _written_runs(spark, sf)))
    return L.top_runs_per_model(report, 2).select("model_name", "dataset_dir", "run_rank")


# ---- streams: the events as frames of messages, drained once


def _frames(spark, sf) -> str:
    path = scratch(spark, "frames")
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    kind = F.when(F.col("k") % 4 == 0, "book").otherwise("last_trade_price")
    message = F.struct(
        kind.alias("event_type"), F.col("event_type").alias("market"), F.concat(F.lit("u"), "user_id").alias("wallet"), F.when(F.col("k") % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        F.lit("0.5").alias("price"), F.col("value").cast("string").alias("size"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
    )
    text = F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).when(F.col("event_id") % 2 == 0, F.to_json(message)).otherwise(F.to_json(F.array(message)))
    e.select(text.alias("value")).write.text(path)
    return path


def _messages(spark, sf) -> DataFrame:
    return Z.filter_events(Z.parse_messages(spark.readStream.text(_frames(spark, sf))))


def _drained(spark, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there; the sink and the checkpoint are files."""
    out = scratch(spark, name)
    Z.drain(df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + ".state"))
    return spark.read.schema(df.schema).parquet(out)


_MSG = "msg AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 9)"


@query(f"WITH {_MSG} SELECT event_type AS market, 'u' || user_id AS wallet, round(value, 6) AS size, epoch_us(ts) AS us FROM msg WHERE k % 4 <> 0", "stream_parse_messages", "stream_filter_events")
def stream_parse_messages(spark, sf):
    out = _drained(spark, _messages(spark, sf), "messages")
    return out.select("market", "wallet", r("size"), F.unix_micros("ts").alias("us"))


@query(f"WITH {_MSG} SELECT event_type AS market, count(*) AS n FROM msg WHERE k % 4 <> 0 GROUP BY 1")
def stream_periodic_refresh(spark, sf):
    """The trigger of a minute: its first batch comes at once and takes all that is there; the query then stops."""
    out = scratch(spark, "refreshed")

    def keep(batch: DataFrame, _: int) -> None:
        batch.groupBy("market").agg(F.count("*").alias("n")).write.mode("append").parquet(out)

    writer = Z.every_minute(_messages(spark, sf).writeStream.foreachBatch(keep).option("checkpointLocation", out + ".state"))
    Z.first_batch(writer)
    return spark.read.schema("market string, n long").parquet(out).groupBy("market").agg(F.sum("n").alias("n"))


@query(f"""WITH RECURSIVE {_MSG}, m AS (SELECT event_type AS market, epoch_us(ts) AS us FROM msg WHERE k % 4 <> 0),
 t AS (SELECT market, min(us) AS us FROM m GROUP BY 1 UNION ALL SELECT t.market, min(m.us) FROM t JOIN m ON m.market = t.market AND m.us >= t.us + 600000000 GROUP BY t.market, t.us)
SELECT market, us FROM t""")
def stream_throttle(spark, sf):
    return _drained(spark, Z.throttle(_messages(spark, sf), 600), "throttled").select("market", F.unix_micros("ts").alias("us"))


@query(f"WITH {_MSG} SELECT event_type AS market, 'u' || user_id AS wallet, CAST(floor(epoch_us(ts) / 300000000) * 300000000 AS BIGINT) AS us, round(sum((CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END) * 0.5 * value), 6) + 0 AS flow, count(*) AS n FROM msg WHERE k % 4 <> 0 GROUP BY 1, 2, 3")
def stream_flow_5m(spark, sf):
    """Complete mode through a batch sink, so that the windows still open are shown too."""
    out = scratch(spark, "flow")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    Z.drain(Z.flow_5m(_messages(spark, sf)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", out + ".state"))
    return spark.read.parquet(out).select("market", "wallet", F.unix_micros("bucket").alias("us"), r("flow"), "n")


def _trade_frames(spark, sf, files: int) -> str:
    """Messages that tell all of a trade, in several files."""
    path = scratch(spark, "trade-frames")
    t = B.wallet_trades(spark, sf)
    kept = table(spark, sf, "events").filter("event_id % 10 <> 9").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long")).select(F.col("event_id").alias("seq"), "k")
    message = F.struct(
        F.when(F.col("k") % 4 == 0, "book").otherwise("last_trade_price").alias("event_type"), F.col("market_id").alias("market"), F.col("asset").alias("asset_id"), "wallet", "side", "outcome",
        F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("seq").alias("id"),
    )
    t.join(kept, "seq").select(F.to_json(message).alias("value"), "seq").repartition(files, "seq").select("value").write.text(path)
    return path


_SEEN = "seen AS (SELECT * FROM events WHERE event_id % 10 <> 9 AND CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 4 <> 0)"


@query(f"WITH {_SEEN}, {WALLETS.replace('FROM events', 'FROM seen')}, {SNAPSHOT}")
def stream_snapshot(spark, sf):
    """The stream in several micro-batches: each adds its trades to the state of its markets and gives these markets
    new snapshots, which replace the stored ones."""
    state = Z.MarketState(scratch(spark, "market-state"))
    frames = spark.readStream.option("maxFilesPerTrigger", 2).text(_trade_frames(spark, sf, 4))
    messages = Z.filter_events(Z.parse_messages(frames))
    profiles = B.profiles(spark, sf)
    Z.drain(Z.snapshot_stream(messages, state, lambda trades: snapshot_of(Written(trades, "trades").rows, profiles), 0, state.path + "/offsets"))
    return snapshot_columns(state.snapshots(spark))
