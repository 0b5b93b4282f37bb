"""The batch chain as a run of written stages, and the analysis as one document."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..sources import sinks
from ..sources.trades import scan_time_range, scan_trades
from . import chain, reports, windows


def run_chain(trades: DataFrame, root: str, params: Params, start: datetime | None = None, end: datetime | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
    """Scans ``trades`` (in [start, end) if given), prepares, labels and windows them.  Every stage is written below
    ``root`` with its manifest and read back for the next one; an existing stage stops the run unless
    ``overwrite``."""
    source = scan_trades(trades)
    if start is not None or end is not None:
        source = scan_time_range(source, start, end)
    prepared = sinks.write_stage(chain.prepare_trades(source, params), "prepared", f"{root}/prepared", "trade_time", params, "year_month", overwrite)
    prepared = prepared.withColumn("year_month", F.col("year_month").cast("string"))
    labeled = sinks.write_stage(chain.label_user_trades(prepared, params), "labeled", f"{root}/labeled", "trade_time", params, "year_month", overwrite)
    made = windows.model_windows(labeled, params)
    return {"prepared": prepared, "labeled": labeled, "windows": sinks.write_stage(made, "windows", f"{root}/windows", "window_end_ts", params, "split", overwrite)}


def analysis_report(labeled: DataFrame, params: Params) -> DataFrame:
    """One row with nested parts: totals, ratios, balance by month, percentiles, streams and the verdict.  Lists hold a
    row for each month, measure or bucket."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name))

    def many(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    out = one(reports.dataset_totals(labeled), "dataset")
    parts = (
        one(reports.class_ratios(labeled), "class_ratios"),
        many(reports.monthly_balance(labeled), "monthly_balance"),
        many(reports.percentiles(labeled), "percentiles"),
        many(reports.stream_length_buckets(labeled), "stream_lengths"),
        one(reports.window_estimates(labeled, params.window, params.stride), "windows"),
        one(reports.label_integrity(labeled), "label_integrity"),
        one(reports.training_feasibility(labeled, params.window, params.stride), "feasibility"),
    )
    for part in parts:
        out = out.crossJoin(part)  # one row each
    return out
