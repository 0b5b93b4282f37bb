"""Exact interpolated percentiles without one task for all values of a group.

Values are counted first.  A bucket is a monotonic function of the value, so the totals of buckets
tell in which bucket each wanted rank lies; only those buckets are put in order.  One row for a
bucket, at most some hundred thousand, meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of a value, and a number beyond all of them.
STEPS, FAR = 256, 300_000


def bucket_of(x: Column) -> Column:
    """Never falls as x grows."""
    size = F.floor(F.log2(F.abs(x)) * STEPS) + FAR
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_percentiles(values: DataFrame, by: Sequence[str], x: str, shares: Mapping[str, float], n: str | None = None) -> DataFrame:
    """``by`` and a column for each share; null values are left out.  ``n``: how often a row counts."""
    by = list(by)
    counts = values.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("__x"))
    counts = counts.agg((F.sum(n) if n else F.count("*")).alias("__n")).withColumn("__b", bucket_of(F.col("__x")))
    totals = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    totals = totals.withColumns({"__upto": F.sum("__bn").over(upto), "__all": F.sum("__bn").over(whole)}).withColumn("__before", F.col("__upto") - F.col("__bn"))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(share)) * (F.col("__all") - 1)).alias("at")) for name, share in shares.items()))
    totals = totals.withColumn("__want", ranks)
    inside = lambda r: (r >= F.col("__before")) & (r < F.col("__upto"))
    totals = totals.withColumn("__want", F.filter("__want", lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))).filter(F.size("__want") > 0)
    within = Window.partitionBy(*by, "__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select(*(F.col(c).alias(f"__of_{c}") for c in [*by, "__b"]), "__before", "__want")
    same = F.lit(True)
    for c in [*by, "__b"]:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    found = counts.join(totals, same).select(*by, "__b", "__x", "__n", "__before", "__want")
    found = found.withColumn("__last", F.col("__before") + F.sum("__n").over(within)).withColumn("__first", F.col("__last") - F.col("__n"))
    hits = found.select(*by, "__x", "__first", "__last", F.inline("__want"))
    holds = lambda r: (r >= F.col("__first")) & (r < F.col("__last"))
    ends = hits.groupBy(*by, "name", "at").agg(F.max(F.when(holds(F.floor("at")), F.col("__x"))).alias("lo"), F.max(F.when(holds(F.ceil("at")), F.col("__x"))).alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    return ends.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares))
