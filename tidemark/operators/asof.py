"""Forward as-of joins.

Spark has no such join.  Probes and quotes are put into time buckets of their key; inside a bucket
a window finds the first quote at or after a probe, and a probe that finds none takes the first
quote of the next bucket that has one.  So a key with a large share of the rows is spread over
its buckets, and no task holds all rows of a key: one shuffle of the rows, one small one of the
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros

BUCKET_SECONDS = 6 * 3600


def asof_forward(
    probes: DataFrame,
    quotes: DataFrame,
    key: str,
    target: Column,
    time: Column,
    values: dict[str, Column],
    tie: list[Column],
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """``probes`` with the columns ``values`` of the first quote of the same ``key`` at or after ``target``.

    ``target`` and ``time`` are zone-less timestamps.  Equal times: the quote with the smallest
    ``tie``.  Without a quote the values are null and the probe stays; probes without a target or
    key find none.
    """
    size = bucket_seconds * 1_000_000
    own = probes.columns
    p = probes.select(F.col(key).alias("__key"), micros(target).alias("__at"), F.lit(1).alias("__probe"), F.struct(*own).alias("__row"), F.lit(None).alias("__q"))
    picked = F.struct(micros(time).alias("t"), *(t.alias(f"tie{i}") for i, t in enumerate(tie)), *(v.alias(n) for n, v in values.items()))
    q = quotes.select(F.col(key).alias("__key"), micros(time).alias("__at"), F.lit(0).alias("__probe"), picked.alias("__q")).filter(F.col("__key").isNotNull() & F.col("__at").isNotNull())
    p = p.withColumn("__q", F.lit(None).cast(q.schema["__q"].dataType))
    q = q.withColumn("__row", F.lit(None).cast(p.schema["__row"].dataType))
    both = p.unionByName(q).withColumn("__bucket", F.floor(F.col("__at") / size))

    # running frames from late to early: the last quote seen is the nearest one ahead
    buckets = both.groupBy("__key", "__bucket").agg(F.min("__q").alias("__own"))
    later = Window.partitionBy("__key").orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("__key", "__bucket", F.last("__own", ignorenulls=True).over(later).alias("__next"))
    order = Window.partitionBy("__key", "__bucket").orderBy(F.col("__at").desc(), F.col("__probe").asc(), F.col("__q").desc())
    ahead = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__hit", F.last("__q", ignorenulls=True).over(ahead)).filter("__probe = 1")
    found = found.join(buckets, (found["__key"] == buckets["__key"]) & (found["__bucket"] == buckets["__bucket"]), "left").drop(buckets["__key"]).drop(buckets["__bucket"])
    hit = F.coalesce("__hit", "__next")
    return found.withColumn("__hit", hit).select("__row.*", *(F.col(f"__hit.{n}").alias(n) for n in values))
