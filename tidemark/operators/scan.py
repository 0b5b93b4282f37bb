"""Running values over an order of rows, without a task that holds a whole key.

A key's rows are cut into segments along their order (an hour of a stream, a range of ids).  Windows run inside (key, segment);
each segment is summed up in one row; only these rows meet by key, where they get what the segments before
carry in; and every row adds that to what it knows of its own segment.  Rows are shuffled once, by (key, segment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros

HOUR = 3_600_000_000


def hour_of(time: Column) -> Column:
    return F.floor(micros(time) / HOUR)


class SegmentedScan:
    """Collects running values of ``rows`` and adds them all at once.

    ``order`` sorts the rows of a key, and ``segment`` grows along it.  Nulls in ``keys`` are keys of their own; null segments
    come first.  With ``large``, only keys of more rows than that are cut; the others are one segment each and carry nothing.
    Rows are read once more to count them, so they should be written ones."""

    def __init__(self, rows: DataFrame, keys: list[str], segment: Column, order: list[str], large: int | None = None) -> None:
        self.columns = rows.columns
        keyed = rows.withColumn("__key", F.struct(*keys))
        self.cut = F.lit(True)
        if large is not None:
            # at most one row for each ``large`` rows
            sizes = keyed.groupBy("__key").agg(F.count("*").alias("__n")).filter(F.col("__n") > large).select("__key", F.lit(True).alias("__large"))
            keyed = keyed.join(F.broadcast(sizes), "__key", "left")
            self.cut = F.col("__large").isNotNull()
        self.base = keyed.withColumn("__segment", F.struct(F.when(self.cut, segment).alias("s")))
        self.window = Window.partitionBy("__key", "__segment").orderBy(*order)
        self.place = F.struct(*order)
        self.inside: dict[str, Column] = {}  # within the segment
        self.summary: dict[str, Column] = {}  # of a segment
        self.carried: dict[str, Column] = {}  # from the segments before (or after)
        self.final: dict[str, Column] = {}

    def _add(self, name: str, inside: Column, summary: Column, carried, final) -> None:
        made, kept, before = f"__in_{name}", f"__sum_{name}", f"__from_{name}"
        self.inside[made] = inside
        self.summary[kept] = summary
        self.carried[before] = carried(F.col(kept))
        self.final[name] = final(F.col(made), F.col(before))

    @property
    def _segments(self):
        return Window.partitionBy("__key").orderBy("__segment")

    @property
    def _before(self):
        return self._segments.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def _so_far(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def number(self, name: str) -> SegmentedScan:
        """The row's number, from 1 on."""
        self._add(name, F.row_number().over(self.window), F.count("*"), lambda s: F.coalesce(F.sum(s).over(self._before), F.lit(0)), lambda i, c: i + F.coalesce(c, F.lit(0)))
        return self

    def total(self, name: str, value: Column, kind: str = "long") -> SegmentedScan:
        """The sum up to and with the row, as a number of this ``kind``."""
        zero = F.lit(0).cast(kind)
        self._add(
            name, F.coalesce(F.sum(value).over(self._so_far).cast(kind), zero), F.coalesce(F.sum(value).cast(kind), zero),
            lambda s: F.coalesce(F.sum(s).over(self._before).cast(kind), zero), lambda i, c: (i + F.coalesce(c, zero)).cast(kind),
        )
        return self

    def peak(self, name: str, value: Column) -> SegmentedScan:
        """The largest value up to and with the row."""
        self._add(name, F.max(value).over(self._so_far), F.max(value), lambda s: F.max(s).over(self._before), lambda i, c: F.greatest(i, c))
        return self

    def lag(self, name: str, value: Column) -> SegmentedScan:
        """The value of the row before; null for the first row."""
        v = F.struct(value.alias("v"))
        self._add(name, F.lag(v).over(self.window), F.max_by(v, self.place), lambda s: F.lag(s).over(self._segments), lambda i, c: F.coalesce(i, c)["v"])
        return self

    def lead(self, name: str, value: Column) -> SegmentedScan:
        """The value of the next row; null for the last row."""
        v = F.struct(value.alias("v"))
        self._add(name, F.lead(v).over(self.window), F.min_by(v, self.place), lambda s: F.lead(s).over(self._segments), lambda i, c: F.coalesce(i, c)["v"])
        return self

    def first(self, name: str, value: Column) -> SegmentedScan:
        """The value of the key's first row."""
        v = F.struct(value.alias("v"))
        upto = self._segments.rowsBetween(Window.unboundedPreceding, 0)
        self._add(name, F.first(v).over(self._so_far), F.min_by(v, self.place), lambda s: F.first(s).over(upto), lambda i, c: F.coalesce(c, i)["v"])
        return self

    def last_known(self, name: str, value: Column) -> SegmentedScan:
        """The last value that is not null, up to and with the row."""
        self._add(
            name, F.last(value, ignorenulls=True).over(self._so_far), F.max_by(value, F.when(value.isNotNull(), self.place)),
            lambda s: F.last(s, ignorenulls=True).over(self._before), lambda i, c: F.coalesce(i, c),
        )
        return self

    def rows(self) -> DataFrame:
        """The rows with all values."""
        both = ["__key", "__segment"]
        inside = self.base.withColumns(self.inside)
        segments = self.base.filter(self.cut).groupBy(*both).agg(*(c.alias(n) for n, c in self.summary.items()))
        segments = segments.withColumns(self.carried).select(*both, *self.carried)
        return inside.join(segments, both, "left").withColumns(self.final).select(*self.columns, *(n for n in self.final if n not in self.columns))


def range_edges(rows: DataFrame, column: str, parts: int = 64, drawn: int = 4096) -> list:
    """At most ``parts`` - 1 values that cut a column into ranges of about as many rows, from ``drawn`` rows of least hash.
    They say how work is dealt and nothing about results."""
    some = rows.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column, F.lit(1))).limit(drawn).collect()
    values = sorted(r[0] for r in some)
    return sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []


def range_of(column: str, edges: list) -> Column:
    """The number of edges at or below the value; null for null."""
    if not edges:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    at = F.array(*map(F.lit, edges))
    return F.when(F.col(column).isNotNull(), F.size(F.filter(at, lambda e: e <= F.col(column))))
