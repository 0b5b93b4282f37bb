"""Every registered query of the core library against its SQL at the smallest scale."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if v == 0 else f"{v:.9g}"
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def distinct_queries():
    seen, out = set(), []
    for name, q in registry.queries().items():
        if id(q) not in seen:
            seen.add(id(q))
            out.append(name)
    return out


@pytest.mark.parametrize("name", [n for n in distinct_queries() if n not in SLOW])
def test_query(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == columns
    assert rows == Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shuffle_is_repeatable(spark, sf):
    q = registry.queries()["shuffle_rows_seeded"]
    assert [r[0] for r in q(spark, sf).collect()] == [r[0] for r in q(spark, sf).collect()]


def test_throttle_lets_one_through(spark, sf):
    rows = registry.queries()["stream_throttle"](spark, sf).collect()
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r.market, []).append(r.us)
    assert by
    for times in by.values():
        times.sort()
        assert all(b - a >= 600_000_000 for a, b in zip(times, times[1:]))


def test_streams_wait_for_their_end_however_long_it_takes(spark, sf, monkeypatch):
    """A snapshot of a larger input was given up after ten minutes, flows after two."""
    from pyspark.sql.streaming import StreamingQuery

    waits = []
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: waits.append(timeout) or wait(self, timeout))
    assert registry.queries()["stream_snapshot"](spark, sf).count() > 0
    assert registry.queries()["stream_flow_5m"](spark, sf).count() > 0
    assert waits == [None, None]
