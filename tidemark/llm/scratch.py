"""Written tables in the cluster's shared folder, and row numbers.

``spark.checkpoint.dir`` names the folder.  Where it is unset, as in tests or on a laptop, a temporary
folder is used if driver and executors share one machine; on a cluster that is an error.

Each call of an operator keeps its tables in a ``Scope`` of its own, which belongs to the thread
that opened it: ``drop_since`` deletes what this call wrote and nothing that another thread or
query wrote.  Tables that no scope deleted stay until ``clear_scratch`` is called.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_left: set[str] = set()  # written and not yet deleted; only clear_scratch goes through it
_writing = [0, None]  # how many writes run, and the setting's value before the first
_open = threading.local()


class Scope:
    """The tables that one call wrote, in the thread that opened the scope."""

    def __init__(self) -> None:
        self.paths: list[str] = []


def _scopes() -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def made(path: str) -> str:
    """Notes a path for the open scopes of this thread and for ``clear_scratch``."""
    for scope in _scopes():
        scope.paths.append(path)
    with _lock:
        _left.add(path)
    return path


class _Cleanup:
    """Shuffle files go as soon as a write ends; the setting is put back after the last of all writes at once."""

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        with _lock:
            if not _writing[0]:
                _writing[1] = self.conf.get(_CLEANUP, None)
                self.conf.set(_CLEANUP, "true")
            _writing[0] += 1

    def __exit__(self, *_) -> None:
        with _lock:
            _writing[0] -= 1
            if not _writing[0]:
                self.conf.unset(_CLEANUP) if _writing[1] is None else self.conf.set(_CLEANUP, _writing[1])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet and reads it back: later steps start from the files, and
    the shuffle files behind it are dropped as soon as it is written."""
    spark = df.sparkSession
    path = made(f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
    with _Cleanup(spark):
        # small row groups: a task that writes whole texts keeps less in memory
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        with _lock:
            _left.discard(path)


def mark() -> Scope:
    """Opens a scope for the tables that this thread writes from now on, until ``drop_since``."""
    scope = Scope()
    _scopes().append(scope)
    return scope


def drop_since(spark: SparkSession, scope: Scope, *needed: DataFrame) -> None:
    """Closes a scope and deletes its tables, but for ``needed``: all that what comes still reads."""
    keep = {df._scratch_path for df in needed}
    open_ = _scopes()
    del open_[open_.index(scope) :]  # and those that an error left open within it
    with _lock:
        gone = [path for path in scope.paths if path not in keep and path in _left]
    _delete(spark, gone)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, [df._scratch_path])


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that ``materialize`` wrote and that are still there."""
    with _lock:
        left = list(_left)
    _delete(spark, left)


def set_aside(docs: DataFrame, *made: str, known: tuple[str, ...] | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` without columns of the ``made`` names (in any case), and with those renamed that begin with ``__`` as an operator's own
    columns do, or that are not ``known``; and the function that gives a result the old names again."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in made))
    taken, away = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.startswith("__") or known is not None and c not in known:
            new = f"aside{len(away)}"
            while new in taken:
                new += "_"
            taken.add(new)
            away[c] = new
    back = {new: c for c, new in away.items()}
    return docs.withColumnsRenamed(away), lambda out: out.withColumnsRenamed(back)


def tasks_for(df: DataFrame, most: int = 64 << 20) -> int:
    """How many tasks a shuffle of ``df`` needs, so that each gets about ``most`` bytes: the session's number, or
    more if the planner's estimate of the table's size asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # the planner's "don't know" is larger
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most) if known else 0)


def numbered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row, doc_id, text`` of every row, written: ``row`` is unique whatever the ids are, and stays the same if a
    lost task reads the table again."""
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "numbered"
    )
