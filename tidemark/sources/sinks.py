"""Sinks: partitioned stages, manifests, reports, predictions and keyed snapshots."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..params import Params

#: Times in JSON reports keep their microseconds.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return bool(fs.exists(at))


def write_partitioned(df: DataFrame, path: str, by: str, overwrite: bool = False, watched: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """zstd Parquet by partition value; an existing stage is an error unless ``overwrite``.  Rows are dealt
    by value and a salt, so that a large month or split has several writers and not one.  ``watched`` may observe
    what is written."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns[:3]), F.lit(8))).repartition(n, by, "__salt").drop("__salt")
    dealt = watched(dealt) if watched else dealt
    dealt.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(by).option("compression", "zstd").parquet(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)


def config_hash(params: Params) -> str:
    return hashlib.sha256(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()[:16]


def write_json_report(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("timestampNTZFormat", TIME).json(path)


def write_csv_report(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A report of a few rows as one CSV file with a header and ISO times."""
    options = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "emptyValue": ""}
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").options(**options).csv(path)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def manifest_consistency(datasets: DataFrame, manifests: DataFrame) -> DataFrame:
    """``dataset_dir, manifest_found, manifest_row_count, actual_row_count, row_count_matches``; the latter is null
    without a manifest."""
    m = manifests.select("dataset_dir", F.col("row_count").alias("manifest_row_count"))
    out = datasets.join(m, "dataset_dir", "left")
    return out.select(
        "dataset_dir", F.col("manifest_row_count").isNotNull().alias("manifest_found"), "manifest_row_count", "actual_row_count",
        (F.col("manifest_row_count") == F.col("actual_row_count")).alias("row_count_matches"),
    )


def write_stage(df: DataFrame, name: str, path: str, time_column: str, params: Params, by: str | None = None, overwrite: bool = False) -> DataFrame:
    """Writes a stage to ``path/data`` and its manifest to ``path/manifest``; returns the stage as read back.  An
    existing stage is an error unless ``overwrite``.

    The manifest's numbers are observed by the tasks that write the rows, so the stage is not read again.  They stand right before
    the write, behind the last shuffle: there a task counts once, however often it is tried."""
    spark = df.sparkSession
    seen = Observation(f"stage-{uuid.uuid4().hex}")
    facts = [F.count(F.lit(1)).alias("row_count"), F.min(time_column).cast("timestamp_ntz").alias("min_time"), F.max(time_column).cast("timestamp_ntz").alias("max_time")]
    if by is None:
        write_parquet(df.observe(seen, *facts), f"{path}/data", overwrite)
    else:
        write_partitioned(df, f"{path}/data", by, overwrite, lambda dealt: dealt.observe(seen, *facts))
    found = seen.get
    row = (name, path, found["row_count"], found["min_time"], found["max_time"], json.dumps(asdict(params), sort_keys=True), config_hash(params))
    write_json_report(spark.createDataFrame([row], MANIFEST), f"{path}/manifest")
    return spark.read.parquet(f"{path}/data")


MANIFEST = "stage string, dataset_dir string, row_count long, min_time timestamp_ntz, max_time timestamp_ntz, config string, config_hash string"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of the stages at ``path`` (which may hold wildcards); without one there are no rows."""
    at, fs = _fs(spark, f"{path}/manifest")
    found = fs.globStatus(at)
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("timestampNTZFormat", TIME).json(f"{path}/manifest")


def actual_counts(spark: SparkSession, stages: dict[str, str]) -> DataFrame:
    """``dataset_dir, actual_row_count`` of written stages, in one job: files are counted by the stage that they lie in, without any
    of their columns."""
    name = lambda c: F.regexp_replace(c, "^file:/*", "/")
    files = spark.read.schema("__none int").option("recursiveFileLookup", True).parquet(*(f"{path}/data" for path in stages.values()))
    counts = files.groupBy(F.regexp_extract(name(F.col("_metadata.file_path")), "^(.*?)/data/", 1).alias("place")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(path,) for path in stages.values()], "dataset_dir string")
    out = every.join(counts, name(F.col("dataset_dir")) == F.col("place"), "left")
    return out.select("dataset_dir", F.coalesce("n", F.lit(0)).alias("actual_row_count"))


class _Lost(Exception):
    """Another writer took the version."""


def upsert_snapshot(new: DataFrame, path: str, key: str, version: str, tries: int = 20) -> None:
    """Keeps the latest row of every key, whoever else writes at the same time.

    The new rows and the current version are merged into a folder of this writer's own; then the marker of the next version is
    created, which fails if it is there (compare and swap).  The loser deletes its folder and merges again, on what
    the winner wrote.  Readers see one version or another; a crash leaves the last one.  The file system must refuse to create a
    file that exists, as HDFS does; on a local disk a lock keeps this process's writers apart."""
    spark = new.sparkSession
    for _ in range(tries):
        markers = _markers(spark, path)
        held = [(n, f) for n, f in sorted(markers.items()) if f]
        rows = spark.read.parquet(f"{path}/{held[-1][1]}").unionByName(new, allowMissingColumns=True) if held else new
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
        folder = f"v-{uuid.uuid4().hex}"
        try:
            latest.write.option("compression", "zstd").parquet(f"{path}/{folder}")
            _mark(spark, path, max(markers, default=0) + 1, folder)
        except Exception as e:
            at, fs = _fs(spark, f"{path}/{folder}")
            fs.delete(at, True)
            # two others were faster: the version that was being read is gone
            if isinstance(e, _Lost) or held and not path_exists(spark, f"{path}/{held[-1][1]}"):
                continue
            raise
        for number, old in held[:-1]:  # the version before stays for readers that have begun
            fs = _fs(spark, path)[1]
            fs.delete(_fs(spark, f"{path}/{old}")[0], True)
            fs.delete(_fs(spark, f"{path}/current/{number:09d}")[0], False)
        return
    raise RuntimeError(f"{tries} other writers came first at {path}")


_one_at_a_time = threading.Lock()


def _mark(spark: SparkSession, path: str, number: int, folder: str) -> None:
    """Makes ``folder`` the version of this number, if there is none yet."""
    at, fs = _fs(spark, f"{path}/current/{number:09d}")
    with _one_at_a_time:
        try:
            out = fs.create(at, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise _Lost from e
            raise
        out.write(bytearray(folder.encode()))
        out.close()


def _markers(spark: SparkSession, path: str, patience: float = 10.0) -> dict[int, str]:
    """Folders of the versions by number.  A marker without a name is being written; it is waited for, and has no folder
    if its writer seems to have died."""
    at, fs = _fs(spark, f"{path}/current")
    end = time.time() + patience
    while True:
        found = {}
        for x in fs.listStatus(at) if fs.exists(at) else []:
            try:
                opened = fs.open(x.getPath())
            except Exception as e:
                if "FileNotFound" in str(e) or "does not exist" in str(e):  # an old version, deleted meanwhile
                    continue
                raise
            found[int(x.getPath().getName())] = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
            opened.close()
        if all(found.values()) or time.time() > end:
            return found
        time.sleep(0.05)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest version; an error where nothing was ever written."""
    held = [folder for _, folder in sorted(_markers(spark, path).items()) if folder]
    if not held:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/{held[-1]}")


def latest_by_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
