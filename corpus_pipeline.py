"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared scratch folder and the next stage reads it back as its ``docs``.  All stages but the last
return the columns of ``documents``.  Nulls and empty texts fail the quality rules, so later
stages see them only if they are run alone; there they are kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, linededup, neardup, quality
from tidemark.llm.scratch import drop_since, mark, materialize, set_aside


#: Columns that stages read or change.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage):
    """A stage that gets other columns under names of no meaning and gives them back as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, restored = set_aside(docs, known=COLUMNS)
        return restored(stage(spark, docs, sf_dir))

    return run


@carrying
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or their host's verdict reject."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


@carrying
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines whose template recurs across documents; a document keeps its row, and ``n_chars`` follows
    its text."""
    out = linededup.drop_recurring_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (five words, similarity 0.8 or more): the one with the smallest
    id, null ids last.  Rows without words are in no group and stay."""
    # the number is written, so that it is the same whenever it is read
    place = mark()
    keyed = materialize(docs.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    ids = keyed.select(F.col("__number").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = neardup.groups(ids).filter("n_shingles > 0")
    members = materialize(found.select("row", "comp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("own")), "members")
    first = members.groupBy("comp").agg(F.min("own").alias("first")).select("comp", F.col("first.row").alias("keeper"))
    gone = members.join(materialize(first, "firsts"), "comp").filter("row <> keeper").select(F.col("row").alias("__number"))
    gone = materialize(gone, "gone")
    drop_since(spark, place, keyed, gone)
    return keyed.join(gone.hint("merge"), "__number", "left_anti").select(*docs.columns)


@carrying
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages (13-word windows over at least a twentieth of their words)."""
    found = decontam.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left; ``exact`` tells that decoding gives the text's bytes again."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks, public_tokenizers.PATTERN)
    out = bpe.decode(ids, ranks)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe_encode", bpe_encode),
]

#: BPE merges can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
