"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, licenses, linededup, neardup, quality, secrets, spelling, templates, tokenfile, urls
from .repeats import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules=urls.RULES)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"), window=13, keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs, keep_text=False).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), copies_apart=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = tokenfile.scratch_path(spark, "tokens")
    shards = tokenfile.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return tokenfile.read_tokens(shards).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.digests(bpe.decode(ids, ranks))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != secrets.LEARNED)
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_main_text(table(spark, sf_dir, "pages"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_html_extraction": op12_html_extraction,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": quality.SQL,
    "op13_phrase_collocations": collocations.SQL,
}
