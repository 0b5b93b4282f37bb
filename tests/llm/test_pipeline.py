from __future__ import annotations

import pytest

import corpus_pipeline as cp
from tidemark.llm import bpe, linededup
from tidemark.llm import queries as Q

from . import brute
from .test_operators import encoding

P = pytest.importorskip("public_tokenizers")


def test_pipeline_equals_a_plain_version(spark, sf):
    """All stages in plain Python, from the whole table on."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    kept = [i for i, ok in zip(ids, brute.quality_kept([(docs[i].source, docs[i].text) for i in ids])) if ok]
    texts = [docs[i].text for i in kept]
    group = {k: c for k, (_, c) in brute.components(kept, texts, 5, 80, 100).items()}
    lines = {i: t for i, t, _, _ in brute.lines(kept, texts, linededup.MIN_DOCS, linededup.SIMILAR, brute.spark_hashes(spark), group)}
    comp = brute.components(kept, [lines[i] for i in kept], 5, 80, 100)
    kept = [i for k, i in enumerate(kept) if comp[k][1] == i or comp[k][0] == 0]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute.contaminated([lines[i] for i in kept], items, 13)
    kept = [i for i, (n, hit, _) in zip(kept, found) if not (hit and 20 * hit >= n)]
    e = encoding()
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert sorted(got) == kept
    for i in kept:
        assert list(got[i].ids) == e.encode_ordinary(lines[i]) and got[i].exact


def test_stages(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe_encode"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf).count() == 0


def test_one_row_of_each_near_duplicate_group(spark, sf):
    text, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(4, text), (4, text), (None, text), (7, text + " end"), (None, other), (None, other), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in cp.near_dedup(spark, docs, sf).collect()), key=str)
    assert got == sorted([(4, text), (None, other), (None, None), (5, ""), (5, "")], key=str)


def test_registered_queries(spark, sf):
    assert sorted(Q.QUERIES, key=lambda n: int(n[2:].split("_")[0]))[0].startswith("op1_") and len(Q.QUERIES) == 13
    for name in ("op4_quality_rules", "op9_secret_scan", "op1_url_filter"):
        assert Q.QUERIES[name](spark, sf).count() > 0


def test_default_ranks():
    assert bpe.default_ranks().endswith(".tiktoken")
