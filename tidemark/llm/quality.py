"""Host-level quality rules (operator 4): built-in functions only.

Every document is measured and tried against the rules.  Failures are summed by host, and each
host's failure rate is shrunk towards an empirical beta prior, so that a host with few documents
is not condemned by them.  Documents of a host whose shrunk rate is over the limit must also
pass stricter rules; documents that pass those are kept whatever their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, set_aside

SPACES = " \t\n\x0b\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Hosts over the limit that may be sent to all workers; beyond that they are joined with salt.
BROADCAST_HOSTS, SALTS = 100_000, 16
HOST_LIMIT = 0.5


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def repeated_words(triples: Column, ordered: Column) -> Column:
    """Words in 3-word windows that are found twice or more.  ``ordered``: the windows sorted by
    text, as (t, i); equal windows are neighbours there."""
    before = lambda k: F.when(k > 0, F.get(ordered, k - 1)["t"])
    after = lambda k: F.get(ordered, k + 1)["t"]
    places = F.transform(ordered, lambda x, k: F.when((x["t"] == before(k)) | (x["t"] == after(k)), x["i"]))
    covered = F.flatten(F.transform(F.array_compact(places), lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures (long) to ``docs``; columns of their names are replaced.

    ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``: lines
    with a word that equal an earlier line; ``n_repeat_words``: words in 3-word windows found
    twice or more in the text.  Null or empty texts: 0 everywhere.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = docs.select(*(c for c in docs.columns if c not in MEASURES))
    out = out.withColumn("__w", words_of(text)).withColumn("__l", lines)
    window = lambda i: F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    out = out.withColumn("__t", F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), window)))
    some = F.size(F.array_distinct("__t")) < F.size("__t")
    out = out.withColumn("__s", F.when(some, F.sort_array(F.transform("__t", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))))
    return out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.when(F.col("__s").isNull(), F.lit(0).cast("long")).otherwise(repeated_words(F.col("__t"), F.col("__s"))),
        }
    ).drop("__w", "__l", "__t", "__s")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def strict_failed() -> Column:
    """What documents of a condemned host must not do."""
    return (
        (F.col("n_words") < 100)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
        | (F.col("n_symbols") * 10 > F.col("word_chars"))
        | (F.col("n_dup_lines") >= 5)
    )


def host_rates(judged: DataFrame, host_col: str = "source") -> DataFrame:
    """``host, n, failed, rate`` of documents with ``base_failed``; ``rate`` is shrunk.

    The prior's mean is the share of all documents that fail; its weight follows from the variance
    of the host rates (method of moments), between 1 and 1000 documents.
    """
    hosts = judged.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"))
    weight = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1000.0))))
    hosts = hosts.crossJoin(F.broadcast(prior.select("m", weight.alias("weight"))))  # one row
    return hosts.select("host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep_text: bool = True, limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``host_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: passes that, and the strict rules too if its host's shrunk failure rate is over
    ``limit``.  Documents without a host are one host.  Null or empty texts fail.  Repeated rows
    count and are judged each; an empty table gives no rows.  Columns of the made names are replaced, all others come back as
    they are, whatever they are called.  The measured rows are written once,
    and both the sum by host and the verdicts read them.
    """
    docs, restored = set_aside(docs, *MEASURES, "base_failed", "host_failed", "kept")
    judged = measure(docs, text_col).withColumn("base_failed", base_failed())
    if not keep_text:
        judged = judged.drop(text_col)
    judged = materialize(judged, "measured")
    bad = materialize(host_rates(judged, host_col).filter(F.col("rate") > limit).select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "hosts")
    if bad.count() <= BROADCAST_HOSTS:
        out = judged.join(F.broadcast(bad), F.col(host_col).eqNullSafe(F.col("__host")), "left")
    else:
        salted = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = judged.withColumn("__own", F.pmod(F.xxhash64(*MEASURES), F.lit(SALTS)).cast("int"))
        out = own.join(salted, F.col(host_col).eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    out = out.withColumn("host_failed", F.coalesce("__bad", F.lit(False))).drop("__host", "__bad")
    return restored(out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_failed") & strict_failed())))


#: The same for DuckDB over ``documents``.
SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM t
), e AS (
  SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(w) - 1)) AS i FROM g
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM e) WHERE c > 1
), p AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM g LEFT JOIN p USING (doc_id)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM b GROUP BY source
), q AS (
  SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS v FROM h
), k AS (
  SELECT m, least(1000.0, greatest(1.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS weight FROM q
), x AS (
  SELECT source, (failed + m * weight) / (n + weight) > 0.5 AS bad FROM h, k
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(x.bad, FALSE) AND (n_words < 100 OR 100 * n_repeat_words > 30 * n_words
         OR 10 * n_symbols > word_chars OR n_dup_lines >= 5)) AS kept
FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
