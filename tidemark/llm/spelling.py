"""Spelling variant grouping with asymmetric q-chunks (operator 11).

Two words are near if one inserted, deleted or replaced code point makes one of the other.

* A word is cut into two disjoint chunks; one edit leaves one of them whole, and in the near word it is a gram
  whose place, counted from the left, has shifted by one at most.
* The half that the edit touched is again a word with one edit, so it is cut in two again, until the place of the
  edit has at most ``WIDE`` code points.  A key holds all chunks but that place.  So a common half (``under...``)
  brings nobody together; words meet only if they agree in all but a few code points.
* One word of a pair, the shorter or either of the same length, gives its chunks; the other gives its grams at all places where
  such chunks may lie, for words of its own length and of one code point less.
* Words that meet are verified.  A pair may meet at two keys; it counts at the one that holds the place where
  the two first differ, so no pairs are gathered to be told apart.
* All joins are sort-merge joins: tables grow with the vocabulary, so none is sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, drop_since, mark, materialize

#: Code points of a place of an edit that is not cut again, and the most places of a word: those of a word of more than
#: 192 code points are wider, so that its keys cost time in proportion to its length.
WIDE = 3
MOST_PLACES = 64
RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): letter runs, lower-cased, each without one code point if ``every`` divides its hash in its document."""
    runs = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(1)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"), runs.alias("run"))
    # a run that is too short is so with or without a code point
    found = found.filter(F.length("run") >= shortest).withColumn("run", F.translate("run", UPPER, LOWER))
    found = found.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = found.select(F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _keys(words: DataFrame, shortest: int) -> DataFrame:
    """(key, word, n, size, start, stop): all of a word but one place.  ``size`` is the length of the word whose chunks these are: the
    word's own, or one less, for grams.  The place is [start, stop) of such a word."""
    sizes = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).filter(F.col("size") >= shortest)
    # two halves, and twice as many places until they are narrow: as many digits as (size / WIDE, rounded up) - 1 has in base 2
    sizes = sizes.withColumn("m", F.expr(f"least({MOST_PLACES}, shiftleft(1, length(bin((size + {WIDE - 1}) div {WIDE} - 1))))"))
    rows = sizes.withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
    rows = rows.withColumns({"start": F.expr("cast(i * size div m as int)"), "stop": F.expr("cast((i + 1) * size div m as int)")})
    key = F.xxhash64("size", "i", _left("word", F.col("start")), _right("word", F.col("size") - F.col("stop")))
    return rows.select(key.alias("key"), "word", "n", "size", "start", "stop")


def _left(word: str, n: Column) -> Column:
    return F.substr(F.col(word), F.lit(1), n)


def _right(word: str, n: Column) -> Column:
    return F.substr(F.col(word), F.length(word) - n + 1)


def near_words(words: DataFrame, shortest: int = 5) -> DataFrame:
    """(word, other, other_n): each pair of near words, from both sides, once."""
    keys = _keys(words, shortest)
    chunks = keys.filter(F.length("word") == F.col("size"))
    grams = keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("size").alias("other_size"), F.col("start").alias("other_start"))
    # the planner sizes the keys as the words that they are exploded from, and would send them through the driver
    met = chunks.join(grams.hint("merge"), "key").filter("word <> other and size = other_size and start = other_start")
    rest = F.col("size") - F.col("stop")
    place = F.substr("word", F.col("start") + 1, F.col("stop") - F.col("start"))
    other_place = F.substr("other", F.col("start") + 1, F.length("other") - rest - F.col("start"))
    same = (_left("word", F.col("start")) == _left("other", F.col("start"))) & (_right("word", rest) == _right("other", rest))
    equal = F.length("word") == F.length("other")
    # the first difference lies in this place: after it the longer word would go on like the shorter
    here = equal | (rest == 0) | ~F.startswith(other_place, place)
    pairs = met.filter(same & (F.levenshtein(place, other_place, 1) == 1) & here)
    side = F.struct("word", "other", "other_n")
    back = F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # words of the same length meet from both sides by themselves
    return pairs.select(F.explode(F.when(equal, F.array(side)).otherwise(F.array(side, back))).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of a chain of forms, by doubling the steps.  A form is at least twice as
    frequent as its word, so chains are short and have no rings.  Reads ``forms`` once; the result is a written table."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = state.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        before, state = state, materialize(after, "roots")
        drop(before)
        if not state.filter("moved").head(1):
            return state


def group_variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """Words and the form that each is a variant of.

    Words are letter runs of ``text``, at least ``shortest`` (2 or more) code points long and found at least ``least`` times; one
    code point is left out of a run if ``every`` divides the crc32 of ``<doc_id>:<run>``.  A word's form is its near word of
    largest n (ties: smallest in code-point order), if that n is at least ``times`` (2 or more) that of the word.

    Returns ``word, form, root, n, n_near, form_n``, one row per word; form and form_n are null where there is none, and the root is
    then the word.  Null and empty texts have no words, a null id is written ``null``, repeated rows count as often as
    they are there, an empty table gives no rows, and extra columns are not read.
    """
    scope = mark()
    words = materialize(word_counts(docs, every, shortest, least), "words")
    found = near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    known = words.join(found.hint("merge"), "word", "left")
    fits = -F.col("best.minus") >= F.lit(times) * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")
    )
    known = materialize(known, "near")
    last = roots(known.filter("form is not null"))
    drop_since(docs.sparkSession, scope, known, last)
    out = known.join(last.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
