"""Phrase collocation mining with Rabin-Karp fingerprints (operator 13).

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``, A-Z lower-cased.
Everything is counted per language.

1. Fingerprints.  Inside a block of texts the word hashes are summed up as a prefix polynomial
   ``S[i] = w[0] + w[1] B + ... + w[i-1] B**(i-1)`` modulo 2**64; the n-gram at i has
   ``(S[i+n] - S[i]) / B**i``, whatever n is.  B is odd, so it has an inverse.
2. Counting.  A task adds up equal fingerprints, the shuffle adds up the tasks'.  Four passes: words; pairs of two frequent
   words; triples of two frequent pairs; phrases of 4 and 5 words all of whose triples are frequent, with the frequent words,
   pairs and triples once more.  What is frequent is passed on as a bit map of fixed size, which may let too much through but
   never too little.  The last pass sends the place of the first occurrence along, and a second fingerprint.
3. Verification.  In a block every occurrence is compared with the first one word by word, and those that differ are set apart.
   A fingerprint that comes with two second fingerprints is a collision; its phrases are counted again by their text.
   The texts of all others are read at their places: only frequent phrases are ever made into strings, each of them once.
4. Scores, on the table of frequent phrases alone: a part of a frequent phrase is itself in that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import drop_since, mark, materialize

U64 = tv.U64
LONGEST = 5
#: Pieces end at these bytes, words also at space and tab.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
KIND = ~BREAKS
KIND[[0x20, 0x09]] = False
BASE = 0x9FB21C651E98DF25  # any odd number
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text whose fingerprints are compared at once (a worker needs some thirty times as many), and the sums and the
#: places that a task holds before it sends them on.
BLOCK = 2 << 20
HELD = 1 << 21
PLACES = 1 << 20
#: log2 of the bits of the map of frequent fingerprints; it is the size that is sent to the workers, whatever the corpus is.
MAP_BITS = 26
#: Bytes of places that are sent to all workers; more are joined.
SENT_BYTES = 32 << 20
_PHRASES = "lang string, phrase string, words int, n long"
#: Parts of a language that are ranked on their own before the last ranking.
RANK_PARTS = 64


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, U64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Block:
    """Words of a batch of texts with their pieces and languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.words = tv.Words(texts, KIND, lower=True)
        w = self.words
        ends = BREAKS[w.data]
        ends[w.bounds[1:] - 1] = True  # the space after each text
        self.piece = np.cumsum(ends)[w.start] if len(w) else np.zeros(0, dtype=np.int64)
        coded = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy().astype(np.int64)[w.doc]
        # a language's own number, taken from its name
        names = tv.Words(pa.array([x.encode().hex() for x in self.langs], type=pa.string()), tv.SPACED, False)
        own = np.zeros(len(self.langs), dtype=U64)
        own[names.doc] = names.hashes(7)
        self.seed = own[self.lang] if len(self.langs) else np.zeros(0, dtype=U64)
        h = w.hashes()
        self.ahead, self.back = powers(BASE, h.size), powers(INVERSE, h.size)
        self.prefix = self._prefix(h)

    def _prefix(self, h: np.ndarray) -> np.ndarray:
        return np.r_[U64(0), np.cumsum(h * self.ahead, dtype=U64)]

    def places(self, n: int) -> np.ndarray:
        """Where an n-gram starts that lies inside one piece."""
        at = np.arange(max(0, len(self.words) - n + 1))
        return at[self.piece[at] == self.piece[at + n - 1]]

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams from ``at`` on, with the language and n."""
        poly = (self.prefix[at + n] - self.prefix[at]) * self.back[at]
        return tv.mix(poly ^ tv.mix(self.seed[at] + U64(n)))

    def second(self):
        """A function for fingerprints of hashes of another seed."""
        prefix = self._prefix(self.words.hashes(1))
        return lambda at, n: tv.mix((prefix[at + n] - prefix[at]) * self.back[at])

    def frequent(self, n: int, bits: np.ndarray, of: int) -> np.ndarray:
        """Places of n-grams all of whose parts of ``of`` words are in the map."""
        all_ = np.arange(max(0, len(self.words) - of + 1))
        good = np.zeros(all_.size + of, dtype=bool)
        good[: all_.size] = in_map(bits, self.prints(all_, of))
        at = self.places(n)
        for k in range(n - of + 1):
            at = at[good[at + k]]
        return at


def _cells(prints: np.ndarray) -> list[np.ndarray]:
    """Two bits of the map for each fingerprint."""
    return [prints & U64((1 << MAP_BITS) - 1), (prints >> U64(MAP_BITS)) & U64((1 << MAP_BITS) - 1)]


def in_map(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    out = np.ones(prints.size, dtype=bool)
    for cell in _cells(prints):
        out &= (bits[(cell >> U64(6)).astype(np.int64)] >> (cell & U64(63))) & U64(1) == 1
    return out


def bit_map(prints: DataFrame) -> Broadcast:
    """The map of a table of fingerprints, made by an aggregation: at most 2**(MAP_BITS - 6) rows, whatever the table is."""
    mask = (1 << MAP_BITS) - 1
    cell = F.explode(F.array(F.col("print").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("print", MAP_BITS).bitwiseAND(F.lit(mask))))
    cells = prints.select(cell.alias("cell"))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    rows = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=U64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U64)
    return prints.sparkSession.sparkContext.broadcast(bits)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in tv.slices(batches, "text", BLOCK):
        yield Block(batch["text"], batch["lang"])


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints)
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if prints.size else np.zeros(0, dtype=np.int64)
    return prints[first], np.add.reduceat(counts, first) if first.size else counts


def _counts(n: int, frequent: Broadcast | None):
    """Fingerprints of n-grams with their number in the task; those of 1-grams come with the number of all words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        words: dict[str, int] = {}
        for block in _blocks(batches):
            at = block.places(n) if frequent is None else block.frequent(n, frequent.value, n - 1)
            found = _summed(block.prints(at, n), np.ones(at.size, dtype=np.int64))
            held = _summed(np.r_[held[0], found[0]], np.r_[held[1], found[1]])
            if held[0].size >= HELD:
                yield _sent(*held)
                held = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
            if frequent is None:
                for code, k in enumerate(np.bincount(block.lang, minlength=len(block.langs))):
                    words[block.langs[code]] = words.get(block.langs[code], 0) + int(k)
        yield _sent(*held)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words)), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()))], ["lang", "print", "n"])

    return run


def _sent(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(prints.size, pa.string()), pa.array(prints.view(np.int64)), pa.array(counts)], ["lang", "print", "n"])


def same_words(block: Block, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each a on are those from each b on, and in the same language."""
    w, out = block.words, block.lang[a] == block.lang[b]
    for k in range(n):
        i, j = a + k, b + k
        size = w.end[i] - w.start[i]
        out &= size == w.end[j] - w.start[j]
        look = np.flatnonzero(out)
        out[look] = tv.same_bytes(w.data, w.start[i[look]], w.start[j[look]], size[look])
    return out


def _apart(block: Block, at: np.ndarray, prints: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the first one, fingerprint, number) of the occurrences of each text; two texts of one fingerprint are apart."""
    while at.size:
        order = np.argsort(prints, kind="stable")
        at, prints = at[order], prints[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        leader = np.repeat(at[first], np.diff(np.r_[first, at.size]))
        same = same_words(block, at, leader, n)
        yield at[first], prints[first], np.add.reduceat(same.astype(np.int64), first)
        at, prints = at[~same], prints[~same]  # collisions: the next of them leads


class Placed:
    """Fingerprints of a task with their second ones, their number, and the first place of each."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += columns[0].size
        if self.held > 2 * PLACES:
            self.merge()

    def merge(self) -> None:
        prints, check, n, row, place, words = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((check, prints))  # stable, so the first place stays first
        prints, check = prints[order], check[order]
        first = np.flatnonzero(np.r_[True, (prints[1:] != prints[:-1]) | (check[1:] != check[:-1])][: prints.size])
        at = order[first]
        n = np.add.reduceat(n[order], first) if first.size else n
        self.parts, self.held = [(prints[first], check[first], n, row[at], place[at], words[at])], first.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            prints, check, n, row, place, words = self.parts[0]
            arrays = [prints.view(np.int64), check.view(np.int64), n, row, place.astype(np.int64), words.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["print", "check", "n", "row", "place", "words"])
        self.parts, self.held = [], 0


def _placed(frequent: Broadcast):
    """All phrases that may be frequent, with the place of their first occurrence in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Placed()
        for batch in tv.slices(batches, "text", BLOCK):
            block, rows = Block(batch["text"], batch["lang"]), batch["row"].to_numpy()
            second = block.second()
            for n in range(1, LONGEST + 1):
                at = block.frequent(n, frequent.value, min(n, 3))
                for first, prints, count in _apart(block, at, block.prints(at, n), n):
                    doc = block.words.doc[first]
                    found.add(prints, second(first, n), count, rows[doc], first - block.words.first[doc], np.full(first.size, n))
            if found.held > PLACES:
                found.merge()
            if found.held > PLACES:
                yield from found.flush()
        yield from found.flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) of the places of a text, which must still have the fingerprints found there."""
    for batch in tv.slices(batches, "text", BLOCK):
        block = Block(batch["text"], batch["lang"])
        out: tuple[list, ...] = ([], [], [], [])
        for doc, places in enumerate(batch["places"].to_pylist()):
            lang = batch["lang"][doc].as_py()
            for p in places:
                i = int(block.words.first[doc]) + p["place"]
                there = i + p["words"] <= len(block.words) and block.prints(np.array([i]), p["words"]).view(np.int64)[0] == p["print"]
                if not there:
                    raise ValueError("the texts came in another order when they were read again; write them to a table first")
                for column, value in zip(out, ("und" if lang is None else lang, block.words.text(i, i + p["words"]).decode("utf-8", "replace"), p["words"], p["n"])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "phrase", "words", "n"])


def _verified(collided: Broadcast):
    """(lang, phrase, words, n) of the n-grams whose fingerprint is in the map, told apart by their text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            held: dict[tuple[str, str, int], int] = {}
            for n in range(1, LONGEST + 1):
                at = block.frequent(n, collided.value, n)
                for first, _, count in _apart(block, at, block.prints(at, n), n):
                    for i, k in zip(first, count):
                        key = block.langs[block.lang[i]], block.words.text(i, i + n).decode("utf-8", "replace"), n
                        held[key] = held.get(key, 0) + int(k)
            yield _texts(held)

    return run


def _texts(held: dict[tuple[str, str, int], int]) -> pa.RecordBatch:
    lang, phrase, words = zip(*held) if held else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(held.values(), pa.int64())], ["lang", "phrase", "words", "n"])


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to 5 words with n >= ``least``, and (lang, total) of all words.  ``docs`` is read
    several times, and rows must come in the same order each time, as they do from files; anything else is an error."""
    spark = docs.sparkSession
    scope = mark()
    row = F.monotonically_increasing_id().alias("row")
    texts = docs.select(row, F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def counted(n: int, frequent: Broadcast | None, name: str) -> DataFrame:
        found = texts.select("lang", "text").mapInArrow(_counts(n, frequent), "lang string, print long, n long")
        return materialize(found.groupBy("lang", "print").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("lang").isNotNull()), name)

    ones = counted(1, None, "words")
    totals = ones.filter("print is null").select("lang", F.col("n").alias("total"))
    known = bit_map(ones.filter("print is not null"))
    twos = counted(2, known, "pairs")
    known.destroy()
    known = bit_map(twos)
    threes = counted(3, known, "triples")
    known.destroy()
    known = bit_map(ones.filter("print is not null").union(twos).union(threes))
    placed = texts.mapInArrow(_placed(known), "print long, check long, n long, row long, place long, words int")
    place = F.struct("row", "place", "words")
    sums = placed.groupBy("print").agg(F.sum("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"), F.min(place).alias("at"))
    sums = materialize(sums.filter(F.col("n") >= least), "placed")
    known.destroy()
    wanted = sums.filter("check = other").groupBy("at.row").agg(F.collect_list(F.struct("print", "at.place", "at.words", "n")).alias("places"))
    wanted = materialize(wanted, "wanted")
    read = texts.join(_few(wanted), "row").select("lang", "text", "places")
    found = read.mapInArrow(_read, _PHRASES)
    collided = sums.filter("check <> other")
    if not collided.isEmpty():
        known = bit_map(collided)
        again = texts.select("lang", "text").mapInArrow(_verified(known), _PHRASES).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
        # the map may let more through, and those phrases are known already
        found = materialize(found, "read")
        found = found.union(again.filter(F.col("n") >= least).join(found, ["lang", "phrase"], "left_anti").select("lang", "phrase", "words", "n"))
    found = materialize(found, "phrases")
    drop_since(spark, scope, ones, found)
    return found, totals


def _few(wanted: DataFrame) -> DataFrame:
    """Sent to all workers if that takes at most ``SENT_BYTES``; otherwise texts are dealt by row."""
    size = wanted.agg(F.coalesce(F.sum(F.size("places") * 24 + 32), F.lit(0))).first()[0]
    return F.broadcast(wanted) if size <= SENT_BYTES else wanted.hint("merge")


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language whose words go together.

    A candidate is a phrase of 2 to 5 words with a = f(phrase) >= ``least`` (1 or more).  A cut after its first k words
    has l = f(first part), r = f(rest) and the score floor(1000 * a * n / (l * r)) over the n words of the
    language; the cut of the lowest score counts, ties to the smallest k.  A candidate goes if its words lie
    contiguously in a longer one with 100 * f(longer) >= ``percent`` * a.

    Returns ``lang, rank, phrase, a, l, r, n, score``.  Null languages are ``und``, which is also a name of its own; null
    and empty texts have no words; repeated rows count as often as they are there.  Ties in rank fall by a, then by the
    bytes of the phrase.  Extra columns are not read, and an empty table gives no rows.  A score beyond 64 bits is an error.
    """
    found, totals = frequent_phrases(docs, least)
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cand = found.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def words(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    held = cand.filter("words >= 3").select("lang", "words", "a", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    held = held.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("start"))
    held = held.select("lang", words(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cand.join(held, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or 100 * cast(longer as decimal(20)) < {int(percent)} * cast(a as decimal(20))"))
    cuts = kept.select("lang", "phrase", "a", "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("left"), words(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals.select("lang", F.col("total").alias("n")), "lang")
    # at most 38 digits: counts of up to 10**17 and 1000 times 10**16 words
    exact = "(cast(a as decimal(17)) * cast(1000 * cast(n as decimal(17)) as decimal(20))) div (cast(l as decimal(18)) * cast(r as decimal(18)))"
    scored = cuts.withColumn("score", F.expr(exact).cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return whole.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB's version over ``documents``, for the query's parameters.
SQL = """
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS cut
  FROM documents),
pieces AS (SELECT lang, unnest(cut) AS piece FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
sized AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM words),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
longer AS (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM cand WHERE k >= 3),
inner_ AS (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS s FROM longer),
held AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS top FROM inner_ GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN held h USING (lang, phrase) WHERE h.top IS NULL OR 100 * h.top < 100 * c.a),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, c, (1000 * cuts.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:c], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[c + 1:], ' ') JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM lowest)
SELECT * FROM ranked WHERE rank <= 2000
"""
