"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 3).

Patterns are the windows of ``window`` consecutive words of every benchmark item; an item of
fewer words is one window.  Windows of one length m form a search: the last two words under the
cursor (one, if m is 1) are a block; the shift table says how far the cursor may jump because no
pattern can end before; where the shift is 0, the bucket of that suffix lists the patterns
that end in it, and a comparison of the words confirms an occurrence.

Texts are cut into lanes that overlap by m - 1 words, and all lanes of a batch step together, so
that jumps, look-ups and comparisons are array operations.

Distinct windows are written with a number, and apart from them which items hold each.  The search
takes windows in blocks of about ``BLOCK`` windows and ``BLOCK_BYTES`` bytes.  A block goes to all workers
with the task, so its size is bounded, and a worker makes its tables once; with more blocks the
documents are written between two passes.  A pass notes window numbers; they are joined with the
items afterwards, once for each distinct set of windows, so no task holds the items of all windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import materialize, set_aside

#: Windows and their bytes in a block of patterns, and words in a lane.
BLOCK, BLOCK_BYTES, LANE = 1 << 18, 32 << 20, 512


class Search:
    """The tables for patterns of one length, given as word hashes, one row for each pattern.  The shift table
    has four slots or more for each block of words in a pattern, so that most slots keep their full jump."""

    def __init__(self, patterns: np.ndarray, words: list[bytes]):
        self.m = patterns.shape[1]
        self.block = min(2, self.m)
        self.words = words
        self.patterns = patterns
        most = self.m - self.block + 1
        self.bits = max(10, (4 * len(words) * most - 1).bit_length())
        self.shift = np.full(1 << self.bits, min(255, most), dtype=np.uint8)
        for end in range(self.block - 1, self.m):
            slot = self.slot(patterns[:, end - self.block + 1], patterns[:, end])
            np.minimum.at(self.shift, slot, min(255, self.m - 1 - end))
        suffix = self.slot(patterns[:, self.m - self.block], patterns[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = b if self.block == 1 else tv.join(a, b)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: tv.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences among all words, and the pattern of each."""
        m, reach = self.m, LANE + self.m - 1
        lanes = -(-np.maximum(0, words.count - m + 1) // LANE)
        if not lanes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(words.count.size), lanes)
        nth = np.arange(doc.size) - np.repeat(np.r_[0, np.cumsum(lanes)[:-1]], lanes)
        begin = words.first[doc] + nth * LANE
        stop = np.minimum(begin + reach, words.first[doc + 1])
        cursor = begin + m - 1
        starts, found = [], []
        while cursor.size:
            slot = self.slot(h[cursor - 1] if self.block == 2 else h[cursor], h[cursor])
            jump = self.shift[slot].astype(np.int64)
            hit = np.flatnonzero(jump == 0)
            if hit.size:
                low = np.searchsorted(self.suffix, slot[hit])
                many = np.searchsorted(self.suffix, slot[hit], side="right") - low
                at = np.repeat(cursor[hit], many) - (m - 1)
                nth = np.arange(at.size) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
                which = self.order[np.repeat(low, many) + nth]
                for k in range(m):
                    same = h[at + k] == self.patterns[which, k]
                    at, which = at[same], which[same]
                starts.append(at)
                found.append(which)
            cursor = cursor + np.maximum(1, jump)
            go = cursor < stop
            cursor, stop = cursor[go], stop[go]
        at, which = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])
        # direct comparison: the words themselves, not their hashes
        sure = np.fromiter((words.text(int(a), int(a) + m) == self.words[w] for a, w in zip(at, which)), dtype=bool, count=at.size)
        return at[sure], which[sure]


def windows_of(batch: pa.RecordBatch, window: int) -> Iterator[tuple[str, bytes]]:
    """(item, its words joined by a space) for every window of a batch of items."""
    words = tv.Words(batch["text"], tv.ALNUM, lower=True)
    for k, item in enumerate(batch["item_id"].to_pylist()):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if a == b or item is None:
            continue
        n = min(window, b - a)
        for i in range(a, b - n + 1):
            yield item, words.text(i, i + n)


def patterns_of(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables ``pattern, words`` of the distinct windows and ``pattern, item`` of the items that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            pairs = list(windows_of(batch, window))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], type=pa.string()), pa.array([x[1] for x in pairs], type=pa.binary())], ["item", "words"])

    cut = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    pairs = materialize(cut.mapInArrow(run, "item string, words binary"), "windows")
    patterns = materialize(pairs.select("words").distinct().select(F.monotonically_increasing_id().alias("pattern"), "words"), "patterns")
    return patterns, materialize(pairs.join(patterns, "words").select("pattern", "item").distinct(), "items")


def pattern_blocks(patterns: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The windows, dealt by their hash to as many blocks as keep to the bounds."""
    n, size = patterns.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        own = patterns.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        yield [(row.pattern, bytes(row.words)) for row in own.collect()]  # one block


def searches(block: list[tuple[int, bytes]]) -> list[tuple[Search, np.ndarray]]:
    """The tables for each length of window, with the windows' numbers."""
    by_length: dict[int, list[tuple[int, bytes]]] = {}
    for number, words in block:
        by_length.setdefault(words.count(b" ") + 1, []).append((number, words))
    out = []
    for m, own in sorted(by_length.items()):
        texts = pa.array([w.decode("utf-8", "surrogatepass") for _, w in own], type=pa.string())
        h = tv.Words(texts, tv.ALNUM, lower=False).hashes()
        out.append((Search(h.reshape(len(own), m), [w for _, w in own]), np.array([k for k, _ in own])))
    return out


#: The tables of the block that this worker searched last.
_known: dict[str, list[tuple[Search, np.ndarray]]] = {}


def find_items(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``n_words, n_hit, n_items, items, items_sha256, contaminated`` to ``docs`` (columns of these
    names are replaced, all others come back as they are; without ``keep_text`` the text is left out).

    Words: runs of a-z, 0-9 and anything beyond ASCII, after lower-casing A-Z.  A word inside any
    occurrence of a window is hit.  ``items``: ids (strings, sorted) of items with an occurring
    window.  ``contaminated``: n_hit > 0 and 20 * n_hit >= n_words.  Null or empty texts and items
    have no words and no hits; items without an id are left out; repeated rows are judged alike,
    repeated items count once; an empty table gives no rows.
    """
    made = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    docs, restored = set_aside(docs, *made)
    rest = docs.columns
    empty = F.array().cast("array<long>")
    state = docs.withColumns({"__spans": empty, "__windows": empty, "__n": F.lit(0).cast("long")})
    schema = state.schema
    patterns, held = patterns_of(items, window, id_col, item_text)
    spark = docs.sparkSession
    passes = 0
    for block in pattern_blocks(patterns):
        if passes:
            state = materialize(state, "decontaminate")
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(block), uuid.uuid4().hex, rest, text_col), schema)
        passes += 1
    if not passes:  # no window: only words are counted
        state = state.mapInArrow(_pass(None, "", rest, text_col), schema)
    rest = [c for c in rest if keep_text or c != text_col]
    state = materialize(state.select(*rest, "__spans", "__windows", "__n"), "searched")
    # items of every distinct set of windows
    sets = state.filter(F.size("__windows") > 0).select("__windows").distinct()
    pairs = sets.select("__windows", F.explode("__windows").alias("pattern")).join(held, "pattern")
    sets = pairs.groupBy("__windows").agg(F.sort_array(F.collect_set("item")).alias("items"))
    sets = materialize(sets, "sets")
    none = F.array().cast("array<string>")
    clean = state.filter(F.size("__windows") == 0).withColumn("items", none)
    state = clean.unionByName(state.filter(F.size("__windows") > 0).join(sets, "__windows"))
    hits = F.aggregate("__spans", F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(0xFFFFFFFF)))
    state = state.withColumns({"n_words": F.col("__n"), "n_hit": hits, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    state = state.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    return restored(state.select(*rest, *made))


def _pass(block, name: str, rest: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _known:
            _known.clear()
            _known[name] = searches(block.value) if block else []
        tables = _known[name]
        for batch in tv.slices(batches, text_col):
            words = tv.Words(batch[text_col], tv.ALNUM, lower=True)
            edge = np.zeros(len(words) + 1, dtype=np.int32)
            doc, start, size = _unpacked(batch["__spans"])
            np.add.at(edge, words.first[doc] + start, 1)
            np.add.at(edge, words.first[doc] + start + size, -1)
            owner, number, _ = _unpacked(batch["__windows"], whole=True)
            owners, numbers = [owner], [number]
            h = words.hashes() if tables else None
            for search, known in tables:
                at, which = search.find(words, h)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + search.m, -1)
                owners.append(words.doc[at])
                numbers.append(known[which])
            owner, number = np.concatenate(owners), np.concatenate(numbers)
            order = np.lexsort((number, owner))
            owner, number = owner[order], number[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])][: owner.size]
            owner, number = owner[new], number[new]
            at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]])][: at.size])
            length = np.diff(np.r_[new, at.size])
            doc = words.doc[at[new]]
            spans = ((at[new] - words.first[doc]) << 32) | length
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in rest),
                    tv.lists(spans, np.bincount(doc, minlength=n), pa.int64()),
                    tv.lists(number, np.bincount(owner, minlength=n), pa.int64()),
                    pa.array(words.count, type=pa.int64()),
                ],
                [*rest, "__spans", "__windows", "__n"],
            )

    return run


def _unpacked(column: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the row, and the high and low half (or all) of every number in a list column."""
    value = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.asarray(column.value_lengths()).astype(np.int64)
    return np.repeat(np.arange(count.size), count), value if whole else value >> 32, value & 0xFFFFFFFF
