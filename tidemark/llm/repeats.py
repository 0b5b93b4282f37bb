"""Substring dedup with difference-cover anchors (operator 10).

A window is ``length`` consecutive words.  Words covered by a window whose word sequence also
starts anywhere else are removed.  A difference cover D modulo a period v has, for any two
positions i and j, a shift d < v for which i+d and j+d both lie in D.  So two equal windows
share an aligned anchor of ``length - v + 1`` words, and it is enough to hash anchors at cover
positions: 5 of 21.  Steps:

1. hash the anchors, find those that occur twice or more;
2. extend: hash whole windows only around such anchors, find those that occur twice or more
   (64 + 31 bits of two hashes with seeds of their own);
3. cut the covered words out of each text.

Hashes are compared by one shuffle on the hash and a sort.  A hash that occurs more than once
inside a task is settled there: its places skip that shuffle's key and only one marker is sent,
so a passage in a third of all rows costs one row per task and not one per place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import drop, materialize, numbered, tasks_for

#: Optimal difference covers (fixed values): period -> residues.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}
#: Hashes that a task compares at once before it sends them on.
COMBINE = 1 << 21
_PLACES = "key long, row long, aux long"


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least two fifths of the window."""
    fit = [v for v in COVERS if length - v + 1 >= max(1, 2 * length // 5)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


class Places:
    """Collects hashed places of a task and packs them: ``aux`` is (check or length) << 32 | position.
    Position -1: the hash is known to occur twice; below: a run of known places, at -2 - position."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, key: np.ndarray, check: np.ndarray, row: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, check, row, pos))
        self.held += key.size
        if self.held >= COMBINE:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, check, row, pos = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((check, key))
        same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
        again, before = np.r_[same, False], np.r_[False, same]
        known = np.zeros(key.size, dtype=bool)
        known[order] = again | before
        first = order[again & ~before]
        once = ~known
        yield _packed(key[once], row[once], check[once], pos[once])
        yield _packed(key[first], np.zeros(first.size, dtype=np.int64), check[first], np.full(first.size, -1))
        at = np.flatnonzero(known)  # in the order of rows and positions
        if at.size:
            r, p = row[at], pos[at]
            starts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)])
            length = np.diff(np.r_[starts, at.size])
            r, p = r[starts], p[starts]
            yield _packed(tv.mix(r.astype(np.uint64) * np.uint64(31) + p.astype(np.uint64)), r, length, -2 - p)


def _packed(key: np.ndarray, row: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    aux = (high.astype(np.int64) << 32) | (low.astype(np.int64) & 0xFFFFFFFF)
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in (key, row, aux)], ["key", "row", "aux"])


def _low(aux: np.ndarray) -> np.ndarray:
    return aux.astype(np.int32).astype(np.int64)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places sorted by hash and check: those whose hash occurs again, and all known runs."""
    last = None  # the row before, still undecided
    for batch in batches:
        key, row, aux = (c.to_numpy() for c in batch.columns)
        run = _low(aux) < -1
        if run.any():
            yield _out(row[run], -2 - _low(aux[run]), aux[run] >> 32)
            key, row, aux = key[~run], row[~run], aux[~run]
        if not key.size:
            continue
        seen = False
        if last is not None:
            key, row, aux, seen = np.r_[last[0], key], np.r_[last[1], row], np.r_[last[2], aux], last[3]
        same = (key[1:] == key[:-1]) & ((aux[1:] >> 32) == (aux[:-1] >> 32))
        before = np.r_[seen, same]
        twice = before[:-1] | same
        keep = twice & (_low(aux[:-1]) >= 0)
        yield _out(row[:-1][keep], _low(aux[:-1][keep]), np.ones(int(keep.sum()), dtype=np.int64))
        last = (key[-1:], row[-1:], aux[-1:], bool(before[-1]))
    if last is not None and last[3] and _low(last[2])[0] >= 0:
        yield _out(last[1], _low(last[2]), np.ones(1, dtype=np.int64))


def _out(row: np.ndarray, pos: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array((pos << 32) | length)], ["row", "span"])


def repeated_places(places: DataFrame, n: int) -> DataFrame:
    """(key, row, aux) -> (row, spans): places whose hash occurs twice or more, gathered by row;
    a span is start << 32 | length.  ``n``: tasks that compare them."""
    found = places.repartition(n, "key").sortWithinPartitions("key", "aux").mapInArrow(_settled, "row long, span long")
    return found.groupBy("row").agg(F.collect_list("span").alias("spans"))


def _anchor_places(length: int, period: int, cover: tuple[int, ...]):
    width = length - period + 1
    inside = np.zeros(period, dtype=bool)
    inside[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in tv.slices(batches, "text"):
            words = tv.Words(batch["text"], tv.SPACED, lower=False)
            at = words.window_ok(width)
            doc = words.doc[at]
            pos = at - words.first[doc]
            fit = inside[pos % period] & (words.count[doc] >= length)
            at, doc, pos = at[fit], doc[fit], pos[fit]
            key = tv.window_hashes(words.hashes(), at, width)
            yield from places.add(key, np.zeros(at.size, dtype=np.int64), batch["row"].to_numpy()[doc], pos)
        yield from places.flush()

    return run


def _window_places(length: int, period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in tv.slices(batches, "text"):
            words = tv.Words(batch["text"], tv.SPACED, lower=False)
            doc, start, size = _spans(batch["spans"])
            from_word = words.first[doc]
            edge = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(edge, from_word + np.maximum(0, start - (period - 1)), 1)
            np.add.at(edge, from_word + start + size, -1)
            at = words.window_ok(length)
            at = at[np.cumsum(edge)[at] > 0]
            key = tv.window_hashes(words.hashes(), at, length)
            check = tv.window_hashes(words.hashes(1), at, length) & np.uint64(0x7FFFFFFF)
            doc = words.doc[at]
            yield from places.add(key, check.astype(np.int64), batch["row"].to_numpy()[doc], at - words.first[doc])
        yield from places.flush()

    return run


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the row, start and length of each span in a list column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    span = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    return np.repeat(np.arange(count.size), count), span >> 32, span & 0xFFFFFFFF


def cut_spans(texts: pa.Array, spans: pa.Array, extra: int) -> tuple[tv.Words, np.ndarray, list[bytes]]:
    """Words, a mask of those covered by spans (each ``extra`` words longer), and what is left of
    each text, its words joined by one space."""
    words = tv.Words(texts, tv.SPACED, lower=False)
    doc, start, length = _spans(spans)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(edge, words.first[doc] + start, 1)
    np.add.at(edge, np.minimum(words.first[doc] + start + length + extra, words.first[doc + 1]), -1)
    cut = np.cumsum(edge)[:-1] > 0
    kept = np.flatnonzero(~cut)
    mark = np.zeros(words.data.size + 1, dtype=np.int8)  # the byte after each kept word stays as its space
    mark[words.start[kept]] += 1
    np.add.at(mark, words.end[kept] + 1, -1)
    stay = np.cumsum(mark)[:-1] > 0
    data = words.data.copy()
    data[words.end] = 0x20
    off = np.r_[0, np.cumsum(stay)][words.bounds]
    left = data[stay].tobytes()
    return words, cut, [left[a:b].removesuffix(b" ") for a, b in zip(off[:-1], off[1:])]


def repeated_windows(docs: DataFrame, length: int = 35) -> DataFrame:
    """``row, doc_id, text, spans``: for every document the starts of windows that occur elsewhere."""
    period, cover = cover_for(length)
    keyed = numbered(docs)
    n = tasks_for(keyed)
    anchors = keyed.select("row", "text").mapInArrow(_anchor_places(length, period, cover), _PLACES)
    anchors = materialize(repeated_places(anchors, n), "anchors")
    windows = keyed.select("row", "text").join(anchors, "row").mapInArrow(_window_places(length, period), _PLACES)
    windows = materialize(repeated_places(windows, n), "windows")
    drop(anchors)
    return keyed.join(windows, "row", "left")


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """Removes the words of every window of ``length`` words that also starts elsewhere.

    Returns ``doc_id, text`` (kept words joined by one space), ``n_words, n_removed,
    kept_sha256``, one row per input row.  Null or empty texts: no words, nothing removed.
    Repeated rows are copies of each other, so their windows go from all of them.  Extra columns
    are left out; null ids are kept; an empty table gives no rows.
    """
    schema = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            words, cut, left = cut_spans(batch["text"], batch["spans"], length - 1)
            removed = np.diff(np.r_[0, np.cumsum(cut)][words.first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([x.decode("utf-8", "surrogatepass") for x in left], type=pa.string()),
                    pa.array(words.count, type=pa.int64()),
                    pa.array(removed, type=pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                ],
                ["doc_id", "text", "n_words", "n_removed", "kept_sha256"],
            )

    return repeated_windows(docs, length).select("doc_id", "text", "spans").mapInArrow(run, schema)
