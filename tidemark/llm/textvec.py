"""Vectorised word handling over a batch of texts.

A batch is an Arrow string column.  Its UTF-8 bytes stay in one NumPy array; words are
found by looking bytes up in a 256-entry table.  Words are hashed eight bytes at a time, and
word windows by joining the hashes of their halves, with a mixing step in between, so that no
Python object is made per word.  Null texts count as empty.

The step is not linear, so no family of words collides by its form, as all sums of
``byte * base**position`` do; long words go through BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
#: Odd multipliers.
WORD_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xC2B2AE3D27D4EB4F

#: Word bytes: all but ASCII white space; or, after lower-casing, a-z, 0-9 and all beyond ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: spreads all bits of a hash."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    h = (a ^ (a >> U64(32))) * U64(WORD_BASE) + (b ^ (b >> U64(29))) * U64(WINDOW_BASE)
    h = (h ^ (h >> U64(31))) * U64(0xFF51AFD7ED558CCD)
    return h ^ (h >> U64(33))


class Words:
    """Words of a batch of texts, in order.

    ``start``/``end``: byte span in ``data``; ``doc``: index of the text; ``first``: index of
    each text's first word, with the total at the end.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool):
        self.data, self.bounds = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        inside = kind[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside.size and inside[0]:
            edge = np.r_[0, edge]
        if edge.size % 2:
            edge = np.r_[edge, inside.size]
        # texts are set apart by one space, so no word crosses two of them
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.count.size), self.count)

    def __len__(self) -> int:
        return self.start.size

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end, seed)

    def window_ok(self, n: int) -> np.ndarray:
        """Indices of words at which a window of n words of one text starts."""
        at = np.arange(max(0, len(self) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]]

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


#: Spans of more bytes are hashed one by one.
LONG = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros after the end."""
    flat = np.zeros(data.size + 8, dtype=np.uint8)
    flat[: data.size] = data
    return np.ndarray((data.size + 1,), dtype="<u8", buffer=flat, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(U64) * U64(WORD_BASE) + U64((seed * 0xA0761D6478BD642F + 1) & ((1 << 64) - 1)))
    if not start.size:
        return out
    for i in np.flatnonzero(size > LONG):
        key = seed.to_bytes(8, "little")
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    chunk = eights(data)
    todo = np.flatnonzero(size <= LONG)
    at, left = start[todo], size[todo]
    while todo.size:
        part = chunk[at]
        short = left < 8
        part[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[todo] = join(out[todo], part)
        go = left > 8
        todo, at, left = todo[go], at[go] + 8, left[go] - 8
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b on are the same, for each pair of places."""
    out = np.ones(size.size, dtype=bool)
    for i in np.flatnonzero(size > LONG):
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    chunk = eights(data)
    todo = np.flatnonzero((size <= LONG) & (a != b) & (size > 0))
    done = 0
    while todo.size:
        left = size[todo] - done
        differ = chunk[a[todo] + done] ^ chunk[b[todo] + done]
        short = left < 8
        differ[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[todo[differ != 0]] = False
        todo, done = todo[left > 8], done + 8
    return out


def window_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n word hashes from each position in ``at`` on: of blocks of 2**k words, made of
    two halves each, from left to right."""
    if not at.size:
        return np.zeros(0, dtype=U64)
    out, place, level, size = np.full(at.size, U64(n)), at, h, 1
    while True:
        if n & size:
            out = join(out, level[place])
            place = place + size
        if n < 2 * size:
            return out
        level = join(level[:-size], level[size:]) if level.size > size else level[:0]
        size *= 2


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, one text after the other, and where each text starts (plus the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a space after each text, and where each text starts (plus the end)."""
    raw, off = raw_bytes(texts)
    n = off.size - 1
    bounds = off + np.arange(n + 1)
    data = np.full(raw.size + n, 0x20, dtype=np.uint8)
    keep = np.ones(data.size, dtype=bool)
    keep[bounds[1:] - 1] = False
    data[keep] = raw
    return data, bounds


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=float)))
        a = 0
        while a < batch.num_rows:
            base = size[a - 1] if a else 0.0
            b = max(a + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column whose rows hold ``counts`` values each."""
    off = np.zeros(counts.size + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))
