"""Splitting texts into tokenizer pieces, and the ids of pieces, for a batch at a time.

The byte-level pattern ``SPLIT`` only looks at character classes, so it is worked out on arrays:
runs of letters, numbers, white space and others begin a piece, but for a space that goes with
the run after it and for contractions.  Other patterns go through the regex library.

Pieces of a batch are grouped by a 64-bit hash, and each is compared with the first of its group
byte by byte; each distinct one is looked up once by its bytes, in a table of known pieces that a
worker keeps (``CACHE`` of them; it only saves time).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from . import textvec as tv

# The byte-level split pattern (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 400_000
OTHER, LETTER, NUMBER, BLANK = range(4)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    import regex

    gap = 0xE000 - 0xD800  # surrogates are no characters
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.zeros(len(every), dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return np.concatenate([table[:0xD800], np.zeros(gap, dtype=np.uint8), table[0xD800:]])


def piece_starts(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of ``SPLIT`` start; ``bounds``: where each text starts, and the end."""
    n = chars.size
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = class_table()[chars]
    edge = np.zeros(n + 1, dtype=bool)  # text starts, and the end
    edge[bounds] = True
    start = np.r_[True, kind[1:] != kind[:-1]] | edge[:-1]
    at = np.flatnonzero(start)
    end = np.r_[at[1:], n]
    blank = (kind[at] == BLANK) & ~edge[end]  # white space before another run
    last = end[blank] - 1
    start[last] = True  # all but the last character are a piece
    joins = chars[last] == 0x20
    start[last[joins] + 1] = False  # a space goes with the run after it
    # contractions: a lone apostrophe that begins a piece, before these letters
    quote = at[(chars[at] == 0x27) & (end - at == 1) & ~edge[end]]
    quote = quote[start[quote]]
    quote = quote[kind[quote + 1] == LETTER]
    one, two = chars[quote + 1], np.where(edge[quote + 2], 0, chars[np.minimum(quote + 2, n - 1)])
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    after = quote + 1 + size
    start[after[after < n]] = True
    return np.flatnonzero(start)


def batch_pieces(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte offset of every piece and the end, pieces of each text)."""
    data, bounds = tv.raw_bytes(texts)
    if pattern == SPLIT:
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        size = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        offset = np.r_[0, np.cumsum(size)]
        starts = offset[piece_starts(chars, np.searchsorted(offset, bounds))]
    else:
        import regex

        findall = regex.compile(pattern).findall
        sizes = [len(p.encode()) for text in texts.to_pylist() if text for p in findall(text)]
        starts = np.r_[0, np.cumsum(sizes)][:-1].astype(np.int64)
    counts = np.diff(np.searchsorted(starts, bounds))
    return data, np.r_[starts, data.size], counts


def distinct_pieces(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each piece's kind, first piece of each kind); pieces of a kind have the same bytes."""
    start, end = offset[:-1], offset[1:]
    code, distinct = pd.factorize(tv.span_hashes(data, start, end))
    first = np.zeros(distinct.size, dtype=np.int64)
    first[code[::-1]] = np.arange(code.size)[::-1]
    size = end - start
    own = first[code]
    odd = np.flatnonzero(size != size[own])
    alike = np.flatnonzero(size == size[own])
    odd = np.r_[odd, alike[~tv.same_bytes(data, start[alike], start[own[alike]], size[alike])]]
    more: dict[bytes, int] = {}  # pieces that only share a hash
    for i in np.sort(odd).tolist():
        piece = data[start[i] : end[i]].tobytes()
        if piece not in more:
            more[piece] = first.size
            first = np.r_[first, i]
        code[i] = more[piece]
    return code, first


class PieceIds:
    """Ids of texts from the ids of their pieces; ``merge`` gives all ids of new pieces, one piece after
    the other, and how many each has."""

    def __init__(self, pattern: str, merge: Callable[[list[bytes]], tuple[Sequence[int], Sequence[int]]]):
        self.pattern, self.merge = pattern, merge
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, how many each text has)."""
        data, offset, counts = batch_pieces(texts, self.pattern)
        if not counts.sum():
            return np.zeros(0, dtype=np.int32), np.zeros(counts.size, dtype=np.int64)
        code, first = distinct_pieces(data, offset)
        whole = data.tobytes()
        keys = [whole[a:b] for a, b in zip(offset[first].tolist(), offset[first + 1].tolist())]
        if len(self.number) > CACHE:
            self.clear()
        new = [k for k in keys if k not in self.number]
        if new:
            ids, sizes = self.merge(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.ends.frombytes((len(self.ids) + np.cumsum(sizes, dtype=np.int64)).tobytes())
            self.ids.frombytes(np.asarray(ids, dtype=np.int32).tobytes())
        known = np.fromiter(map(self.number.__getitem__, keys), dtype=np.int64, count=len(keys))[code]
        ends = np.array(self.ends, dtype=np.int64)
        begin, size = ends[known], ends[known + 1] - ends[known]
        upto = np.cumsum(size)
        out = np.array(self.ids, dtype=np.int32)[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        return out, np.diff(np.r_[0, upto][np.r_[0, np.cumsum(counts)]])
