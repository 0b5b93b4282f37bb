"""Byte-level BPE encoding and decoding with a segment tree (operator 8).

A text is split by the tokenizer's pattern; every piece is merged on its own.  The segment tree
over a piece's byte positions keeps, at its root, the leftmost pair of smallest rank.  A merge
changes three leaves (the pair's, its left neighbour's and the one that vanishes), each in
logarithmic time, so that a piece of n bytes takes O(n log n) and not O(n**2).

Pieces repeat, so a worker keeps the ids of those it has merged (see ``pieces``).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .pieces import PieceIds

NONE = 1 << 62
#: Ids that are decoded at once; more only if one text has more.
SLICE = 1 << 21
_LOW = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of smallest rank merges until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))  # of live positions

    def put(at: int, value: int) -> None:
        k = size + at
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low

    def pair(at: int) -> int:
        right = after[at]
        rank = get(piece[at : after[right]]) if right < n else None
        return NONE if rank is None else rank << 32 | at

    while tree[1] != NONE:
        at = tree[1] & _LOW
        gone = after[at]
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        put(gone, NONE)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PieceIds:
    ranks = read_ranks(path)

    def merge(new: list[bytes]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        ends = [0]
        for piece in new:
            ids += merge_piece(piece, ranks)
            ends.append(len(ids))
        return ids, np.diff(ends)

    return PieceIds(pattern, merge)


@lru_cache(maxsize=2)
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens, one after the other, and where each begins."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in tokens])]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``, the ids (array<int>) of the whole text; replaces a column of that name.

    Null texts count as empty and have no ids.  No special tokens: their strings are plain text.
    All other columns, rows and repeated rows stay as they are; an empty table gives no rows.  ``path``: a rank file that all
    workers have; ``pattern``: splits text into pieces.
    """
    rest = [c for c in docs.columns if c != out_col]
    schema = docs.select(rest).withColumn(out_col, F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in tv.slices(batches, text_col):
            ids = tv.lists(*encoder.encode(batch[text_col]), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), ids], [*rest, out_col])

    return docs.select(rest).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the bytes (binary) of the ids; null ids give no bytes.  A sequence that was
    cut inside a character may not be valid UTF-8, so the result is bytes.  Rows are decoded in slices of
    ``SLICE`` ids, so that only a value beyond Spark's own limit of 2 GiB could pass Arrow's.  An empty
    table gives no rows."""
    rest = [c for c in encoded.columns if c != out_col]
    schema = encoded.select(rest).withColumn(out_col, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start = _decoder(path)
        for whole in batches:
            column = whole[ids_col]
            counts = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
            last = np.cumsum(counts)
            row, a = 0, 0
            while row < whole.num_rows:  # as many rows as have SLICE ids, at least one
                upto = max(row + 1, int(np.searchsorted(last, a + SLICE, side="right")))
                batch, own = whole.slice(row, upto - row), counts[row:upto]
                ids = batch[ids_col].flatten().to_numpy(zero_copy_only=False)
                size = start[ids + 1] - start[ids]
                ends = np.cumsum(size)
                source = np.repeat(start[ids] - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)
                off = np.r_[0, ends][np.r_[0, np.cumsum(own)]]
                text = pa.Array.from_buffers(pa.binary(), own.size, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[source])])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), text], [*rest, out_col])
                row, a = upto, int(last[upto - 1])

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from ids and decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_ranks() -> str:
    """The rank file of the public tokenizer that is installed here; ``TIDEMARK_RANKS`` overrides it."""
    import public_tokenizers

    return os.environ.get("TIDEMARK_RANKS", public_tokenizers.path("byte_bpe_50k.tiktoken"))
