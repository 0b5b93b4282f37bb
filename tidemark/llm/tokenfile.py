"""Token-id shards with a minimal perfect hash index (operator 7).

Documents are range-partitioned by id, sorted, encoded and cut into shards.  A shard is one row
of a Parquet table, so Spark's commit protocol covers lost executors and any store that Spark
can write is good:

* ``part, seq``: range partition and place in it; ``n_before``: ids of the partition before it;
* ``first_id, last_id, n_docs, n_null, n_tokens``;
* ``keys``: the ids of its documents in order (int64), only to list what is there;
* ``index``: the minimal perfect hash of the distinct keys;
* ``offsets``: where each document starts (uint64), by its number in the shard;
* ``payload``: raw ids, little-endian unsigned 32-bit.

The index hashes a key to a bit of the first level; keys that collide go on to the next level.
The rank of a key's bit is its slot, one slot for each key and none empty.  A slot holds a
32-bit fingerprint and the number of the key's first document.  Other keys fail at a bit or
at the fingerprint.  A look-up reads a few words, whatever the number of keys.  All readers
get to a document through its slot; columns are separate in Parquet, so a look-up reads the
index of the shards in range first and then the payload of those that hold a key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .pieces import PieceIds
from .scratch import made, shared_dir, tasks_for

#: A shard is closed at so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 21, 1 << 16
#: Bits of a level for each key, and levels before what is left is stored sorted.
GAMMA, LEVELS = 2.0, 24
MAGIC = b"TMX1"
SCHEMA = "part int, seq int, n_before long, first_id long, last_id long, n_docs long, n_null long, n_tokens long, keys binary, index binary, offsets binary, payload binary"


# ---- minimal perfect hash


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return tv.mix(keys.view(np.uint64) * np.uint64(tv.WORD_BASE) + np.uint64((salt * 0xD1B54A32D192ED03) & ((1 << 64) - 1)))


def build_index(keys: np.ndarray, first: np.ndarray) -> bytes:
    """The index of distinct int64 keys; ``first``: number of each key's first document."""
    levels, left = [], np.ascontiguousarray(keys, dtype=np.int64)
    slot = np.zeros(left.size, dtype=np.int64)
    todo, base = np.arange(left.size), 0
    for level in range(LEVELS):
        if not todo.size:
            break
        size = max(64, -(-int(GAMMA * todo.size) // 64) * 64)
        at = (_hash(left[todo], level + 1) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[todo[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        levels.append(bits)
        todo = todo[~alone]
    todo = todo[np.argsort(left[todo])]
    slot[todo] = base + np.arange(todo.size)
    prints = np.zeros(left.size, dtype=np.uint32)
    prints[slot] = (_hash(left, 0) >> np.uint64(32)).astype(np.uint32)
    number = np.zeros(left.size, dtype=np.uint32)
    number[slot] = first
    out = [MAGIC, struct.pack("<III", left.size, len(levels), todo.size)]
    for bits in levels:
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(words))][:-1].astype(np.uint32)
        out += [struct.pack("<II", words.size, int(bits.sum())), words.tobytes(), ranks.tobytes()]
    return b"".join([*out, left[todo].tobytes(), prints.tobytes(), number.tobytes()])


def find(index: bytes, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys' first documents in the shard, or -1."""
    if index[:4] != MAGIC:
        raise ValueError("not an index of this format")
    keys = np.ascontiguousarray(keys, dtype=np.int64)
    n, n_levels, n_left = struct.unpack_from("<III", index, 4)
    slot = np.full(keys.size, -1, dtype=np.int64)
    todo, at, base = np.arange(keys.size), 16, 0
    for level in range(n_levels):
        n_words, n_set = struct.unpack_from("<II", index, at)
        at += 8
        words = np.frombuffer(index, dtype=np.uint64, count=n_words, offset=at)
        ranks = np.frombuffer(index, dtype=np.uint32, count=n_words, offset=at + 8 * n_words)
        bit = _hash(keys[todo], level + 1) % np.uint64(n_words * 64)
        word, place = words[(bit >> np.uint64(6)).astype(np.int64)], bit & np.uint64(63)
        there = (word >> place) & np.uint64(1) == 1
        lower = word & ((np.uint64(1) << place) - np.uint64(1))
        rank = ranks[(bit >> np.uint64(6)).astype(np.int64)] + np.bitwise_count(lower)
        slot[todo[there]] = base + rank[there].astype(np.int64)
        todo = todo[~there]
        at += 12 * n_words
        base += n_set
    left = np.frombuffer(index, dtype=np.int64, count=n_left, offset=at)
    at += 8 * n_left
    if todo.size and n_left:
        place = np.minimum(np.searchsorted(left, keys[todo]), n_left - 1)
        there = left[place] == keys[todo]
        slot[todo[there]] = base + place[there]
    prints = np.frombuffer(index, dtype=np.uint32, count=n, offset=at)
    number = np.frombuffer(index, dtype=np.uint32, count=n, offset=at + 4 * n)
    sure = np.flatnonzero(slot >= 0)
    sure = sure[prints[slot[sure]] == (_hash(keys[sure], 0) >> np.uint64(32)).astype(np.uint32)]
    out = np.full(keys.size, -1, dtype=np.int64)
    out[sure] = number[slot[sure]]
    return out


# ---- encoding by the library


class LibraryIds:
    """Ids by the tokenizers library.  Its own byte-level pattern splits a text into the same pieces, which do
    not influence each other, so a piece's ids are the same in every text and each kind is encoded once.
    Texts that hold the string of an added token go to the library as a whole."""

    def __init__(self, path: str, pattern: str, special_as_text: bool):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if not (special_as_text and t.special)]
        self.pieces = PieceIds(pattern, self._merge)

    def _merge(self, new: list[bytes]) -> tuple[list[int], np.ndarray]:
        got = self.tokenizer.encode([p.decode() for p in new], is_pretokenized=True, add_special_tokens=False)
        return got.ids, np.bincount(got.word_ids, minlength=len(new))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.pieces.encode(texts)
        data, bounds = tv.raw_bytes(texts)
        raw, odd = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(bounds, at, side="right")) - 1
                if at + len(token) <= bounds[k + 1]:
                    odd.add(k)
                    at = raw.find(token, int(bounds[k + 1]))
                else:
                    at = raw.find(token, at + 1)
        if odd:
            own = np.split(ids, np.cumsum(counts)[:-1])
            for k in odd:
                own[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=ids.dtype)
                counts[k] = own[k].size
            ids = np.concatenate(own)
        return ids, counts


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, special_as_text: bool) -> LibraryIds:
    return LibraryIds(path, pattern, special_as_text)


# ---- writing and reading


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Encodes ``text`` of every document as the library does by default without adding special tokens, appends
    ``end_id``, and writes shards in ascending ``doc_id`` order to ``path``; returns the written table.

    The string of a special token in a text is that token, or with ``special_as_text`` plain text.  Null
    texts are empty, so they hold the end id alone.  Null ids come first and have no key.  Repeated ids stay
    next to each other, in the order of a hash of their text, perhaps in several shards; a look-up
    gives all of them.  Extra columns are left out.  An empty table gives no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        encoder = _encoder(tokenizer, pattern, special_as_text)
        for batch in tv.slices(batches, "text"):
            every, counts = encoder.encode(batch["text"])
            ids.append(batch["doc_id"])
            sizes.append(counts + 1)
            tokens.append(np.insert(every.astype("<u4"), np.cumsum(counts), end_id))
            held += tokens[-1].size
            if held >= SHARD_IDS or sum(map(len, ids)) >= SHARD_DOCS:
                yield _shard(part, seq, before, ids, sizes, tokens)
                seq, before, held, ids, sizes, tokens = seq + 1, before + held, 0, [], [], []
        if ids:
            yield _shard(part, seq, before, ids, sizes, tokens)

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one id may have a large share of the rows, so its rows are dealt by their text too
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    docs = docs.repartitionByRange(tasks_for(docs), *order).sortWithinPartitions(*order)
    docs.mapInArrow(run, SCHEMA).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return open_tokens(spark, path)


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _shard(part: int, seq: int, before: int, ids: list[pa.Array], sizes: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
    every = pa.concat_arrays(ids)
    keys = every.drop_null().to_numpy().astype(np.int64)  # nulls come first
    nulls = every.null_count
    distinct, first = np.unique(keys, return_index=True)
    offsets = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.uint64)
    some = keys.size > 0
    row = {
        "part": part, "seq": seq, "n_before": before,
        "first_id": int(keys[0]) if some else None, "last_id": int(keys[-1]) if some else None,
        "n_docs": len(every), "n_null": nulls, "n_tokens": int(offsets[-1]),
        "keys": keys.tobytes(), "index": build_index(distinct, first + nulls), "offsets": offsets.tobytes(),
        "payload": np.concatenate(tokens).astype("<u4").tobytes(),
    }
    ints = {"part": pa.int32(), "seq": pa.int32()}
    kind = lambda k: ints.get(k) or (pa.binary() if isinstance(row[k], bytes) else pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([row[k]], type=kind(k)) for k in row], list(row))


def numbers_of(keys: np.ndarray, index: bytes, n_null: int) -> np.ndarray:
    """The number of every document of a shard, got from its key through the index: the key's first document,
    and on from there for repeated keys.  Documents without a key come first."""
    first = find(index, keys)
    if (first < 0).any():
        raise ValueError("a key of the shard is not in its index")
    again = np.arange(keys.size) - np.searchsorted(keys, keys)
    return np.r_[np.arange(n_null), first + again]


def read_tokens(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_le`` of all documents: ``start`` counts the ids of all documents
    before it, ``ids_le`` are its raw bytes.  Every key is resolved through the index.  The starts of the
    range partitions come from one sum for each partition."""
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch[c][k].as_py() for c in ("part_start", "n_before", "n_null", "keys", "index", "offsets")}
                off = np.frombuffer(x["offsets"], dtype=np.uint64).astype(np.int64)
                keys = np.frombuffer(x["keys"], dtype=np.int64)
                number = numbers_of(keys, x["index"], x["n_null"])
                payload = batch["payload"][k].as_buffer()
                by_number = pa.Array.from_buffers(pa.binary(), off.size - 1, [None, pa.py_buffer((4 * off).astype(np.int32)), payload])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(x["n_null"], pa.int64()), pa.array(keys)]),
                        pa.array(off[number] + x["part_start"] + x["n_before"]),
                        pa.array(off[number + 1] - off[number]),
                        by_number.take(pa.array(number)),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_le"],
                )

    cut = shards.join(F.broadcast(starts), "part")  # one row for each range partition
    cut = cut.select("part_start", "n_before", "n_null", "keys", "index", "offsets", "payload")
    return cut.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_le binary")


def lookup(shards: DataFrame, keys: Sequence[int]) -> DataFrame:
    """``doc_id, ids_le`` of the given keys (a short list).  Shards whose range holds none are pruned; the index
    of the others tells where a key's documents start; only shards that hold one are read further.
    Unknown keys give no row."""
    keys = sorted(set(keys))
    wanted = F.lit(False)
    for key in keys:
        wanted = wanted | F.lit(key).between(F.col("first_id"), F.col("last_id"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array(keys, dtype=np.int64)
        for batch in batches:
            for x in batch.to_pylist():
                first = find(x["index"], asked)
                # a fingerprint may fit a key that is not there, so the shard's range is asked too
                there = np.flatnonzero((first >= 0) & (asked >= x["first_id"]) & (asked <= x["last_id"]))
                n = there.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["part"]] * n, type=pa.int32()), pa.array([x["seq"]] * n, type=pa.int32()), pa.array(asked[there]), pa.array(first[there])], ["part", "seq", "doc_id", "number"]
                )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                off = np.frombuffer(x["offsets"], dtype=np.uint64).astype(np.int64)
                own = np.frombuffer(x["keys"], dtype=np.int64)
                at, found = x["number"], []
                while at < x["n_docs"] and own[at - x["n_null"]] == x["doc_id"]:
                    found.append(x["payload"][4 * off[at] : 4 * off[at + 1]])
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"]] * len(found), type=pa.int64()), pa.array(found, type=pa.binary())], ["doc_id", "ids_le"])

    found = shards.filter(wanted).select("part", "seq", "first_id", "last_id", "index").mapInArrow(places, "part int, seq int, doc_id long, number long")
    cut = shards.join(F.broadcast(found), ["part", "seq"])  # at most the asked keys and their repeats
    return cut.select("n_docs", "n_null", "keys", "offsets", "payload", "doc_id", "number").mapInArrow(parts, "doc_id long, ids_le binary")


def scratch_path(spark: SparkSession, name: str) -> str:
    import uuid

    return made(f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
