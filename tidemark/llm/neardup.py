"""MinHash near-dedup: one-permutation hashing, optimal densification, star edges (operator 6).

1. Every document becomes its set of word shingles; documents with equal sets form one class.
2. One-permutation hashing: each shingle is hashed once, the top bits choose one of ``bins``
   bins and the bin keeps its smallest hash.  Empty bins borrow from a filled bin chosen by a
   hash of (bin, attempt) that is the same for all documents (optimal densification).
3. ``rows`` bins make a band; classes that agree on a band share a bucket.
4. Every bucket sends star edges: a few centers against its other members, never all pairs.
   Edges are confirmed on the full shingle sets.  A center is then done with this bucket; the
   bucket goes on with the rest until it has one component or one member left.  So a link of
   two texts that share a bucket is never lost, and the stars stop early where all is linked.
   Rounds take more and more centers, so that their number stays small in a bucket whose members
   are not linked.  Two exact bounds keep pairs inside the join.  Jaccard distance is a metric:
   members whose distances to the bucket's first center differ by more than the threshold allows
   cannot be linked.  And of a set, those shingles are in no intersection that fall where the
   other set's map of 2048 hash cells is empty.
5. Connected components by large-star/small-star, with a written table after every step.

Members of a large bucket are dealt to several tasks by a salt, and its centers go to all of them.

With 24 bands of 5 rows two texts of similarity 0.85 share no bucket with probability 8e-7,
and at 0.8 with 7e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .collocations import bit_map, in_map
from .scratch import drop, drop_since, mark, materialize, numbered

#: Centers of a bucket in its second round, and how many times more each round after it takes.
BANDS, ROWS, CENTERS, MORE_CENTERS = 24, 5, 256, 4
#: Cells of the map of a set; members of a bucket that one task takes.
CELLS, SPLIT = 2048, 512
#: So many pairs are sent to the texts; more are joined with them by a shuffle of both.
SENT_PAIRS = 1 << 18
#: Attempts of the densification before it takes the next filled bin.
ATTEMPTS = 96


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other; and their counts.
    A text with fewer words than ``width`` has its whole sequence as one shingle."""
    words = tv.Words(texts, tv.SPACED, lower=True)
    h = words.hashes()
    at = words.window_ok(width)
    doc, value = [words.doc[at]], [tv.window_hashes(h, at, width)]
    for n in range(1, width):
        short = np.flatnonzero(words.count == n)
        if short.size:
            doc.append(short)
            value.append(tv.window_hashes(h, words.first[short], n) ^ np.uint64(n))
    d, v = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])][: d.size]
    return v[new], np.bincount(d[new], minlength=len(texts))


def signatures(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """(texts, bins) one-permutation signatures, densified; rows of texts without shingles are 0."""
    n = counts.size
    doc = np.repeat(np.arange(n), counts)
    slot = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    cell = doc * bins + slot.astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: cell.size])  # values are sorted, so it is the bin's smallest
    flat = np.zeros(n * bins, dtype=np.uint64)
    full = np.zeros(n * bins, dtype=bool)
    flat[cell[first]], full[cell[first]] = values[first], True
    sig, filled = flat.reshape(n, bins), full.reshape(n, bins)
    row, col = np.nonzero(~filled & (counts > 0)[:, None])
    out = sig.copy()
    for attempt in range(ATTEMPTS):
        if not row.size:
            break
        pick = tv.mix(np.arange(bins, dtype=np.uint64) * np.uint64(1000003) + np.uint64(attempt + 1)) % np.uint64(bins)
        other = pick.astype(np.int64)[col]
        ok = filled[row, other]
        out[row[ok], col[ok]] = sig[row[ok], other[ok]]
        row, col = row[~ok], col[~ok]
    for step in range(1, bins):
        if not row.size:
            break
        other = (col + step) % bins
        ok = filled[row, other]
        out[row[ok], col[ok]] = sig[row[ok], other[ok]]
        row, col = row[~ok], col[~ok]
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, "text"):
            values, counts = shingle_sets(batch["text"], width)
            sig = signatures(values, counts, bands * rows).reshape(-1, bands, rows)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (sig.shape[0], 1))
            for r in range(rows):
                keys = tv.mix(keys * np.uint64(tv.WINDOW_BASE) + sig[:, :, r])
            off = np.r_[0, np.cumsum(counts)]
            sums = [np.r_[np.zeros(1, np.uint64), np.cumsum(tv.mix(values ^ np.uint64(s)))] for s in (0x51, 0xA7)]
            a, b = ((s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums)
            some = counts > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"],
                    batch["doc_id"],
                    pa.array(counts, type=pa.int64()),
                    pa.array(a),
                    pa.array(b),
                    tv.lists(keys[some].view(np.int64).ravel(), np.where(some, bands, 0), pa.int64()),
                ],
                ["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _maps(width: int):
    """Which of ``CELLS`` cells the hashes of a set fall into, as bits of longs, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in tv.slices(batches, "text"):
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                values, counts = shingle_sets(batch["text"], width)
                bits = np.zeros((batch.num_rows, CELLS), dtype=np.uint8)
                bits[np.repeat(np.arange(batch.num_rows), counts), (tv.mix(values) % np.uint64(CELLS)).astype(np.int64)] = 1
                longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                columns = [batch["row"], tv.lists(longs.ravel(), np.full(batch.num_rows, CELLS // 64), pa.int64()), pa.array(bits.sum(axis=1, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "map", "filled"])

    return run


def _maps_allow(num: int, den: int) -> Column:
    """False where the maps of a member and a center rule a link out: cells that only one of them fills hold at
    least one shingle each that the other lacks."""
    common = sum((F.bit_count(F.col("map")[i].bitwiseAND(F.col("cmap")[i])) for i in range(CELLS // 64)), F.lit(0))
    most = F.least(F.col("n") - F.col("filled"), F.col("cn") - F.col("cfilled")) + common
    return most * (num + den) >= (F.col("n") + F.col("cn")) * num


def _confirm(width: int, num: int, den: int):
    """Pairs of texts -> pairs whose full sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(tv.slices(batches, "text_a"), "text_b"):
            values, counts, pair = [], [], []
            for name in ("text_a", "text_b"):
                v, c = shingle_sets(batch[name], width)
                values.append(v)
                counts.append(c)
                pair.append(np.repeat(np.arange(c.size), c))
            v, p = np.concatenate(values), np.concatenate(pair)
            order = np.lexsort((v, p))
            v, p = v[order], p[order]
            both = (v[1:] == v[:-1]) & (p[1:] == p[:-1])
            inter = np.bincount(p[1:][both], minlength=batch.num_rows)
            union = counts[0] + counts[1] - inter
            ok = den * inter >= num * union
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok), pa.array(inter / union)], ["a", "b", "linked", "sim"])

    return run


def _in(wanted: Broadcast):
    """Rows whose fingerprint is in a map, which may let more through, without the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = pa.array(in_map(wanted.value, batch["print"].to_numpy().view(np.uint64)))
            yield batch.select(["row", "text"]).filter(here)

    return run


def texts_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row, text`` of the ``wanted`` rows, written.  A map of fixed size goes to the texts first, so that those of other
    rows are not shuffled."""
    found = bit_map(wanted.select(F.xxhash64("row").alias("print")))
    some = keyed.select("row", "text", F.xxhash64("row").alias("print")).mapInArrow(_in(found), "row long, text string")
    texts = materialize(some.join(wanted.hint("merge"), "row"), "texts")
    found.destroy()
    return texts


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, text_a, text_b`` of written pairs.  Few pairs are sent to the texts, so that only texts of pairs are shuffled, once each."""
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    if pairs.count() <= SENT_PAIRS:
        pairs, right = F.broadcast(pairs), right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    return left.join(pairs, "a").join(right, "b").select("a", "b", "text_a", "text_b")


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` -> ``node, comp`` with comp the smallest node reachable.

    Large-star/small-star (Kiveris et al. 2014).  Each step is an aggregation with partial sums
    and a join on the node; the edge list is written between steps.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        # done when every node has one edge and no edge leads to a node that has one
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty():
            break
    comp = edges.groupBy("u").agg(F.min("v").alias("comp"))
    return comp.select(F.col("u").alias("node"), "comp").union(comp.select(F.col("comp").alias("node"), "comp").distinct())


def _centers(state: DataFrame, first: bool, most: int) -> DataFrame:
    """``bucket, salts, center, cn, ccomp, clo, chi``: the members that a round compares with the rest of their bucket.

    The first round takes the smallest member, which is the same one in most bands, so that a
    member has one edge.  Later rounds take a member of about ``most`` components other than the
    bucket's largest, at least one of any: what is linked already needs no center.
    """
    own = F.struct(F.col("cid").alias("center"), F.col("n").alias("cn"), F.col("comp").alias("ccomp"), F.col("lo").alias("clo"), F.col("hi").alias("chi"))
    if first:
        return state.groupBy("bucket").agg(F.min_by(own, "cid").alias("c"), F.first("salts").alias("salts")).select("bucket", "salts", "c.*")
    parts = state.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.min_by(own, F.xxhash64("bucket", "cid")).alias("c"), F.first("salts").alias("salts"))
    parts = materialize(salted(parts.withColumn("place", F.pmod(F.xxhash64("comp", F.lit(7)), F.lit(1 << 30))), "comp"), "parts")
    whole = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.count("*").alias("parts"), F.min("place").alias("least"), F.first("salts").alias("salts"))
    some = (F.col("comp") != F.col("largest")) & (F.col("place") * F.col("parts") < F.lit(most << 30))
    joined = parts.drop("salts").join(copied(whole), ["bucket", "salt"])
    return joined.filter(some | (F.col("place") == F.col("least"))).select("bucket", "salts", "c.*")


def salted(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``salts``) with the salt that ``key`` gives them."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts")).cast("int"))


def copied(buckets: DataFrame) -> DataFrame:
    """``buckets`` (with ``salts``) once for each salt."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)))


def groups(
    keyed: DataFrame, width: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, centers: int = CENTERS, spend: bool = False
) -> DataFrame:
    """``row, doc_id, n_shingles, comp, component_id`` of ``keyed`` (``row, doc_id, text``, rows unique): ``comp`` is the
    smallest row reachable, ``component_id`` the smallest id.  ``spend``: ``keyed`` is a written table that is deleted once the texts to
    compare are written, so that both don't lie on the disk while pairs are shuffled."""
    place = mark()
    signed = keyed.mapInArrow(_sign(width, bands, rows), "row long, doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")
    signed = materialize(signed, "signatures")
    key = ["set_a", "set_b", "n_shingles"]
    classes = signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("cid"), F.min("doc_id").alias("cdoc"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    member = classes.select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1")
    shared = materialize(shared.select("bucket", (F.floor(F.col("k") / SPLIT) + 1).alias("salts")), "shared")
    member = materialize(member.join(shared, "bucket"), "buckets")
    texts = texts_of(keyed, member.select(F.col("cid").alias("row")).distinct())
    if spend:
        drop(keyed)

    spark = keyed.sparkSession
    links = tested = spark.createDataFrame([], "a long, b long")
    labels = maps = None
    state = salted(member, "cid").withColumns({"comp": F.col("cid"), "lo": F.lit(0.0), "hi": F.lit(1.0)})
    columns = ["bucket", "salt", "salts", "cid", "n", "comp", "lo", "hi"]
    reach = 1 - num / den + 1e-9
    while not state.isEmpty():
        star = materialize(_centers(state, labels is None, centers), "centers")
        fits = F.least("n", "cn") * den >= F.greatest("n", "cn") * num
        near = (F.col("lo") - F.col("chi") <= reach) & (F.col("clo") - F.col("hi") <= reach)
        able = (F.col("bucket") == F.col("cbucket")) & (F.col("salt") == F.col("csalt")) & (F.col("comp") != F.col("ccomp")) & fits & near
        members, hubs = state, copied(star)
        if labels is not None:
            members = state.join(maps, "cid")
            hubs = hubs.join(maps.withColumnsRenamed({"cid": "center", "map": "cmap", "filled": "cfilled", "bands": "cbands"}), "center")
            # a pair counts only in the first bucket that it shares, and stays there until it is compared
            able = able & _maps_allow(num, den) & (F.col("bucket") == F.array_min(F.array_intersect("bands", "cbands")))
            centers *= MORE_CENTERS
        pairs = members.join(hubs.drop("salts").withColumnsRenamed({"bucket": "cbucket", "salt": "csalt"}), able)
        pairs = pairs.select(F.least("cid", "center").alias("a"), F.greatest("cid", "center").alias("b")).distinct()
        if labels is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = with_texts(materialize(pairs, "pairs"), texts)
        judged = materialize(pairs.mapInArrow(_confirm(width, num, den), "a long, b long, linked boolean, sim double"), "judged")
        links, tested = links.union(judged.filter("linked").select("a", "b")), tested.union(judged.filter("not linked").select("a", "b"))
        opening = labels is None
        if opening or not judged.filter("linked").isEmpty():  # else the components are as before
            labels = materialize(components(links), "labels")
        # a bucket goes on without its centers, if it still holds two components
        rest = state.drop("comp").join(star.select("bucket", F.col("center").alias("cid")), ["bucket", "cid"], "left_anti")
        rest = rest.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        if opening:  # distances to the bucket's first center, or their bounds by size
            pivots = copied(star.select("bucket", "salts", "center", "cn")).drop("salts")
            sims = judged.select("a", "b", "sim")
            rest = rest.join(pivots, ["bucket", "salt"]).withColumns({"a": F.least("cid", "center"), "b": F.greatest("cid", "center")}).join(sims, ["a", "b"], "left")
            rest = rest.withColumns({"lo": 1 - F.coalesce("sim", F.least("n", "cn") / F.greatest("n", "cn")), "hi": F.coalesce(1 - F.col("sim"), F.lit(1.0))})
        rest = materialize(rest.select(*columns), "rest")
        live = rest.groupBy("bucket").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.first("salts").alias("salts")).filter("first <> last")
        live = copied(live.select("bucket", "salts")).drop("salts")
        state = materialize(rest.join(live, ["bucket", "salt"], "left_semi"), "buckets")
        if opening:
            maps = texts.join(state.select(F.col("cid").alias("row")).distinct(), "row", "left_semi")
            maps = maps.mapInArrow(_maps(width), "cid long, map array<long>, filled long")
            maps = materialize(maps.join(classes.select("cid", "bands"), "cid"), "maps")

    if labels is None:
        labels = spark.createDataFrame([], "node long, comp long")
    named = classes.select(*key, "cid", "cdoc").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    low = materialize(named.groupBy("comp").agg(F.min("cdoc").alias("component_id")), "low")
    named = materialize(named.join(low, "comp").select(*key, "comp", "component_id"), "named")
    drop_since(spark, place, signed, named)
    alone = signed.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("comp"), F.col("doc_id").alias("component_id"))
    grouped = signed.filter("n_shingles > 0").join(named, key).select("row", "doc_id", "n_shingles", "comp", "component_id")
    return grouped.union(alone)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, centers: int = CENTERS) -> DataFrame:
    """Near-duplicate components: ``doc_id, n_shingles, component_id, kept``, one row per input row.

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of distinct
    ``width``-word shingles (words: runs without ASCII white space, A-Z lower-cased).
    ``component_id`` is the smallest doc_id reachable; ``kept`` marks that document.  Null or
    empty texts have no shingles and are linked with nothing.  Repeated rows have one class, and
    all rows that carry the smallest id are kept.  Null ids: the component's id is the smallest
    other one, or null.  Extra columns are left out; an empty table gives no rows.
    """
    keyed = numbered(docs)
    found = groups(keyed, width, num, den, bands, rows, centers, spend=True)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
