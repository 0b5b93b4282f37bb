"""Line dedup with a log-template tree (operator 5).

Lines are sorted into a tree of fixed depth: by token count, then by the leading tokens.  Tokens
with a digit are variable fields and read ``<*>`` unless all tokens are such.  The line that most documents of a leaf hold
is the leaf's first template; lines that agree with it in enough places belong to it and the places that
differ are variable fields too.  Of the lines that are left the most frequent one is the next
template, and so on until no line of the leaf is left.  A template
that recurs in ``min_docs`` documents or more is dropped from all of them but the first, so that its
content is not lost.

A leaf is dealt to ``PARTS`` parts by the hash of a line; templates of the parts are then sorted
into templates of the leaf in the same way, so that a leaf with many lines has several tasks and
only its templates meet in one.  A task reads lines in order and keeps templates alone.  Lines that
agree in enough places agree in several of a few blocks of neighbouring places at once, so a line is compared
with templates of which it shares such a choice of blocks, which are hardly more than those that it agrees with.

Lines travel as hashes; texts of lines are fetched only for the distinct lines of leaves that enough
documents reach and that hold more than one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .neardup import groups
from .quality import SPACES, words_of
from .scratch import drop_since, mark, materialize, set_aside

FIELD = "<*>"
DEPTH, SIMILAR, MIN_DOCS = 2, 0.7, 2
PARTS = 16
#: Choices of blocks that a line is known by.
MOST_KEYS = 64


def masked(line: Column) -> Column:
    """The line's tokens with variable fields for tokens that hold a digit.  A line of fields alone
    would say nothing, so it keeps its tokens."""
    words = words_of(line)
    fields = F.transform(words, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    telling = F.exists(fields, lambda t: t != FIELD)
    return F.when(line.rlike("[0-9]") & telling, fields).otherwise(words)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines_of(keyed: DataFrame) -> DataFrame:
    """``row, nth, leaf, exact`` (and ``unit``, if it is there) of every line with a token; ``leaf`` and ``exact`` are
    hashes of the path in the tree and of all tokens.  The tokens themselves stay behind."""
    rest = [c for c in ("row", "unit") if c in keyed.columns]
    lines = keyed.select(*rest, F.posexplode(split_lines(F.col("text"))).alias("nth", "line"))
    lines = lines.filter(F.trim("line", F.lit(SPACES)) != "").select(*rest, "nth", masked(F.col("line")).alias("tokens"))
    return lines.select(*rest, "nth", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"), F.xxhash64("tokens").alias("exact"))


@cache
def shared_blocks(size: int, similar: float) -> tuple[int, np.ndarray, np.ndarray]:
    """For lines of ``size`` tokens: in how many places two must agree, where the blocks of their later tokens start and
    end, and which blocks make a key.

    At most ``size - least`` places differ, so of that many blocks and g more, g are free of differences.  Keys are all
    choices of g blocks; there are as many blocks as leave at most ``MOST_KEYS`` of them, or one more than may differ."""
    least = math.ceil(similar * size - 1e-9)
    rest, differ = max(0, size - DEPTH), size - least
    if rest <= differ:  # all later tokens may differ
        return least, np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.int64)
    blocks = max([m for m in range(differ + 1, rest + 1) if math.comb(m, differ) <= MOST_KEYS], default=differ + 1)
    edges = np.arange(blocks + 1) * rest // blocks
    return least, edges, np.array(list(combinations(range(blocks), blocks - differ)), dtype=np.int64)


class Templates:
    """The templates of one leaf, in the order in which they were found."""

    def __init__(self, similar: float):
        self.similar = similar
        self.tokens: list[np.ndarray] = []
        self.keyed: dict[tuple[int, int, int], list[int]] = {}

    def place(self, tokens: np.ndarray) -> int:
        """The number of the first template that agrees with the line; a new one if none does."""
        size = tokens.size
        least, edges, chosen = shared_blocks(size, self.similar)
        sums = np.zeros(max(1, edges.size - 1), dtype=np.uint64)
        if edges[-1]:
            rest = tokens[DEPTH:].view(np.uint64)
            sums = np.add.reduceat(tv.mix(rest + (np.arange(rest.size, dtype=np.uint64) << np.uint64(40))), edges[:-1])
        keys = [(size, k, h) for k, h in enumerate(tv.mix(sums[chosen]).sum(axis=1, dtype=np.uint64).tolist())]
        seen = set()
        for key in keys:
            seen.update(self.keyed.get(key, ()))
        for k in sorted(seen):
            if int((self.tokens[k] == tokens).sum()) >= least:
                return k
        self.tokens.append(tokens)
        for key in keys:
            self.keyed.setdefault(key, []).append(len(self.tokens) - 1)
        return len(self.tokens) - 1


def _families(similar: float):
    """Lines ``leaf, part, exact, n, tokens`` sorted by leaf, part and rank -> the same with ``seed``, their template's
    ``exact``; tokens stay only with templates.  A leaf may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, seeds = None, Templates(similar), []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part, exact = (batch[c].to_numpy() for c in ("leaf", "part", "exact"))
            lists = batch["tokens"]
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            flat, end = np.asarray(lists.flatten()), np.cumsum(size)
            out = np.empty(leaf.size, dtype=np.int64)
            for i in range(leaf.size):
                if at != (leaf[i], part[i]):
                    at, found, seeds = (leaf[i], part[i]), Templates(similar), []
                k = found.place(flat[end[i] - size[i] : end[i]].copy())
                if k == len(seeds):
                    seeds.append(exact[i])
                out[i] = seeds[k]
            own = pa.array(out == exact)
            columns = [batch["leaf"], batch["exact"], batch["n"], pa.array(out), pa.compute.if_else(own, lists, pa.nulls(leaf.size, lists.type))]
            yield pa.RecordBatch.from_arrays(columns, ["leaf", "exact", "n", "seed", "tokens"])

    return run


def _sorted_into(kinds: DataFrame, part: Column, similar: float) -> DataFrame:
    """The line in most documents first, the largest hash among equals."""
    kinds = kinds.select("leaf", part.cast("int").alias("part"), "exact", "n", "tokens").repartition("leaf", "part")
    kinds = kinds.sortWithinPartitions("leaf", "part", F.desc("n"), F.desc("exact"))
    return kinds.mapInArrow(_families(similar), "leaf long, exact long, n long, seed long, tokens array<long>")


def recurring(keyed: DataFrame, min_docs: int, similar: float, units: DataFrame | None = None) -> DataFrame:
    """``row, nth`` of lines whose template recurs, but for those in the template's first document.  ``keyed``: ``row, text``
    and ``unit``, what counts as one document (the smallest one is the first); or units come from ``units`` (``row,
    unit``)."""
    place = mark()
    lines = lines_of(keyed)
    lines = materialize(lines if units is None else lines.join(units, "row"), "lines")
    line = ["leaf", "exact"]
    each = lines.groupBy(*line, "unit").agg(F.min(F.struct("row", "nth")).alias("at"))
    kinds = each.groupBy(*line).agg(F.count("*").alias("n"), F.min("unit").alias("keeper"), F.min("at").alias("at"))
    kinds = materialize(kinds.select(*line, "n", "keeper", "at.row", "at.nth"), "kinds")

    # leaves of several lines that enough documents may reach, and the tokens of their lines
    several = kinds.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("n").alias("docs")).filter((F.col("k") > 1) & (F.col("docs") >= min_docs))
    several = materialize(several.select("leaf"), "several")
    pool = materialize(kinds.join(several.hint("merge"), "leaf", "left_semi").select(*line, "n", "row", "nth"), "pool")
    wanted = materialize(pool.groupBy("row").agg(F.collect_list("nth").alias("want")), "wanted")
    picked = once(split_lines(F.col("text")), lambda s: F.transform("want", lambda k: F.struct(k.alias("nth"), F.get(s, k).alias("line"))))
    there = keyed.select("row", "text").join(wanted.hint("merge"), "row").select("row", F.inline(picked))
    tokens = F.transform(masked(F.col("line")), lambda t: F.when(t == FIELD, F.lit(0).cast("long")).otherwise(F.xxhash64(t)))
    pool = pool.join(there.select("row", "nth", tokens.alias("tokens")).hint("merge"), ["row", "nth"])

    parts = materialize(_sorted_into(pool, F.pmod(F.xxhash64("exact"), F.lit(PARTS)), similar), "parts")
    whole = _sorted_into(parts.filter(F.col("tokens").isNotNull()), F.lit(0), similar)
    whole = materialize(whole.select("leaf", F.col("exact").alias("seed"), F.col("seed").alias("template")), "templates")
    named = parts.select(*line, "seed").join(whole, ["leaf", "seed"]).select(*line, "template")
    # templates of one line are judged by what is known of the line
    wide = named.groupBy("leaf", "template").agg(F.count("*").alias("k")).filter("k > 1").select("leaf", "template")
    named = materialize(named.join(wide, ["leaf", "template"]), "named")
    each = lines.select(*line, "unit").join(named.hint("merge"), line).select("leaf", "template", "unit")
    each = materialize(each, "placed").distinct()
    often = materialize(each.groupBy("leaf", "template").agg(F.count("*").alias("all"), F.min("unit").alias("first")), "counted")
    often = materialize(named.join(often, ["leaf", "template"]).select(*line, "all", "first"), "often")
    decided = kinds.select(*line, "n", "keeper").join(often.hint("merge"), line, "left")
    decided = decided.filter(F.coalesce("all", "n") >= min_docs).select(*line, F.coalesce("first", "keeper").alias("keeper"))
    decided = materialize(decided, "decided")
    gone = materialize(lines.join(decided.hint("merge"), line).filter("unit <> keeper").select("row", "nth"), "gone")
    drop_since(keyed.sparkSession, place, gone)
    return gone


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, text_col: str = "text", copies_apart: bool = False) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``, plus ``n_lines`` and ``n_dropped`` (long; columns of these
    names are replaced, all others come back as they are).

    Lines are set apart by \\n; lines without a token stay and recur nowhere.  A null or empty text
    has one line and stays as it is.  The first document of a template is the one with the smallest
    id, null ids last; among rows of one id it is the one read first.  An empty table gives no rows.

    Near copies (five words, similarity 0.8 or more), repeated rows among them, are one document and are cut alike, so
    that a near-dedup after this step still finds them; with ``copies_apart`` every row counts, and lines go
    from copies and repeated rows too.
    """
    docs, restored = set_aside(docs, "n_lines", "n_dropped")
    place = mark()
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.col("__row").alias("row"), F.col("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    if copies_apart:
        gone = recurring(keyed.select("row", "text", own.alias("unit")), min_docs, similar)
    else:
        copies = groups(keyed.withColumn("doc_id", F.col("doc_id").cast("long"))).select("row", "comp")
        named = materialize(copies.join(keyed.select("row", "doc_id"), "row").select("row", "comp", own.alias("own")), "members")
        first = materialize(named.groupBy("comp").agg(F.min("own").alias("unit")), "firsts")
        units = materialize(named.select("row", "comp").join(first, "comp").select("row", "unit"), "units")
        gone = recurring(keyed.select("row", "text"), min_docs, similar, units)
    cuts = materialize(gone.groupBy(F.col("row").alias("__row")).agg(F.collect_list("nth").alias("__gone")), "cuts")
    drop_since(docs.sparkSession, place, numbered, cuts)
    # the same plan at every size
    out = numbered.join(cuts.hint("merge"), "__row", "left")
    kept = once(split_lines(F.col(text_col)), lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), "__gone"), lambda k: F.get(s, k)), "\n"))
    out = out.withColumns(
        {
            "n_lines": F.size(split_lines(F.col(text_col))).cast("long"),
            "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept),
        }
    )
    return restored(out.select(*docs.columns, "n_lines", "n_dropped"))
