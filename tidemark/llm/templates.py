"""Main text of web pages by equivalence-class template deduction (operator 12).

1. Every page is a sequence of tokens: start tags and end tags with their paths, and blocks of text with theirs.
2. The occurrence vector of a token says how often each page of its host has it; tokens with equal vectors are one class.
   Vectors are compared by an order-free sum of hashes of (page, number), so no vector is ever gathered.  Pages whose texts
   may all be of one article count once: many copies of an article don't make it a template.
3. A class is valid if it stands on half of its host's pages, has two tokens or more, if they stand in the same order everywhere
   and if its instances nest in the same slot of the same class everywhere.  Valid classes are the host's template.
4. Text that is part of a template, and slots that hold the same few texts on all pages, are the host's own.  What is left of
   the slots is extracted, from the article's place: the element that the page marks as article or main part, else the
   deepest one that holds most of the text of the host's pages.

Names of elements, classes and ids tell what an invariable or a variable slot is for (menus, adverts, comments and so on).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .pagetree import Page, candidates, holder, number, parse, volumes
from .scratch import drop_since, mark, materialize
from .urls import url_parts

#: Different pages that a host needs before anything is taken for its template.
PAGES = 3
#: Share of a host's pages, in percent, on which a class stands, and on which a text of a template stands.
CLASS_PERCENT, TEXT_PERCENT = 50, 90
#: A slot with ``SLOT_TEXTS`` texts or more of which at most a tenth differ is the host's own.
SLOT_TEXTS, SLOT_SHARE = 10, 10
#: Percent of a host's candidate text that may be the host's own: where the pages mark their articles, and where they don't.  More of
#: it means pages that are copies of one another, of which nothing says what is the host's own.
MARKED_PERCENT, OWN_PERCENT = 20, 50
#: Percent of a host's text that the article's place holds.
PLACE_PERCENT = 70
#: Bytes of templates that are sent to all workers; more are joined by host, each host dealt to ``SALTS`` parts.
SENT_BYTES, SALTS = 32 << 20, 32


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return tv.slices(rows, "html", 8 << 20)


_SCANNED = "host string, page long, tok array<long>, times array<int>, seq array<int>, txt array<long>, slot array<long>, chars array<int>, path array<long>, depth array<int>, vol array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page with their numbers and order, its texts with their slots, and how much text each element holds."""
    for batch in _batches(batches):
        cols: list[list] = [[] for _ in range(10)]
        for html in batch["html"].to_pylist():
            page = parse(html or "")
            tok, first, seq = np.unique(np.array(page.tokens, dtype=np.int64), return_index=True, return_inverse=True)
            some = candidates(page)
            vol = volumes(some) if some and not (some[0].at.article or some[0].at.main) else {}
            row = (
                number(np.array([t.token for t in some] or page.tokens, dtype=np.int64).tobytes()), tok, np.bincount(seq, minlength=tok.size), seq,
                [t.token for t in some], [t.at.path for t in some], [len(t.text) for t in some],
                list(vol), [v[0] for v in vol.values()], [v[1] for v in vol.values()],
            )
            for col, value in zip(cols, row):
                col.append(value)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2]
        arrays = [pa.array(c, type=k) for c, k in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([batch["host"], *arrays], ["host", "page", "tok", "times", "seq", "txt", "slot", "chars", "path", "depth", "vol"])


def class_order(tokens: list[int], kind: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(class, order, parent) of the classes on a page: hashes of the order of a class's tokens and of the slot it nests in.

    0 stands for a class that fails: its tokens change their order, or its instances cross others or nest in different slots."""
    of: dict[int, list[int]] = defaultdict(list)
    for t in tokens:
        if t in kind:
            of[kind[t]].append(t)
    turn: dict[int, dict[int, int]] = {}
    order: dict[int, int] = {}
    for c, found in of.items():
        one = list(dict.fromkeys(found))
        good = found == one * (len(found) // len(one))
        order[c] = number(np.array(one, dtype=np.int64).tobytes()) or 1 if good else 0
        if good:
            turn[c] = {t: i for i, t in enumerate(one)}
    parents: dict[int, int] = {}
    stack: list[tuple[int, int]] = []  # class, place of its last token
    for t in tokens:
        c = kind.get(t)
        if c not in turn:
            continue
        i = turn[c][t]
        if i:
            if all(above != c for above, _ in stack):
                order[c] = 0  # another class has cut it off
                continue
            while stack[-1][0] != c:
                order[stack.pop()[0]] = 0  # it goes on past the end of its slot
            stack[-1] = c, i
        else:
            above = number(np.array(stack[-1], dtype=np.int64).tobytes()) if stack else 1
            if parents.setdefault(c, above) != above:
                parents[c] = 0
            stack.append((c, 0))
        if i == len(turn[c]) - 1:
            stack.pop()
    for c in of:
        yield c, order[c], parents.get(c, 0)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for host, tok, seq, kinds, members in zip(*(batch[c].to_pylist() for c in ("host", "tok", "seq", "kinds", "members"))):
            kind = dict(zip(members, kinds))
            out += [(host, *found) for found in class_order([tok[i] for i in seq], kind)]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, (pa.string(), *[pa.int64()] * 3))], ["host", "kind", "order", "parent"])


def _with_host(rows: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """Rows with their host's row of a table of ``size`` bytes; a hot host's rows are dealt to many tasks in both ways."""
    if size <= SENT_BYTES:
        return rows.join(F.broadcast(table), "host", "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return rows.withColumn("salt", salt).join(copies.hint("merge"), ["host", "salt"], "left").drop("salt")


def _bytes(table: DataFrame, *lists: str) -> int:
    sizes = sum((F.greatest(F.size(c), F.lit(0)) for c in lists), F.length("host") + 64)
    return 8 * (table.agg(F.sum(sizes)).first()[0] or 0)


def host_templates(scanned: DataFrame) -> DataFrame:
    """(host, place, texts, slots): the article's place, and the texts and slots that are the host's own."""
    once = scanned.groupBy("host", "page").agg(F.any_value(F.struct("tok", "times", "seq", "txt", "slot", "chars", (F.size("path") == 0).alias("marked"))).alias("x"))
    once = materialize(once.select("host", "page", "x.*"), "pages")
    hosts = once.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= PAGES)
    seen = once.select("host", "page", F.explode(F.arrays_zip("tok", "times")).alias("x")).select("host", "page", "x.tok", "x.times")
    vectors = seen.groupBy("host", "tok").agg(F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "times")).alias("kind"))
    vectors = vectors.filter(F.col("on") > 1).join(hosts, "host").filter(100 * F.col("on") >= CLASS_PERCENT * F.col("pages"))
    # at most twice as many tokens as a page of the host has on average
    vectors = materialize(vectors, "vectors")
    classes = vectors.groupBy("host", "kind").agg(F.collect_list("tok").alias("members")).filter(F.size("members") > 1)
    classes = classes.select("host", "kind", F.explode("members").alias("tok")).groupBy("host")
    classes = materialize(classes.agg(F.collect_list("kind").alias("kinds"), F.collect_list("tok").alias("members")), "classes")
    rows = _with_host(once.select("host", "tok", "seq"), classes, _bytes(classes, "kinds", "members")).filter("kinds is not null")
    checked = rows.mapInArrow(_checked, "host string, kind long, order long, parent long")
    valid = checked.groupBy("host", "kind").agg(*(f("order").alias(n) for f, n in ((F.min, "o"), (F.max, "p"))), *(f("parent").alias(n) for f, n in ((F.min, "q"), (F.max, "r"))))
    valid = valid.filter("o = p and o <> 0 and q = r and q <> 0").select("host", "kind")
    template = materialize(vectors.join(valid, ["host", "kind"]).select("host", "tok", "on", "pages"), "template")
    # texts by slot, and what of them is the host's own
    texts = once.select("host", F.explode(F.arrays_zip("txt", "slot", "chars")).alias("x")).select("host", "x.*")
    texts = texts.groupBy("host", "slot", "txt").agg(F.count("*").alias("times"), F.sum("chars").alias("chars"))
    fixed = template.filter(100 * F.col("on") >= TEXT_PERCENT * F.col("pages")).select("host", F.col("tok").alias("txt"), F.lit(True).alias("fixed"))
    texts = materialize(texts.join(fixed, ["host", "txt"], "left"), "texts")
    slots = texts.groupBy("host", "slot").agg(
        F.sum("times").alias("times"), F.count("*").alias("different"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("fixed"), F.col("chars"))).alias("fixed_chars"),
        F.collect_set(F.when(F.col("fixed"), F.col("txt"))).alias("texts"),
    )
    known = template.select("host", F.col("tok").alias("slot"), F.lit(True).alias("known"))
    slots = slots.join(known, ["host", "slot"], "left")
    own = F.col("known") & (F.col("times") >= SLOT_TEXTS) & (SLOT_SHARE * F.col("different") <= F.col("times"))
    slots = slots.withColumn("own", F.coalesce(own, F.lit(False)))
    found = slots.groupBy("host").agg(
        F.sum("chars").alias("chars"), F.sum(F.when(F.col("own"), F.col("chars")).otherwise(F.coalesce("fixed_chars", F.lit(0)))).alias("own_chars"),
        F.collect_list(F.when(F.col("own"), F.col("slot"))).alias("slots"), F.flatten(F.collect_list(F.when(~F.col("own"), F.col("texts")))).alias("texts"),
    )
    marks = once.filter(F.size("txt") > 0).groupBy("host").agg(F.bool_or("marked").alias("marked"))
    most = F.when(F.col("marked"), MARKED_PERCENT).otherwise(OWN_PERCENT)
    found = found.join(marks, "host").filter(100 * F.col("own_chars") <= most * F.col("chars")).select("host", "texts", "slots")
    # the article's place on pages that mark none
    held = scanned.select("host", F.explode(F.arrays_zip("path", "depth", "vol")).alias("x")).select("host", "x.*")
    held = held.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.sum("vol").alias("vol"))
    whole = held.filter("path = 0").select("host", F.col("vol").alias("whole"))
    held = held.join(whole, "host").filter((F.col("path") != 0) & (100 * F.col("vol") >= PLACE_PERCENT * F.col("whole")))
    places = held.groupBy("host").agg(F.max_by("path", F.struct("depth", "vol", "path")).alias("place"))
    return materialize(places.join(found, "host", "full").select("host", "place", "texts", "slots"), "templates")


def main_text(page: Page, place: int | None, texts: set[int], slots: set[int]) -> str:
    """The text of a page that its host's template leaves."""
    some = candidates(page)
    left = [t for t in some if t.token not in texts and t.at.path not in slots]
    if left and not (left[0].at.article or left[0].at.main):
        if not any(place in t.at.holders for t in left):
            place = holder(volumes(left), PLACE_PERCENT)
        left = [t for t in left if not place or place in t.at.holders]
    return "\n".join(t.text for t in left)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _batches(batches):
        out = []
        for html, place, texts, slots in zip(*(batch[c].to_pylist() for c in ("html", "place", "texts", "slots"))):
            out.append(main_text(parse(html or ""), place, set(texts or ()), set(slots or ())))
        text = pa.array([x.encode("utf-8", "surrogatepass").decode("utf-8", "replace") for x in out], type=pa.string())
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], text, pa.array([len(x) for x in out], type=pa.int64())], ["page_id", "url", "text", "n_chars"])


def _host(url: Column) -> Column:
    return F.coalesce(url_parts(url)[0], F.lit(""))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The article of every page, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    comments.

    Character references are decoded; white space inside a block is one space; blocks are joined by one line feed.

    Returns ``page_id, url, text, n_chars``, one row per input row.  Null or empty html: empty text.  Null urls and urls without
    ``://`` are one host of their own.  Repeated rows are extracted alike and count once for a template; a host of fewer
    than three different pages has no template, and names and the size of its elements decide alone.  Ties go to the deepest
    element.  An empty table gives no rows; extra columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", _host(F.col("url")))
    scope = mark()
    scanned = materialize(rows.select("host", "html").mapInArrow(_scan, _SCANNED), "scanned")
    templates = host_templates(scanned)
    drop_since(pages.sparkSession, scope, templates)
    joined = _with_host(rows, templates, _bytes(templates, "texts", "slots"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.select("page_id", "url", "html", "place", "texts", "slots").mapInArrow(_extract, schema)
