"""Operators 11 to 13 against plain versions, and scratch tables of calls side by side."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm import collocations, decontam, linededup, neardup, pagetree, quality, repeats, scratch, spelling, templates, tokenfile
from tidemark.llm import queries as Q

from .test_operators import ODD, corpus, frame

# ---- spelling variants


def plain_variants(rows, every=97, shortest=5, least=3, times=2):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= shortest and k >= least}
    near = defaultdict(set)
    alike = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            alike[i, cut].append(w)
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    for words in alike.values():
        for w in words:
            near[w].update(v for v in words if v != w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def variants(docs, **how):
    return sorted(tuple(r) for r in spelling.group_variants(docs, **how).collect())


@pytest.mark.parametrize("every, letters", [(97, "ab"), (3, "abé"), (2, "abcd")])
def test_variants_equal_a_plain_version(spark, every, letters):
    rng = random.Random(every)
    words = ["".join(rng.choices(letters, k=rng.choice([4, 5, 5, 6, 7, 9, 12, 13, 25]))) for _ in range(150)]
    for w in list(words[:60]):  # one edit away, also at the ends and in runs
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[0] + w, w + w[-1]]
    rows = [(i % 7 if i % 11 else None, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 60))).title()) for i in range(120)]
    rows += [(5, None), (5, ""), (None, "12 34 --"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants(docs, every=every) == plain_variants(rows, every)


def test_variants_of_long_and_odd_words(spark):
    long = "".join(random.Random(2).choices("abcdefgh", k=3000))
    rows = [(1, " ".join([long] * 8)), (2, " ".join([long[:1500] + "x" + long[1500:]] * 3)), (3, " ".join([long[:2999]] * 3)), (4, " ".join(["a" * 6, "a" * 7, "a" * 8] * 3))]
    rows += [(5, f"{t} naïve×x Ünder ÜNDER ünder ") for t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    assert variants(docs) == plain_variants(rows)
    more = docs.selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as root", "5 as h", "6 as run")
    assert variants(more) == variants(docs)
    assert variants(docs.limit(0)) == []


def test_query_variants(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in Q.op11_spelling_variants(spark, sf).collect()) == plain_variants(rows)


@pytest.mark.parametrize("size", [2, 4, 5, 6, 7, 12, 13, 24, 25, 192, 193, 1000])
def test_places_tile_a_word(spark, size):
    words = spark.createDataFrame([("x" * size, 3)], "word string, n long")
    rows = spelling._keys(words, size).orderBy("start").collect()
    assert [rows[0].start, *(r.stop for r in rows)] == [*(r.start for r in rows), size]
    assert len(rows) >= 2 and max(r.stop - r.start for r in rows) <= max(spelling.WIDE, -(-size // spelling.MOST_PLACES))


def test_no_variants_go_through_the_driver(spark, monkeypatch):
    """Keys are sized as the words that they are exploded from: a vocabulary below the broadcast threshold made keys that the driver could not hold."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    write = spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, name: plan(df) or write(df, name))
    docs = spark.createDataFrame([(i, "colour colour color garden gardens gardens") for i in range(6)], "doc_id long, text string")
    out = spelling.group_variants(docs)
    plan(out)
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)


# ---- collocations


def plain_collocations(rows, least, percent=100, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    inside = {}
    for (lang, p), a in f.items():
        if a >= least and len(p) >= 3:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    key = lang, p[i : i + k]
                    inside[key] = max(inside.get(key, 0), a)
    best = defaultdict(list)
    for (lang, p), a in f.items():
        if a >= least and len(p) >= 2 and not 100 * inside.get((lang, p), -1) >= percent * a:
            cuts = []
            for k in range(1, len(p)):
                left, right = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            best[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, found in best.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts_with_phrases(seed, n=60):
    rng = random.Random(seed)
    words = ["New", "york", "city", "a", "b", "c", "É", "日本", "x y", "it's", "#1"]
    rows = [(rng.choice(["en", "de", "und", "", None]), rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", ";", "!"]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", t) for t in ODD] + [("en", "new york city hall new york city hall")] * 5


@pytest.mark.parametrize("least, percent, top", [(1, 100, 2000), (3, 100, 2000), (4, 80, 7), (5, 100, 3)])
def test_collocations_equal_a_plain_version(spark, least, percent, top):
    rows = texts_with_phrases(least)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, percent, top).collect())
    assert got == plain_collocations(rows, least, percent, top)


def test_collocations_of_colliding_prints(spark, monkeypatch):
    """All fingerprints of a size collide; the texts tell the phrases apart."""
    rows = texts_with_phrases(9, 20)
    block = collocations.Block(pa.array([t for _, t in rows]), pa.array([x for x, _ in rows]))
    real = collocations.Block.prints
    want = {}
    for collide in (False, True):
        monkeypatch.setattr(collocations.Block, "prints", (lambda self, at, n: real(self, at, n) & collocations.U64(1)) if collide else real)

        class Sent:
            value = ~collocations.np.zeros(1 << (collocations.MAP_BITS - 6), dtype=collocations.U64)

        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["lang", "text"])
        found = pa.Table.from_batches(list(collocations._verified(Sent)(iter([batch])))).to_pylist()
        want[collide] = sorted((r["lang"], r["phrase"], r["words"], r["n"]) for r in found)
    assert want[True] == want[False] and len(block.words) > 100


def test_collocations_send_no_phrase_of_a_rare_triple(spark, monkeypatch):
    """All pairs of three words are frequent and few triples are, so the last pass sends few of the longer phrases."""
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choice("abcdef") for _ in range(40))) for _ in range(20)]
    sent, real = spark.sparkContext.accumulator(0), collocations._placed

    def placed(known):
        run = real(known)

        def counting(batches):
            for batch in run(batches):
                sent.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(collocations, "_placed", placed)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found, _ = collocations.frequent_phrases(docs, 13)
    assert sorted({r.words for r in found.select("words").collect()}) == [1, 2]
    assert sent.value <= 60  # 6 words and 36 pairs


def test_collocations_extra_columns_and_empty(spark):
    rows = texts_with_phrases(3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    more = docs.selectExpr("*", "1 as phrase", "2 as n", "3 as print", "4 as rank", "5 as a")
    assert sorted(map(tuple, collocations.collocations(more, 3).collect())) == sorted(map(tuple, collocations.collocations(docs, 3).collect()))
    assert collocations.collocations(docs.limit(0), 3).count() == 0


def test_texts_in_another_order_are_an_error(spark):
    rows = [f"{i} new york city {i}" for i in range(60)]
    docs = spark.createDataFrame([("en", t) for t in rows], "lang string, text string")
    texts = docs.coalesce(1).selectExpr("monotonically_increasing_id() as row", "lang", "text", "array(named_struct('print', 5L, 'place', 1L, 'words', 2, 'n', 60L)) as places")
    with pytest.raises(Exception, match="another order"):
        texts.mapInArrow(collocations._read, collocations._PHRASES).collect()


def test_scores_of_large_numbers_are_exact(spark):
    a, n, left, right = 99_999_999_999, 9_999_999_999_999, 100_000_000_003, 100_000_000_019
    sql = "(cast(a as decimal(17)) * cast(1000 * cast(n as decimal(17)) as decimal(20))) div (cast(l as decimal(18)) * cast(r as decimal(18)))"
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(sql + " as s").first().s
    assert got == 1000 * a * n // (left * right)


def test_query_collocations_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in Q.op13_phrase_collocations(spark, sf).collect())
    assert got == sorted(con.execute(collocations.SQL).fetchall())


# ---- main text


def words_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 8))) for _ in range(n))


def article(i, paragraphs=4):
    return [words_of(f"{i}-{k}", 25) for k in range(paragraphs)]


def marked(i, host="a.example"):
    ps = article(i)
    html = (
        f"<!DOCTYPE html><html><head><title>t {i}</title><style>p{{}}</style><script>var x='</p>';</script></head><body class='has-sidebar'><header><p>{words_of(f'h{i}', 9)}</p></header>"
        f"<nav><ul><li><a href=/{i}>{words_of(f'n{i}', 2)}</a><li><a href=/>Home</a></ul></nav><div class=cookie-notice>{words_of(f'c{i}', 12)}</div><aside>{words_of(f's{i}', 30)}</aside>"
        f"<article><h1>Head {i} &amp; more</h1><div class='ad'>{words_of(f'a{i}', 9)}</div><p>" + "<p>".join(f"{p} &lt;{k}&gt;<br>x\n  y" for k, p in enumerate(ps)) + f"<form><input>{words_of(f'f{i}', 5)}</form></article>"
        f"<section id=comments><article class=comment><p>{words_of(f'k{i}', 40)}</p></article></section><footer>&copy; {words_of(f'z{i}', 6)}</footer></body></html>"
    )
    return f"http://{host}/{i}", html, "\n".join([f"Head {i} & more", *(f"{p} <{k}> x y" for k, p in enumerate(ps))])


def plain_marks(i, host="b.example"):
    """No names say what is what; only other pages of the host do."""
    ps = article(f"u{i}")
    html = (
        f"<html><body><div class=q1><div>Welcome to our place</div><div>All rights reserved by us {'' if i % 2 else ''}</div></div><div class=q2><div class=q3>{words_of(f'x{i}', 4)}</div>"
        f"<div class=q4><h2>Head {i}</h2>" + "".join(f"<p>{p}</p>" for p in ps) + "<p>Read this with a friend</p></div></div><div class=q5><span>Reach us by mail</span></div></body></html>"
    )
    return f"https://{host}/p/{i}?x=1", html, "\n".join([f"Head {i}", *ps])


def extracted(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r for r in templates.extract_main_text(df).collect()}


def test_main_text_of_marked_and_plain_pages(spark):
    pages = [marked(i) for i in range(6)] + [plain_marks(i) for i in range(12)] + [marked(99, "only-one.example")]
    got = extracted(spark, pages)
    for k, (_, _, want) in enumerate(pages):
        assert got[k].text == want, k
        assert got[k].n_chars == len(want)


def test_copies_of_an_article_are_no_template(spark):
    pages = [marked(1, "c.example")] * 12 + [marked(2, "c.example")]
    near = []
    for i in range(9):  # near copies: one paragraph differs
        url, html, want = marked(3, "d.example")
        near.append((url, html.replace("<p>", f"<p>{words_of(f'v{i}', 8)} ", 3), None))
    got = extracted(spark, pages + near)
    for k, (_, _, want) in enumerate(pages):
        assert got[k].text == want
    for k in range(len(pages), len(pages) + 9):
        assert len(got[k].text.split("\n")) == 5


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    broken = ["<", "<p", "a < b <3 & c", "<!-- never", "<script>x", "</div></p>text", "<p>one<p>two", '<a title="x>y">in</a> out', "<table><tr><td>a<td>b<tr><td>c</table>", "<b>x</i>y", "&#0;&#x110000;&nosuch;&amp;amp;", "<p hidden>no</p><p>yes</p>", "\x00\x0b"]
    html = [None, "", " \n", *broken, deep, "word " * 200_000, "<p>" * 20_000]
    pages = [(None if k % 5 == 0 else "no scheme" if k % 5 == 1 else f"http://h{k % 3}.example/", h, None) for k, h in enumerate(html)]
    got = extracted(spark, pages + pages)
    texts = [got[k].text for k in range(len(html))]
    assert texts[:3] == ["", "", ""] and texts[3 + 7] == "in out" and texts[3 + 6] == "one\ntwo" and texts[3 + 8] == "a\nb\nc" and texts[3 + 11] == "yes" and texts[3 + 2] == "a < b <3 & c"
    assert texts[len(html) - 3] == "deep text" and len(texts[len(html) - 2]) == 999_999
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_extraction_of_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(marked(i) for i in range(4))], "page_id int, url string, html string")
    out = templates.extract_main_text(df.selectExpr("*", "1 as host", "2 as text", "3 as page", "4 as texts", "5 as place", "6 as salt", "7 as n_chars"))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["page_id"] == "int"
    assert sorted(r.text for r in out.collect()) == sorted(marked(i)[2] for i in range(4))
    assert templates.extract_main_text(df.limit(0)).count() == 0


def test_templates_joined_by_host_give_the_same(spark, monkeypatch):
    pages = [marked(i) for i in range(4)] + [plain_marks(i) for i in range(12)]
    sent = extracted(spark, pages)
    monkeypatch.setattr(templates, "SENT_BYTES", -1)
    assert extracted(spark, pages) == sent


def test_class_order_and_nesting():
    kind = {1: 10, 2: 10, 3: 20, 4: 20, 5: 30, 6: 30}
    good = {c: (o != 0, p != 0) for c, o, p in templates.class_order([1, 3, 4, 3, 4, 2], kind)}
    assert good == {10: (True, True), 20: (True, True)}
    assert {c: o != 0 for c, o, _ in templates.class_order([3, 4, 4, 3], kind)}[20] is False  # order
    crossed = {c: (o != 0) and p != 0 for c, o, p in templates.class_order([1, 3, 2, 4], kind)}
    assert not all(crossed.values())
    slots = {c: p for c, _, p in templates.class_order([3, 4, 1, 3, 4, 2], kind)}
    assert slots[20] == 0  # in two places


def test_query_pages(spark, sf):
    for r in Q.op12_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(pagetree.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?(?:b|br)>", " ", body))]
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "label, out",
    [("ad", True), ("ad-slot-3", True), ("text-ad", True), ("user-comments-list", True), ("siteFooter", True), ("topnav", True), ("main-menu", True), ("cookie_notice", True), ("Sidebar left", True)]
    + [("content", False), ("has-sidebar", False), ("no-comments", False), ("comments-open", False), ("readable", False), ("article-body", False), ("lead", False), ("addition", False), ("formal", False)],
)
def test_labels(label, out):
    page = pagetree.parse(f"<div class='{label}'><p>text</p></div>")
    assert page.texts[0].at.out is out
    assert pagetree.parse(f"<div id={label.split()[0]}>text</div>").texts[0].at.out is out


# ---- calls side by side


def test_operators_side_by_side(spark):
    docs = frame(spark, corpus(3))
    public = pytest.importorskip("public_tokenizers")

    def op7():
        shards = tokenfile.write_tokens(docs.select("doc_id", "text"), tokenfile.scratch_path(spark, "tokens"), public.path("byte_bpe_50k.json"), public.PATTERN, end_id=0)
        return sorted(tuple(r) for r in tokenfile.read_tokens(shards).select("doc_id", "start", "n_tokens").collect())

    jobs = [
        lambda: sorted(map(tuple, linededup.drop_recurring_lines(docs.select("doc_id", "text"), copies_apart=True).select("doc_id", "n_lines", "n_dropped").collect())),
        lambda: sorted(map(tuple, neardup.near_duplicates(docs.select("doc_id", "text"), width=3, num=85, den=100).collect())),
        op7,
        lambda: sorted(map(tuple, repeats.remove_repeats(docs.select("doc_id", "text"), length=9).collect())),
    ]
    alone = [job() for job in jobs]
    with ThreadPoolExecutor(4) as pool:
        assert [f.result() for f in [pool.submit(job) for job in jobs]] == alone


def test_a_scope_deletes_only_its_own(spark):
    df = spark.range(3)
    outer = scratch.mark()
    a = scratch.materialize(df, "a")
    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(scratch.materialize, df, "other").result()
    inner = scratch.mark()
    scratch.materialize(df, "b")
    scratch.drop_since(spark, inner)
    scratch.drop_since(spark, outer, a)
    assert a.count() == other.count() == 3
    scratch.drop(a, other)


# ---- columns of any name

NAMES = ("__n", "__spans", "__windows", "__host", "__w", "__l", "__t", "__s", "__row", "__gone", "__number", "__bad", "__own", "__salt", "aside0", "row", "nth", "unit", "host", "hosts", "spans")


def test_operators_and_stages_give_back_columns_of_any_name(spark, sf):
    import corpus_pipeline as cp

    docs = frame(spark, corpus(5)).drop("n_words")
    wide = docs.selectExpr("*", *(f"concat('{c}-', coalesce(doc_id, -1)) as {c}" for c in NAMES))
    items = spark.read.parquet(f"{sf}/benchmark.parquet")

    def whole(out):
        for r in out.select("doc_id", *NAMES).collect():
            assert [r[c] for c in NAMES] == [f"{c}-{-1 if r.doc_id is None else r.doc_id}" for c in NAMES]
        return sorted(map(tuple, out.drop(*NAMES).collect()), key=str)

    for op in (lambda d: decontam.find_items(d, items), quality.judge, linededup.drop_recurring_lines):
        assert whole(op(wide)) == sorted(map(tuple, op(docs).collect()), key=str)
    more = wide.selectExpr("*", "'k' as kept", "'w' as n_words", "'d' as n_dropped", "'c' as contaminated")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns
        assert {tuple(r) for r in out.select("kept", "n_words", "n_dropped", "contaminated").collect()} <= {("k", "w", "d", "c")}
        whole(out)
