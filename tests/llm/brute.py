"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text, lower=False):
    return SPACED.findall((text or "").translate(LOWER) if lower else text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(texts, length):
    """[(n_words, n_removed, kept)] by text."""
    words = [spaced(t) for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        cut = {j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut)))
    return out


def components(ids, texts, width, num, den):
    """{index: (set size, component id)}."""
    sets = []
    for t in texts:
        w = spaced(t, lower=True)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        low[find(i)].append(ids[i])
    return {i: (len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i in range(len(ids))}


def contaminated(texts, items, window):
    """[(n_words, n_hit, sorted items)] by text."""
    patterns = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        if w and item is not None:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                patterns[tuple(w[i : i + m])].add(str(item))
    out = []
    for t in texts:
        w, hit, found = alnum(t), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in patterns:
                    hit.update(range(i, i + m))
                    found |= patterns[tuple(w[i : i + m])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def measures(text):
    text = text or ""
    w = spaced(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    covered = {j for i, x in enumerate(tri) if count[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def phrases(text, every):
    w = alnum(text)
    places, labels = [], set()
    for phrase, label in every:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def masked(line):
    words = spaced(line)
    fields = ["<*>" if re.search("[0-9]", w) else w for w in words]
    return fields if any(f != "<*>" for f in fields) else words


def spark_hashes(spark):
    """The engine's hashes of lines of tokens, which only break ties and deal lines out."""
    from pyspark.sql import functions as F

    def run(lines):
        rows = spark.createDataFrame([(list(t),) for t in lines], "t array<string>").select("t", F.xxhash64("t").alias("h"))
        rows = rows.select("t", "h", F.pmod(F.xxhash64("h"), F.lit(16)).alias("part"))
        return {tuple(r.t): (r.h, r.part) for r in rows.collect()}

    return run


def templates(lines, similar):
    """(leaf, exact, exact of its template, tokens of a template) of lines (leaf, exact, tokens) in order: each goes to the
    first template of its leaf that agrees in enough places."""
    seeds, out = [], []
    for leaf, exact, t in lines:
        found = next((e for at, e, s in seeds if at == leaf and len(s) == len(t) and sum(a == b for a, b in zip(s, t)) >= similar * len(t)), None)
        if found is None:
            seeds.append((leaf, exact, t))
        out.append((leaf, exact, exact if found is None else found, list(t) if found is None else None))
    return out


def lines(ids, texts, min_docs, similar, hashes, groups=None):
    """[(id, text, n_lines, n_dropped)] by rank of the row: by id, nulls last, then as given.  Rows count each, or all rows
    of one group (``groups``: by row) count once."""
    rows = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    unit = {}
    for rank, i in enumerate(rows):
        unit.setdefault(i if groups is None else groups[i], rank)
    of_row = [unit[i if groups is None else groups[i]] for i in rows]
    docs = defaultdict(set)  # line -> ranks of its units
    for rank, i in enumerate(rows):
        for x in (texts[i] or "").split("\n"):
            if spaced(x):
                docs[tuple(masked(x))].add(of_row[rank])
    known = hashes(docs)
    ranked = sorted(docs, key=lambda t: (len(t), t[:2], known[t][1], -len(docs[t]), -known[t][0]))
    first = templates([((len(t), t[:2], known[t][1]), t, t) for t in ranked], similar)
    seeds = sorted({s for _, _, s, _ in first}, key=lambda t: (len(t), t[:2], -len(docs[t]), -known[t][0]))
    top = {e: s for _, e, s, _ in templates([((len(t), t[:2]), t, t) for t in seeds], similar)}
    of = {e: top[s] for _, e, s, _ in first}
    reached = defaultdict(set)
    for t, ranks in docs.items():
        reached[of[t]] |= ranks
    out = []
    for rank, i in enumerate(rows):
        parts = (texts[i] or "").split("\n")
        kept = [x for x in parts if not spaced(x) or len(r := reached[of[tuple(masked(x))]]) < min_docs or min(r) == of_row[rank]]
        out.append((ids[i], "\n".join(kept) if texts[i] is not None else None, len(parts), len(parts) - len(kept)))
    return out


def quality_kept(rows):
    """Whether each of the rows (host, text) is kept."""
    found = [measures(t) for _, t in rows]
    failed = [n < 50 or 100 * repeat > 50 * n for n, _, _, _, repeat in found]
    by = defaultdict(list)
    for (host, _), bad in zip(rows, failed):
        by[host].append(bad)
    mean = sum(failed) / len(failed)
    rates = [sum(x) / len(x) for x in by.values()]
    spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
    weight = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1 if spread > 0 else 1000.0))
    bad = {h for h, x in by.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    strict = [n < 100 or 100 * repeat > 30 * n or 10 * symbols > chars or dup >= 5 for n, chars, symbols, dup, repeat in found]
    return [not f and not (host in bad and s) for (host, _), f, s in zip(rows, failed, strict)]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host = rest.split("/", 1)[0]
    return host.translate(LOWER), rest[len(host) :]


def rule_of(host, path, rules):
    """(rule, action) of the longest rule that fits, the last of equally long ones."""
    found = (None, None)
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + tail):
            found = (rule, action)
    return found


def grams(host, path):
    out = []
    for name, text in (("h", host), ("p", path)):
        marked = "^" + re.sub("[1-9]", "0", text) + "$"
        for n in (3, 4):
            out += [name + marked[i : i + n] for i in range(len(marked) - n + 1)]
    return out
