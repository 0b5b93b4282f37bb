"""Secret scans by grammar inference (operator 9).

Labelled credentials become a prefix tree of character classes.  States whose outgoing
frequencies are statistically compatible (Hoeffding bound, for all their continuations) are
merged, which turns the tree into a probabilistic automaton (ALERGIA, Carrasco and Oncina 1994).
A second automaton is learned from labelled plain tokens.  Every candidate in a text, a run of
credential characters with a letter and a digit, is scored by its log-likelihood ratio per
character, as a whole and by its parts between separators, so that an unknown prefix hides nothing;
those above ``threshold`` are reported next to the fixed formats.  What these find is scored too, but
reported whatever its score, and what they leave of a candidate is a candidate.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

# Fixed formats (fixed values): kind, pattern, group that must have the least length.
FORMATS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.ASCII), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}", re.ASCII), 0, 24),  # runs below 24 would be dropped anyway
)
LEARNED = "format"
#: Bits a character.  Chosen on tokens of seeds that neither the learning nor the held-out figures use.
THRESHOLD = 0.3
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}", re.ASCII)
SEPARATOR, LEAST_PART = re.compile(r"[_.=/-]", re.ASCII), 16
LETTER_DIGIT = re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])", re.ASCII)
END = ""
_CLASSES = {**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")}
SYMBOLS = ("9", "a", "g", "A", "+", "/", "_", ".", "=", "-", END)
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def classes(token: str) -> list[str]:
    return [_CLASSES.get(c, c) for c in token]


class Automaton:
    """A probabilistic deterministic automaton: per state, counts of symbols and their targets."""

    def __init__(self, counts: list[dict[str, int]], target: list[dict[str, int]]):
        self.counts, self.target = counts, target
        self.total = [sum(c.values()) for c in counts]

    def cost(self, symbols: list[str], smooth: float = 0.5) -> float:
        """Bits that the automaton spends on the symbols and the end."""
        bits, state = 0.0, 0
        for s in (*symbols, END):
            c = self.counts[state] if state >= 0 else {}
            total = self.total[state] if state >= 0 else 0
            bits -= math.log2((c.get(s, 0) + smooth) / (total + smooth * len(SYMBOLS)))
            state = self.target[state].get(s, -1) if state >= 0 else -1
        return bits


def learn(samples: Iterable[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA: builds the prefix tree of the samples and merges compatible states."""
    counts: list[dict[str, int]] = [{}]
    target: list[dict[str, int]] = [{}]
    for token in samples:
        state = 0
        for s in classes(token):
            counts[state][s] = counts[state].get(s, 0) + 1
            if s not in target[state]:
                target[state][s] = len(counts)
                counts.append({})
                target.append({})
            state = target[state][s]
        counts[state][END] = counts[state].get(END, 0) + 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        seen = set()
        while todo:
            x, y = todo.pop()
            if (x, y) in seen or x == y:
                continue
            seen.add((x, y))
            n1, n2 = sum(counts[x].values()), sum(counts[y].values())
            if not n1 or not n2:
                continue
            for s in {*counts[x], *counts[y]}:
                if differ(counts[x].get(s, 0), n1, counts[y].get(s, 0), n2):
                    return False
                if s in target[x] and s in target[y]:
                    todo.append((target[x][s], target[y][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            for s, n in counts[y].items():
                counts[x][s] = counts[x].get(s, 0) + n
            for s, t in target[y].items():
                if s in target[x]:
                    todo.append((target[x][s], t))
                else:
                    target[x][s] = t

    red = [0]
    while True:
        blue = [(r, s, t) for r in red for s, t in target[r].items() if t not in red]
        if not blue:
            break
        r, s, b = max(blue, key=lambda x: (sum(counts[x[2]].values()), -x[2]))
        for q in red:
            if compatible(q, b):
                target[r][s] = q
                fold(q, b)
                break
        else:
            red.append(b)
    place = {q: k for k, q in enumerate(red)}
    return Automaton([counts[q] for q in red], [{s: place[t] for s, t in target[q].items()} for q in red])


def labelled_credentials(each: int = 40, seed: int = 7) -> list[tuple[str, bool]]:
    """Labelled tokens (token, is a credential), ``each`` of every format; made by rule, so that no
    real credential is stored.  The number is the bound of the training set."""
    rng = random.Random(seed)
    some = lambda n, letters=ALNUM: "".join(rng.choices(letters, k=n))
    hexes, b64, upper, lower = "0123456789abcdef", ALNUM + "+/", ALNUM[:26] + ALNUM[52:], ALNUM[26:]
    good = (
        lambda: "ghp_" + some(36),
        lambda: "glpat-" + some(20, ALNUM + "_-"),
        lambda: "xoxb-" + some(12, "0123456789") + "-" + some(24),
        lambda: "sk_live_" + some(24),
        lambda: "AIza" + some(35, ALNUM + "_-"),
        lambda: "SG." + some(22) + "." + some(43),
        lambda: "eyJ" + some(33) + "." + "eyJ" + some(50) + "." + some(43, ALNUM + "_-"),
        lambda: "AKIA" + some(16, upper),
        lambda: some(40, b64),
        lambda: some(43, b64) + "=",
        lambda: some(32, hexes),
        lambda: some(40, hexes),
        lambda: some(32, lower),
    )
    word = lambda: "".join(rng.choice(("re", "ti", "on", "an", "er", "st", "en", "le", "in", "do")) for _ in range(rng.randint(2, 6)))
    number = lambda n: some(n, "0123456789")
    plain = (
        lambda: word() + word() + word() + number(1),
        lambda: "_".join(word() for _ in range(3)) + "_" + number(2),
        lambda: "-".join(word() for _ in range(4)) + "-" + number(rng.randint(1, 4)),
        lambda: "/".join(word() for _ in range(3)) + "/" + number(3) + ".html",
        lambda: f"20{number(2)}-0{number(1)}-1{number(1)}T1{number(1)}" + "-" + word(),
        lambda: number(3) + "." + number(3) + "." + number(2) + "." + number(3) + "." + word(),
        lambda: "www." + word() + word() + ".example.com/" + number(3),
        lambda: word() + "=" + number(2) + "." + number(3) + word(),
        lambda: number(16) + word(),
        lambda: word().upper() + "-" + number(6) + "-" + word().upper(),
        lambda: "v" + number(1) + "." + number(2) + "." + number(1) + "-" + word() + "." + number(1),
        lambda: "-" * rng.randint(8, 30) + number(2) + word(),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + number(2),
        lambda: word() + number(rng.randint(1, 2)) + "." + word() + word() + "." + rng.choice(("com", "org", "net", "de")),
    )
    return [(make(), label) for makers, label in ((good, True), (plain, False)) for make in makers for _ in range(each)]


class Scorer:
    """Log-likelihood ratio of a token's format, in bits per character: above 0, it looks more like a
    labelled credential than like a plain token."""

    def __init__(self, labelled: list[tuple[str, bool]], alpha: float = 0.05):
        self.secret = learn((t for t, good in labelled if good), alpha)
        self.plain = learn((t for t, good in labelled if not good), alpha)

    def ratio(self, token: str) -> float:
        symbols = classes(token)
        return (self.plain.cost(symbols) - self.secret.cost(symbols)) / (len(symbols) + 1)

    def score(self, token: str) -> float:
        """The largest ratio of the token and of its longer parts."""
        parts = [p for p in SEPARATOR.split(token) if LEAST_PART <= len(p) < len(token) and LETTER_DIGIT.match(p)]
        return max(map(self.ratio, [token, *parts]))


Span = tuple[int, int, int, float]


def base_spans(text: str, scorer: Scorer | None = None) -> list[Span]:
    """(start, number of the kind, end, score of the value) of the fixed formats, leftmost and non-overlapping in each
    kind."""
    score = scorer.score if scorer else lambda token: 0.0
    return sorted(
        (m.start(), k, m.end(), score(m.group(group)))
        for k, (_, pattern, group, least) in enumerate(FORMATS)
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    )


def learned_spans(text: str, scorer: Scorer, threshold: float, taken: list[Span]) -> list[Span]:
    """Candidates over the threshold; of a candidate that fixed formats touch, what they leave of it.  ``taken`` is sorted, so
    each of its spans is passed once."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        free, at = [], max(m.start(), reach)
        while k < len(taken) and taken[k][0] < m.end():
            free.append((at, taken[k][0]))
            reach = max(reach, taken[k][2])
            at = max(at, reach)
            k += 1
        free.append((at, m.end()))
        for a, b in free:
            token = text[a:b]
            if b - a >= LEAST and LETTER_DIGIT.match(token):
                score = scorer.score(token)
                if score > threshold:
                    out.append((a, len(FORMATS), b, score))
    return out


def find_secrets(docs: DataFrame, labelled: list[tuple[str, bool]] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, score), code points with end exclusive, by start,
    then kind; ``score``: bits per character.  A column of that name is replaced.

    Null or empty texts have no spans; repeated rows get the same; all other columns stay; an empty table gives no
    rows.  Time grows with a text's length.
    ``labelled``: tokens to learn from (by default ``labelled_credentials()``).
    """
    scorer = Scorer(labelled or labelled_credentials())
    kinds = [k for k, *_ in FORMATS] + [LEARNED]
    rest = [c for c in docs.columns if c != "spans"]
    schema = docs.select(rest).withColumn("spans", F.lit(None).cast("array<struct<kind:string,start:long,end:long,score:double>>")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, text_col):
            rows = []
            for text in batch[text_col].to_pylist():
                base = base_spans(text, scorer) if text else []
                more = learned_spans(text, scorer, threshold, base) if text else []
                every = sorted(base + more)
                rows.append([{"kind": kinds[k], "start": a, "end": b, "score": score} for a, k, b, score in every])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(rows, type=kind)], [*rest, "spans"])

    return docs.select(rest).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", mask: str = "[secret]") -> DataFrame:
    """Replaces every span in the text by ``mask``; overlapping spans are masked as one.  Null texts stay null."""
    names = docs.columns

    def masked(text: str | None, spans: list[dict] | None) -> str | None:
        if not text or not spans:
            return text
        parts, at = [], 0
        for a, b in sorted((s["start"], s["end"]) for s in spans):
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, text_col):
            texts = pa.array(map(masked, batch[text_col].to_pylist(), batch[spans_col].to_pylist()), type=pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text_col else batch[c] for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
