"""URL filters (operator 1): rules, and logistic regression on hashed character n-grams.

A rule ``host/path`` fits its host, all subdomains and paths that start with its path; the longest
fitting rule decides.  All other URLs are judged by a logistic regression on hashed character
3- and 4-grams of host and path, trained from a small labelled URL table.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules (fixed values).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Size of the hashed feature space; rules that one expression holds, and that are sent to all workers beyond it.
FEATURES, MOST_RULES, SENT_RULES = 1 << 14, 500, 100_000
#: Rows of the labelled table that the fit may use.
TRAIN_ROWS = 20_000
#: From held-out labelled urls, which it parts without error; so does anything from 0.45 to 0.8.
THRESHOLD = 0.5

# Words of the labelled hosts: junk in pairs, ordinary ones from dictionaries of several languages (fixed values).
JUNK_FIRST = ("cheap", "free", "hot", "win", "fake", "replica", "instant", "payday", "crack", "adult", "miracle", "spam", "bulk", "online", "lucky", "easy")
JUNK_SECOND = ("pills", "loans", "singles", "prize", "watches", "keygen", "pharmacy", "betting", "cams", "diet", "cash", "clicks", "farm", "casino", "jackpot", "bonus")
#: Names that the labelled table leaves out, so that tests on them say something.
UNLISTED = ("cheap-pills", "spam-farm")
WORDS = (
    "news docs wiki library museum school weather research recipes gardening history garden river mountain bicycle kitchen orchestra village harbour "
    "science chemistry travel railway university hospital council theatre football newspaper bakery carpenter engineering software letters poetry "
    "zeitung wetter schule garten stadt verein bahnhof wissen kirche handwerk reisen gemeinde bibliothek musik "
    "journal meteo ecole jardin mairie voyage cuisine histoire musee librairie sante quartier "
    "noticias escuela ciudad jardines historia cocina viajes biblioteca salud pueblo musica "
    "giornale scuola cucina viaggi comune storia noticia escola cidade cozinha viagem saude krant fiets gemeente tuin keuken "
    "szkola ogrod miasto podroze tidning skola resor bokhandel nyheter sanat kaupunki kirja haber okul kitap shinbun gakko ryori sakana"
).split()
TOPS = ("com", "org", "net", "de", "fr", "es", "it", "nl", "pl", "se", "fi", "co.uk", "edu", "io", "info", "eu", "ch", "com.br", "co.jp", "com.tr")
PREFIXES = ("", "", "www.", "en.", "shop.", "forum.")
PLAIN_PATHS = ("", "/", "/index.php", "/page/7", "/2019/04/17/title", "/en/a-1", "/de/seite-3.html", "/fr/page/5", "/es/p12", "/item?id=4", "/c/90/x.htm")
BLOCKED_PATHS = (*PLAIN_PATHS, "/buy-now", "/viagra", "/free-download.exe", "/claim/bonus")
ALLOWED_PATHS = (*PLAIN_PATHS, "/about", "/articles/report.html", "/contact", "/docs/start")


def labelled_hosts(held_out: bool = False, seed: int = 11) -> list[tuple[str, float]]:
    """Host names without their top domain, and 1.0 for junk.  Held-out ones: other pairs of junk words, and
    ordinary names of words that the table does not hold."""
    rng = random.Random(seed + held_out)
    pairs = [(a, b) for i, a in enumerate(JUNK_FIRST) for j, b in enumerate(JUNK_SECOND) if ((i + j) % 4 == 0) == held_out]
    junk = [a + rng.choice(("-", "-", "")) + b for a, b in pairs if f"{a}-{b}" not in UNLISTED]
    words = [w for i, w in enumerate(WORDS) if (i % 4 == 0) == held_out]
    plain = [*words, *(rng.choice(words) + rng.choice(("-", "")) + rng.choice(words) for _ in range(3 * len(words)))]
    return [(h, 1.0) for h in junk] + [(h, 0.0) for h in plain]


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """The labelled table ``url, block``: four urls of each host, with top domains, prefixes and paths that do not
    depend on the label but for a few paths."""
    rng = random.Random(5 + held_out)
    rows = []
    for host, block in labelled_hosts(held_out):
        paths = BLOCKED_PATHS if block else ALLOWED_PATHS
        rows += [(f"https://{rng.choice(PREFIXES)}{host}.{rng.choice(TOPS)}{rng.choice(paths)}", block) for _ in range(4)]
    return spark.createDataFrame(rows, "url string, block double").coalesce(1)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path).  Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end.  Null or without ``://``: both empty."""
    after = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    place = F.regexp_extract(after, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(place, r"(?s)^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), place.substr(F.length(host) + 1, F.length(place))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, else nulls; equally long ones: the last in the order of
    ``rules``."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):  # the last, longest one is asked first
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found["rule"], found["action"]


def with_rule(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``action`` to rows with ``host`` and ``path``.

    Few rules are one expression.  Of many, each distinct host and path is joined with the rules of its host
    and of every domain above it.
    """
    if len(rules) <= MOST_RULES:
        rule, action = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "action": action})
    listed = [(r.partition("/")[0], "".join(r.partition("/")[1:]), r, action, (len(r), k)) for k, (action, r) in enumerate(rules)]
    table = rows.sparkSession.createDataFrame(listed, "own string, head string, rule string, action string, place struct<long: int, nth: int>")
    table = F.broadcast(table) if len(rules) <= SENT_RULES else table
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct()
    hits = urls.select("host", "path", F.explode(above).alias("own")).join(table, "own").filter(F.col("path").startswith(F.col("head")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), "place").alias("best")).select("host", "path", "best.*")
    return rows.join(best, ["host", "path"], "left")


def with_features(df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``grams`` (3- and 4-grams of host and of path) and ``features`` (hashed, present or not)."""

    def grams(text: str, n: int) -> Column:
        # numbers in a path say little, so all digits look alike; letters are split once, however long the text is
        marked = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        cut = lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(F.lit(text[0]), *(F.get(cs, i + k) for k in range(n))))
        parts = F.flatten(F.transform(F.array(F.split(marked, "")), cut))
        return F.when(F.length(text) + 2 >= n, parts).otherwise(F.array().cast("array<string>"))

    df = df.withColumn("grams", reduce(F.concat, [grams(c, n) for c in (host, path) for n in (3, 4)]))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def fit(labelled: DataFrame, reg: float = 0.002, rounds: int = 60) -> LogisticRegressionModel:
    """Fits on ``url, block`` (1.0: block), both classes with the same weight; the table must not exceed
    ``TRAIN_ROWS`` rows."""
    if labelled.limit(TRAIN_ROWS + 1).count() > TRAIN_ROWS:
        raise ValueError(f"the labelled table has more than {TRAIN_ROWS} rows")
    host, path = url_parts(F.col("url"))
    share = F.broadcast(labelled.agg(F.avg("block").alias("share")))
    weight = F.when(F.col("block") == 1, 0.5 / F.col("share")).otherwise(0.5 / (1 - F.col("share")))
    rows = with_features(labelled.crossJoin(share).select(host.alias("host"), path.alias("path"), F.col("block").alias("label"), weight.alias("weight")))
    model = LogisticRegression(regParam=reg, maxIter=rounds, standardization=False, weightCol="weight")
    return model.fit(rows.select("features", "label", "weight"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block``, one row per input row.

    ``verdict``: ``allow`` or ``block``: the rule's, else ``block`` where the model's probability is over
    ``threshold``.  Of rules of one length the last one given wins.  URLs without a host and path (null, no
    ``://``) are allowed.  Repeated rows are judged alike; extra columns are left out; an empty table gives no rows.
    """
    model = fit(labelled) if labelled is not None else _default_model(pages.sparkSession)
    host, path = url_parts(F.col(url_col).cast("string"))
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    rows = with_features(with_rule(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), rules))
    scored = model.transform(rows).withColumn("p_block", vector_to_array("probability")[1])
    bare = (F.col("host") == "") & (F.col("path") == "")
    guess = F.when((F.col("p_block") > threshold) & ~bare, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", guess).alias("verdict"), "p_block")


_models: dict[str, LogisticRegressionModel] = {}


def _default_model(spark: SparkSession) -> LogisticRegressionModel:
    """The model of ``labelled_urls``, fitted once in a Spark application."""
    key = spark.sparkContext.applicationId
    if key not in _models:
        _models.clear()
        _models[key] = fit(labelled_urls(spark))
    return _models[key]
