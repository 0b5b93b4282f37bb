"""Wallet pairs of a market that act alike.

A pair needs 35 points of 100.  With neither (1) entries within 15 minutes nor (2) exits within 30 it can only reach them with the same
outcome and (3) account ages within 7 days or (4) a size similarity of at least 15/18, or else (5) with full points for age and size.
Each of these is an equality of adjacent buckets, so candidates come from one join by rule and bucket that loses no pair, and not from
all pairs of a market.  All pairs are scored where they meet; they are never shuffled, so disk holds wallets alone however many
pairs there are.

The twenty best pairs of a market are found by a search whose work stays far below all pairs:

1. *Bound.*  Wallets are laid into cells of several sizes; all pairs of one cell lose at most what the cell's size
   says.  The finest cells that hold twenty pairs of a market say how little its twenty best pairs lose at most.
   Cells are only counted; no pair is made.
2. *Search.*  Pairs that may lose no more than that bound meet in cells as wide as the bound allows, by entry and by one
   more measure.  Where a market is crowded the bound is small and so are the cells; no cell of a market holds many wallets, or
   a smaller bound had been found.
3. Wallets alike in everything score alike with everybody, so of many only those come in that win ties by their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, micros, pair_key

ENTRY_S, EXIT_S, AGE_S = 15 * 60, 30 * 60, 7 * 24 * 3600
LEAST_SCORE, TOP_PAIRS = 35.0, 20
#: Points that each measure adds at best.
ENTRY, OUTCOME, SIZE, AGE, EXIT = 30.0, 20.0, 18.0, 17.0, 15.0
#: Sizes of cells, as the points that two wallets of one cell may lose; and what rounding a score to two digits may hide.
CELL_LOSSES = tuple(8.0 / 4**k for k in range(10))
ROUNDING = 0.011
#: Wallets of one cell that meet the others in one task.
MOST_IN_CELL = 4096
#: log of the size ratio below which sizes can still be 15/18 alike; and one for sizes that are equal but for rounding.
SIZE_STEP, EQUAL_STEP = 0.1823215567939546, 1e-4
#: How two wallets may be near: a measure, the width of its cells, and whether the outcome must be the same.  What most pairs meet by comes first.
RULES = (("age", AGE_S, True), ("size", SIZE_STEP, True), ("entry", ENTRY_S, False), ("exit", EXIT_S, False), ("size", EQUAL_STEP, False))


def _seconds(c: str) -> Column:
    return micros(F.col(c)) / 1e6


def _blocks(wallets: DataFrame) -> DataFrame:
    """A row of a wallet for each rule by which it may be in a pair: ``rule, same, cell``; the cells of all rules stay beside them."""
    w = wallets.select("market_id", "wallet", "dominant_outcome", "total_usdc", _seconds("first_ts").alias("entry"), _seconds("first_sell_ts").alias("exit"), _seconds("first_seen").alias("age"))
    size = F.log(F.greatest("total_usdc", F.lit(1.0)))
    w = w.withColumns({f"cell_{k}": F.floor((size if of == "size" else F.col(of)) / width) for k, (of, width, _) in enumerate(RULES)})
    same = lambda alike: F.col("dominant_outcome") if alike else F.lit("")
    blocks = F.array(*(F.struct(F.lit(k).alias("rule"), same(alike).alias("same"), F.col(f"cell_{k}").alias("cell")) for k, (_, _, alike) in enumerate(RULES)))
    return w.select("*", F.inline(blocks)).filter(F.col("cell").isNotNull() & F.col("same").isNotNull())


def met_pairs(wallets: DataFrame) -> DataFrame:
    """Pairs of a market that may reach the least score, each once, with the measures of both sides; ``left`` sorts before ``right``.

    A pair may meet by several rules and counts at the first of them, so no pairs are gathered to be told apart; wallets travel with all
    that scores are made of, so no pair is shuffled.  A full cell is dealt to parts, and what it meets goes to all of them."""
    rows, key = _blocks(wallets), ["market_id", "rule", "same", "cell"]
    full = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_IN_CELL).select(*key, F.ceil(F.col("n") / MOST_IN_CELL).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    # a cell meets itself and the one after it
    met_by = rows.withColumn("after", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("cell", F.col("cell") - F.col("after"))
    # full cells are few: no more than rows by MOST_IN_CELL
    one = rows.join(F.broadcast(full), key, "left").withColumn("part", F.pmod(F.xxhash64("wallet"), parts))
    other = met_by.join(F.broadcast(full), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    own = ("wallet", "dominant_outcome", "total_usdc", "entry", "exit", "age", *(f"cell_{k}" for k in range(len(RULES))))
    side = lambda df, s, *more: df.select(*key, "part", *more, *(F.col(c).alias(f"{s}_{c}") for c in own))
    met = side(one, "left").join(side(other, "right", "after").hint("merge"), [*key, "part"]).filter("after = 1 or left_wallet < right_wallet")
    for k, (_, _, alike) in enumerate(RULES[:-1]):
        near = F.abs(F.col(f"left_cell_{k}") - F.col(f"right_cell_{k}")) <= 1
        if alike:
            near = near & (F.col("left_dominant_outcome") == F.col("right_dominant_outcome"))
        met = met.filter((F.col("rule") <= k) | ~F.coalesce(near, F.lit(False)))
    # measures are those of a pair in either order
    names = {"left_wallet": F.least("left_wallet", "right_wallet"), "right_wallet": F.greatest("left_wallet", "right_wallet")}
    return met.select("market_id", *(c.alias(n) for n, c in names.items()), *(f"{s}_{c}" for s in ("left", "right") for c in own[1:6]))


def pair_candidates(wallets: DataFrame) -> DataFrame:
    """Distinct (market, left, right) that may reach the least score; ``left`` sorts before ``right``."""
    return met_pairs(wallets).select("market_id", "left_wallet", "right_wallet")


def pair_scores(wallets: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Scored pairs of at least 35 points, of ``candidates`` or of all that may have them.  ``wallets``: market_id, wallet,
    first_ts, first_sell_ts, total_usdc, dominant_outcome and first_seen, one row for each wallet of a market."""
    if candidates is None:
        p = met_pairs(wallets)
    else:
        columns = {"entry": _seconds("first_ts"), "exit": _seconds("first_sell_ts"), "age": _seconds("first_seen"), "total_usdc": F.col("total_usdc"), "dominant_outcome": F.col("dominant_outcome")}
        side = lambda s: wallets.select("market_id", F.col("wallet").alias(f"{s}_wallet"), *(c.alias(f"{s}_{name}") for name, c in columns.items()))
        p = candidates.join(side("left"), ["market_id", "left_wallet"]).join(side("right"), ["market_id", "right_wallet"])
    apart = lambda c, most: 1 - clamp(F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) / most)
    known = lambda c, most: F.when(F.col(f"left_{c}").isNotNull() & F.col(f"right_{c}").isNotNull(), apart(c, most)).otherwise(0.0)
    p = p.withColumns(
        {
            "entry_score": apart("entry", ENTRY_S),
            "same_outcome": F.when(F.col("left_dominant_outcome") == F.col("right_dominant_outcome"), 1.0).otherwise(0.0),
            "size_score": 1 - F.abs(F.col("left_total_usdc") - F.col("right_total_usdc")) / F.greatest("left_total_usdc", "right_total_usdc", F.lit(1.0)),
            "age_score": known("age", AGE_S),
            "exit_score": known("exit", EXIT_S),
        }
    )
    points = 0.3 * F.col("entry_score") + 0.2 * F.col("same_outcome") + 0.18 * F.col("size_score") + 0.17 * F.col("age_score") + 0.15 * F.col("exit_score")
    return p.withColumn("score", 100 * points).filter(F.col("score") >= LEAST_SCORE)


def with_reasons(pairs: DataFrame) -> DataFrame:
    """``pair_key``, and the reasons as text in ``evidence``."""
    # sentences (fixed values)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("entry_score") >= 0.7, "Entered the market in a tight time window."),
            F.when(F.col("same_outcome") == 1, "Built exposure on the same outcome."),
            F.when(F.col("age_score") >= 0.7, "Observed account ages are unusually close."),
            F.when(F.col("exit_score") >= 0.7, "Exits were synchronized."),
        )
    )
    return pairs.withColumn("evidence", reasons).withColumn("pair_key", pair_key(F.col("left_wallet"), F.col("right_wallet")))


def pair_evidence(pairs: DataFrame) -> DataFrame:
    """Rounded scores, keys and the reasons as text."""
    rounded = {c: F.round(c, 3) for c in ("entry_score", "same_outcome", "size_score", "age_score", "exit_score")}
    return with_reasons(pairs).withColumns(rounded).withColumn("score", F.round("score", 2))


def _measures(wallets: DataFrame) -> DataFrame:
    """Numbers whose differences bound the points that a pair loses."""
    usd = F.col("total_usdc")
    # |a - b| / max(a, b, 1) is at most the difference of these
    size = F.when(usd < 1, usd).otherwise(1 + F.log(F.greatest(usd, F.lit(1.0))))
    return wallets.withColumns({"__entry": _seconds("first_ts"), "__exit": _seconds("first_sell_ts"), "__age": _seconds("first_seen"), "__size": size})


def without_twins(wallets: DataFrame, n: int) -> DataFrame:
    """Of wallets of one market that agree in all measures, those that can be in its ``n`` best pairs.

    Their pairs with any wallet tie, and ties go by the text ``left|right``.  Of a group only the ``n`` first as ``wallet|``
    can be a left one.  A right one has at most n - 1 before it that would do better, but for those that are the beginning
    of the left name, of which there are no more than it has letters."""
    same = ["market_id", "first_ts", "first_sell_ts", "total_usdc", "dominant_outcome", "first_seen"]
    most = F.lit(n + 1) + F.max(F.length("wallet")).over(Window.partitionBy(*same))
    ranks = [F.row_number().over(Window.partitionBy(*same).orderBy(o)) for o in (F.col("wallet"), F.concat("wallet", F.lit("|")))]
    return wallets.withColumns({"__most": most, "__a": ranks[0], "__b": ranks[1]}).filter("__a <= __most or __b <= __most").drop("__most", "__a", "__b")


def loss_bounds(wallets: DataFrame, n: int = TOP_PAIRS) -> DataFrame:
    """``market_id, bound``: points that each of a market's ``n`` best pairs loses at most, 65 (the least score) where
    no cells tell."""
    w = _measures(wallets)
    steps = F.explode(F.array(*map(F.lit, CELL_LOSSES))).alias("loss")
    # with both ages known or not, and both exits known or not; a quarter of the loss for each measure
    kinds = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(e).alias("e")) for a in (True, False) for e in (True, False)))).alias("kind")
    rows = w.select("market_id", "dominant_outcome", "__entry", "__size", "__age", "__exit", kinds).filter("(not kind.a or __age is not null) and (not kind.e or __exit is not null)")
    rows = rows.select("*", steps)
    part = F.col("loss") / 4

    def cell(c: str, width: float, points: float) -> Column:
        return F.floor(F.col(c) / (part * (width / points)))

    cells = rows.groupBy(
        "market_id", "dominant_outcome", "kind", "loss", cell("__entry", ENTRY_S, ENTRY).alias("x"), cell("__size", 1.0, SIZE).alias("y"),
        F.when(F.col("kind.a"), cell("__age", AGE_S, AGE)).alias("z"), F.when(F.col("kind.e"), cell("__exit", EXIT_S, EXIT)).alias("t"),
    ).agg(F.count("*").alias("c"))
    pairs = cells.filter("c > 1 and dominant_outcome is not null").groupBy("market_id", "kind", "loss").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs"))
    lost = F.col("loss") + F.when(F.col("kind.a"), 0.0).otherwise(AGE) + F.when(F.col("kind.e"), 0.0).otherwise(EXIT)
    found = pairs.filter(F.col("pairs") >= n).groupBy("market_id").agg(F.min(lost).alias("bound"))
    every = wallets.select("market_id").distinct()
    return every.join(found, "market_id", "left").select("market_id", F.least(F.coalesce("bound", F.lit(100 - LEAST_SCORE)) + ROUNDING, F.lit(100 - LEAST_SCORE)).alias("bound"))


def _halves(x: Column, width: Column) -> Column:
    """Cells of twice the width, once more shifted by half: what lies no further apart than the width shares one of them."""
    place = x / (2 * F.greatest(width * (1 + 1e-9), F.lit(1e-6)))
    return F.array(F.struct(F.lit(0).alias("shift"), F.floor(place).alias("cell")), F.struct(F.lit(1).alias("shift"), F.floor(place + 0.5).alias("cell")))


def search_candidates(wallets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct (market, left, right) that may lose no more than the market's bound."""
    w = _measures(wallets).join(bounds, "market_id")
    one = F.array(F.struct(F.lit(0).alias("shift"), F.lit(0).cast("long").alias("cell")))
    kinds = []
    for k in range(8):
        o, a, e = bool(k & 4), bool(k & 2), bool(k & 1)
        left = F.col("bound") - (0.0 if o else OUTCOME) - (0.0 if a else AGE) - (0.0 if e else EXIT)
        fits = F.lit(True)
        for c, on in (("dominant_outcome", o), ("__age", a), ("__exit", e)):
            fits = fits & F.col(c).isNotNull() if on else fits
        second = F.when(left < SIZE, _halves(F.col("__size"), -F.log(1 - F.least(left, F.lit(SIZE - 1e-3)) / SIZE))).otherwise(one)
        if a:
            second = F.when(left < AGE, _halves(F.col("__age"), left * (AGE_S / AGE))).otherwise(second)
        if e:
            second = F.when(left < EXIT, _halves(F.col("__exit"), left * (EXIT_S / EXIT))).otherwise(second)
        near = F.struct(F.lit(k).alias("rule"), (F.col("dominant_outcome") if o else F.lit("")).alias("same"), _halves(F.col("__entry"), left * (ENTRY_S / ENTRY)).alias("xs"), second.alias("ys"))
        kinds.append(F.when(fits & (left >= 0) & (left < ENTRY), near))
    close = w.select("market_id", "wallet", F.inline(F.array_compact(F.array(*kinds)))).select("market_id", "wallet", "rule", "same", F.explode("xs").alias("x"), "ys")
    close = close.select("market_id", "wallet", "rule", "same", "x", F.explode("ys").alias("y"))
    sides = [close.withColumnRenamed("wallet", f"{s}_wallet") for s in ("left", "right")]
    found = sides[0].join(sides[1], ["market_id", "rule", "same", "x", "y"]).filter("left_wallet < right_wallet").select("market_id", "left_wallet", "right_wallet")
    # a bound so wide that entries may lie anywhere: few wallets, or few of a kind
    rest = F.col("bound") - F.when(F.col("__age").isNull(), AGE).otherwise(0.0) - F.when(F.col("__exit").isNull(), EXIT).otherwise(0.0)
    wide = w.filter(rest >= ENTRY).drop("bound", "__entry", "__exit", "__age", "__size")
    return found.union(pair_candidates(wide)).distinct()


def best_pairs(wallets: DataFrame, n: int = TOP_PAIRS) -> DataFrame:
    """The ``n`` best pairs of every market with their scores and evidence, by rounded score, then by pair."""
    few = without_twins(wallets, n)
    return top_pairs(pair_evidence(pair_scores(few, search_candidates(few, loss_bounds(few, n)))), n)


def top_pairs(pairs: DataFrame, n: int = TOP_PAIRS) -> DataFrame:
    w = Window.partitionBy("market_id").orderBy(F.col("score").desc(), F.col("pair_key"))
    return pairs.withColumn("pair_rank", F.row_number().over(w)).filter(F.col("pair_rank") <= n)
