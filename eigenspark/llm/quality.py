"""Quality rules whose cutoffs are chosen under a proven risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_words, checkpointed, let

#: Rules: a name, the value as a rate, and the cutoffs tried; a document fails a rule if its value is over the cutoff.
CUTOFFS = {
    "symbol_rate": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "dup_line_rate": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeat_rate": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45),
    "long_word": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "shouting": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
}
#: In each stratum at most this part of the good documents may be rejected, with this confidence over all tests.
MAX_FALSE_REJECTION, CONFIDENCE = 0.02, 0.95
#: One in so many labelled documents tells the order of the tests; the others are tested with.
LEARNING = 4


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text.

    Texts without an equal pair of windows are settled by a set.  For others, starts of repeated windows come from one
    sort of (window, place); each start then covers 3 words less its overlap with the next one.  Windows are compared
    by a 64-bit hash, within one text.
    """

    def of(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), among)

    def among(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), starts), covered))

    def starts(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, of)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Adds the counts of the base rules and the rates of the method's rules to doc_id and the stratum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("t"), blank_words(F.col("text")).alias("w"))
    lines = let(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.regexp_count("t", F.lit("\n")).alias("breaks"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("capitals"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        *rows.columns[:7],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_rate"),
        (F.col("n_dup_lines") / (F.col("breaks") + 1)).alias("dup_line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
        per("word_chars", "n_words").alias("long_word"),
        per("capitals", "word_chars").alias("shouting"),
    )


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1, by Stirling's series of x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return series - shift


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), and 1 where k is n * p or more.

    Below n * p the terms fall from k downwards, faster than those of a normal curve; they are added up over 12 deviations,
    beyond which less than exp(-72) of them is left.
    """
    x, m = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1) + x * math.log(p) + (m - x) * math.log1p(-p))
    reach = F.least(k, F.ceil(12 * F.sqrt(m * (p * (1 - p)))) + 60).cast("long")

    def down(a: Column, j: Column) -> Column:
        term = a["term"] * (x - j + 1) / (m - x + j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    terms = F.when(reach < 1, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(reach, F.lit(1).cast("long"))))
    return F.when(x >= m * p, F.lit(1.0)).otherwise(top * F.aggregate(terms, start, down, lambda a: a["sum"]))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Measured documents that pass the base rules, with good: whether one of their labels has a quality of 1."""
    label = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"))
    return rows.where(~F.col("base_failed")).join(label, "doc_id")


def ordered_steps(learning: DataFrame) -> DataFrame:
    """stratum, and steps: its pairs of a rule and a cutoff, in the order in which they are added.

    A pair takes part if it rejects a larger share of the bad than of the good documents; the largest ratio of these
    shares comes first, then the higher cutoff; pairs that then reject no bad document that an earlier one leaves go.
    At most a row for each stratum, and a step for each pair.
    """
    tried = [(r, c) for r, cs in CUTOFFS.items() for c in cs]
    counted = learning.groupBy("stratum").agg(
        F.count(F.when(F.col("good"), 1)).alias("good"),
        F.count(F.when(~F.col("good"), 1)).alias("bad"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.count(F.when(F.col("good") & (F.col(r) > c), 1)).alias("lost"), F.count(F.when(~F.col("good") & (F.col(r) > c), 1)).alias("caught")) for r, c in tried]).alias("tried"),
    )
    pairs = counted.select("stratum", "good", "bad", F.explode("tried").alias("x")).select("stratum", "good", "bad", "x.*")
    useful = pairs.where("caught * good > lost * bad or (good = 0 and caught > 0)")
    ratio = (F.col("caught") + 1) / (F.col("bad") + 2) * (F.col("good") + 2) / (F.col("lost") + 1)
    order = Window.partitionBy("stratum").orderBy(ratio.desc(), F.desc("cutoff"), "rule")
    step = F.struct(F.row_number().over(order).alias("place"), "rule", "cutoff")
    steps = checkpointed(useful.select("stratum", step.alias("step")).groupBy("stratum").agg(F.sort_array(F.collect_list("step")).alias("steps")))
    first = learning.where("not good").join(small(steps), "stratum").select("stratum", first_broken().alias("place"))
    return steps.join(first.groupBy("stratum").agg(F.collect_set("place").alias("places")), "stratum").select("stratum", F.filter("steps", lambda s: F.array_contains("places", s["place"])).alias("steps"))


def first_broken() -> Column:
    """The place of the first of `steps` that a document breaks; null if it breaks none."""
    values = F.create_map(*[v for r in CUTOFFS for v in (F.lit(r), F.col(r))])
    return F.array_min(F.transform(F.filter("steps", lambda s: values[s["rule"]] > s["cutoff"]), lambda s: s["place"]))


def cutoffs(rows: DataFrame, labels: DataFrame, limit: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum, rule and cutoff: the rules under which, with the given confidence, less than `limit` of the good documents
    of every stratum are rejected by all rules together.

    Labelled documents that pass the base rules are the holdout.  One in LEARNING of them, by a hash of the id, tells the
    order in which pairs of a rule and a cutoff are added (ordered_steps).  The others test that order: the rejection by
    the first step, by the first two steps together, and so on.  Steps are tested in a fixed sequence, each by the exact
    binomial test at (1 - confidence) / strata, until one fails; so the number of steps costs nothing, and the strata are
    corrected for by Bonferroni.  The steps before the first failure are used.  Without labels there are no cutoffs.
    """
    held = checkpointed(labelled(rows, labels).withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit("learning")), F.lit(LEARNING))))
    strata = held.agg(F.count_distinct("stratum")).first()[0]
    steps = checkpointed(ordered_steps(held.where("_part = 0")))
    tested = held.where("_part > 0").join(small(steps), "stratum").where("good")
    lost = tested.select("stratum", first_broken().alias("place")).groupBy("stratum", "place").agg(F.count("*").alias("lost"))
    n = lost.groupBy("stratum").agg(F.sum("lost").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row for each step
    each = steps.select("stratum", F.explode("steps").alias("s")).select("stratum", "s.*").join(lost, ["stratum", "place"], "left").join(n, "stratum")
    counted = each.withColumn("lost", F.sum(F.coalesce("lost", F.lit(0))).over(upto))
    passed = F.min((tail(F.col("lost"), F.col("n"), limit) <= (1 - confidence) / max(1, strata)).cast("int")).over(upto) == 1
    return counted.withColumn("passed", passed).where("passed").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A stored table with a hint to broadcast it if it has at most so many rows; beyond that Spark joins as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each document and whether it is kept.

    A document is kept if it passes the base rules and every rule that has a cutoff in its stratum (its lang, null is a
    stratum of its own).  Null, empty and blank texts have no words and fail.  Each row is judged by its whole text,
    however long, and by nothing else, so repeated rows and ids are judged alike; an id with several labels counts as
    good if one of them is 1, and null labels and ids aren't learned from.  Without labels there are no cutoffs; an empty
    table gives no rows; other columns don't matter.
    """
    rows = checkpointed(measured(docs))  # a few numbers a document, used twice
    chosen = cutoffs(rows, labels).groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.first("cutoff"))
    chosen = checkpointed(chosen.select("stratum", *[F.col(r).alias(f"max_{r}") for r in CUTOFFS]))
    fails = F.lit(False)
    for r in CUTOFFS:
        fails = fails | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return rows.join(small(chosen), "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~fails).alias("kept"))
