"""Quality rules whose cutoffs come with a guarantee on false rejections.

Every rule is a ratio that is higher for worse texts.  A *ladder* holds a fixed row of rule
sets from mild to strict: a level rejects a document if any of its five ratios reaches the
level's cutoff for it, and with it all that milder levels reject.  On labelled documents the
levels are tested stratum by stratum: the good documents that a level rejects, by all its
rules together, are a binomial count, and the exact probability of so few under a
false-rejection rate of ``risk`` is the p-value of "this level rejects more than ``risk`` of
the good".  The levels of a stratum are tested from the mildest up and the first that is not
proven ends the row (fixed-sequence testing, which needs no further correction), at
``error`` divided by the number of strata (Bonferroni).  So with probability 1 - ``error``
there is no stratum at all in which the chosen level rejects more than ``risk`` of the good
documents that the base rule leaves.  Of the proven levels that with the most rejected bad
documents is taken, where a good one counts ``cost`` times as much; of equal ones the
mildest.  A stratum with too few labels has no proven level and rejects nothing beyond the
base rule.

DataFrame functions only; texts are never exchanged.  What is repeated within a text is found
by sorting the hashes of its windows inside the row, in n log n.

Defined cases: a null text has no words (and fails the base rule); a null stratum is one of
its own; labels that are null, repeated with both values, or without a document are left out;
an empty table gives no rows; other columns are ignored by ``verdicts`` and kept as they are by ``accepted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
RULES = ("symbols", "repeats", "duplicate_lines", "capitals", "marks")
# Cutoffs of each rule, from the mildest level to the strictest.
LADDER = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.02, 0.01),
    "repeats": (0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.12, 0.1, 0.08, 0.05),
    "duplicate_lines": (0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "capitals": (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08),
    "marks": (0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03),
}
LEVELS = 10
RISK, ERROR, COST = 0.03, 0.05, 10


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """(text, ...) -> the named columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rules' ratios."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    bare = F.array_join("words", "")
    df = df.select(*keep, n.alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("names"), bare.alias("bare"), F.length(bare).cast("long").alias("word_chars"), "lines")
    at = F.when(F.col("n") >= WINDOW, F.sequence(F.lit(0), F.col("n") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get("names", i + j) for j in range(WINDOW)]).alias("h"), i.alias("i")))
    df = df.select(
        *keep, F.col("n").cast("long").alias("n_words"), "word_chars", F.sort_array(windows).alias("windows"),
        (F.col("word_chars") - F.length(F.translate("bare", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        (F.col("word_chars") - F.length(F.regexp_replace("bare", r"\p{Lu}+", ""))).alias("n_capitals"),
        (F.col("word_chars") - F.length(F.translate("bare", "!?", ""))).alias("n_marks"),
    )
    # Sorted windows beside the next ones: the places of both of an equal pair.
    after = F.slice("windows", 2, F.greatest(F.size("windows") - 1, F.lit(0)))
    pairs = F.filter(F.zip_with("windows", after, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    df = df.withColumn("repeated", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("windows")
    step = F.transform("repeated", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("repeated", i + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)).drop("repeated")
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    out = [
        *(F.col(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("n_repeat_words", "n_words").alias("repeats"), share("n_dup_lines", "n_lines").alias("duplicate_lines"),
        share("n_capitals", "word_chars").alias("capitals"), share("n_marks", "word_chars").alias("marks"),
    ]
    # A generator: a later filter on a measure must not be pushed below it, which would work out all measures again inside the condition.
    return df.select(*keep, F.inline(F.array(F.struct(*out))))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p), exactly: the terms' logarithms are summed up one from the other."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * F.lit(math.log1p(-p))).alias("log_term"), F.exp(n * F.lit(math.log1p(-p))).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["log_term"] + F.log((n - j + 1).cast("double")) - F.log(j.cast("double")) + F.lit(odds)
        return F.struct(term.alias("log_term"), (a["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.aggregate(terms, start, add, lambda a: a["sum"]), F.lit(1.0))


def level(rules: dict[str, tuple[float, ...]] = LADDER) -> Column:
    """The mildest level that rejects a measured document; one more than the levels where none does."""
    reached = [sum((F.col(rule) >= c).cast("int") for c in cuts) for rule, cuts in rules.items()]
    return F.lit(LEVELS + 1) - F.greatest(*reached)


def proven(found: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cost: float = COST) -> DataFrame:
    """Measured documents (doc_id, stratum, base_failed, level), labels (doc_id, quality 0/1) -> the chosen level of each stratum that has one.

    stratum, chosen, good, good_rejected, bad_rejected, p_value
    """
    sure = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    # The base rule decides first; a level answers for what it leaves.
    held = found.filter(~F.col("base_failed")).select("doc_id", "stratum", "level").join(sure, "doc_id")
    rejected = [F.count_if((F.col("level") <= s) & (F.col("quality") == q)).alias(f"{side}_{s}") for s in range(1, LEVELS + 1) for q, side in ((1, "good"), (0, "bad"))]
    counts = held.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("good"), *rejected)
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))  # one row a stratum
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("chosen"), F.col(f"good_{s}").alias("good_rejected"), F.col(f"bad_{s}").alias("bad_rejected")) for s in range(1, LEVELS + 1)]))
    tested = counts.select("stratum", "good", "strata", each)
    tested = tested.withColumn("p_value", F.when(F.col("good") > 0, binomial_tail(F.col("good_rejected"), F.col("good"), risk)).otherwise(1.0))
    row = Window.partitionBy("stratum").orderBy("chosen")
    unbroken = F.max("p_value").over(row) <= F.lit(error) / F.col("strata")
    gain = F.col("bad_rejected") - F.lit(cost) * F.col("good_rejected")
    best = F.max_by(F.struct("chosen", "good", "good_rejected", "bad_rejected", "p_value"), F.struct(gain, -F.col("chosen")))
    return tested.withColumn("unbroken", unbroken).filter("unbroken").filter(gain > 0).groupBy("stratum").agg(best.alias("b")).select("stratum", "b.*")


def judged(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Measured documents with ``kept``: neither the base rule nor the level of their stratum rejects them."""
    by = B.stored(chosen.select(F.col("stratum").alias("of"), "chosen"), "levels")  # one small row for each stratum with a proven level
    over = F.coalesce(F.col("level") <= F.col("chosen"), F.lit(False))
    return found.join(by, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("of", "chosen")


def _stored(docs: DataFrame, *keep: str) -> DataFrame:
    return B.stored(measured(docs, *keep).withColumn("level", level()), "measures")


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, text, stratum) -> one row each with the measures, level, base_failed and kept."""
    found = _stored(docs.withColumn("stratum", F.col(stratum)), "doc_id", "stratum")
    return judged(found, proven(found, labels, risk, error))


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents, all columns, that the rules keep; they wait with their measures in a written table, so no text is exchanged or measured twice."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _stored(docs.select(row, F.col("doc_id"), F.col("text"), F.col(stratum).alias("stratum")), "row", "doc_id", "stratum")
    kept = judged(found, proven(found, labels, risk, error)).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
