"""Which of many texts hold which of many needles: an inverted index of the needles' rarest grams.

A text that holds a needle holds all its grams (of three characters; of one or two for shorter
needles), so a needle is looked up by that one of its grams that the fewest texts of its world
hold, and a needle with a gram that no text holds is not looked up at all.  Needles that all
begin alike, or share a word, so meet few texts in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(c: str, n: Column) -> Column:
    """The distinct pieces of ``n`` characters."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(F.col(c), i, n))))


def candidates(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (world_id, hay, needle) to be tested: texts that hold a needle's rarest gram.

    How many texts hold a gram is counted without the texts, and one gram a needle goes on to meet them.
    """
    own = needles.select("world_id", "needle").filter(F.length("needle") > 0).distinct().withColumn("n", F.least(F.lit(GRAM), F.length("needle")))
    asked = own.select("world_id", "needle", F.explode(grams("needle", F.col("n"))).alias("gram"))
    sizes = own.groupBy("world_id").agg(F.collect_set("n").alias("sizes"))  # three at most
    texts = hays.select("world_id", "hay").distinct().join(sizes, "world_id")
    each = F.flatten(F.transform("sizes", lambda n: F.coalesce(grams("hay", n), F.array().cast("array<string>"))))
    held = texts.select("world_id", "hay", F.explode(each).alias("gram"))
    often = held.groupBy("world_id", "gram").agg(F.count("*").alias("texts"))
    rarest = asked.join(often, ["world_id", "gram"], "left").groupBy("world_id", "needle").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.bool_and(F.col("texts").isNotNull()).alias("possible")
    )
    return held.join(rarest.filter("possible").drop("possible"), ["world_id", "gram"]).select("world_id", "hay", "needle")


def containing(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """Rows of both tables, of one world, where ``hay`` contains ``needle``; an empty needle is in nothing."""
    found = candidates(hays, needles).filter(F.col("hay").contains(F.col("needle")))
    return found.join(hays, ["world_id", "hay"]).join(needles, ["world_id", "needle"])


def holding(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """As ``containing``, for needles that hold words between spaces: these are whole words of the text, and are looked up by the rarest.

    Grams of numbers repeat, numbers don't.
    """
    split = F.split("needle", " ")
    inner = F.when(F.size(split) > 2, F.array_remove(F.array_distinct(F.slice(split, F.lit(2), F.size(split) - 2)), ""))
    own = needles.select("world_id", "needle").distinct().withColumn("inner", F.coalesce(inner, F.array().cast("array<string>")))
    asked = own.select("world_id", "needle", F.explode("inner").alias("word"))
    words = hays.select("world_id", "hay").distinct().select("world_id", "hay", F.explode(F.array_distinct(F.split("hay", " "))).alias("word"))
    words = words.join(asked.select("world_id", "word").distinct(), ["world_id", "word"], "left_semi")
    often = words.groupBy("world_id", "word").agg(F.count("*").alias("texts"))
    rarest = asked.join(often, ["world_id", "word"], "left").fillna(0, ["texts"]).groupBy("world_id", "needle").agg(F.min_by("word", F.struct("texts", "word")).alias("word"))
    found = words.join(rarest, ["world_id", "word"]).filter(F.col("hay").contains(F.col("needle"))).select("world_id", "hay", "needle")
    by_word = found.join(hays, ["world_id", "hay"]).join(needles, ["world_id", "needle"])
    others = needles.join(own.filter(F.size("inner") == 0).select("world_id", "needle"), ["world_id", "needle"], "left_semi")
    rest = containing(hays, others)
    return by_word.unionByName(rest.select(*by_word.columns))
