"""Which names are near each other: one holds all tokens of the other, or they share half of all their tokens.

Near names share two thirds of the smaller one's tokens at least, so one of the smaller's rarest
tokens is among them.  Names meet by these alone, and a token that all names hold makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(c: str):
    return F.array_distinct(F.filter(F.split(c, " +"), lambda t: t != ""))


def _rarest(each: DataFrame, held: DataFrame, key: str, words: str) -> DataFrame:
    """(world_id, key, words, tok): of each name's tokens the rarest, so many that near names have one of them."""
    by = each.join(held, ["world_id", "tok"]).groupBy("world_id", key, words).agg(F.transform(F.sort_array(F.collect_list(F.struct("names", "tok"))), lambda x: x["tok"]).alias("rare"))
    n = F.size("rare")
    return by.select("world_id", key, words, F.explode(F.slice("rare", F.lit(1), n - F.ceil(2 * n / 3).cast("int") + 1)).alias("tok"))


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names (world_id, a, ta) and (world_id, b, tb), ta and tb their distinct tokens -> (world_id, a, ta, b, tb), once each."""
    one, two = left.withColumn("tok", F.explode("ta")), right.withColumn("tok", F.explode("tb"))
    held = one.select("world_id", "tok").unionByName(two.select("world_id", "tok")).groupBy("world_id", "tok").agg(F.count("*").alias("names"))
    small = _rarest(one, held, "a", "ta").join(two, ["world_id", "tok"]).filter(F.size("ta") <= F.size("tb"))
    large = one.join(_rarest(two, held, "b", "tb"), ["world_id", "tok"]).filter(F.size("tb") < F.size("ta"))
    both = small.select("world_id", "a", "ta", "b", "tb").unionByName(large.select("world_id", "a", "ta", "b", "tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter((common == F.least(F.size("ta"), F.size("tb"))) | (common >= 0.5 * (F.size("ta") + F.size("tb") - common))).distinct()
