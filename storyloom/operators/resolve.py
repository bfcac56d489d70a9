"""Surfaces into entities: a world's names joined to one another in the order in which they appear.

What becomes of a name depends only on the names near it that came before: it joins the one
entity that they belong to, waits for a person if they belong to several, and is an entity of its
own if to none.  Names of t and u tokens are near exactly if they share ``least_shared(t, u)``
tokens, so names meet in *blocks*, one for each such set of tokens and pair of sizes: in a block all names of the one
size are near all of the other, and what a name learns there is which roots came before,
none, one or several.  So near names are never paired, and a word that all names hold costs one block.

Connected groups of names are folded apart, each in one pass over its names and their blocks, and a group of more than
``most`` names, which shouldn't be one task, is decided in rounds: each decides all names
anew by what their blocks tell under the last decisions, until none changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import names
from storyloom.operators.folds import surfaces
from storyloom.operators.lineage import components, cut

MOST = 200_000
SHORT = 6  # names of more tokens have too many sets of tokens, and meet others in blocks of two
DECIDED = "world_id long, norm string, root string, outcome string"


def least_shared(t: Column, u: Column) -> Column:
    """How many tokens names of t and u tokens must share to be near: all of the smaller, or half of all."""
    return F.least(t, u, F.ceil((t + u) / 3).cast("int"))


def pairs(found: DataFrame) -> DataFrame:
    """Near names (world_id, a, b), a < b, whose tokens are not the same, of which one is longer than ``SHORT``."""
    t = found.select("world_id", F.col("norm").alias("a"), names.tokens("norm").alias("ta")).distinct()
    long_ = t.filter(F.size("ta") > SHORT)
    near = names.near_pairs(long_, t.withColumnsRenamed({"a": "b", "ta": "tb"}))
    apart = ~((F.size("ta") == F.size("tb")) & (F.size(F.array_intersect("ta", "tb")) == F.size("ta")))
    return near.filter(apart).select("world_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def places(found: DataFrame) -> DataFrame:
    """(world_id, norm, words, block, own, other): the blocks of each name, its side in each and the side whose names are near it.

    ``words`` are a name's tokens in order; names with the same ones aren't near each other. Roles, which join nothing,
    are in no block, nor are names alone.
    """
    kept = found.filter(~F.col("is_role")).select("world_id", "norm", F.array_sort(names.tokens("norm")).alias("tok"))
    words = F.array_join("tok", " ").alias("words")
    short = kept.filter(F.size("tok").between(1, SHORT)).withColumn("t", F.size("tok"))
    sizes = short.groupBy("world_id").agg(F.collect_set("t").alias("sizes"))  # SHORT at most
    sets = F.expr("transform(sequence(1, shiftleft(1, t) - 1), m -> filter(tok, (x, i) -> getbit(m, i) = 1))")
    each = short.join(sizes, "world_id").select("world_id", "norm", words, "t", F.explode("sizes").alias("u"), "tok")
    each = each.select("world_id", "norm", "words", "t", "u", F.explode(sets).alias("common")).filter(F.size("common") == least_shared(F.col("t"), F.col("u")))
    block = F.concat_ws(" ", F.least("t", "u").cast("string"), F.greatest("t", "u").cast("string"), F.array_join("common", " "))
    of_words = each.select("world_id", "norm", "words", block.alias("block"), F.col("t").alias("own"), F.col("u").alias("other"))
    near = pairs(found.filter(~F.col("is_role")))
    side = lambda c, own: near.select("world_id", F.col(c).alias("norm"), F.to_json(F.array("a", "b")).alias("block"), F.lit(own).alias("own"), F.lit(1 - own).alias("other"))
    of_two = side("a", 0).unionByName(side("b", 1)).join(kept.select("world_id", "norm", words), ["world_id", "norm"])
    all_ = of_words.unionByName(of_two.select(*of_words.columns))
    meets = (F.min("own") != F.max("own")) | (F.bool_and(F.col("own") == F.col("other")) & (F.min("words") != F.max("words")))
    used = all_.groupBy("world_id", "block").agg(meets.alias("meets")).filter("meets").select("world_id", "block")
    return all_.join(used, ["world_id", "block"], "left_semi").select(*of_words.columns)


def groups(found: DataFrame, at: DataFrame) -> DataFrame:
    """(world_id, norm) -> the smallest name reachable over the blocks."""
    end = lambda kind, c: F.struct("world_id", F.lit(kind).alias("kind"), F.col(c).alias("key"))
    label = components(at.select(end(0, "norm").alias("a"), end(1, "block").alias("b"))).filter("node.kind = 0").select("node.world_id", F.col("node.key").alias("norm"), F.col("component.key").alias("label"))
    return found.select("world_id", "norm").join(label, ["world_id", "norm"], "left").withColumn("label", F.coalesce("label", "norm"))


def _met(side: dict[str, set[str]], words: str | None) -> set[str]:
    """The roots on a side of a block but those of names with the same words; of more than one, two or more."""
    met: set[str] = set()
    for w, roots in side.items():
        if w != words:
            met |= roots
            if len(met) > 1:
                break
    return met


def _add(side: dict[str, set[str]], words: str, root: str) -> None:
    """Adds a root to a side if that changes what some later name meets there, so a side stays of a few entries."""
    if any(len(met) < 2 and root not in met for met in (_met(side, w) for w in (None, *side) if w != words)):
        side.setdefault(words, set()).add(root)


def fold(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Decisions on groups of names (rows with a ``label``), each in one pass in order."""
    near = at.groupBy("world_id", "norm").agg(F.first("words").alias("words"), F.collect_list(F.struct("block", "own", "other")).alias("places"))
    both = rows.select("world_id", "norm", "label", "first_position", "is_role").join(near, ["world_id", "norm"], "left")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        sides: dict[tuple[str, int], dict[str, set[str]]] = {}
        out = []
        for r in pdf.sort_values(["first_position", "norm"]).itertuples():
            if r.is_role:
                out.append((r.world_id, r.norm, None, "role"))
                continue
            mine = r.places if r.places is not None else []
            met = set().union(*(_met(sides.get((p["block"], p["other"]), {}), r.words) for p in mine))
            if len(met) > 1:
                out.append((r.world_id, r.norm, None, "ambiguous"))
                continue
            root = met.pop() if met else r.norm
            for p in mine:
                _add(sides.setdefault((p["block"], p["own"]), {}), r.words, root)
            out.append((r.world_id, r.norm, root, "new" if root == r.norm else "alias"))
        return pd.DataFrame(out, columns=["world_id", "norm", "root", "outcome"])

    return both.groupBy("world_id", "label").applyInPandas(decide, DECIDED)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names in order of world, block and appearance, with their roots -> the least and the most root that each meets in each block."""
    last, sides = None, {}
    for batch in batches:
        out = []
        for world, norm, words, block, own, other, root in zip(*(c.to_pylist() for c in batch.columns)):
            if (world, block) != last:
                last, sides = (world, block), {}
            met = _met(sides.get(other, {}), words)
            if met:
                out.append((world, norm, min(met), max(met)))
            if root is not None:
                _add(sides.setdefault(own, {}), words, root)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["world_id", "norm", "least", "most"])


def rounds(rows: DataFrame, at: DataFrame) -> DataFrame:
    """The same decisions in rounds, for groups too large for one task.

    A decision depends on earlier names alone, so when none changes, all are right. A round settles at least the names
    whose earlier neighbours are settled, and mostly far more, since of a block's names only the first of the first two roots matter.
    """
    at = cut(at.join(rows.select("world_id", "norm", "first_position"), ["world_id", "norm"]))
    now = cut(rows.select("world_id", "norm", "is_role", F.when(~F.col("is_role"), F.col("norm")).alias("root")))
    while True:
        ordered = at.join(now, ["world_id", "norm"]).repartition("world_id", "block").sortWithinPartitions("world_id", "block", F.asc_nulls_last("first_position"), "norm")
        met = ordered.select("world_id", "norm", "words", "block", "own", "other", "root").mapInArrow(_told, "world_id long, norm string, least string, most string")
        met = met.groupBy("world_id", "norm").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        root = F.when(F.col("is_role") | F.coalesce(F.col("least") != F.col("most"), F.lit(False)), F.lit(None)).otherwise(F.coalesce("least", "norm"))
        new = cut(now.withColumnRenamed("root", "was").join(met, ["world_id", "norm"], "left").select("world_id", "norm", "is_role", "was", root.alias("root")))
        now = new.drop("was")
        if new.filter(~F.col("was").eqNullSafe(F.col("root"))).isEmpty():
            outcome = F.when(F.col("is_role"), "role").when(F.col("root").isNull(), "ambiguous").when(F.col("root") == F.col("norm"), "new").otherwise("alias")
            return now.select("world_id", "norm", "root", outcome.alias("outcome"))


def resolve(mentions: DataFrame, present: DataFrame, seed: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(world_id, surface, kind, position) -> world_id, norm, surface, entity, kind, provisional, outcome.

    ``entity`` is the canonical name; the outcome is new, alias, role (queued) or ambiguous (queued).  A longer
    surface that joins an entity becomes its canonical name, unless the entity is seeded.  Characters that no row of
    ``present`` (world_id, norm) shows are provisional; seeded ones (seed: world_id, norm, surface, kind) never.
    """
    found = surfaces(mentions)
    base = found.select("world_id", "norm", "surface", "kind", "first_position", F.lit(False).alias("seeded"))
    if seed is not None:
        s = seed.select("world_id", "norm", "surface", "kind", F.lit(-1).alias("first_position"), F.lit(True).alias("seeded"))
        base = s.unionByName(base.join(seed.select("world_id", "norm"), ["world_id", "norm"], "left_anti"))
    base = cut(base.withColumn("is_role", text.is_role_reference("surface")))
    at = cut(places(base))
    rows = cut(base.join(groups(base, at), ["world_id", "norm"]))
    large = cut(rows.groupBy("world_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("world_id", "label"))
    if large.isEmpty():
        decided = fold(rows, at)
    else:
        own = rows.join(large, ["world_id", "label"], "left_semi")
        apart = own.select("world_id", "norm")
        decided = fold(rows.join(large, ["world_id", "label"], "left_anti"), at.join(apart, ["world_id", "norm"], "left_anti")).unionByName(rounds(own, at.join(apart, ["world_id", "norm"], "left_semi")))
    decided = cut(decided)
    shown = present.select("world_id", "norm", F.lit(True).alias("shown")).distinct()
    members = decided.join(base, ["world_id", "norm"]).join(shown, ["world_id", "norm"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    return members.select("world_id", "norm", "surface", "outcome", "root", F.col("kind").alias("own_kind")).join(entities(members), ["world_id", "root"], "left").select(
        "world_id", "norm", "surface", "entity", F.coalesce("kind", "own_kind").alias("kind"), F.coalesce("provisional", F.lit(False)).alias("provisional"), "outcome"
    )


def entities(members: DataFrame) -> DataFrame:
    """(world_id, root, entity, kind, provisional) of decided names: the canonical name grows as longer surfaces join, in order."""
    in_order = F.sort_array(F.collect_list(F.struct("first_position", "norm", "surface", F.size(names.tokens("norm")).alias("n"))))
    own = F.col("norm") == F.col("root")
    e = members.filter("root is not null").groupBy("world_id", "root").agg(
        in_order.alias("all"), F.max(F.when(own, F.col("surface"))).alias("first"), F.max(F.when(own, F.col("kind"))).alias("kind"), F.bool_or(own & F.col("seeded")).alias("seeded"), F.bool_or("shown").alias("shown")
    )
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    grown = F.aggregate("all", F.col("first"), lambda name, m: F.when(m["n"] > words(name), m["surface"]).otherwise(name))
    return e.select("world_id", "root", F.when(F.col("seeded"), F.col("first")).otherwise(grown).alias("entity"), "kind", ((F.col("kind") == "character") & ~F.col("shown") & ~F.col("seeded")).alias("provisional"))


def queue(resolved: DataFrame, mentions: DataFrame, most: int = 6) -> DataFrame:
    """What a person has to decide, with the first mentions of each."""
    m = mentions.withColumn("norm", F.trim(text.norm_strip("surface"))).select("world_id", "norm", "position")
    first = m.groupBy("world_id", "norm").agg(F.array_join(F.slice(F.sort_array(F.collect_list("position")), 1, most).cast("array<string>"), ",").alias("positions"))
    return resolved.filter("outcome in ('role', 'ambiguous')").select("world_id", "norm", "outcome").join(first, ["world_id", "norm"])
