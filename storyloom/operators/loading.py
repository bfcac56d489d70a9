"""From extracted rows to the tables of a graph: mentions, resolved assertions, ranges, presence, constraints.

Extracted rows are (world_id, row_id, position, subject, predicate, object_entity, object_value, object_fact_ref,
polarity, starts_here, ends_here, quote, confidence); names are surfaces as they stand in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import folds
from storyloom.operators.overlap import overlap_join

EVENTS = ("dies", "destroyed")
# Predicates whose subject is a character, and the kind of an object by predicate.
CHARACTER_SUBJECTS = (
    "knows", "believes", "cannot", "dies", "occupation", "married_to", "parent_of", "sibling_of", "romantic_with", "allied_with", "enemy_of", "member_of", "possesses",
    "promised", "goal", "secret_of", "trait", "alive", "present_in_scene",
)
OBJECT_KINDS = {
    "located_at": "location", "possesses": "object", "member_of": "faction", "married_to": "character", "parent_of": "character", "sibling_of": "character",
    "romantic_with": "character", "allied_with": "character", "enemy_of": "character", "created": "object", "secret_of": "character",
}


def occ_kind(role: Column, predicate: Column) -> Column:
    """The kind of entity that a mention in this role of this predicate hints at."""
    subject = F.when(predicate.isin("located_at", "created"), "object").when(predicate == "destroyed", "location").when(predicate.isin(*CHARACTER_SUBJECTS), "character").otherwise("other")
    kinds = F.create_map(*[F.lit(x) for pair in OBJECT_KINDS.items() for x in pair])
    thing = F.coalesce(F.element_at(kinds, predicate), F.lit("other"))
    return F.when(role.isin("presence", "death"), "character").when(role == "destruction", "location").when(role == "subject", subject).when(role == "object", thing).otherwise("other")


def mentions(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Extracted rows and names (world_id, position, role presence|death|destruction, surface) -> world_id, surface, role, predicate, position, kind."""
    part = lambda df, role, c: df.select("world_id", F.trim(F.col(c)).alias("surface"), F.lit(role).alias("role"), "predicate", "position")
    out = part(rows, "subject", "subject").unionByName(part(rows, "object", "object_entity"))
    out = out.unionByName(named.select("world_id", F.trim("surface").alias("surface"), "role", F.lit(None).cast("string").alias("predicate"), "position"))
    return out.filter(F.coalesce("surface", F.lit("")) != "").withColumn("kind", occ_kind(F.col("role"), F.coalesce("predicate", F.lit(""))))


def resolved(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Extracted rows with the canonical names and provisional flags of both ends; registry: world_id, norm, entity_id, entity, kind, provisional.

    A reference to a fact counts as a value.  A subject that the registry doesn't know keeps its surface and is provisional.
    """
    norm = lambda c: F.trim(text.norm_strip(c))
    end = lambda side: registry.select("world_id", F.col("norm").alias(f"{side}_norm"), F.col("entity_id").alias(f"{side}_id"), F.col("entity").alias(f"{side}_name"), F.col("kind").alias(f"{side}_kind"), F.col("provisional").alias(f"{side}_flag"))
    both = rows.withColumn("s_norm", norm("subject")).withColumn("o_norm", norm("object_entity")).join(end("s"), ["world_id", "s_norm"], "left").join(end("o"), ["world_id", "o_norm"], "left")
    value = F.coalesce(F.nullif("object_value", F.lit("")), "object_fact_ref")
    return both.select(
        "world_id", "row_id", "position", F.coalesce("s_name", "subject").alias("subject"), "predicate", F.col("o_name").alias("object_entity"), value.alias("object_value"), "polarity", "starts_here", "ends_here",
        "quote", "confidence", F.coalesce("s_flag", F.lit(True)).alias("subject_provisional"), F.coalesce("o_flag", F.lit(False)).alias("object_provisional"),
        F.col("s_id").alias("subject_id"), F.col("o_id").alias("object_id"), F.col("s_kind").alias("subject_kind"), F.col("o_kind").alias("object_kind"),
    )


def earliest_events(rows: DataFrame) -> DataFrame:
    """A subject dies or is destroyed once: of several such rows the earliest stays."""
    w = Window.partitionBy("world_id", "subject_id", "predicate").orderBy(F.asc_nulls_last("position"), "row_id")
    event = F.col("predicate").isin(*EVENTS)
    return rows.withColumn("nth", F.when(event, F.row_number().over(w)).otherwise(1)).filter("nth = 1").drop("nth")


def load_assertions(rows: DataFrame, scenes: DataFrame, bar: float = 0.85) -> DataFrame:
    """Resolved rows -> assertions: known subjects and scenes only, single events, ranges, placeholders, clamped confidence, status.

    A row that starts in its scene begins there, one that ends there ends behind it; an event without a start is
    anchored to its scene.  Places follow one another: a move closes the stay before it, a restatement of an open stay
    is left out, two places at one position stay as a conflict, and a stay told backwards ("there until now") begins at
    the subject's latest start in the same place.
    """
    at = scenes.select("world_id", F.col("story_position").alias("position"), "scene_id")
    known = earliest_events(rows.filter("subject_id is not null").join(at, ["world_id", "position"]))
    lo = F.when(F.col("starts_here") | F.col("predicate").isin(*EVENTS), F.col("position")).cast("int")
    hi = F.when(F.col("ends_here"), F.col("position") + 1).cast("int")
    value = text.object_placeholder(F.col("object_value"), F.col("object_id"), F.col("predicate"))
    sure = F.coalesce(text.clamp_confidence(F.col("confidence")), F.lit(0.0))
    out = known.select("world_id", F.col("row_id").alias("assertion_id"), "subject_id", "subject_kind", "predicate", "object_id", "object_kind", value.alias("object_value"), "polarity", "position", lo.alias("lo"), hi.alias("hi"), "scene_id", F.col("quote").alias("supporting_quote"), sure.alias("confidence"), F.when(sure >= bar, "canon").otherwise("draft").alias("status"))
    return placed(out).drop("position")


def placed(rows: DataFrame) -> DataFrame:
    """Assertions with the ranges of ``located_at`` settled by windows over each subject's rows in order of position, then id.

    ``mirrored`` marks those that a table of one place at a time may hold.
    """
    here = F.col("predicate") == "located_at"
    order = Window.partitionBy("world_id", "subject_id").orderBy("position", "assertion_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stay = Window.partitionBy("world_id", "subject_id", "object_id").orderBy("position", "assertion_id").rowsBetween(Window.unboundedPreceding, -1)
    p = rows.filter(here & F.col("object_id").isNotNull())
    start = F.max("lo").over(stay)
    p = p.withColumn("lo", F.when(F.col("lo").isNull() & F.col("hi").isNotNull() & (start < F.col("hi")), start).otherwise(F.col("lo")))
    # The open stay before a row; of several places at one position the first is the stay, the others are conflicts.
    same = Window.partitionBy("world_id", "subject_id", "position").orderBy("assertion_id")
    p = p.withColumn("nth", F.row_number().over(same))
    prev = F.last(F.when(F.col("hi").isNull() & (F.col("nth") == 1), F.col("object_id")), ignorenulls=True).over(before)
    p = p.withColumn("prev", prev).filter(F.col("prev").isNull() | (F.col("prev") != F.col("object_id")))
    # What is left are changes of place; an open one ends where the next later one begins.
    after = Window.partitionBy("world_id", "subject_id").orderBy("position").rangeBetween(1, Window.unboundedFollowing)
    p = p.withColumn("next", F.min("lo").over(after))
    mirrored = (F.col("nth") == 1) & F.coalesce(F.col("subject_kind") == "character", F.lit(False)) & F.coalesce(F.col("object_kind") == "location", F.lit(False))
    closes = F.col("hi").isNull() & (F.col("nth") == 1) & (F.col("next") > F.coalesce("lo", F.lit(-1)))
    p = p.withColumn("mirrored", mirrored).withColumn("hi", F.when(closes, F.col("next")).otherwise(F.col("hi"))).drop("prev", "next", "nth")
    rest = rows.filter(~here | F.col("object_id").isNull()).withColumn("mirrored", F.lit(False))
    return rest.unionByName(p)


def presence_from_slug(scenes: DataFrame, entities: DataFrame) -> DataFrame:
    """(world_id, scene_id, entity_id): the place that a scene's heading names; matched among all entities, kept if it is a location."""
    place = scenes.withColumn("norm", F.trim(text.norm_strip(text.slug_place("slug"))))
    found = folds.entity_match(place.select("world_id", "norm").distinct(), entities).filter("entity_id is not null")
    where = found.join(entities.filter("kind = 'location'").select("world_id", "entity_id"), ["world_id", "entity_id"], "left_semi")
    return place.join(where, ["world_id", "norm"]).select("world_id", "scene_id", "entity_id")


def exclusion_violations(places: DataFrame) -> DataFrame:
    """(world_id, assertion_id, character_id, lo, hi): pairs that hold one character in overlapping ranges, equal ones included."""
    b = places.select("world_id", "character_id", F.col("assertion_id").alias("other"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    both = overlap_join(places, b, ["world_id", "character_id"], ("lo", "hi"), ("o_lo", "o_hi")).filter(F.col("assertion_id") < F.col("other"))
    return both.select("world_id", "character_id", "assertion_id", "other")


def merge(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, fixed: Column | None = None) -> DataFrame:
    """The next snapshot of a table: rows of ``new`` by key, of known keys only the ``update`` columns (all others if null), old rows without a new one as they are.

    Old rows for which ``fixed`` holds never change.
    """
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, F.struct(*rest).alias("__new"))
    stays = F.coalesce(fixed, F.lit(False)) if fixed is not None else F.lit(False)
    both = old.select(*keys, F.struct(*rest).alias("__old"), stays.alias("__stays")).join(fresh, keys, "full_outer")
    change = set(rest if update is None else update)
    take = lambda c: F.when(F.col("__new").isNull() | F.coalesce("__stays", F.lit(False)) | (F.col("__old").isNotNull() & F.lit(c not in change)), F.col("__old")[c]).otherwise(F.col("__new")[c])
    return both.select(*keys, *[take(c).alias(c) for c in rest]).select(*old.columns)
