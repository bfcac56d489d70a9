"""Gap queries: (world_id, category, question, detail, scene_id, assertion_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import checks
from storyloom.sources.graph import Graph

MUTED = ("rejected", "retconned")
CATEGORIES = ("unknown_entity", "open_thread", "unsourced_knowledge", "unconfirmed_belief")


def _gaps(df: DataFrame, category: str, question: Column, detail: Column) -> DataFrame:
    return df.select("world_id", F.lit(category).alias("category"), question.alias("question"), detail.alias("detail"), F.col("scene_id").cast("long").alias("scene_id"), F.col("assertion_id").cast("long").alias("assertion_id"))


def _positions(g: Graph) -> DataFrame:
    return g.scenes.select("world_id", "scene_id", F.col("story_position").alias("at"))


def unknown_entity(g: Graph) -> DataFrame:
    first = checks.first_references(g, MUTED).join(g.assertions.select("world_id", "assertion_id", "scene_id"), ["world_id", "assertion_id"]).join(_positions(g), ["world_id", "scene_id"])
    return _gaps(first, "unknown_entity", F.concat(F.lit("Who or what is "), "name", F.lit("?")), F.concat(F.lit("first at "), F.col("at").cast("string")))


def open_thread(g: Graph) -> DataFrame:
    """Open setups whose subject has no later row with the same raw value; the first of each normalised value."""
    kept = checks.active(g, MUTED).filter(F.col("predicate").isin(*checks.OPEN_PREDICATES) & F.col("hi").isNull())
    same = Window.partitionBy("world_id", "subject_id", "fact_key")
    first = kept.withColumn("first_id", F.min("assertion_id").over(same)).filter("assertion_id = first_id").join(_positions(g), ["world_id", "scene_id"])
    last = g.assertions.join(_positions(g), ["world_id", "scene_id"]).groupBy("world_id", "subject_id", "object_value").agg(F.max("at").alias("last"))
    open_ = first.join(last, ["world_id", "subject_id", "object_value"], "left").filter(F.col("last").isNull() | (F.col("last") <= F.col("at"))).join(checks.names(g), ["world_id", "subject_id"])
    return _gaps(open_, "open_thread", F.concat(F.lit("Does "), "name", F.lit(" follow through on "), F.coalesce("object_value", F.lit("")), F.lit("?")), F.concat(F.lit("set up at "), F.coalesce(F.col("lo").cast("string"), F.lit("an open start"))))


def unsourced_knowledge(g: Graph) -> DataFrame:
    found = checks.unsourced(g, MUTED).join(checks.names(g), ["world_id", "subject_id"])
    return _gaps(found, "unsourced_knowledge", F.concat(F.lit("How does "), "name", F.lit(" know "), "object_value", F.lit("?")), F.concat(F.lit("acted on at "), F.col("since").cast("string")))


def unconfirmed_belief(g: Graph) -> DataFrame:
    base = checks.active(g, MUTED)
    held = base.filter((F.col("predicate") == "believes") & F.col("object_value").isNotNull())
    first = held.withColumn("first_id", F.min("assertion_id").over(Window.partitionBy("world_id", "subject_id", "fact_key"))).filter("assertion_id = first_id")
    known = base.filter("predicate = 'knows' and fact_key is not null").select("world_id", "fact_key").distinct()
    found = first.join(known, ["world_id", "fact_key"], "left_anti").join(_positions(g), ["world_id", "scene_id"]).join(checks.names(g), ["world_id", "subject_id"])
    return _gaps(found, "unconfirmed_belief", F.concat("name", F.lit(" believes "), "object_value", F.lit(": is it so?")), F.concat(F.lit("held at "), F.coalesce("lo", "at").cast("string")))


def holes_report(g: Graph) -> DataFrame:
    """All gaps with their category's rank and the scene's label."""
    out = unknown_entity(g)
    for fn in (open_thread, unsourced_knowledge, unconfirmed_belief):
        out = out.unionByName(fn(g))
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int")
    return out.join(scene_labels(g).select("world_id", "scene_id", "label"), ["world_id", "scene_id"], "left").withColumn("category_rank", rank)


def scene_labels(g: Graph) -> DataFrame:
    """Short labels such as E101/sc3: the first word of the work's title and the scene's place in it."""
    place = F.row_number().over(Window.partitionBy("world_id", "work_id").orderBy("story_position"))
    both = g.scenes.join(g.works.select("world_id", "work_id", "title"), ["world_id", "work_id"])
    return both.withColumn("ordinal", place).withColumn("label", F.concat(F.substring_index("title", " ", 1), F.lit("/sc"), F.col("ordinal").cast("string"))).select("world_id", "work_id", "scene_id", "story_position", "slug", "title", "ordinal", "label")
