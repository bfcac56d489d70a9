"""The reference dossier as one long table: every line cites its scene, uncited rows are only counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import ranges
from storyloom.operators import checks
from storyloom.operators.holes import scene_labels
from storyloom.sources.graph import RELATIONS, Graph

MUTED = ("retconned", "rejected")
SECTIONS = {"trait": "trait", "occupation": "occupation", "goal": "goal", "knows": "knowledge", "believes": "knowledge", "destroyed": "place", "fact": "fact", "cannot": "rule", "promised": "open"}
SECTIONS |= dict.fromkeys(RELATIONS, "relationship")


def lines(g: Graph) -> DataFrame:
    """(world_id, section, name, ord, text, label, note, assertion_id): what is told of each subject by section, with the name of the other end, or the value, or the nested fact's value."""
    sections = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    labels = scene_labels(g).select("world_id", "scene_id", "label", "story_position")
    nested = g.assertions.select("world_id", F.col("assertion_id").alias("object_assertion_id"), F.col("object_value").alias("nested"))
    base = checks.active(g, MUTED).withColumn("section", F.element_at(sections, F.col("predicate"))).filter("section is not null")
    out = base.join(labels, ["world_id", "scene_id"]).join(checks.names(g), ["world_id", "subject_id"]).join(nested, ["world_id", "object_assertion_id"], "left")
    other = g.entities.select("world_id", F.col("entity_id").alias("object_id"), F.col("name").alias("other"))
    out = out.join(other, ["world_id", "object_id"], "left")
    said = F.concat_ws(" ", F.when(~F.col("polarity"), "not"), F.translate("predicate", "_", " "), F.coalesce("other", "object_value", "nested", F.lit("")), F.when(F.col("section") == "knowledge", F.concat(F.lit("learned at "), "label")))
    w = Window.partitionBy("world_id", "section", "subject_id").orderBy("story_position", "assertion_id")
    note = F.when(F.col("status").isin("draft", "sealed"), F.col("status")).otherwise("")
    return out.select("world_id", "section", "name", F.row_number().over(w).alias("ord"), said.alias("text"), "label", note.alias("note"), "assertion_id")


def omitted(g: Graph) -> DataFrame:
    return checks.active(g, MUTED).join(g.scenes.select("world_id", "scene_id"), ["world_id", "scene_id"], "left_anti").groupBy("world_id").agg(F.count("*").alias("omitted"))


def timeline(g: Graph) -> DataFrame:
    """Canon and sealed assertions in story order, each with its label and its place in the order."""
    at = scene_labels(g).select("world_id", "scene_id", "label", "story_position")
    rows = g.assertions.filter(F.col("status").isin("canon", "sealed")).join(at, ["world_id", "scene_id"]).join(checks.names(g), ["world_id", "subject_id"])
    place = F.row_number().over(Window.partitionBy("world_id", "label").orderBy("assertion_id"))
    return rows.select("world_id", "story_position", "label", place.alias("ord"), "name", "predicate", "object_value", "assertion_id")


def destructions(g: Graph) -> DataFrame:
    """The first destruction of each place, by position, then id; denied ones don't count."""
    at = scene_labels(g).select("world_id", "scene_id", "label", "story_position")
    rows = checks.active(g, MUTED).filter("predicate = 'destroyed' and polarity").join(at, ["world_id", "scene_id"])
    first = rows.groupBy("world_id", "subject_id").agg(F.min_by(F.struct("story_position", "label", "assertion_id"), F.struct("story_position", "assertion_id")).alias("f"))
    return first.join(checks.names(g), ["world_id", "subject_id"]).select("world_id", "name", "f.*")


def occupations(g: Graph) -> DataFrame:
    """What each character does, with the range in words, in order of its start; an open start comes first."""
    rows = checks.active(g, MUTED).filter("predicate = 'occupation'").join(checks.names(g), ["world_id", "subject_id"])
    w = Window.partitionBy("world_id", "subject_id").orderBy(F.asc_nulls_first("lo"), "assertion_id")
    return rows.select("world_id", "name", F.row_number().over(w).alias("ord"), "object_value", ranges.gloss(F.col("lo"), F.col("hi")).alias("gloss"), "assertion_id")
