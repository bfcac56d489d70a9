"""Rules of a world as data: (rule_id, world_id, kind, predicate, subject_entity_id, subject_trait, entity_id, object_entity_id, check_name, pos_from, pos_to, severity, label, disabled)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import checks
from storyloom.operators.lineage import cut
from storyloom.sources.graph import PREDICATES, Graph

MUTED = ("sealed", "rejected", "retconned")
INTRANSITIVE = ("alive", "dies", "destroyed")
KINDS = ("cannot", "only", "exception")


def validated(rules: DataFrame) -> DataFrame:
    """Rules with ``errors``, the codes of what is wrong with each."""
    code = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    c, acts = F.col, F.col("kind").isin("cannot", "only")
    codes = [
        code(~c("kind").isin(*KINDS), "kind"), code(acts & ~F.coalesce(c("predicate").isin(*PREDICATES), F.lit(False)), "predicate"),
        code((c("kind") == "cannot") & (c("subject_entity_id").isNull() == c("subject_trait").isNull()), "scope"),
        code((c("kind") == "only") & c("entity_id").isNull(), "holder"), code(acts & c("object_entity_id").isNotNull() & c("predicate").isin(*INTRANSITIVE), "object"),
        code((c("kind") == "exception") & ~F.coalesce(c("check_name").isin(*checks.CHECKS), F.lit(False)), "family"), code((c("kind") == "exception") & c("entity_id").isNull(), "entity"),
        code(c("pos_from") > c("pos_to"), "range"), code(acts & ~F.coalesce(c("severity").isin("critical", "warning", "note"), F.lit(False)), "severity"),
    ]
    return rules.withColumn("errors", F.array_compact(F.array(*codes)))


def usable(rules: DataFrame, kind: str) -> DataFrame:
    return validated(rules).filter((F.size("errors") == 0) & (F.col("kind") == kind) & ~F.col("disabled")).drop("errors")


def _finding(df: DataFrame, g: Graph) -> DataFrame:
    seals = g.seals.select("world_id", "check_name", F.col("assertion_a").alias("assertion_id")).distinct()
    df = df.withColumn("check_name", F.concat(F.lit("rule:"), "rule_id")).join(seals, ["world_id", "check_name", "assertion_id"], "left_anti").join(checks.names(g), ["world_id", "subject_id"])
    said = F.concat("name", F.lit(" "), "predicate", F.lit(" against rule "), F.coalesce("label", "rule_id"))
    return df.select("world_id", "check_name", "severity", said.alias("explanation"), F.col("scene_id").cast("long").alias("scene_id"), F.col("assertion_id").alias("assertion_a"), F.lit(None).cast("long").alias("assertion_b"))


def cannot(g: Graph, rules: DataFrame) -> DataFrame:
    """Acts of an entity, or of any holder of a trait, that a rule forbids."""
    r = usable(rules, "cannot").select("rule_id", "world_id", "predicate", "subject_entity_id", "subject_trait", "object_entity_id", "severity", "label")
    base = checks.active(g, MUTED).filter("polarity")
    holders = base.filter("predicate = 'trait'").select("world_id", F.col("object_value").alias("subject_trait"), F.col("subject_id").alias("holder")).distinct()
    named = r.filter("subject_entity_id is not null").withColumn("holder", F.col("subject_entity_id"))
    by_trait = r.filter("subject_trait is not null").join(holders, ["world_id", "subject_trait"])
    scope = named.select("rule_id", "world_id", "predicate", "holder", "object_entity_id", "severity", "label").unionByName(by_trait.select("rule_id", "world_id", "predicate", "holder", "object_entity_id", "severity", "label"))
    hit = base.join(scope.withColumnRenamed("holder", "subject_id"), ["world_id", "predicate", "subject_id"]).filter(F.col("object_entity_id").isNull() | (F.col("object_entity_id") == F.col("object_id")))
    return _finding(hit, g)


def only(g: Graph, rules: DataFrame) -> DataFrame:
    """Acts that a rule reserves for one entity, by another; a rule whose holder is missing says nothing."""
    r = usable(rules, "only").join(g.entities.select("world_id", "entity_id"), ["world_id", "entity_id"], "left_semi").select("rule_id", "world_id", "predicate", F.col("entity_id").alias("holder"), "object_entity_id", "severity", "label")
    base = checks.active(g, MUTED).filter("polarity")
    hit = base.join(r, ["world_id", "predicate"]).filter((F.col("subject_id") != F.col("holder")) & (F.col("object_entity_id").isNull() | (F.col("object_entity_id") == F.col("object_id"))))
    return _finding(hit, g)


def without_exceptions(g: Graph, found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings less those that an exception covers: its check, its entity, inside its positions; an unknown position stays."""
    r = usable(rules, "exception").select("world_id", "check_name", F.col("entity_id").alias("about"), "pos_from", "pos_to")
    at = g.scenes.select("world_id", "scene_id", F.col("story_position").alias("at"))
    # Only assertions of excepted entities can matter; the others' findings stay without a subject.
    subject = g.assertions.select("world_id", F.col("assertion_id").alias("assertion_a"), F.col("subject_id").alias("about"), "scene_id")
    subject = subject.join(r.select("world_id", "about").distinct(), ["world_id", "about"], "left_semi")
    subject = cut(subject.join(at.withColumnRenamed("at", "own_at"), ["world_id", "scene_id"], "left").drop("scene_id"))
    f = found.join(subject, ["world_id", "assertion_a"], "left").join(at, ["world_id", "scene_id"], "left").withColumn("where_", F.coalesce("at", "own_at"))
    fa, ra = f.alias("f"), r.alias("r")
    inside = F.coalesce(F.col("f.where_") >= F.col("r.pos_from"), F.col("r.pos_from").isNull()) & F.coalesce(F.col("f.where_") <= F.col("r.pos_to"), F.col("r.pos_to").isNull())
    same = (F.col("f.world_id") == F.col("r.world_id")) & (F.col("f.check_name") == F.col("r.check_name")) & (F.col("f.about") == F.col("r.about"))
    return fa.join(ra, same & inside, "left_anti").select(*found.columns)


def compose(g: Graph, rules: DataFrame) -> DataFrame:
    """Checks and rules together, sealed ones marked, less exceptions."""
    found = checks.all_findings(g)
    more = checks.mark_sealed(cannot(g, rules).unionByName(only(g, rules)), g.seals)
    return without_exceptions(g, found.unionByName(more), rules)


def rule_list(log: DataFrame) -> DataFrame:
    """A log of rules (world_id, rule_id, op create|enable|disable|delete, at, kind, label) -> the rules that there are.

    Without deleted rules and those never created; what came before the creation counts for nothing.  ``disabled_at``
    is the last disabling, unless enabled since; ``place`` is by creation, then id.
    """
    made = F.col("op") == "create"
    when = F.struct("at", "op")
    per = log.groupBy("world_id", "rule_id").agg(
        F.min(F.when(made, F.struct("at", "kind", "label"))).alias("made"), F.max(F.when(F.col("op").isin("enable", "disable"), when)).alias("turn"),
        F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("gone"),
    )
    there = per.filter("made is not null and (gone is null or gone < made.at)")
    off = (F.col("turn.op") == "disable") & (F.col("turn.at") >= F.col("made.at"))
    place = F.row_number().over(Window.partitionBy("world_id").orderBy("made.at", "rule_id"))
    return there.select("world_id", "rule_id", "made.kind", "made.label", F.col("made.at").alias("created_at"), F.when(off, F.col("turn.at")).alias("disabled_at"), place.alias("place"))
