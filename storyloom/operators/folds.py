"""Ordered folds and resolution: locations into closed intervals, surfaces into entities, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import names
from storyloom.operators.lineage import chains
from storyloom.sources.graph import KINDS, PREDICATES


def interval_fold(rows: DataFrame) -> DataFrame:
    """Locations (world_id, subject_id, assertion_id, object_id, position, starts) in order of position, then id.

    A move closes the open interval at its position; a row that repeats the open place is skipped; two places at
    one position stay open together as a conflict; a row that does not start there, or has no place or position, is
    anchored one position wide.

    Only windows within a subject.  Of the places at a position the first, a, is the new one, unless it is the open one
    already: then it is the next other place, b, if any.  So whether b is taken follows from the position before: it is
    taken anew where a is what was open there, and with b open there if b was a.  That is a running parity since the
    last position where neither holds.
    """
    free = F.coalesce(~F.col("starts"), F.lit(True)) | F.col("position").isNull() | F.col("object_id").isNull()
    own, here = ["world_id", "subject_id"], ["world_id", "subject_id", "position"]
    order, at = Window.partitionBy(*own).orderBy("position", "assertion_id", "object_id"), Window.partitionBy(*here)
    till = order.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.filter(~free).select(*own, "assertion_id", "object_id", F.col("position").cast("int").alias("position")).repartition(*own)
    r = r.withColumn("nth", F.row_number().over(at.orderBy("assertion_id", "object_id")))
    r = r.withColumn("a", F.min_by("object_id", "nth").over(at))
    r = r.withColumn("b", F.min_by("object_id", F.when(F.col("object_id") != F.col("a"), F.col("nth"))).over(at))
    begins = F.col("nth") == 1
    same_a = F.coalesce(F.lag("a").over(order) == F.col("a"), F.lit(False))
    same_b = F.coalesce(F.lag("b").over(order) == F.col("a"), F.lit(False))
    r = r.withColumn("fresh", (begins & (F.col("b").isNull() | ~(same_a | same_b))).cast("int")).withColumn("turns", (begins & same_a).cast("int"))
    r = r.withColumn("run", F.sum("fresh").over(till))
    since = Window.partitionBy(*own, "run").orderBy("position", "assertion_id", "object_id").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(F.when(F.col("fresh") == 1, 0).otherwise(F.col("turns"))).over(since) % 2
    r = r.withColumn("live", F.when(turned == 1, F.col("b")).otherwise(F.col("a")))
    r = r.withColumn("prev", F.lag("live").over(order)).withColumn("prev", F.min_by("prev", "nth").over(at))
    moved = F.coalesce(F.col("live") != F.col("prev"), F.lit(True))
    r = r.withColumn("mover", F.min(F.when(moved & (F.col("object_id") == F.col("live")), F.col("nth"))).over(at))
    moves = F.coalesce(F.col("nth") == F.col("mover"), F.lit(False))
    later = Window.partitionBy(*own).orderBy("position").rangeBetween(1, Window.unboundedFollowing)
    r = r.withColumn("next", F.min(F.when(moves, F.col("position"))).over(later))
    other = (F.col("nth") > F.col("mover")) & (F.col("object_id") != F.col("live"))
    action = F.when(moves & F.col("next").isNotNull(), "closed").when(moves, "open").when(other, "conflict").otherwise("skipped")
    folded = r.select(*own, "assertion_id", "object_id", F.col("position").alias("lo"), F.when(moves, F.col("next")).alias("hi"), action.alias("action"))
    lone = rows.filter(free).select(*own, "assertion_id", "object_id", F.col("position").cast("int").alias("lo"), (F.col("position") + 1).cast("int").alias("hi"), F.lit("anchored").alias("action"))
    return folded.unionByName(lone)


def surfaces(mentions: DataFrame) -> DataFrame:
    """(world_id, surface, kind, position) -> one row a normalised surface: its richest form, first position, and the kind with most votes (ties by the order of KINDS)."""
    m = mentions.withColumn("norm", F.trim(text.norm_strip("surface"))).filter("norm <> ''")
    votes = m.groupBy("world_id", "norm", "kind").agg(F.count("*").alias("n"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0)), F.lit(99))
    kind = votes.groupBy("world_id", "norm").agg(F.min_by("kind", F.struct(-F.col("n"), rank, "kind")).alias("kind"))
    form = F.max_by("surface", F.struct(F.size(F.split("surface", " ")), F.length("surface"), "surface"))
    return m.groupBy("world_id", "norm").agg(form.alias("surface"), F.min("position").alias("first_position"), F.count("*").alias("mentions")).join(kind, ["world_id", "norm"])


def entity_match(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Surfaces (world_id, norm) against names (world_id, entity_id, name): exact, fuzzy (token subset or half of the tokens shared), ambiguous or none."""
    reg = registry.select("world_id", "entity_id", F.trim(text.norm_strip("name")).alias("key")).distinct()
    exact = found.join(reg.withColumnRenamed("key", "norm"), ["world_id", "norm"]).groupBy("world_id", "norm").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    rest = found.join(exact.select("world_id", "norm"), ["world_id", "norm"], "left_anti").select("world_id", F.col("norm").alias("a"), names.tokens("norm").alias("ta")).distinct()
    known = reg.select("world_id", F.col("entity_id").alias("b"), names.tokens("key").alias("tb")).distinct()
    near = names.near_pairs(rest, known).select("world_id", F.col("a").alias("norm"), F.col("b").alias("entity_id"))
    fuzzy = near.groupBy("world_id", "norm").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    both = exact.withColumn("how", F.lit("exact")).unionByName(fuzzy.withColumn("how", F.lit("fuzzy")))
    out = found.select("world_id", "norm").distinct().join(both, ["world_id", "norm"], "left")
    return out.select("world_id", "norm", F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise(F.col("how")).alias("match"), F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"))


def merge_targets(merges: DataFrame) -> DataFrame:
    """Merge decisions (world_id, old_id, new_id), chains of any length followed to their end."""
    return chains(merges, ["world_id"], "old_id", "new_id")


def apply_merges(rows: DataFrame, merges: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the named id columns pointed at what their entities were merged into."""
    to = merge_targets(merges)
    for c in columns:
        own = to.select("world_id", F.col("old_id").alias(c), F.col("new_id").alias("__to"))
        rows = rows.join(own, ["world_id", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return rows


def merge_entities(entities: DataFrame, aliases: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases after merges (world_id, old_id, new_id).

    What was merged away is left out; the kept entity is provisional only if all of them were, and takes what it has no
    value for from the merged one with the smallest id that has.  Names merged away become aliases, once each.
    """
    to = merge_targets(merges).select("world_id", F.col("old_id").alias("entity_id"), F.col("new_id").alias("__to"))
    at = lambda df: df.join(to, ["world_id", "entity_id"], "left").withColumn("__into", F.coalesce("__to", "entity_id"))
    e = at(entities)
    order = F.struct(F.col("entity_id") != F.col("__into"), "entity_id")
    rest = [c for c in entities.columns if c not in ("world_id", "entity_id", "provisional")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    kept = e.groupBy("world_id", F.col("__into").alias("entity_id")).agg(F.bool_and("provisional").alias("provisional"), *first)
    gone = e.filter("__to is not null").select("world_id", F.col("__into").alias("entity_id"), F.col("name").alias("alias"))
    known = at(aliases).select("world_id", F.col("__into").alias("entity_id"), "alias").unionByName(gone).distinct()
    return kept.select(*entities.columns), known


# What an edit may change.
EDITABLE = ("subject_id", "predicate", "object_id", "object_value", "polarity", "lo", "hi", "supporting_quote", "confidence")


def apply_rulings(assertions: DataFrame, rulings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rulings (assertion_id, verdict accept|reject|edit, seq): the newest moves a draft; and the applied ones.

    Columns of ``EDITABLE`` in the rulings are an edit's new values, null ones change nothing; an edited draft is canon.
    An edit to a predicate that nobody knows isn't applied.
    """
    patch = [c for c in rulings.columns if c in EDITABLE and c in assertions.columns]
    last = rulings.groupBy("assertion_id").agg(F.max_by(F.struct("verdict", *patch), F.struct("seq", "verdict")).alias("__r"))
    verdict = F.col("__r.verdict")
    valid = verdict.isin("accept", "reject")
    change = verdict == "edit"
    if "predicate" in patch:
        change = change & (F.col("__r.predicate").isNull() | F.col("__r.predicate").isin(*PREDICATES))
    both = assertions.join(last, "assertion_id", "left").withColumn("__ok", F.coalesce((F.col("status") == "draft") & (valid | change), F.lit(False)))
    applied = both.filter("__ok").select("assertion_id", verdict.alias("verdict"))
    edited = F.col("__ok") & (verdict == "edit")
    for c in patch:
        both = both.withColumn(c, F.when(edited, F.coalesce(F.col(f"__r.{c}"), F.col(c))).otherwise(F.col(c)))
    status = F.when(F.col("__ok") & (verdict == "reject"), "rejected").when(F.col("__ok"), "canon").otherwise(F.col("status"))
    return both.withColumn("status", status).drop("__r", "__ok"), applied


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of run, subject, predicate and both ids -> those that hold: each expected one takes its first actual one that is free."""
    group, done, used = None, None, set()
    for batch in batches:
        taken = []
        for i, (*now, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if now != group:
                group, done = now, None
                used.clear()
            if x != done and y not in used:
                done = x
                used.add(y)
                taken.append(i)
        yield batch.select(["run_id", "expected_id", "actual_id"]).take(pa.array(taken, pa.int64()))


def score_extraction(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Recall per run of (run_id, expected_id, subject, predicate, value) against (run_id, actual_id, ...): greedy, one to one, in expected order within each run, subject and predicate; normalised values match if equal or one holds the other."""
    norm = lambda df, i: df.select("run_id", i, text.norm_strip("subject").alias("s"), "predicate", text.norm_strip("value").alias("v"))
    e, a = norm(expected, "expected_id"), norm(actual, "actual_id").withColumnRenamed("v", "w")
    pairs = e.join(a, ["run_id", "s", "predicate"]).filter(F.col("v").contains(F.col("w")) | F.col("w").contains(F.col("v")))

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    order = ["run_id", "s", "predicate", "expected_id", "actual_id"]
    # Groups are many and small: they stream through a task in order, and are not handed over one by one.
    ordered = pairs.select(*order).repartition("run_id", "s", "predicate").sortWithinPartitions(*order)
    hit = ordered.mapInArrow(_greedy, f"run_id {kinds['run_id']}, expected_id {kinds['expected_id']}, actual_id {kinds['actual_id']}")
    total = expected.groupBy("run_id").agg(F.count("*").alias("expected"))
    return total.join(hit.groupBy("run_id").agg(F.count("*").alias("matched")), "run_id", "left").fillna(0, ["matched"]).withColumn("recall", F.col("matched") / F.col("expected"))


def integrity(assertions: DataFrame, entities: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """Violations (constraint, key): repeated ids, unknown subjects, unknown predicates, several object sides, confidence out of range."""
    sides = F.col("object_id").isNotNull().cast("int") + F.col("object_value").isNotNull().cast("int") + F.col("object_assertion_id").isNotNull().cast("int")
    key = F.col("assertion_id").cast("string").alias("key")
    rows = lambda df, name: df.select(F.lit(name).alias("constraint"), key)
    parts = [
        rows(assertions.groupBy("assertion_id").count().filter("count > 1"), "unique_id"), rows(assertions.join(entities.select("world_id", F.col("entity_id").alias("subject_id")), ["world_id", "subject_id"], "left_anti"), "subject_exists"),
        rows(assertions.filter(~F.col("predicate").isin(*predicates)), "predicate_known"), rows(assertions.filter(sides > 1), "one_object"), rows(assertions.filter((F.col("confidence") < 0) | (F.col("confidence") > 1)), "confidence_range"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
