"""Report tables: sections under a line budget, outside questions by scene, coverage scores, plain listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators.holes import scene_labels
from storyloom.operators.lifecycle import met_links, met_pools, word_pools
from storyloom.operators.lineage import cut
from storyloom.operators.matching import first_free
from storyloom.sources.graph import Graph


def budgeted(lines: DataFrame, most: int) -> DataFrame:
    """Lines (world_id, section, ord, line) in order of section and ord; each world's first ``most``, the last one marked if more were cut."""
    w = Window.partitionBy("world_id")
    ranked = lines.withColumn("place", F.row_number().over(w.orderBy("section", "ord", "line"))).withColumn("total", F.count("*").over(w))
    kept = ranked.filter(F.col("place") <= most)
    return kept.withColumn("capped", (F.col("place") == most) & (F.col("total") > most)).drop("total")


# The sections of notes by family.
NOTE_SECTIONS = ("F1", "F2", "F3", "F4")


def sections(found: DataFrame, bearing: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines (world_id, section, ord, line) of a report, fit for ``budgeted``: live findings, load-bearing names, open notes by family.

    findings: check_name, severity, explanation, sealed; names: place, name, degree, scenes; notes: family, status,
    salience, note_key, summary.  A section without rows in a world that has any gets no line.
    """
    live = found.filter("not sealed").withColumn("ord", F.row_number().over(Window.partitionBy("world_id").orderBy("severity", "check_name", "explanation", "assertion_a", "assertion_b", "scene_id")))
    first = live.select("world_id", F.lit("1 findings").alias("section"), "ord", F.concat(F.lit("["), "severity", F.lit("] "), "check_name", F.lit(": "), "explanation").alias("line"))
    second = bearing.select("world_id", F.lit("2 load-bearing").alias("section"), F.col("place").alias("ord"), F.format_string("%s: %d rows in %d scenes", "name", "degree", "scenes").alias("line"))
    open_ = notes.filter(F.col("status") == "open").filter(F.col("family").isin(*NOTE_SECTIONS))
    open_ = open_.withColumn("ord", F.row_number().over(Window.partitionBy("world_id", "family").orderBy(F.desc("salience"), "note_key")))
    third = open_.select("world_id", F.concat(F.lit("3 notes "), "family").alias("section"), "ord", F.col("summary").alias("line"))
    return first.unionByName(second).unionByName(third)


def questions_by_scene(g: Graph, questions: DataFrame) -> DataFrame:
    """Outside questions (world_id, question, label or null, position or null) at the scene of their label, else of their position."""
    at = scene_labels(g)
    by_label = at.select("world_id", "label", F.col("scene_id").alias("s1"))
    by_place = at.groupBy("world_id", F.col("story_position").alias("position")).agg(F.min("scene_id").alias("s2"))
    out = questions.join(by_label, ["world_id", "label"], "left").join(by_place, ["world_id", "position"], "left")
    return out.select("world_id", "question", F.coalesce("s1", "s2").alias("scene_id"))


def score_coverage(expected: DataFrame, notes: DataFrame, decoys: DataFrame) -> DataFrame:
    """Per world: expected notes (world_id, family, scene_id) that are met, notes that are no decoy's, recall and precision."""
    key = ["world_id", "family", "scene_id"]
    e, n = expected.select(*key).distinct(), notes.select(*key).distinct()
    met = e.join(n, key, "left_semi").groupBy("world_id").agg(F.count("*").alias("met"))
    wrong = n.join(decoys.select(*key).distinct(), key, "left_semi").groupBy("world_id").agg(F.count("*").alias("decoys_flagged"))
    out = e.groupBy("world_id").agg(F.count("*").alias("expected")).join(met, "world_id", "left").join(wrong, "world_id", "left").fillna(0)
    return out.withColumn("recall", F.col("met") / F.col("expected")).withColumn("precision", F.coalesce(F.try_divide(F.col("met").cast("double"), F.col("met") + F.col("decoys_flagged")), F.lit(1.0)))


# Other names of the families of notes; and notes that no longer count.
FAMILY_ALIASES = {"open question": "f1", "idle setup": "f2", "dormant knowledge": "f3", "unmotivated turn": "f4"}
SETTLED = ("sealed", "dismissed", "addressed")


def coverage_scores(expected: DataFrame, notes: DataFrame, decoys: DataFrame) -> DataFrame:
    """Per world: expected notes that are met, notes left over, hits of decoys, recall and precision.

    Expectations and decoys (world_id, expected_id, family, scene_id, line, words): one with a scene is met by a note of
    its family (or an alias of it) that cites the scene or repeats the line, one without by a note with all its words;
    without either by none.  Notes (world_id, note_id, family, status, scene_ids, body) meet one expectation each, in
    order of id, but any number of decoys; sealed, dismissed and addressed ones don't count.
    """
    alias = F.create_map(*[F.lit(x) for kv in FAMILY_ALIASES.items() for x in kv])
    family = F.coalesce(F.element_at(alias, text.norm_collapse("family")), text.norm_collapse("family"))
    keyed = lambda df: df.withColumn("group", F.xxhash64("world_id", family))
    live = cut(keyed(notes.filter(~F.lower(F.coalesce("status", F.lit("open"))).isin(*SETTLED))).withColumnRenamed("note_id", "offered"), grows=True)
    said = live.select("group", "offered", F.col("body").alias("said"))
    cited = live.select("group", "offered", F.explode(F.array_distinct("scene_ids")).alias("scene_id"))

    def parted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        want = keyed(df).withColumnRenamed("expected_id", "wanted")
        return want.filter("scene_id is not null"), want.filter("scene_id is null")

    placed, loose = parted(expected)
    both = zip(met_pools(placed, said, cited), word_pools(loose, said))
    hit = cut(first_free(None, *(one.unionByName(two) for one, two in both)))
    # Ids are a world's own, so whom a link is about is looked up by group.
    met = keyed(expected).join(hit.withColumnRenamed("wanted", "expected_id"), ["group", "expected_id"], "left_semi").groupBy("world_id").agg(F.count("*").alias("met"))
    wrong = live.join(hit, ["group", "offered"], "left_anti").groupBy("world_id").agg(F.count("*").alias("left_over"))
    placed, loose = parted(decoys)
    direct = met_links(placed, said, cited).distinct()  # a decoy is hit once by scene or line
    pools, members = word_pools(loose, said)
    sizes = members.groupBy("group", "pool").agg(F.count("*").alias("n"))
    hits = direct.select("group", "offered", F.lit(1).cast("long").alias("n")).unionByName(pools.join(sizes, ["group", "pool"]).select("group", "offered", "n"))
    flagged = live.select("world_id", "group", "offered").join(hits, ["group", "offered"]).groupBy("world_id").agg(F.sum("n").alias("decoy_hits"))
    out = expected.groupBy("world_id").agg(F.count("*").alias("expected"))
    for part in (met, wrong, flagged):
        out = out.join(part, "world_id", "left")
    out = out.fillna(0).withColumn("recall", F.col("met") / F.col("expected"))
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("met").cast("double"), F.col("met") + F.col("left_over")), F.lit(1.0)))


def works_with_scenes(g: Graph) -> DataFrame:
    """Works in order, each with the slugs of its scenes in order."""
    inner = g.scenes.groupBy("world_id", "work_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("story_position", "slug"))), lambda x: x["slug"]), "|").alias("scenes"), F.count("*").alias("n"))
    return g.works.join(inner, ["world_id", "work_id"], "left").select("world_id", "work_id", "title", "sort_order", "scenes", "n")
