"""Registered queries on report tables and note validation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import holes, notes, report
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import LABELS
from storyloom.sources.graph import Graph, derive


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _lines(g: Graph):
    n = F.col("assertion_id")
    return g.assertions.select("world_id", F.col("predicate").alias("section"), n.alias("ord"), F.coalesce("object_value", F.lit("-")).alias("line"))


def _questions(g: Graph):
    n = F.col("assertion_id")
    return g.assertions.select("world_id", F.concat(F.lit("why "), n.cast("string")).alias("question"), F.when(n % 3 == 0, F.concat(F.lit("E"), (100 + n % 30).cast("string"), F.lit("/sc2"))).alias("label"), F.when(n % 4 != 0, (n % 130).cast("int")).alias("position"))


def _cited(g: Graph):
    n = F.col("assertion_id")
    first = F.struct(n.alias("assertion_id"), F.when(n % 7 == 0, F.col("scene_id") + 1).otherwise(F.col("scene_id")).alias("scene_id"), F.when(n % 5 == 0, F.lit("made up")).otherwise(F.upper("supporting_quote")).alias("quote"))
    second = F.struct((n + F.when(n % 11 == 0, 10**9).otherwise(0)).alias("assertion_id"), F.col("scene_id").alias("scene_id"), F.col("supporting_quote").alias("quote"))
    return g.assertions.select(F.concat(F.lit("k"), n.cast("string")).alias("note_key"), "world_id", F.array(first, second).alias("citations"))


def _coverage(g: Graph):
    n = F.col("assertion_id")
    row = lambda df: df.select("world_id", F.concat(F.lit("F"), (n % 4 + 1).cast("string")).alias("family"), "scene_id")
    return row(g.assertions.filter("assertion_id % 9 = 0")), row(g.assertions.filter("assertion_id % 5 < 2")), row(g.assertions.filter("assertion_id % 31 = 0"))


def _drafts(g: Graph):
    """A draft for every fact, by turns of no candidate, without text, on turns with odd motives or words, without citations."""
    n = F.col("assertion_id")
    motive = F.when(n % 3 == 0, "present").when(n % 3 == 1, "some")
    drafts = _cited(g).withColumn("assertion_id", F.substring("note_key", 2, 30).cast("long")).select(
        "world_id", F.col("note_key").alias("draft_id"), F.when(n % 13 == 0, -n).otherwise(n).alias("candidate_id"), F.when(n % 17 == 0, " ").otherwise("Why now").alias("summary"),
        F.when(n % 19 < 4, "A Weak turn.").otherwise("A weakened turn.").alias("body"), motive.alias("motivation"), (n % 29 != 0).alias("surface"), F.when(n % 23 != 0, F.col("citations")).alias("citations"),
    )
    found = g.assertions.select("world_id", n.alias("candidate_id"), F.concat(F.lit("key"), n.cast("string")).alias("note_key"), F.concat(F.lit("F"), (n % 4 + 1).cast("string")).alias("family"), F.when(n % 5 < 4, "absent").alias("motivation"))
    return drafts, found


QUERIES = {
    "validated_drafts": _with(lambda g: notes.validated_drafts(*_drafts(g), g)),
    "report_lines": _with(lambda g: report.budgeted(_lines(g), 40)),
    "scene_questions_join": _with(lambda g: report.questions_by_scene(g, _questions(g))),
    "validate_notes": _with(lambda g: notes.validate(_cited(g), g)),
    "score_coverage": _with(lambda g: report.score_coverage(*_coverage(g))),
    "works_with_scenes": _with(report.works_with_scenes),
    "title_labels": _with(lambda g: holes.scene_labels(g).groupBy("world_id", "title").agg(F.min("label").alias("first_label"), F.count("*").alias("n"))),
}

ORACLES = {
    "report_lines": over_graph("r AS (SELECT world_id, predicate AS section, assertion_id AS ord, coalesce(object_value, '-') AS line, row_number() OVER (PARTITION BY world_id ORDER BY predicate, assertion_id) AS p, count(*) OVER (PARTITION BY world_id) AS t FROM a) SELECT world_id, section, ord, line, CAST(p AS INT) AS place, p = 40 AND t > 40 AS capped FROM r WHERE p <= 40"),
    "scene_questions_join": over_graph(f"{LABELS}, q AS (SELECT world_id, 'why ' || assertion_id AS question, CASE WHEN assertion_id % 3 = 0 THEN 'E' || (100 + assertion_id % 30) || '/sc2' END AS label, CASE WHEN assertion_id % 4 <> 0 THEN assertion_id % 130 END AS position FROM a) SELECT q.world_id, question, coalesce(l.scene_id, (SELECT min(s.scene_id) FROM scenes s WHERE s.world_id = q.world_id AND s.story_position = q.position)) AS scene_id FROM q LEFT JOIN labels_ l ON l.world_id = q.world_id AND l.label = q.label"),
    "validate_notes": over_graph("""c AS (
 SELECT assertion_id AS k, world_id, 0 AS nth, assertion_id AS aid, CASE WHEN assertion_id % 7 = 0 THEN scene_id + 1 ELSE scene_id END AS sid, CASE WHEN assertion_id % 5 = 0 THEN 'made up' ELSE upper(supporting_quote) END AS quote FROM a
 UNION ALL SELECT assertion_id, world_id, 1, assertion_id + CASE WHEN assertion_id % 11 = 0 THEN 1000000000 ELSE 0 END, scene_id, supporting_quote FROM a),
j AS (SELECT c.*, CASE WHEN s.raw_text IS NULL THEN 'unknown_scene' WHEN x.assertion_id IS NULL THEN 'unknown_assertion' WHEN x.scene_id <> c.sid THEN 'scene_mismatch' WHEN lower(c.quote) <> lower(x.supporting_quote) THEN 'quote_differs' WHEN NOT contains(lower(s.raw_text), lower(c.quote)) THEN 'quote_not_in_scene' END AS reason
 FROM c LEFT JOIN a x ON x.world_id = c.world_id AND x.assertion_id = c.aid LEFT JOIN scenes s ON s.world_id = c.world_id AND s.scene_id = c.sid)
SELECT world_id, 'k' || k AS note_key, arg_min(reason, nth) FILTER (reason IS NOT NULL) AS reason FROM j GROUP BY world_id, k"""),
    "score_coverage": over_graph("""r AS (SELECT world_id, 'F' || (assertion_id % 4 + 1) AS family, scene_id, assertion_id FROM a), e AS (SELECT DISTINCT world_id, family, scene_id FROM r WHERE assertion_id % 9 = 0), n AS (SELECT DISTINCT world_id, family, scene_id FROM r WHERE assertion_id % 5 < 2), d AS (SELECT DISTINCT world_id, family, scene_id FROM r WHERE assertion_id % 31 = 0),
m AS (SELECT world_id, count(*) AS met FROM e SEMI JOIN n USING (world_id, family, scene_id) GROUP BY 1), w AS (SELECT world_id, count(*) AS decoys_flagged FROM n SEMI JOIN d USING (world_id, family, scene_id) GROUP BY 1), t AS (SELECT world_id, count(*) AS expected FROM e GROUP BY 1)
SELECT world_id, expected, coalesce(met, 0) AS met, coalesce(decoys_flagged, 0) AS decoys_flagged, CAST(coalesce(met, 0) AS DOUBLE) / expected AS recall, coalesce(CAST(coalesce(met, 0) AS DOUBLE) / nullif(coalesce(met, 0) + coalesce(decoys_flagged, 0), 0), 1.0) AS precision FROM t LEFT JOIN m USING (world_id) LEFT JOIN w USING (world_id)"""),
    "works_with_scenes": over_graph("one AS (SELECT 1) SELECT w.world_id, w.work_id, title, sort_order, string_agg(slug, '|' ORDER BY story_position, slug) AS scenes, count(*) AS n FROM works w JOIN scenes s USING (world_id, work_id) GROUP BY 1, 2, 3, 4"),
    "title_labels": over_graph(f"{LABELS} SELECT world_id, title, min(label) AS first_label, count(*) AS n FROM labels_ GROUP BY 1, 2"),
}
ORACLES["validated_drafts"] = over_graph(f"""v AS ({ORACLES["validate_notes"]}), d AS (SELECT world_id, 'k' || assertion_id AS draft_id, assertion_id AS n, assertion_id % 4 = 3 AS turn FROM a WHERE assertion_id % 29 <> 0)
SELECT d.world_id, draft_id, CASE WHEN n % 13 <> 0 THEN 'key' || n END AS note_key, CASE WHEN n % 13 = 0 THEN 'unknown_candidate' WHEN n % 17 = 0 THEN 'empty_text' WHEN turn AND (n % 3 = 1 OR n % 3 = 2 AND n % 5 = 4) THEN 'bad_motivation' WHEN turn AND n % 19 < 4 THEN 'banned_word'
 WHEN n % 23 = 0 THEN 'no_citations' ELSE coalesce(v.reason, 'keep') END AS verdict FROM d LEFT JOIN v ON v.world_id = d.world_id AND v.note_key = d.draft_id""")
