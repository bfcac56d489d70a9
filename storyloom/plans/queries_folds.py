"""Registered queries on folds, resolution, scoring and integrity, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import folds, resolve
from storyloom.plans.oracle_graph import over_graph
from storyloom.sources.graph import PREDICATES, Graph, derive


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _moves(g: Graph):
    return g.assertions.filter("predicate = 'located_at'").select("world_id", "subject_id", "assertion_id", "object_id", F.col("lo").alias("position"), (F.col("assertion_id") % 6 != 0).alias("starts"))


def _mentions(g: Graph):
    a = g.assertions.select("world_id", "assertion_id", F.concat(F.when(F.col("assertion_id") % 3 == 0, "Old ").otherwise(""), F.lit("User "), (F.col("subject_id") - 1).cast("string"), F.when(F.col("assertion_id") % 5 == 0, "!").otherwise("")).alias("surface"), F.when(F.col("polarity"), "character").otherwise("group").alias("kind"), F.coalesce("lo", F.lit(999)).alias("position"))
    return a.drop("assertion_id")


def _merges(g: Graph):
    return g.entities.filter("kind = 'character' and entity_id % 6 < 2 and entity_id > 6").select("world_id", F.col("entity_id").alias("old_id"), (F.col("entity_id") - F.when(F.col("entity_id") % 6 == 1, 4).otherwise(4)).alias("new_id"))


QUERIES = {
    "interval_fold": _with(lambda g: folds.interval_fold(_moves(g))),
    "surfaces": _with(lambda g: folds.surfaces(_mentions(g))),
    "entity_match": _with(lambda g: folds.entity_match(folds.surfaces(_mentions(g)).select("world_id", "norm"), g.entities)),
    "resolve_entities": _with(lambda g: resolve.resolve(_mentions(g), folds.surfaces(_mentions(g)).filter("mentions > 20").select("world_id", "norm"))),
    "apply_merges": _with(lambda g: folds.apply_merges(g.assertions.select("world_id", "assertion_id", "subject_id", "object_id"), _merges(g), ["subject_id", "object_id"])),
    "apply_rulings": _with(lambda g: folds.apply_rulings(g.assertions.select("assertion_id", "status"), g.assertions.filter("assertion_id % 3 = 0").select("assertion_id", F.when(F.col("assertion_id") % 2 == 0, "accept").otherwise("reject").alias("verdict"), F.lit(1).alias("seq")))[0]),
    "score_extraction": _with(lambda g: folds.score_extraction(g.assertions.filter("object_value is not null").select(F.col("world_id").alias("run_id"), F.col("assertion_id").alias("expected_id"), F.col("subject_id").cast("string").alias("subject"), "predicate", F.col("object_value").alias("value")), g.assertions.filter("object_value is not null and assertion_id % 3 <> 0").select(F.col("world_id").alias("run_id"), F.col("assertion_id").alias("actual_id"), F.col("subject_id").cast("string").alias("subject"), "predicate", F.upper("object_value").alias("value")))),
    "integrity": _with(lambda g: folds.integrity(g.assertions, g.entities.filter("entity_id % 9 <> 0"), PREDICATES[:-4])),
}

_M = "m AS (SELECT world_id, CASE WHEN assertion_id % 3 = 0 THEN 'Old ' ELSE '' END || 'User ' || (subject_id - 1) || CASE WHEN assertion_id % 5 = 0 THEN '!' ELSE '' END AS surface, CASE WHEN polarity THEN 'character' ELSE 'group' END AS kind, coalesce(lo, 999) AS position FROM a), n AS (SELECT *, trim(regexp_replace(lower(surface), '[^a-z0-9 ]', '', 'g')) AS norm FROM m)"
_FOLD = """r AS (SELECT world_id, subject_id, assertion_id, object_id, lo, row_number() OVER (PARTITION BY world_id, subject_id ORDER BY lo, assertion_id) AS nth
 FROM a WHERE predicate = 'located_at' AND assertion_id % 6 <> 0 AND lo IS NOT NULL),
f AS (SELECT *, 'moved' AS act, object_id AS live, lo AS since FROM r WHERE nth = 1
 UNION ALL SELECT r.*, CASE WHEN r.object_id = f.live THEN 'skipped' WHEN r.lo = f.since THEN 'conflict' ELSE 'moved' END, CASE WHEN r.lo <> f.since THEN r.object_id ELSE f.live END, CASE WHEN r.object_id <> f.live THEN r.lo ELSE f.since END
 FROM f JOIN r ON r.world_id = f.world_id AND r.subject_id = f.subject_id AND r.nth = f.nth + 1),
m AS (SELECT assertion_id, lead(lo) OVER (PARTITION BY world_id, subject_id ORDER BY nth) AS nxt FROM f WHERE act = 'moved')
SELECT world_id, subject_id, f.assertion_id, object_id, lo, nxt AS hi, CASE WHEN act <> 'moved' THEN act WHEN nxt IS NULL THEN 'open' ELSE 'closed' END AS action FROM f LEFT JOIN m USING (assertion_id)
UNION ALL SELECT world_id, subject_id, assertion_id, object_id, lo, CAST(lo + 1 AS INT), 'anchored' FROM a WHERE predicate = 'located_at' AND (assertion_id % 6 = 0 OR lo IS NULL)"""
ORACLES = {
    "interval_fold": over_graph(_FOLD).replace("WITH ", "WITH RECURSIVE ", 1),
    "surfaces": over_graph(f"{_M}, v AS (SELECT world_id, norm, kind, row_number() OVER (PARTITION BY world_id, norm ORDER BY count(*) DESC, CASE kind WHEN 'character' THEN 1 ELSE 99 END, kind) AS nth FROM n GROUP BY 1, 2, 3) SELECT n.world_id, n.norm, arg_max(surface, (len(string_split(surface, ' ')), length(surface), surface)) AS surface, min(position) AS first_position, count(*) AS mentions, any_value(v.kind) AS kind FROM n JOIN v ON v.world_id = n.world_id AND v.norm = n.norm AND nth = 1 GROUP BY 1, 2"),
    "entity_match": over_graph(f"{_M}, s AS (SELECT DISTINCT world_id, norm, string_split(norm, ' ') AS t FROM n), r AS (SELECT world_id, entity_id, string_split(lower(name), ' ') AS u, lower(name) AS k FROM entities), x AS (SELECT s.world_id, norm, count(*) AS n, min(entity_id) AS e FROM s JOIN r ON r.world_id = s.world_id AND r.k = s.norm GROUP BY 1, 2), f AS (SELECT s.world_id, s.norm, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM s JOIN r ON r.world_id = s.world_id AND len(list_intersect(t, u)) > 0 AND (len(list_intersect(t, u)) = least(len(t), len(u)) OR len(list_intersect(t, u)) >= 0.5 * (len(t) + len(u) - len(list_intersect(t, u)))) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.world_id = s.world_id AND x.norm = s.norm) GROUP BY 1, 2) SELECT s.world_id, s.norm, CASE WHEN x.n = 1 THEN 'exact' WHEN x.n > 1 THEN 'ambiguous' WHEN f.n = 1 THEN 'fuzzy' WHEN f.n > 1 THEN 'ambiguous' ELSE 'none' END AS match, CASE WHEN x.n = 1 THEN x.e WHEN f.n = 1 THEN f.e END AS entity_id FROM s LEFT JOIN x ON x.world_id = s.world_id AND x.norm = s.norm LEFT JOIN f ON f.world_id = s.world_id AND f.norm = s.norm"),
    "apply_merges": over_graph("mg AS (SELECT world_id, entity_id AS o, entity_id - 4 AS n FROM entities WHERE kind = 'character' AND entity_id % 6 < 2 AND entity_id > 6), m2 AS (SELECT x.world_id, x.o, coalesce(z.n, y.n, x.n) AS n FROM mg x LEFT JOIN mg y ON y.world_id = x.world_id AND y.o = x.n LEFT JOIN mg z ON z.world_id = x.world_id AND z.o = y.n) SELECT a.world_id, assertion_id, coalesce(p.n, subject_id) AS subject_id, coalesce(q.n, object_id) AS object_id FROM a LEFT JOIN m2 p ON p.world_id = a.world_id AND p.o = subject_id LEFT JOIN m2 q ON q.world_id = a.world_id AND q.o = object_id"),
    "apply_rulings": over_graph("one AS (SELECT 1) SELECT assertion_id, CASE WHEN status = 'draft' AND assertion_id % 3 = 0 THEN CASE WHEN assertion_id % 2 = 0 THEN 'canon' ELSE 'rejected' END ELSE status END AS status FROM a"),
    "integrity": over_graph("one AS (SELECT 1) SELECT 'subject_exists' AS \"constraint\", CAST(assertion_id AS VARCHAR) AS key FROM a WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.world_id = a.world_id AND e.entity_id = a.subject_id AND e.entity_id % 9 <> 0) UNION ALL SELECT 'predicate_known', CAST(assertion_id AS VARCHAR) FROM a WHERE predicate IN ('cannot', 'goal', 'promised', 'fact') UNION ALL SELECT 'one_object', CAST(assertion_id AS VARCHAR) FROM a WHERE (object_id IS NOT NULL)::int + (object_value IS NOT NULL)::int + (object_assertion_id IS NOT NULL)::int > 1"),
}
