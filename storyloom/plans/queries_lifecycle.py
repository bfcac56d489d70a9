"""Registered queries on life cycles, exports, probes and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import checks, lifecycle, usage
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import OVER, _unsourced
from storyloom.sources.graph import Graph, derive, events


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _notes(g: Graph):
    n = F.col("assertion_id")
    return g.assertions.select(
        "world_id", n.cast("string").alias("note_key"), F.concat(F.lit("F"), (n % 4 + 1).cast("string")).alias("family"), F.when(n % 5 == 0, "sealed").when(n % 5 == 1, "dismissed").when(n % 5 == 2, "addressed").otherwise("open").alias("status"),
        F.concat(F.lit("run"), (n % 3).cast("string")).alias("first_seen_run"), F.concat(F.lit("run"), F.greatest(n % 3, n % 4 - 1).cast("string")).alias("last_seen_run"),
        F.array("scene_id", F.col("scene_id") + 1).alias("cited"), F.array(F.col("scene_id") + 1, F.col("scene_id") + 2).alias("anchors"),
    )


def _seal_events(g: Graph):
    n = F.col("assertion_id")
    one = g.assertions.select("world_id", F.lit("dead_speaker").alias("check_name"), (n % 50).alias("assertion_a"), F.when(n % 3 == 0, n % 7).alias("assertion_b"), F.when(n % 2 == 0, "seal").otherwise("unseal").alias("kind"), n.alias("seq"))
    return one


def _run_events(s, d):
    return events(s, d).select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"))


def _tail(s, d):
    numbered = lifecycle.ledger(_run_events(s, d))
    return lifecycle.tail(numbered, numbered.groupBy("run_id").agg((F.max("seq") - 2).alias("after"))).select("run_id", "event_id", "seq", "kind")


def _links(s, d):
    e = events(s, d)
    return e.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), "world_id", (F.col("k") % 10).cast("string").alias("kind"), F.col("event_id").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).alias("revoked_at"))


def _cases(g: Graph):
    n = F.col("assertion_id")
    return g.assertions.select(n.alias("case_id"), (n % 4 != 0).alias("extracted"), lifecycle.containment("object_value", "supporting_quote").alias("drift"), (n % 7 != 0).alias("present"), F.col("status").isin("sealed", "rejected").alias("muted"))


def _runs(s, d):
    return _run_events(s, d).select((F.col("run_id") % 40).alias("world_id"), F.col("run_id"), F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "purchase", "done").otherwise("running").alias("status"), F.col("ts").alias("heartbeat"))


def _expected(g: Graph):
    found = checks.destroyed_location_use(g).select(F.col("world_id").alias("run_id"), F.row_number().over(Window.partitionBy("world_id").orderBy("assertion_a", "scene_id")).cast("long").alias("finding_id"), "check_name", "scene_id", "explanation", "severity")
    want = found.filter("finding_id % 3 = 0").select("run_id", F.col("finding_id").alias("expected_id"), "check_name", "scene_id", F.array(F.lit("is used")).alias("words"))
    return want, found


QUERIES = {
    "note_rulings": _with(lambda g: lifecycle.note_rulings(_notes(g), g.assertions.filter("assertion_id % 6 < 3").select("world_id", F.col("assertion_id").cast("string").alias("note_key"), F.when(F.col("assertion_id") % 2 == 0, "sealed").otherwise("dismissed").alias("verdict"), F.lit(1).alias("seq"))).select("world_id", "note_key", "status")),
    "note_diff": _with(lambda g: lifecycle.note_diff(_notes(g))),
    "notes_by_scene": _with(lambda g: lifecycle.notes_by_scene(_notes(g))),
    "seal_fold": _with(lambda g: lifecycle.seal_fold(_seal_events(g))),
    "run_ledger": _tail,
    "share_links": lambda s, d: lifecycle.live_links(_links(s, d)),
    "export_manifest": _with(lambda g: lifecycle.manifest({"assertions": g.assertions, "entities": g.entities, "aliases": g.aliases, "works": g.works})),
    "probes": _with(lifecycle.probes),
    "attribute_misses": _with(lambda g: lifecycle.attribute_misses(_cases(g))),
    "run_status": lambda s, d: usage.run_status(_runs(s, d), F.lit(1706600000)),
    "score_findings": _with(lambda g: lifecycle.score_findings(*_expected(g))),
}

_N = """n AS (SELECT world_id, CAST(assertion_id AS VARCHAR) AS note_key, assertion_id, scene_id, 'F' || (assertion_id % 4 + 1) AS family, CASE assertion_id % 5 WHEN 0 THEN 'sealed' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'addressed' ELSE 'open' END AS status,
 'run' || (assertion_id % 3) AS f, 'run' || greatest(assertion_id % 3, assertion_id % 4 - 1) AS l FROM a)"""
_E = "e AS (SELECT event_id, ts, user_id AS run_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS c FROM ev)"
_STOP = "(" + ", ".join(f"'{w}'" for w in ("", *text.STOP_WORDS)) + ")"
_TOK = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN " + _STOP + ")"
_MUTE = "'rejected', 'retconned'"

ORACLES = {
    "note_rulings": over_graph(f"{_N} SELECT world_id, note_key, CASE WHEN status = 'open' AND assertion_id % 6 < 3 THEN CASE WHEN assertion_id % 2 = 0 THEN 'sealed' ELSE 'dismissed' END ELSE status END AS status FROM n"),
    "note_diff": over_graph(f"{_N}, m AS (SELECT *, max(l) OVER (PARTITION BY world_id) AS r FROM n) SELECT world_id, note_key, family, CASE WHEN status IN ('sealed', 'dismissed') THEN status WHEN status = 'addressed' AND l = r THEN 'resolved' WHEN f = r AND l = r THEN 'new' ELSE 'carried' END AS change FROM m"),
    "notes_by_scene": over_graph(f"{_N} SELECT world_id, note_key, CAST(i AS INT) AS nth, scene_id + i AS scene_id FROM n CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) WHERE status = 'open'"),
    "seal_fold": over_graph("s AS (SELECT world_id, assertion_id % 50 AS x, coalesce(CASE WHEN assertion_id % 3 = 0 THEN assertion_id % 7 END, 0) AS b, arg_max(CASE WHEN assertion_id % 2 = 0 THEN 'seal' ELSE 'unseal' END, assertion_id) AS k FROM a GROUP BY 1, 2, 3) SELECT world_id, 'dead_speaker' AS check_name, x AS assertion_a, nullif(b, 0) AS assertion_b FROM s WHERE k = 'seal'"),
    "run_ledger": over_graph(f"{_E} SELECT run_id, event_id, CAST(seq AS INT) AS seq, kind FROM e WHERE seq > c - 2"),
    "share_links": over_graph("l AS (SELECT world_id, CAST(k % 10 AS VARCHAR) AS kind, max(event_id) AS m FROM ev GROUP BY 1, 2) SELECT world_id, kind, 't' || m AS token FROM l WHERE m % 3 <> 0"),
    "export_manifest": over_graph("one AS (SELECT 1) SELECT 'assertions' AS table_name, world_id, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'entities', world_id, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'aliases', world_id, count(*) FROM aliases GROUP BY 2 UNION ALL SELECT 'works', world_id, count(*) FROM works GROUP BY 2"),
    "probes": over_graph(f"{_unsourced(_MUTE, '')} SELECT world_id, 'late_knowers' AS probe, count(*) AS n FROM late GROUP BY 1 UNION ALL SELECT world_id, 'late_without_source', count(*) FROM uns GROUP BY 1 UNION ALL SELECT x.world_id, 'overlapping_places', count(*) FROM a x JOIN a y ON x.world_id = y.world_id AND x.subject_id = y.subject_id AND y.assertion_id > x.assertion_id WHERE x.predicate = 'located_at' AND y.predicate = 'located_at' AND x.object_id <> y.object_id AND x.status NOT IN ({_MUTE}) AND y.status NOT IN ({_MUTE}) AND {OVER} GROUP BY 1 UNION ALL SELECT d.world_id, 'scenes_after_end', count(*) FROM a d JOIN presence p ON p.world_id = d.world_id AND p.entity_id = d.subject_id JOIN scenes s ON s.world_id = p.world_id AND s.scene_id = p.scene_id WHERE d.predicate IN ('dies', 'destroyed') AND d.status NOT IN ({_MUTE}) AND s.story_position > d.lo GROUP BY 1"),
    "attribute_misses": over_graph(f"c AS (SELECT *, {_TOK.format('object_value')} AS x, {_TOK.format('supporting_quote')} AS y FROM a) SELECT assertion_id AS case_id, CASE WHEN assertion_id % 4 = 0 THEN 'not_extracted' WHEN coalesce(CAST(len(list_intersect(x, y)) AS DOUBLE) / nullif(len(x), 0), 0) < 0.5 THEN 'drifted' WHEN assertion_id % 7 = 0 THEN 'not_present' WHEN status IN ('sealed', 'rejected') THEN 'muted' ELSE 'check' END AS layer FROM c"),
    "run_status": over_graph("r AS (SELECT user_id % 40 AS world_id, user_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE CASE WHEN floor(epoch(ts)) < 1706600000 - 90 THEN 'failed' ELSE 'running' END END AS status, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, user_id DESC) AS nth FROM ev) SELECT world_id, run_id, status FROM r WHERE nth = 1"),
}
