"""Registered queries on checks and gaps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import checks, holes
from storyloom.plans.oracle_graph import off, over_graph
from storyloom.sources import stored
from storyloom.sources.graph import derive

OVER = "(x.lo IS NULL OR y.hi IS NULL OR x.lo < y.hi) AND (y.lo IS NULL OR x.hi IS NULL OR y.lo < x.hi) AND NOT coalesce(x.lo >= x.hi, false) AND NOT coalesce(y.lo >= y.hi, false)"
RANGE = "(CASE WHEN {0}.lo IS NULL THEN '(' ELSE '[' || {0}.lo END || ',' || coalesce(CAST({0}.hi AS VARCHAR), '') || ')')"
COLS = "world_id, check_name, severity, explanation, scene_id, assertion_a, assertion_b"


def _seen(check: str, predicate: str, extra: str, words: str, anti: str) -> str:
    return f"""
SELECT d.world_id, '{check}' AS check_name, 'critical' AS severity, e.name || ' is {words[0]} at ' || s.story_position || ' after {words[1]} at ' || d.lo AS explanation,
       s.scene_id, d.assertion_id AS assertion_a, CAST(NULL AS BIGINT) AS assertion_b
FROM a d JOIN entities e ON e.world_id = d.world_id AND e.entity_id = d.subject_id {extra}
JOIN presence p ON p.world_id = d.world_id AND p.entity_id = d.subject_id JOIN scenes s ON s.world_id = d.world_id AND s.scene_id = p.scene_id
WHERE d.predicate = '{predicate}' AND d.polarity AND d.status <> 'sealed' AND s.story_position > d.lo AND NOT s.is_flashback AND {off(check, 'd.world_id')} {anti}"""


ALIVE = """AND NOT EXISTS (SELECT 1 FROM a r WHERE r.world_id = d.world_id AND r.subject_id = d.subject_id AND r.predicate = 'alive' AND r.polarity AND r.status <> 'sealed'
 AND r.lo <= s.story_position AND (r.hi IS NULL OR s.story_position < r.hi) AND r.lo > d.lo)"""


def _unsourced(muted: str, gate: str) -> str:
    return f"""
kn AS (SELECT k.*, coalesce(k.lo, s.story_position) AS since FROM a k JOIN scenes s USING (world_id, scene_id) WHERE predicate = 'knows' AND object_value IS NOT NULL AND status NOT IN ({muted})),
pos AS (SELECT p.*, s.story_position FROM presence p JOIN scenes s USING (world_id, scene_id)),
meet AS (SELECT DISTINCT x.world_id, x.entity_id AS subject_id, k2.fact_key, x.story_position FROM kn k2 JOIN pos y ON y.world_id = k2.world_id AND y.entity_id = k2.subject_id
         AND (k2.lo IS NULL OR k2.lo <= y.story_position) AND (k2.hi IS NULL OR y.story_position < k2.hi) JOIN pos x ON x.world_id = y.world_id AND x.scene_id = y.scene_id AND x.entity_id <> y.entity_id),
late AS (SELECT * FROM kn WHERE since > (SELECT min(since) FROM kn k0 WHERE k0.world_id = kn.world_id AND k0.fact_key = kn.fact_key) {gate}),
uns AS (SELECT late.*, e.name FROM late JOIN entities e ON e.world_id = late.world_id AND e.entity_id = late.subject_id
        WHERE NOT EXISTS (SELECT 1 FROM meet m WHERE m.world_id = late.world_id AND m.subject_id = late.subject_id AND m.fact_key = late.fact_key AND m.story_position <= late.since))"""


_DEAD = _seen("dead_speaker", "dies", "", ("seen", "dying"), ALIVE)
_DESTROYED = _seen("destroyed_location_use", "destroyed", "AND e.kind IN ('location', 'object')", ("used", "its destruction"), "")
_CONFLICT = f"""
SELECT x.world_id, 'presence_conflict' AS check_name, 'critical' AS severity,
       e.name || ' is at ' || p.name || ' ' || {RANGE.format('x')} || ' and at ' || q.name || ' ' || {RANGE.format('y')} AS explanation,
       y.scene_id, x.assertion_id AS assertion_a, y.assertion_id AS assertion_b
FROM a x JOIN a y ON x.world_id = y.world_id AND x.subject_id = y.subject_id AND y.assertion_id > x.assertion_id
JOIN entities e ON e.world_id = x.world_id AND e.entity_id = x.subject_id JOIN entities p ON p.world_id = x.world_id AND p.entity_id = x.object_id
JOIN entities q ON q.world_id = x.world_id AND q.entity_id = y.object_id
WHERE x.predicate = 'located_at' AND y.predicate = 'located_at' AND x.status <> 'sealed' AND y.status <> 'sealed' AND x.object_id <> y.object_id
  AND x.lo IS NOT NULL AND y.lo IS NOT NULL AND {OVER} AND {off('presence_conflict', 'x.world_id')}"""
_PREMATURE = """
SELECT world_id, 'premature_knowledge' AS check_name, 'critical' AS severity, name || ' knows "' || object_value || '" at ' || since || ' without a source' AS explanation,
       scene_id, assertion_id AS assertion_a, CAST(NULL AS BIGINT) AS assertion_b FROM uns"""
_KN = _unsourced("'sealed'", f"AND {off('premature_knowledge', 'kn.world_id')}")
_FIRST = """
SELECT e.world_id, e.entity_id, e.name, min(x.assertion_id) AS aid FROM entities e JOIN a x ON x.world_id = e.world_id AND (x.subject_id = e.entity_id OR x.object_id = e.entity_id)
WHERE e.provisional AND x.status NOT IN ({}) GROUP BY 1, 2, 3"""
_DANGLING = f"""
SELECT f.world_id, 'dangling_reference' AS check_name, 'note' AS severity, f.name || ' is referred to but unresolved' AS explanation, x.scene_id, x.assertion_id AS assertion_a, CAST(NULL AS BIGINT) AS assertion_b
FROM ({_FIRST.format("'sealed'")}) f JOIN a x ON x.assertion_id = f.aid WHERE {off('dangling_reference', 'f.world_id')}"""
_SAID = "regexp_replace(lower(coalesce({0}.object_value, '') || ' ' || coalesce({0}.supporting_quote, '')), '[^a-z0-9 ]', '', 'g')"
_CAPABILITY = f"""
SELECT x.world_id, 'capability_violation' AS check_name, 'warning' AS severity, e.name || ' cannot "' || x.object_value || '" ' || {RANGE.format('x')} || ' but: ' || y.supporting_quote AS explanation,
       y.scene_id, x.assertion_id AS assertion_a, y.assertion_id AS assertion_b
FROM a x JOIN a y ON x.world_id = y.world_id AND x.subject_id = y.subject_id AND x.assertion_id <> y.assertion_id JOIN entities e ON e.world_id = x.world_id AND e.entity_id = x.subject_id
WHERE x.predicate = 'cannot' AND x.polarity AND x.object_value IS NOT NULL AND x.status <> 'sealed' AND y.status <> 'sealed' AND {OVER} AND {off('capability_violation', 'x.world_id')}
  AND ((y.polarity AND y.predicate <> 'cannot' AND contains({_SAID.format('y')}, x.fact_key)) OR (NOT y.polarity AND y.predicate = 'cannot' AND y.fact_key = x.fact_key))"""
_IDLE = f"""
SELECT x.world_id, 'idle_setup' AS check_name, 'note' AS severity, e.name || ' has an open thread: ' || x.object_value AS explanation, x.scene_id, x.assertion_id AS assertion_a, CAST(NULL AS BIGINT) AS assertion_b
FROM opened x JOIN entities e ON e.world_id = x.world_id AND e.entity_id = x.subject_id
WHERE {off('idle_setup', 'x.world_id')}
  AND x.assertion_id = (SELECT min(z.assertion_id) FROM opened z WHERE z.world_id = x.world_id AND z.subject_id = x.subject_id AND z.fact_key = x.fact_key)
  AND NOT EXISTS (SELECT 1 FROM lat l WHERE l.world_id = x.world_id AND l.at > x.at AND l.assertion_id <> x.assertion_id AND (
    (l.subject_id = x.subject_id AND l.fact_key = x.fact_key) OR (x.object_id IS NOT NULL AND (l.subject_id = x.object_id OR l.object_id = x.object_id))
    OR (l.object_value IS NOT NULL AND length(x.fact_key) >= 3 AND contains(l.said, x.fact_key))))
  AND NOT EXISTS (SELECT 1 FROM lat l JOIN als ON als.world_id = l.world_id AND (als.entity_id = l.subject_id OR als.entity_id = l.object_id)
    WHERE l.world_id = x.world_id AND l.at > x.at AND length(als.h) >= 3 AND contains(x.fact_key, als.h))"""
_IDLE_CTE = f"""
lat AS (SELECT a.*, s.story_position AS at, {_SAID.format('a')} AS said FROM a JOIN scenes s USING (world_id, scene_id) WHERE status <> 'sealed'),
opened AS (SELECT * FROM lat WHERE predicate IN ('promised', 'goal', 'secret_of') AND object_value IS NOT NULL AND hi IS NULL),
als AS (SELECT world_id, entity_id, regexp_replace(lower(alias), '[^a-z0-9 ]', '', 'g') AS h FROM aliases)"""
ALL_CHECKS = " UNION ALL ".join(f"SELECT {COLS} FROM ({q})" for q in (_DEAD, _CONFLICT, _PREMATURE, _DESTROYED, _DANGLING, _CAPABILITY, _IDLE))
FINDINGS_CTE = f"{_KN.strip()},\n{_IDLE_CTE.strip()},\nraw_findings AS ({ALL_CHECKS}),\nfindings AS (SELECT f.*, EXISTS (SELECT 1 FROM seals z WHERE z.world_id = f.world_id AND z.check_name = f.check_name AND z.assertion_a = f.assertion_a AND coalesce(z.assertion_b, 0) = coalesce(f.assertion_b, 0)) AS sealed FROM raw_findings f)"

_UNKNOWN = f"""
SELECT f.world_id, 'unknown_entity' AS category, 'Who or what is ' || f.name || '?' AS question, 'first at ' || s.story_position AS detail, x.scene_id, x.assertion_id
FROM ({_FIRST.format("'rejected', 'retconned'")}) f JOIN a x ON x.assertion_id = f.aid JOIN scenes s ON s.scene_id = x.scene_id"""
_THREAD = """
SELECT x.world_id, 'open_thread' AS category, 'Does ' || e.name || ' follow through on ' || coalesce(x.object_value, '') || '?' AS question, 'set up at ' || coalesce(CAST(x.lo AS VARCHAR), 'an open start') AS detail, x.scene_id, x.assertion_id
FROM a x JOIN scenes s USING (world_id, scene_id) JOIN entities e ON e.world_id = x.world_id AND e.entity_id = x.subject_id
WHERE x.predicate IN ('promised', 'goal', 'secret_of') AND x.hi IS NULL AND x.status NOT IN ('rejected', 'retconned')
  AND NOT EXISTS (SELECT 1 FROM a l JOIN scenes ls USING (world_id, scene_id) WHERE l.world_id = x.world_id AND l.subject_id = x.subject_id AND l.object_value = x.object_value AND l.assertion_id <> x.assertion_id AND ls.story_position > s.story_position)
  AND x.assertion_id = (SELECT min(z.assertion_id) FROM a z WHERE z.world_id = x.world_id AND z.subject_id = x.subject_id AND z.predicate IN ('promised', 'goal', 'secret_of') AND z.hi IS NULL AND z.status NOT IN ('rejected', 'retconned') AND z.fact_key = x.fact_key)"""
_UNSOURCED = "SELECT world_id, 'unsourced_knowledge' AS category, 'How does ' || name || ' know ' || object_value || '?' AS question, 'acted on at ' || since AS detail, scene_id, assertion_id FROM uns"
_BELIEF = """
SELECT x.world_id, 'unconfirmed_belief' AS category, e.name || ' believes ' || x.object_value || ': is it so?' AS question, 'held at ' || coalesce(x.lo, s.story_position) AS detail, x.scene_id, x.assertion_id
FROM a x JOIN scenes s USING (world_id, scene_id) JOIN entities e ON e.world_id = x.world_id AND e.entity_id = x.subject_id
WHERE x.predicate = 'believes' AND x.object_value IS NOT NULL AND x.status NOT IN ('rejected', 'retconned')
  AND NOT EXISTS (SELECT 1 FROM a k WHERE k.world_id = x.world_id AND k.predicate = 'knows' AND k.fact_key = x.fact_key AND k.status NOT IN ('rejected', 'retconned'))
  AND x.assertion_id = (SELECT min(z.assertion_id) FROM a z WHERE z.world_id = x.world_id AND z.subject_id = x.subject_id AND z.predicate = 'believes' AND z.status NOT IN ('rejected', 'retconned') AND z.fact_key = x.fact_key)"""
_KN_HOLES = _unsourced("'rejected', 'retconned'", "")
LABELS = "labels_ AS (SELECT s.*, title, row_number() OVER (PARTITION BY s.world_id, s.work_id ORDER BY story_position) AS ordinal, string_split(title, ' ')[1] || '/sc' || row_number() OVER (PARTITION BY s.world_id, s.work_id ORDER BY story_position) AS label FROM scenes s JOIN works USING (world_id, work_id))"
_REPORT = f"""
{_KN_HOLES.strip()}, {LABELS},
gaps AS ({" UNION ALL ".join(f"SELECT world_id, category, question, detail, scene_id, assertion_id FROM ({q})" for q in (_UNKNOWN, _THREAD, _UNSOURCED, _BELIEF))})
SELECT g.*, l.label, CAST(list_position(['unknown_entity', 'open_thread', 'unsourced_knowledge', 'unconfirmed_belief'], category) AS INT) AS category_rank
FROM gaps g LEFT JOIN labels_ l ON l.world_id = g.world_id AND l.scene_id = g.scene_id"""

QUERIES = {
    "check_dead_speaker": lambda s, d: checks.dead_speaker(derive(s, d)),
    "check_presence_conflict": lambda s, d: checks.presence_conflict(derive(s, d)),
    "check_presence_conflict_binned": lambda s, d: checks.presence_conflict(stored.derived(s, d), hot_rows=4),
    "check_premature_knowledge": lambda s, d: checks.premature_knowledge(derive(s, d)),
    "check_destroyed_use": lambda s, d: checks.destroyed_location_use(derive(s, d)),
    "check_dangling_reference": lambda s, d: checks.dangling_reference(derive(s, d)),
    "check_capability_violation": lambda s, d: checks.capability_violation(derive(s, d)),
    "check_idle_setup": lambda s, d: checks.idle_setup(stored.derived(s, d)),
    "run_checks": lambda s, d: checks.all_findings(stored.derived(s, d)),
    "severity_summary": lambda s, d: checks.all_findings(stored.derived(s, d)).groupBy("world_id", "severity").agg(F.count_if(~F.col("sealed")).alias("live"), F.count_if("sealed").alias("sealed")),
    "hole_unknown_entity": lambda s, d: holes.unknown_entity(derive(s, d)),
    "hole_open_thread": lambda s, d: holes.open_thread(derive(s, d)),
    "hole_unsourced_knowledge": lambda s, d: holes.unsourced_knowledge(derive(s, d)),
    "hole_unconfirmed_belief": lambda s, d: holes.unconfirmed_belief(derive(s, d)),
    "holes_report": lambda s, d: holes.holes_report(stored.derived(s, d)),
    "scene_labels": lambda s, d: holes.scene_labels(derive(s, d)),
}

ORACLES = {
    "check_dead_speaker": over_graph("one AS (SELECT 1)" + _DEAD),
    "check_presence_conflict": over_graph("one AS (SELECT 1)" + _CONFLICT),
    "check_presence_conflict_binned": over_graph("one AS (SELECT 1)" + _CONFLICT),
    "check_premature_knowledge": over_graph(_KN + _PREMATURE),
    "check_destroyed_use": over_graph("one AS (SELECT 1)" + _DESTROYED),
    "check_dangling_reference": over_graph("one AS (SELECT 1)" + _DANGLING),
    "check_capability_violation": over_graph("one AS (SELECT 1)" + _CAPABILITY),
    "check_idle_setup": over_graph(_IDLE_CTE + _IDLE),
    "run_checks": over_graph(FINDINGS_CTE + " SELECT * FROM findings"),
    "severity_summary": over_graph(FINDINGS_CTE + " SELECT world_id, severity, count(*) FILTER (NOT sealed) AS live, count(*) FILTER (sealed) AS sealed FROM findings GROUP BY 1, 2"),
    "hole_unknown_entity": over_graph("one AS (SELECT 1)" + _UNKNOWN),
    "hole_open_thread": over_graph("one AS (SELECT 1)" + _THREAD),
    "hole_unsourced_knowledge": over_graph(_KN_HOLES + " " + _UNSOURCED),
    "hole_unconfirmed_belief": over_graph("one AS (SELECT 1)" + _BELIEF),
    "holes_report": over_graph(_REPORT),
    "scene_labels": over_graph(LABELS + " SELECT world_id, work_id, scene_id, story_position, slug, title, CAST(ordinal AS INT) AS ordinal, label FROM labels_"),
}
