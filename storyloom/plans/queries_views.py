"""Registered queries on projections, counts, rules and proposed changes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import checks, ripple, rules, views
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import COLS, FINDINGS_CTE, LABELS, OVER
from storyloom.sources import stored
from storyloom.sources.graph import Graph, derive

ONE = "one AS (SELECT 1)"
_RANGE = "CASE WHEN coalesce(lo >= hi, false) THEN 'empty' ELSE (CASE WHEN lo IS NULL THEN '(' ELSE '[' || lo END || ',' || coalesce(CAST(hi AS VARCHAR), '') || ')') END"
_GLOSS = """CASE WHEN lo IS NULL AND hi IS NULL THEN 'all positions' WHEN hi IS NULL THEN 'pos ' || lo || ' onward' WHEN lo IS NULL THEN 'through pos ' || (hi - 1)
 WHEN lo = hi - 1 THEN 'pos ' || lo ELSE 'pos ' || lo || '–' || (hi - 1) END"""
NS = "regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g')"


def rule_table(spark: SparkSession) -> DataFrame:
    """A few rules of every kind over the derived worlds, some faulty."""
    rows = [
        ("r1", 0, "cannot", "knows", 5, None, None, None, None, None, None, "warning", "five knows nothing", False), ("r2", 1, "cannot", "located_at", None, "Fact 3!", None, None, None, None, None, "critical", None, False),
        ("r3", 2, "only", "promised", None, None, 3, None, None, None, None, "note", None, False), ("r4", 0, "exception", None, None, None, 1, None, "dead_speaker", None, None, None, None, False),
        ("r5", 1, "exception", None, None, None, 2, None, "presence_conflict", 10, 60, None, None, False), ("r6", 3, "cannot", "fly", 4, None, None, None, None, None, None, "warning", None, False),
        ("r7", 3, "only", "goal", None, None, 999999, None, None, None, None, "warning", None, False), ("r8", 0, "exception", None, None, None, 1, None, "dead_speaker", 9, 2, None, None, False), ("r9", 0, "cannot", "goal", 9, None, None, None, None, None, None, "warning", None, True),
    ]
    return spark.createDataFrame(rows, "rule_id string, world_id long, kind string, predicate string, subject_entity_id long, subject_trait string, entity_id long, object_entity_id long, check_name string, pos_from int, pos_to int, severity string, label string, disabled boolean")


def change_table(g: Graph) -> DataFrame:
    """A change for every assertion and a cut of every character."""
    a = g.assertions.select(
        F.concat(F.lit("c"), F.col("assertion_id").cast("string")).alias("change_id"), "world_id", F.when(F.col("assertion_id") % 3 == 0, "remove").otherwise("move").alias("type"), "assertion_id",
        F.greatest(F.lit(1), F.coalesce(F.col("lo"), F.lit(40)) - 5 + (F.col("assertion_id") % 11).cast("int")).alias("to_position"), F.lit(None).cast("long").alias("entity_id"),
    )
    e = g.entities.filter("kind = 'character'").select(F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("change_id"), "world_id", F.lit("cut").alias("type"), F.lit(None).cast("long").alias("assertion_id"), F.lit(None).cast("int").alias("to_position"), "entity_id")
    return a.unionByName(e)


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _ruled(fn):
    return lambda s, d: fn(stored.derived(s, d), rule_table(s))


def _changed(fn):
    def run(s, d):
        g = stored.derived(s, d)
        return fn(g, change_table(g))

    return run


def _refs(g: Graph) -> DataFrame:
    names = g.entities.select("world_id", F.col("name").alias("ref")).union(g.aliases.select("world_id", F.col("alias").alias("ref"))).union(g.entities.select("world_id", F.concat("name", F.lit("?!x")).alias("ref")))
    return names.distinct()


def _positions(g: Graph) -> DataFrame:
    return g.works.select("world_id").distinct().select("world_id", F.explode(F.array(*[F.lit(x) for x in ("17", "E101/sc3", "e105", "1.03", "2.01", "nowhere", "E999/sc1")])).alias("ref"))


def text_functions(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        "doc_id", F.md5(text.norm_strip("text")).alias("stripped"), F.md5(text.norm_collapse("text")).alias("collapsed"),
        F.md5(F.array_join(F.sort_array(text.tokens("text")), " ")).alias("tokens"), F.length(text.quote_norm("text")).alias("quote_chars"),
        F.md5(text.slugify("text")).alias("slug"), F.ceil(F.size(F.split("text", "\n")) / 55).cast("long").alias("pages"),
    )


STOPPED = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

QUERIES = {
    "assertion_enriched": _with(lambda g: views.enrich(g).select("world_id", "assertion_id", "subject", "object", "label", "title", "nested_value", "lo_open", "hi_open", "range", "gloss", views.phrase().alias("phrase"))),
    "family_toggle": lambda s, d: views.family_on(derive(s, d), ("dead_speaker", "presence_conflict", "destroyed_location_use", "F2")),
    "assertion_search": _with(lambda g: views.assertion_search(g, "fact 1", ("knows", "goal")).select("world_id", "assertion_id", "place", "total", "truncated")),
    "entity_search": _with(lambda g: views.entity_search(g, "fact 1").select("world_id", "entity_id", "name", "aliases", "as_subject", "as_object")),
    "true_at": _with(lambda g: views.true_at(g, g.works.select("world_id").distinct().withColumn("at", F.lit(17))).select("world_id", "assertion_id", "at")),
    "open_intervals": _with(lambda g: views.still_open(g).select("world_id", "assertion_id")),
    "entity_ref_resolve": _with(lambda g: views.resolve_names(g, _refs(g))),
    "position_ref_resolve": _with(lambda g: views.resolve_positions(g, _positions(g))),
    "draft_queue": _with(views.draft_queue),
    "world_summary": _with(views.world_summary),
    "world_list": _with(views.world_list),
    "scene_density": _with(views.scene_density),
    "load_bearing": _with(views.load_bearing),
    "corpus_stats": _with(views.corpus_stats),
    "alias_array": _with(views.alias_array),
    "singletons": _with(views.singletons),
    "age_threshold": _with(views.age_threshold),
    "interval_close": _with(views.interval_close),
    "first_last_appearance": _with(views.first_last_appearance),
    "rolling_synopsis": _with(lambda g: views.rolling_synopsis(g).withColumn("synopsis", F.md5("synopsis"))),
    "entity_profile": _with(views.entity_profile),
    "findings_diff": _with(lambda g: views.findings_diff(checks.dead_speaker(g), checks.dead_speaker(g.with_(assertions=g.assertions.filter("assertion_id % 4 <> 0"))))),
    "text_functions": text_functions,
    "rule_cannot": _ruled(rules.cannot),
    "rule_only": _ruled(rules.only),
    "rule_exception": _ruled(lambda g, r: rules.without_exceptions(g, checks.all_findings(g), r)),
    "compose_findings": _ruled(rules.compose),
    "ripple_proposed": _changed(lambda g, c: ripple.proposed(g, c).select("change_id", "world_id", "status", "lo", "hi")),
    "related_assertions": _changed(ripple.related),
    "ripple_cut_entity": _changed(ripple.cut_entity),
    "epistemic_overlap": _changed(ripple.epistemic_overlap),
    "predicted_findings": _changed(ripple.predicted),
    "ripple_summary": _changed(ripple.summary),
}

_ENRICHED = f"""{LABELS}
SELECT a.world_id, a.assertion_id, s.name AS subject, o.name AS object, l.label, l.title, n.object_value AS nested_value, a.lo IS NULL AS lo_open, a.hi IS NULL AS hi_open,
       {_RANGE.replace('lo', 'a.lo').replace('hi ', 'a.hi ').replace('hi)', 'a.hi)').replace('(hi', '(a.hi').replace('a.a.', 'a.').replace('>= hi', '>= a.hi')} AS range, {_GLOSS.replace('lo ', 'a.lo ').replace('hi ', 'a.hi ')} AS gloss,
       trim(s.name || CASE WHEN a.polarity THEN '' ELSE ' not' END || ' ' || a.predicate || ' ' || coalesce(o.name, a.object_value, n.object_value, '')) AS phrase
FROM a JOIN entities s ON s.world_id = a.world_id AND s.entity_id = a.subject_id JOIN labels_ l ON l.world_id = a.world_id AND l.scene_id = a.scene_id
LEFT JOIN entities o ON o.world_id = a.world_id AND o.entity_id = a.object_id LEFT JOIN a n ON n.world_id = a.world_id AND n.assertion_id = a.object_assertion_id"""
_RULES = """rules AS (SELECT * FROM (VALUES ('r1', 0, 'cannot', 'knows', 5, NULL, NULL, 'warning', 'five knows nothing'), ('r2', 1, 'cannot', 'located_at', NULL, 'Fact 3!', NULL, 'critical', NULL),
 ('r3', 2, 'only', 'promised', NULL, NULL, 3, 'note', NULL)) t(rule_id, world_id, kind, predicate, subject_entity_id, subject_trait, entity_id, severity, label)),
acts AS (SELECT * FROM a WHERE polarity AND status NOT IN ('sealed', 'rejected', 'retconned')),
ruled AS (
 SELECT x.world_id, 'rule:' || r.rule_id AS check_name, r.severity, e.name || ' ' || x.predicate || ' against rule ' || coalesce(r.label, r.rule_id) AS explanation, x.scene_id, x.assertion_id AS assertion_a, CAST(NULL AS BIGINT) AS assertion_b, r.kind
 FROM acts x JOIN rules r ON r.world_id = x.world_id AND r.predicate = x.predicate JOIN entities e ON e.world_id = x.world_id AND e.entity_id = x.subject_id
 WHERE (r.kind = 'cannot' AND (x.subject_id = r.subject_entity_id OR x.subject_id IN (SELECT t.subject_id FROM acts t WHERE t.world_id = x.world_id AND t.predicate = 'trait' AND t.object_value = r.subject_trait)))
    OR (r.kind = 'only' AND x.subject_id <> r.entity_id AND EXISTS (SELECT 1 FROM entities h WHERE h.world_id = r.world_id AND h.entity_id = r.entity_id)))"""
_EXCEPT = """SELECT f.* FROM {0} f LEFT JOIN a x ON x.world_id = f.world_id AND x.assertion_id = f.assertion_a LEFT JOIN scenes s ON s.scene_id = f.scene_id
WHERE NOT coalesce((f.world_id = 0 AND f.check_name = 'dead_speaker' AND x.subject_id = 1) OR (f.world_id = 1 AND f.check_name = 'presence_conflict' AND x.subject_id = 2 AND s.story_position BETWEEN 10 AND 60), false)"""
_CHANGES = """changes AS (
 SELECT 'c' || assertion_id AS change_id, world_id, CASE WHEN assertion_id % 3 = 0 THEN 'remove' ELSE 'move' END AS type, assertion_id, greatest(1, coalesce(lo, 40) - 5 + CAST(assertion_id % 11 AS INT)) AS to_position, CAST(NULL AS BIGINT) AS entity_id FROM a WHERE true
 UNION ALL SELECT 'e' || entity_id, world_id, 'cut', NULL, NULL, entity_id FROM entities WHERE kind = 'character'),
prop AS (SELECT c.change_id, c.world_id, c.type, c.assertion_id, x.subject_id, x.object_id, x.predicate, x.fact_key, CASE WHEN type = 'move' THEN to_position ELSE x.lo END AS lo, x.hi,
 CASE WHEN type = 'move' AND to_position > x.hi THEN 'invalid_range' WHEN type = 'move' AND to_position = x.hi THEN 'empty' ELSE 'ok' END AS status FROM changes c JOIN a x ON x.world_id = c.world_id AND x.assertion_id = c.assertion_id),
act2 AS (SELECT * FROM a WHERE status NOT IN ('sealed', 'retconned')),
related AS (SELECT DISTINCT x.change_id, x.world_id, y.assertion_id, y.scene_id FROM prop x JOIN act2 y ON y.world_id = x.world_id AND y.assertion_id <> x.assertion_id AND __OVER__
 WHERE x.status = 'ok' AND (y.subject_id IN (x.subject_id, x.object_id) OR y.object_id IN (x.subject_id, x.object_id) OR y.object_assertion_id = x.assertion_id)),
cut AS (
 SELECT c.change_id, c.world_id, 'assertion' AS kind, y.assertion_id AS id FROM changes c JOIN act2 y ON y.world_id = c.world_id AND (y.subject_id = c.entity_id OR y.object_id = c.entity_id) WHERE type = 'cut'
 UNION SELECT c.change_id, c.world_id, 'assertion', y.assertion_id FROM changes c JOIN aliases l ON l.world_id = c.world_id AND l.entity_id = c.entity_id
  JOIN act2 y ON y.world_id = c.world_id AND length(__NA__) >= 3 AND contains(__NS__, __NA__) WHERE type = 'cut'
 UNION SELECT c.change_id, c.world_id, 'scene', p.scene_id FROM changes c JOIN presence p ON p.world_id = c.world_id AND p.entity_id = c.entity_id WHERE type = 'cut'),
epi AS (SELECT x.change_id, x.world_id, y.assertion_id, y.predicate FROM prop x JOIN act2 y ON y.world_id = x.world_id AND y.fact_key = x.fact_key AND y.assertion_id <> x.assertion_id AND __OVER__
 WHERE x.status = 'ok' AND x.predicate IN ('knows', 'believes') AND y.predicate IN ('knows', 'believes')),
pred_use AS (SELECT x.change_id, x.world_id, CASE WHEN x.predicate = 'dies' THEN 'dead_speaker' ELSE 'destroyed_location_use' END AS check_name, x.assertion_id, s.scene_id
 FROM prop x JOIN presence p ON p.world_id = x.world_id AND p.entity_id = x.subject_id JOIN scenes s ON s.world_id = x.world_id AND s.scene_id = p.scene_id
 WHERE x.status = 'ok' AND x.type = 'move' AND x.predicate IN ('dies', 'destroyed') AND s.story_position > x.lo AND NOT s.is_flashback
 AND NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = x.world_id AND NOT c.enabled AND c.family = CASE WHEN x.predicate = 'dies' THEN 'dead_speaker' ELSE 'destroyed_location_use' END)
 AND NOT (x.predicate = 'dies' AND EXISTS (SELECT 1 FROM a r WHERE r.world_id = x.world_id AND r.subject_id = x.subject_id AND r.predicate = 'alive' AND r.polarity AND r.status <> 'sealed' AND r.lo > x.lo AND r.lo <= s.story_position AND (r.hi IS NULL OR s.story_position < r.hi)))),
pred_place AS (SELECT x.change_id, x.world_id, 'presence_conflict' AS check_name, x.assertion_id, y.scene_id FROM prop x JOIN act2 y ON y.world_id = x.world_id AND y.subject_id = x.subject_id AND y.assertion_id <> x.assertion_id AND __OVER__
 WHERE x.status = 'ok' AND NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = x.world_id AND NOT c.enabled AND c.family = 'presence_conflict') AND x.predicate = 'located_at' AND y.predicate = 'located_at' AND x.object_id <> y.object_id),
pred_act AS (SELECT x.change_id, x.world_id, 'capability_violation' AS check_name, x.assertion_id, y.scene_id FROM prop x JOIN act2 y ON y.world_id = x.world_id AND y.subject_id = x.subject_id AND y.assertion_id <> x.assertion_id AND __OVER__
 WHERE x.status = 'ok' AND NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = x.world_id AND NOT c.enabled AND c.family = 'capability_violation') AND x.predicate = 'cannot' AND x.fact_key IS NOT NULL
  AND (SELECT polarity FROM a z WHERE z.world_id = x.world_id AND z.assertion_id = x.assertion_id)
  AND ((y.polarity AND y.predicate <> 'cannot' AND contains(__NS__, x.fact_key)) OR (NOT y.polarity AND y.predicate = 'cannot' AND y.fact_key = x.fact_key))),
pred AS (SELECT * FROM pred_use UNION ALL SELECT * FROM pred_place UNION ALL SELECT * FROM pred_act)
""".replace("__OVER__", OVER).replace("__NA__", NS.format("l.alias")).replace("__NS__", NS.format("coalesce(y.object_value, '') || ' ' || coalesce(y.supporting_quote, '')"))
_ENDS = "ends AS (SELECT world_id, subject_id AS entity_id, scene_id FROM a UNION ALL SELECT world_id, object_id, scene_id FROM a WHERE object_id IS NOT NULL)"
_ALIASES = "al AS (SELECT e.world_id, e.entity_id, e.name, coalesce(string_agg(l.alias, '|' ORDER BY l.alias), '') AS aliases FROM entities e LEFT JOIN aliases l USING (world_id, entity_id) GROUP BY 1, 2, 3)"

ORACLES = {
    "assertion_enriched": over_graph(_ENRICHED),
    "family_toggle": over_graph(ONE + " SELECT world_id, family FROM (SELECT DISTINCT world_id FROM works) CROSS JOIN (SELECT unnest(['dead_speaker', 'presence_conflict', 'destroyed_location_use', 'F2']) AS family) f WHERE NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = works.world_id AND c.family = f.family AND NOT c.enabled)").replace("(SELECT DISTINCT world_id FROM works) CROSS", "(SELECT DISTINCT world_id FROM works) works CROSS"),
    "assertion_search": over_graph(ONE + " SELECT world_id, assertion_id, CAST(place AS INT) AS place, total, total > 50 AS truncated FROM (SELECT world_id, assertion_id, count(*) OVER (PARTITION BY world_id) AS total, row_number() OVER (PARTITION BY world_id ORDER BY lo NULLS LAST, assertion_id) AS place FROM a WHERE (object_value ILIKE '%fact 1%' OR supporting_quote ILIKE '%fact 1%') AND predicate IN ('knows', 'goal')) WHERE place <= 50"),
    "entity_search": over_graph(ONE + " SELECT world_id, entity_id, name, (SELECT count(*) FROM aliases l WHERE l.world_id = e.world_id AND l.entity_id = e.entity_id) AS aliases, (SELECT count(*) FROM a WHERE a.world_id = e.world_id AND a.subject_id = e.entity_id) AS as_subject, (SELECT count(*) FROM a WHERE a.world_id = e.world_id AND a.object_id = e.entity_id) AS as_object FROM entities e WHERE name ILIKE '%fact 1%' OR EXISTS (SELECT 1 FROM aliases l WHERE l.world_id = e.world_id AND l.entity_id = e.entity_id AND l.alias ILIKE '%fact 1%')"),
    "true_at": over_graph(ONE + " SELECT world_id, assertion_id, 17 AS at FROM a WHERE (lo IS NULL OR lo <= 17) AND (hi IS NULL OR 17 < hi) AND status NOT IN ('rejected', 'retconned')"),
    "open_intervals": over_graph(ONE + " SELECT world_id, assertion_id FROM a WHERE hi IS NULL AND status NOT IN ('rejected', 'retconned')"),
    "entity_ref_resolve": over_graph(f"refs AS (SELECT world_id, name AS ref FROM entities UNION SELECT world_id, alias FROM aliases UNION SELECT world_id, name || '?!x' FROM entities), keys AS (SELECT world_id, entity_id, {NS.format('name')} AS k FROM entities UNION SELECT world_id, entity_id, {NS.format('alias')} FROM aliases) SELECT r.world_id, ref, CASE count(DISTINCT entity_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(entity_id) END AS entity_id FROM refs r LEFT JOIN keys ON keys.world_id = r.world_id AND keys.k = {NS.format('r.ref')} GROUP BY 1, 2"),
    "position_ref_resolve": over_graph(f"{LABELS}, nth AS (SELECT world_id, work_id, dense_rank() OVER (PARTITION BY world_id ORDER BY sort_order) AS n FROM works), refs AS (SELECT DISTINCT world_id, unnest(['17', 'E101/sc3', 'e105', '1.03', '2.01', 'nowhere', 'E999/sc1']) AS ref FROM works) SELECT r.world_id, r.ref, coalesce(TRY_CAST(CASE WHEN regexp_full_match(r.ref, '[0-9]+') THEN r.ref END AS INT), (SELECT min(story_position) FROM labels_ l WHERE l.world_id = r.world_id AND lower(l.label) = lower(r.ref)), (SELECT min(story_position) FROM labels_ l JOIN nth USING (world_id, work_id) WHERE l.world_id = r.world_id AND n || '.' || lpad(CAST(ordinal AS VARCHAR), 2, '0') = r.ref), (SELECT min(story_position) FROM labels_ l WHERE l.world_id = r.world_id AND lower(string_split(title, ' ')[1]) = lower(r.ref))) AS position FROM refs r"),
    "draft_queue": over_graph(ONE + " SELECT world_id, assertion_id, confidence, CAST(place AS INT) AS place, total, total > 20 AS truncated FROM (SELECT world_id, assertion_id, confidence, row_number() OVER (PARTITION BY world_id ORDER BY confidence DESC, assertion_id) AS place, count(*) OVER (PARTITION BY world_id) AS total FROM a WHERE status = 'draft') WHERE place <= 20"),
    "world_summary": over_graph(ONE + " SELECT world_id, 'kind' AS dimension, kind AS value, count(*) AS n FROM entities GROUP BY 1, 3 UNION ALL SELECT world_id, 'provisional', kind, count(*) FROM entities WHERE provisional GROUP BY 1, 3 UNION ALL SELECT world_id, 'status', status, count(*) FROM a GROUP BY 1, 3 UNION ALL SELECT world_id, 'predicate', predicate, count(*) FROM a GROUP BY 1, 3 UNION ALL SELECT world_id, 'size', 'scenes', count(*) FROM scenes GROUP BY 1 UNION ALL SELECT world_id, 'size', 'works', count(*) FROM works GROUP BY 1 UNION ALL SELECT world_id, 'size', 'presence', count(*) FROM presence GROUP BY 1"),
    "world_list": over_graph(ONE + " SELECT world_id, count(*) AS works, (SELECT count(*) FROM scenes s WHERE s.world_id = w.world_id) AS scenes, (SELECT count(*) FROM entities s WHERE s.world_id = w.world_id) AS entities, (SELECT count(*) FROM a s WHERE s.world_id = w.world_id) AS assertions FROM works w GROUP BY 1"),
    "scene_density": over_graph(ONE + " SELECT world_id, scene_id, story_position, (SELECT count(*) FROM presence p WHERE p.world_id = s.world_id AND p.scene_id = s.scene_id) AS present, (SELECT count(*) FROM a p WHERE p.world_id = s.world_id AND p.scene_id = s.scene_id) AS asserted FROM scenes s"),
    "load_bearing": over_graph(f"{_ENDS} SELECT world_id, entity_id, degree, scenes, name, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY world_id ORDER BY degree DESC, name, entity_id) AS place FROM (SELECT x.world_id, x.entity_id, e.name, count(*) AS degree, count(DISTINCT scene_id) AS scenes FROM ends x JOIN entities e USING (world_id, entity_id) GROUP BY 1, 2, 3)) WHERE place <= 10"),
    "corpus_stats": over_graph(f"{LABELS} SELECT world_id, min(story_position) AS first_position, max(story_position) AS last_position, arg_min(label, story_position) AS first_label, arg_max(label, story_position) AS last_label, count(*) AS scenes, (SELECT count(*) FROM works s WHERE s.world_id = l.world_id) AS works, (SELECT count(*) FROM entities s WHERE s.world_id = l.world_id) AS entities, (SELECT count(*) FROM a s WHERE s.world_id = l.world_id) AS assertions FROM labels_ l GROUP BY 1"),
    "alias_array": over_graph(f"{_ALIASES} SELECT * FROM al"),
    "singletons": over_graph(ONE + " SELECT world_id, assertion_id, subject_id, predicate FROM (SELECT *, count(*) OVER (PARTITION BY world_id, subject_id, predicate, object_id, fact_key) AS n FROM a) WHERE n = 1"),
    "age_threshold": over_graph(ONE + " SELECT world_id, CAST(greatest(15, max(n)) AS INT) AS threshold FROM (SELECT s.world_id, title, count(*) AS n FROM scenes s JOIN works w ON w.work_id = s.work_id GROUP BY 1, 2) GROUP BY 1"),
    "interval_close": over_graph(ONE + ", h AS (SELECT * FROM a WHERE predicate = 'located_at' AND lo IS NOT NULL AND status NOT IN ('rejected', 'retconned')) SELECT world_id, subject_id, assertion_id, object_id, lo, hi, coalesce(hi, (SELECT min(n.lo) FROM h n WHERE n.world_id = h.world_id AND n.subject_id = h.subject_id AND n.lo > h.lo)) AS closed_hi, CAST(row_number() OVER (PARTITION BY world_id, subject_id ORDER BY lo, assertion_id) AS INT) AS ordinal FROM h"),
    "first_last_appearance": over_graph(ONE + ", p AS (SELECT world_id, entity_id, arg_min(scene_id, story_position) AS f, arg_max(scene_id, story_position) AS l FROM presence JOIN scenes USING (world_id, scene_id) GROUP BY 1, 2), q AS (SELECT a.world_id, subject_id AS entity_id, arg_min(scene_id, story_position) AS f, arg_max(scene_id, story_position) AS l FROM a JOIN scenes USING (world_id, scene_id) GROUP BY 1, 2) SELECT e.world_id, e.entity_id, coalesce(p.f, q.f) AS first_scene, coalesce(p.l, q.l) AS last_scene FROM entities e LEFT JOIN p USING (world_id, entity_id) LEFT JOIN q USING (world_id, entity_id)"),
    "rolling_synopsis": over_graph(ONE + ", f AS (SELECT *, row_number() OVER (PARTITION BY world_id, scene_id ORDER BY assertion_id) AS place FROM a), dg AS (SELECT world_id, scene_id, string_agg(subject_id || ' ' || predicate || ' ' || coalesce(object_value, CAST(object_id AS VARCHAR), ''), '; ' ORDER BY place) AS digest FROM f WHERE place <= 12 GROUP BY 1, 2) SELECT world_id, scene_id, story_position, md5(coalesce(string_agg(coalesce(digest, ''), ' / ') OVER (PARTITION BY world_id ORDER BY story_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS synopsis FROM scenes LEFT JOIN dg USING (world_id, scene_id)"),
    "entity_profile": over_graph(f"{_ALIASES} SELECT *, coalesce((SELECT string_agg(CAST(assertion_id AS VARCHAR), ',' ORDER BY assertion_id) FROM a WHERE a.world_id = al.world_id AND a.subject_id = al.entity_id), '') AS as_subject, coalesce((SELECT string_agg(CAST(assertion_id AS VARCHAR), ',' ORDER BY assertion_id) FROM a WHERE a.world_id = al.world_id AND a.object_id = al.entity_id), '') AS as_object FROM al"),
    "findings_diff": None,
    "text_functions": rf"""WITH n AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS stripped, md5(c) AS collapsed,
 md5(array_to_string(list_sort(list_filter(list_distinct(string_split(c, ' ')), lambda w: w NOT IN ('', {STOPPED}))), ' ')) AS tokens,
 CAST(length(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '\s+', ' ', 'g')))) AS INT) AS quote_chars,
 md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, CAST(ceil(len(string_split(text, chr(10))) / 55.0) AS BIGINT) AS pages FROM n""",
    "rule_cannot": over_graph(f"{_RULES} SELECT {COLS} FROM ruled WHERE kind = 'cannot'"),
    "rule_only": over_graph(f"{_RULES} SELECT {COLS} FROM ruled WHERE kind = 'only'"),
    "rule_exception": over_graph(FINDINGS_CTE + " " + _EXCEPT.format("findings")),
    "compose_findings": over_graph(FINDINGS_CTE + f", {_RULES}, both_ AS (SELECT {COLS}, sealed FROM findings UNION ALL SELECT {COLS}, false FROM ruled) " + _EXCEPT.format("both_")),
    "ripple_proposed": over_graph(_CHANGES + " SELECT change_id, world_id, status, lo, hi FROM prop"),
    "related_assertions": over_graph(_CHANGES + " SELECT * FROM related"),
    "ripple_cut_entity": over_graph(_CHANGES + " SELECT * FROM cut"),
    "epistemic_overlap": over_graph(_CHANGES + " SELECT * FROM epi"),
    "predicted_findings": over_graph(_CHANGES + " SELECT * FROM pred"),
    "ripple_summary": over_graph(_CHANGES + " SELECT change_id, world_id, type, (SELECT count(*) FROM related r WHERE r.change_id = c.change_id) AS related, (SELECT count(*) FROM cut r WHERE r.change_id = c.change_id AND kind = 'assertion') AS cut_assertions, (SELECT count(*) FROM cut r WHERE r.change_id = c.change_id AND kind = 'scene') AS cut_scenes, (SELECT count(*) FROM epi r WHERE r.change_id = c.change_id) AS epistemic, (SELECT count(*) FROM pred r WHERE r.change_id = c.change_id) AS predicted FROM changes c"),
}
_DEAD_OF = """dead_{0} AS (SELECT DISTINCT d.world_id, 'dead_speaker' AS check_name, e.name || ' is seen at ' || s.story_position || ' after dying at ' || d.lo AS explanation
FROM a{1} d JOIN entities e ON e.world_id = d.world_id AND e.entity_id = d.subject_id JOIN presence p ON p.world_id = d.world_id AND p.entity_id = d.subject_id JOIN scenes s ON s.world_id = d.world_id AND s.scene_id = p.scene_id
WHERE d.predicate = 'dies' AND d.polarity AND d.status <> 'sealed' AND s.story_position > d.lo AND NOT s.is_flashback
AND NOT EXISTS (SELECT 1 FROM a{1} r WHERE r.world_id = d.world_id AND r.subject_id = d.subject_id AND r.predicate = 'alive' AND r.polarity AND r.status <> 'sealed' AND r.lo <= s.story_position AND (r.hi IS NULL OR s.story_position < r.hi) AND r.lo > d.lo))"""
ORACLES["findings_diff"] = over_graph("a2 AS (SELECT * FROM a WHERE assertion_id % 4 <> 0), " + _DEAD_OF.format("x", "") + ", " + _DEAD_OF.format("y", "2") + " SELECT *, 'added' AS change FROM (SELECT * FROM dead_y EXCEPT SELECT * FROM dead_x) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM dead_x EXCEPT SELECT * FROM dead_y)")
