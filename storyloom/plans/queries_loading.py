"""Registered queries on loading, look-ups, open questions and predicted effects, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import checks, lifecycle, loading, notes, ripple, views
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import COLS, FINDINGS_CTE
from storyloom.plans.queries_notes import _BASE, _NOT_HEARD, _NOTE, CONCERNS, IGNORE, open_questions_sql
from storyloom.plans.queries_views import _CHANGES, change_table
from storyloom.sources import stored, texts
from storyloom.sources.graph import Graph, derive

ONE = "one AS (SELECT 1)"
RELATIONS = (*notes.RELATIONS, "occupation")


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _stored(fn):
    return lambda s, d: fn(stored.derived(s, d))


def _extracted(g: Graph):
    """The facts as an extraction would give them: names as they stand in the text, flags for where a range begins and ends."""
    n = F.col("assertion_id")
    names = g.entities.select("world_id", F.col("entity_id").alias("subject_id"), F.col("name").alias("s_name"))
    things = g.entities.select("world_id", F.col("entity_id").alias("object_id"), F.col("name").alias("object_entity"))
    at = g.scenes.select("world_id", "scene_id", F.col("story_position").alias("position"))
    a = g.assertions.join(names, ["world_id", "subject_id"], "left").join(things, ["world_id", "object_id"], "left").join(at, ["world_id", "scene_id"])
    surface = F.when(n % 8 == 0, F.lit("Nobody Known")).when(n % 2 == 0, F.upper("s_name")).otherwise(F.regexp_replace("s_name", "^User ", "U"))
    return a.select(
        "world_id", n.alias("row_id"), "position", surface.alias("subject"), "predicate", "object_entity", F.when(n % 9 == 0, "").otherwise(F.col("object_value")).alias("object_value"), F.when(n % 9 == 0, F.lit("ref")).alias("object_fact_ref"),
        "polarity", (n % 6 != 0).alias("starts_here"), (n % 5 == 0).alias("ends_here"), F.col("supporting_quote").alias("quote"), "confidence",
    )


def _registry(g: Graph):
    norm = F.trim(text.norm_strip("surface"))
    e = g.entities.withColumn("entity", F.col("name"))
    u = e.select("world_id", F.col("name").alias("surface"), "entity_id", "entity", "kind", "provisional").unionByName(
        e.filter("kind = 'character'").select("world_id", F.regexp_replace("name", "^User ", "U").alias("surface"), "entity_id", "entity", "kind", "provisional")
    )
    return u.select("world_id", norm.alias("norm"), "entity_id", "entity", "kind", "provisional")


def _named(g: Graph):
    e = g.presence.join(g.entities.filter("kind = 'character'").select("world_id", "entity_id", "name"), ["world_id", "entity_id"]).join(g.scenes.select("world_id", "scene_id", F.col("story_position").alias("position")), ["world_id", "scene_id"])
    role = F.when(F.col("entity_id") % 10 == 0, "death").when(F.col("entity_id") % 10 == 1, "destruction").otherwise("presence")
    return e.select("world_id", "position", role.alias("role"), F.concat(F.lit(" "), "name").alias("surface"))


def _resolved(g: Graph):
    return loading.resolved(_extracted(g), _registry(g))


def _refs(g: Graph):
    n = F.col("assertion_id")
    by_id = g.assertions.select(F.concat(F.lit("i"), n).alias("ref_id"), "world_id", F.when(n % 7 == 0, -n).otherwise(n).alias("assertion_id"), "subject_id", "predicate", F.lit(None).cast("int").alias("at"))
    by_name = g.assertions.select(F.concat(F.lit("n"), n).alias("ref_id"), "world_id", F.lit(None).cast("long").alias("assertion_id"), "subject_id", "predicate", F.when(n % 3 != 0, (n % 100).cast("int")).alias("at"))
    return by_id.unionByName(by_name)


def _asked(g: Graph):
    n = F.col("assertion_id")
    return g.assertions.select("world_id", "scene_id", F.when(n % 10 == 0, " ").otherwise(F.concat(F.lit("What of "), F.coalesce("object_value", F.lit("this")), F.when(n % 2 == 0, F.lit("?")).otherwise(F.lit("")))).alias("question"), F.when(n % 3 == 0, F.col("supporting_quote")).alias("quote"))


def _cases(g: Graph):
    n = F.col("assertion_id")
    return g.assertions.select(F.col("world_id").alias("run_id"), n.alias("case_id"), F.when(n % 50 == 0, "trap").otherwise("error").alias("kind"), F.when(n % 50 == 0, (F.col("world_id") == 1) & (n % 100 == 0)).otherwise(F.col("world_id") + n % 7 > 1).alias("hit"))


def _touched(g: Graph):
    return change_table(g).filter("type <> 'cut'").join(g.assertions.select("world_id", "assertion_id", "scene_id"), ["world_id", "assertion_id"]).select("change_id", "world_id", "assertion_id", "scene_id")


QUERIES = {
    "mentions": _with(lambda g: loading.mentions(_extracted(g), _named(g))),
    "resolved_assertions": _with(lambda g: _resolved(g).select("world_id", "row_id", "subject", "object_entity", "object_value", "subject_provisional", "object_provisional")),
    "earliest_events": _with(lambda g: loading.earliest_events(_resolved(g).filter("subject_id is not null")).select("world_id", "row_id", "predicate")),
    "load_assertions": _with(lambda g: loading.load_assertions(_resolved(g), g.scenes).select("world_id", "assertion_id", "subject_id", "predicate", "object_id", "object_value", "lo", "hi", "scene_id", "confidence", "status", "mirrored")),
    "presence_from_slug": _with(lambda g: loading.presence_from_slug(g.scenes, g.entities)),
    "exclusion_violations": _with(lambda g: loading.exclusion_violations(g.assertions.filter("predicate = 'located_at'").select("world_id", "assertion_id", F.col("subject_id").alias("character_id"), "lo", "hi"))),
    "merge_snapshot": _with(lambda g: loading.merge(g.entities.filter("entity_id % 4 <> 0").select("world_id", "entity_id", "name", "kind"), g.entities.filter("entity_id % 3 <> 0").select("world_id", "entity_id", F.upper("name").alias("name"), F.lit("new").alias("kind")), ["world_id", "entity_id"], ["name"])),
    "distinct_values": _with(views.distinct_values),
    "assertion_lookup": _with(lambda g: views.assertion_lookup(g, _refs(g))),
    "fact_concerns": _with(lambda g: notes.fact_concerns(g, IGNORE)),
    "note_open_questions": _with(lambda g: notes.open_questions(g, IGNORE, RELATIONS)),
    "note_given_questions": _with(lambda g: notes.given_questions(g, _asked(g))),
    "note_drafts": _with(lambda g: notes.drafts(notes.idle_setups(g, IGNORE).unionByName(notes.open_questions(g, IGNORE, RELATIONS)), g)),
    "predicted_presence": _with(lambda g: ripple.predicted_presence(g, change_table(g))),
    "predicted_capability": _with(lambda g: ripple.predicted_capability(g, change_table(g))),
    "findings_touching": _stored(lambda g: ripple.touching(g, checks.all_findings(g), _touched(g))),
    "evaluate_runs": _with(lambda g: lifecycle.evaluate_runs(_cases(g), g.works.select(F.col("world_id").alias("run_id"), (F.col("work_id") % 3).alias("n")), 30)),
    "quote_offsets": _with(lambda g: g.assertions.join(g.scenes.select("world_id", "scene_id", "raw_text"), ["world_id", "scene_id"]).select("world_id", "assertion_id", text.quote_offset("raw_text", F.upper("supporting_quote")).cast("int").alias("offset"))),
    "role_references": lambda s, d: texts.role_references(s.read.parquet(f"{d}/documents.parquet")),
}

_X = """x AS (SELECT a.world_id, assertion_id AS row_id, s.story_position AS position, CASE WHEN assertion_id % 8 = 0 THEN 'Nobody Known' WHEN assertion_id % 2 = 0 THEN upper(e.name) ELSE regexp_replace(e.name, '^User ', 'U') END AS subject,
 predicate, o.name AS object_entity, CASE WHEN assertion_id % 9 = 0 THEN '' ELSE object_value END AS object_value, CASE WHEN assertion_id % 9 = 0 THEN 'ref' END AS object_fact_ref, polarity, assertion_id % 6 <> 0 AS starts_here, assertion_id % 5 = 0 AS ends_here, supporting_quote AS quote, confidence
 FROM a JOIN scenes s USING (world_id, scene_id) LEFT JOIN entities e ON e.world_id = a.world_id AND e.entity_id = a.subject_id LEFT JOIN entities o ON o.world_id = a.world_id AND o.entity_id = a.object_id),
reg AS (SELECT world_id, lower(name) AS norm, * EXCLUDE (world_id) FROM entities UNION ALL SELECT world_id, replace(lower(name), 'user ', 'u'), * EXCLUDE (world_id) FROM entities WHERE kind = 'character'),
r AS (SELECT x.*, coalesce(nullif(x.object_value, ''), object_fact_ref) AS val, e.entity_id AS subject_id, e.name AS s_name, e.kind AS subject_kind, e.provisional AS s_flag, o.entity_id AS object_id, o.name AS o_name, o.kind AS object_kind, o.provisional AS o_flag
 FROM x LEFT JOIN reg e ON e.world_id = x.world_id AND e.norm = lower(x.subject) LEFT JOIN reg o ON o.world_id = x.world_id AND o.norm = lower(x.object_entity)),
ev1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world_id, subject_id, predicate ORDER BY position, row_id) AS nth FROM r WHERE subject_id IS NOT NULL) WHERE nth = 1 OR predicate NOT IN ('dies', 'destroyed'))"""
_CHAR = ", ".join(f"'{p}'" for p in loading.CHARACTER_SUBJECTS)
_OBJ = " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in loading.OBJECT_KINDS.items())
_LOAD = f"""{_X}, b AS (SELECT world_id, row_id AS assertion_id, subject_id, subject_kind, predicate, object_id, object_kind, CASE WHEN object_id IS NOT NULL OR coalesce(val, '') <> '' THEN val ELSE predicate END AS object_value, position,
 CASE WHEN starts_here OR predicate IN ('dies', 'destroyed') THEN position END AS lo, CASE WHEN ends_here THEN position + 1 END AS hi, world_id * 1000 + position AS scene_id, greatest(0, least(1, confidence)) AS confidence FROM ev1),
p0 AS (SELECT *, max(lo) OVER (PARTITION BY world_id, subject_id, object_id ORDER BY position, assertion_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM b WHERE predicate = 'located_at' AND object_id IS NOT NULL),
p1 AS (SELECT * REPLACE (CASE WHEN lo IS NULL AND hi IS NOT NULL AND st < hi THEN st ELSE lo END AS lo), row_number() OVER (PARTITION BY world_id, subject_id, position ORDER BY assertion_id) AS nth FROM p0),
p2 AS (SELECT *, last_value(CASE WHEN hi IS NULL AND nth = 1 THEN object_id END IGNORE NULLS) OVER (PARTITION BY world_id, subject_id ORDER BY position, assertion_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p1),
p3 AS (SELECT *, min(lo) OVER (PARTITION BY world_id, subject_id ORDER BY position RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM p2 WHERE prev IS NULL OR prev <> object_id),
done AS (SELECT world_id, assertion_id, subject_id, predicate, object_id, object_value, lo, CASE WHEN hi IS NULL AND nth = 1 AND nxt > coalesce(lo, -1) THEN nxt ELSE hi END AS hi, scene_id, confidence, nth = 1 AND coalesce(subject_kind = 'character', false) AND coalesce(object_kind = 'location', false) AS mirrored FROM p3
 UNION ALL SELECT world_id, assertion_id, subject_id, predicate, object_id, object_value, lo, hi, scene_id, confidence, false FROM b WHERE predicate <> 'located_at' OR object_id IS NULL)
SELECT world_id, assertion_id, subject_id, predicate, object_id, object_value, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, scene_id, confidence, CASE WHEN confidence >= 0.85 THEN 'canon' ELSE 'draft' END AS status, mirrored FROM done"""
_OVER = "(y.lo IS NULL OR x.hi IS NULL OR y.lo < x.hi) AND (x.lo IS NULL OR y.hi IS NULL OR x.lo < y.hi) AND coalesce(x.lo < x.hi, true) AND coalesce(y.lo < y.hi, true)"
_F2 = _NOTE.format("F2", "0") + f" FROM base x WHERE predicate IN ('promised', 'goal', 'secret_of', 'created') AND max_at - apos >= threshold AND {_NOT_HEARD.replace('b.', 'x.')}"
ORACLES = {
    "mentions": over_graph(f"""{_X}, m AS (SELECT world_id, trim(subject) AS surface, 'subject' AS role, predicate, position FROM x UNION ALL SELECT world_id, object_entity, 'object', predicate, position FROM x
 UNION ALL SELECT p.world_id, e.name, CASE e.entity_id % 10 WHEN 0 THEN 'death' WHEN 1 THEN 'destruction' ELSE 'presence' END, NULL, s.story_position FROM presence p JOIN entities e ON e.world_id = p.world_id AND e.entity_id = p.entity_id AND e.kind = 'character' JOIN scenes s ON s.world_id = p.world_id AND s.scene_id = p.scene_id)
SELECT *, CASE WHEN role IN ('presence', 'death') THEN 'character' WHEN role = 'destruction' THEN 'location' WHEN role = 'subject' THEN CASE WHEN predicate IN ('located_at', 'created') THEN 'object' WHEN predicate = 'destroyed' THEN 'location' WHEN predicate IN ({_CHAR}) THEN 'character' ELSE 'other' END ELSE CASE predicate {_OBJ} ELSE 'other' END END AS kind FROM m WHERE coalesce(surface, '') <> ''"""),
    "resolved_assertions": over_graph(f"{_X} SELECT world_id, row_id, coalesce(s_name, subject) AS subject, o_name AS object_entity, val AS object_value, coalesce(s_flag, true) AS subject_provisional, coalesce(o_flag, false) AS object_provisional FROM r"),
    "earliest_events": over_graph(f"{_X} SELECT world_id, row_id, predicate FROM ev1"),
    "load_assertions": over_graph(_LOAD),
    "presence_from_slug": over_graph(ONE + """, pl AS (SELECT world_id, scene_id, 'place ' || story_position % 20 AS norm, string_split('place ' || story_position % 20, ' ') AS t FROM scenes), nm AS (SELECT world_id, entity_id, kind, list_distinct(string_split(lower(name), ' ')) AS u FROM entities),
h AS (SELECT pl.world_id, pl.norm, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM (SELECT DISTINCT world_id, norm, t FROM pl) pl JOIN nm ON nm.world_id = pl.world_id AND len(list_intersect(t, u)) > 0 AND (len(list_intersect(t, u)) = least(len(t), len(u)) OR len(list_intersect(t, u)) >= 0.5 * (len(t) + len(u) - len(list_intersect(t, u)))) GROUP BY 1, 2)
SELECT pl.world_id, pl.scene_id, h.entity_id FROM pl JOIN h ON h.world_id = pl.world_id AND h.norm = pl.norm AND n = 1 JOIN entities e ON e.world_id = h.world_id AND e.entity_id = h.entity_id AND e.kind = 'location'"""),
    "exclusion_violations": over_graph(f"{ONE} SELECT x.world_id, x.subject_id AS character_id, x.assertion_id, y.assertion_id AS other FROM a x JOIN a y ON y.world_id = x.world_id AND y.subject_id = x.subject_id AND x.assertion_id < y.assertion_id AND {_OVER} WHERE x.predicate = 'located_at' AND y.predicate = 'located_at'"),
    "merge_snapshot": over_graph(ONE + " SELECT world_id, entity_id, CASE WHEN entity_id % 3 <> 0 THEN upper(name) ELSE name END AS name, CASE WHEN entity_id % 4 <> 0 THEN kind ELSE 'new' END AS kind FROM entities WHERE entity_id % 4 <> 0 OR entity_id % 3 <> 0"),
    "distinct_values": over_graph(ONE + " SELECT DISTINCT world_id, 'kind' AS field, kind AS value FROM entities UNION SELECT world_id, 'predicate', predicate FROM a UNION SELECT world_id, 'trait', object_value FROM a WHERE predicate = 'trait' AND object_value IS NOT NULL UNION SELECT world_id, 'position', CAST(story_position AS VARCHAR) FROM scenes"),
    "assertion_lookup": over_graph(ONE + """, q AS (SELECT 'i' || assertion_id AS ref_id, world_id, CASE WHEN assertion_id % 7 = 0 THEN -assertion_id ELSE assertion_id END AS id, subject_id, predicate, NULL::INT AS pos FROM a UNION ALL SELECT 'n' || assertion_id, world_id, NULL, subject_id, predicate, CASE WHEN assertion_id % 3 <> 0 THEN CAST(assertion_id % 100 AS INT) END FROM a),
h AS (SELECT ref_id, a.assertion_id FROM q JOIN a ON a.world_id = q.world_id AND a.assertion_id = q.id UNION ALL SELECT ref_id, a.assertion_id FROM q JOIN a ON a.world_id = q.world_id AND a.subject_id = q.subject_id AND a.predicate = q.predicate WHERE id IS NULL AND (pos IS NULL OR (coalesce(a.lo <= pos, true) AND coalesce(pos < a.hi, true) AND coalesce(a.lo < a.hi, true)))),
n AS (SELECT ref_id, count(*) AS n, min(assertion_id) AS hit FROM h GROUP BY 1) SELECT q.ref_id, q.world_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN hit END AS assertion_id FROM q LEFT JOIN n USING (ref_id)"""),
    "fact_concerns": over_graph(f"{ONE}, {CONCERNS} SELECT * FROM cf"),
    "note_open_questions": over_graph(f"{_BASE} {open_questions_sql(RELATIONS)}"),
    "note_given_questions": over_graph(f"""{_BASE}, q AS (SELECT a.world_id, a.scene_id, CASE WHEN assertion_id % 10 = 0 THEN ' ' ELSE 'What of ' || coalesce(object_value, 'this') || CASE WHEN assertion_id % 2 = 0 THEN '?' ELSE '' END END AS question, CASE WHEN assertion_id % 3 = 0 THEN supporting_quote END AS quote FROM a)
SELECT q.world_id, 'F1' AS family, 'F1:' || left(sha256(question || chr(31) || l.label), 24) AS note_key, CAST(60 + max_at - s.story_position AS BIGINT) AS salience, q.scene_id, l.label, CASE WHEN question LIKE '%?' THEN question ELSE question || '?' END AS summary, coalesce(quote, s.raw_text) AS quote
FROM q JOIN scenes s USING (world_id, scene_id) JOIN mx USING (world_id) JOIN labels_ l ON l.world_id = q.world_id AND l.scene_id = q.scene_id WHERE trim(question) <> ''"""),
    "note_drafts": over_graph(f"""{_BASE}, n AS ({_F2} UNION ALL {open_questions_sql(RELATIONS)}) SELECT n.world_id, n.family, n.note_key, CASE family WHEN 'F1' THEN 'Is this ever settled: ' || about || '?' ELSE 'Set up and not taken up again: ' || about || '.' END AS summary, n.label || ': ' || supporting_quote AS citation
FROM n JOIN (SELECT *, concat_ws(' ', name, predicate, object_value) AS about FROM base) b ON b.world_id = n.world_id AND b.assertion_id = n.assertion_id"""),
    "findings_touching": over_graph(FINDINGS_CTE + f""", t AS (SELECT 'c' || assertion_id AS change_id, world_id, assertion_id, scene_id FROM a), f AS (SELECT {COLS}, sealed FROM findings g WHERE NOT sealed AND NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = g.world_id AND c.family = g.check_name AND NOT c.enabled))
SELECT change_id, f.world_id, check_name, f.scene_id, assertion_a, assertion_b FROM f JOIN t ON t.world_id = f.world_id AND t.assertion_id = f.assertion_a UNION SELECT change_id, f.world_id, check_name, f.scene_id, assertion_a, assertion_b FROM f JOIN t ON t.world_id = f.world_id AND t.assertion_id = f.assertion_b UNION SELECT change_id, f.world_id, check_name, f.scene_id, assertion_a, assertion_b FROM f JOIN t ON t.world_id = f.world_id AND t.scene_id = f.scene_id"""),
    "evaluate_runs": over_graph(ONE + """, c AS (SELECT world_id AS run_id, assertion_id % 50 = 0 AS trap, CASE WHEN assertion_id % 50 = 0 THEN world_id = 1 AND assertion_id % 100 = 0 ELSE world_id + assertion_id % 7 > 1 END AS hit FROM a), w AS (SELECT world_id AS run_id, CAST(sum(work_id % 3) AS BIGINT) AS wrong FROM works GROUP BY 1),
s AS (SELECT run_id, count(*) FILTER (NOT trap) AS errors, count(*) FILTER (NOT trap AND hit) AS caught, count(*) FILTER (trap) AS traps, count(*) FILTER (trap AND NOT hit) AS respected FROM c GROUP BY 1) SELECT *, caught / errors AS recall, wrong / 30 AS wrong_per_episode, caught / errors >= 0.8 AND wrong / 30 <= 2 AND respected = traps AS passed FROM s JOIN w USING (run_id)"""),
    "quote_offsets": over_graph(ONE + " SELECT a.world_id, assertion_id, CAST(strpos(lower(raw_text), lower(supporting_quote)) AS INT) AS \"offset\" FROM a JOIN scenes s USING (world_id, scene_id)"),
    "role_references": "SELECT DISTINCT surface FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z.]+')) AS surface FROM documents) WHERE surface <> '' AND (regexp_full_match(surface, '([A-Za-z]\\.){2,}') OR trim(regexp_replace(lower(CASE WHEN lower(surface) IN ('the', 'a', 'an') THEN '' ELSE surface END), '[^a-z0-9 ]', '', 'g')) IN ('', " + ", ".join(f"'{w}'" for w in (*text.ROLE_WORDS, *text.PRONOUNS)) + "))",
}
ORACLES["predicted_presence"] = over_graph(_CHANGES + " SELECT * FROM pred_place")
ORACLES["predicted_capability"] = over_graph(_CHANGES + " SELECT * FROM pred_act")
