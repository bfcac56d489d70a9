"""Registered queries on constraints, rulings, merges, exports, pages, scores and the dossier's further sections, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import checks, constraints, dossier, folds, lifecycle, report, ripple, usage, views
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import FINDINGS_CTE, LABELS
from storyloom.plans.queries_folds import _merges
from storyloom.plans.queries_notes import _claims, _table
from storyloom.plans.queries_views import _CHANGES, change_table
from storyloom.sources import stored, texts
from storyloom.sources.graph import Graph, derive, events

ONE = "one AS (SELECT 1)"


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _stored(fn):
    """For queries that read the graph many times, as all checks do."""
    return lambda s, d: fn(stored.derived(s, d))


def _found(g: Graph) -> DataFrame:
    return checks.all_findings(g)


def _constraints(s: SparkSession, d: str) -> DataFrame:
    """The graph without some entities and scenes, and share links with repeated tokens and a kind that nobody knows."""
    g = derive(s, d)
    kind = F.when(F.col("k") % 3 == 0, "report").when(F.col("k") % 3 == 1, "bible").otherwise("other")
    links = events(s, d).select(F.concat(F.lit("t"), (F.col("event_id") - F.col("event_id") % 7 % 2).cast("string")).alias("token"), "world_id", kind.alias("kind"))
    return constraints.violations({
        "assertions": g.assertions, "entities": g.entities.filter("entity_id % 9 <> 0"), "scenes": g.scenes.filter("story_position % 10 <> 0"), "works": g.works,
        "aliases": g.aliases, "presence": g.presence, "seals": g.seals, "family_config": g.family_config, "links": links,
    })


def _ruled(g: Graph) -> tuple[DataFrame, DataFrame]:
    n = F.col("assertion_id")
    verdict = F.when(n % 3 == 0, "accept").when(n % 3 == 1, "reject").otherwise("edit")
    predicate = F.when(n % 5 == 0, "no such").when(n % 5 == 1, "trait")
    new = g.assertions.filter("assertion_id % 4 < 3").select("assertion_id", verdict.alias("verdict"), F.lit(2).alias("seq"), predicate.alias("predicate"), F.when(n % 2 == 0, "edited").alias("object_value"))
    old = g.assertions.filter("assertion_id % 4 > 1").select("assertion_id", F.lit("reject").alias("verdict"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("object_value"))
    return folds.apply_rulings(g.assertions.select("assertion_id", "status", "predicate", "object_value"), new.unionByName(old))


def _merged(g: Graph) -> tuple[DataFrame, DataFrame]:
    e = g.entities.select("world_id", "entity_id", "name", "kind", "provisional", F.when(F.col("entity_id") % 2 == 0, F.concat(F.lit("n"), F.col("entity_id").cast("string"))).alias("note"))
    return folds.merge_entities(e, g.aliases, _merges(g))


def _summary(g: Graph) -> DataFrame:
    n = F.col("assertion_id")
    results = g.assertions.filter("fact_key is not null").select(F.col("world_id").alias("system"), F.col("fact_key").alias("case_id"), (n % 3).alias("run"), (F.col("confidence") > 0.3).alias("caught"))
    wrong = g.works.select(F.col("world_id").alias("system"), (F.col("work_id") % 3).alias("run"), (F.col("work_id") % 4).alias("n"))
    out = usage.consistency_summary(results, wrong, 30)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _owned(g: Graph) -> DataFrame:
    owners = g.works.select("world_id").distinct().select(F.concat(F.lit("acc"), (F.col("world_id") % 2).cast("string")).alias("account_id"), "world_id")
    return lifecycle.account_manifest(owners, {"assertions": g.assertions, "entities": g.entities, "presence": g.presence})


def _errors(g: Graph) -> DataFrame:
    n = F.col("assertion_id")
    check = F.when(n % 5 == 0, None).when(n % 5 == 1, "capability_violation").otherwise("dead_speaker")
    return g.assertions.select("world_id", check.alias("check"), F.concat(F.lit(" who "), F.col("subject_id").cast("string")).alias("who"), F.col("supporting_quote").alias("explanation"), F.col("object_value").alias("contradicts"))


def _traps(g: Graph) -> DataFrame:
    check = F.when(F.col("entity_id") % 3 == 0, "*").when(F.col("entity_id") % 3 == 1, "premature_knowledge").otherwise("presence_conflict")
    return g.entities.filter("kind = 'character'").select(F.col("world_id").alias("run_id"), F.col("entity_id").alias("trap_id"), check.alias("check_name"), F.array(F.concat("name", F.lit(" "))).alias("words"))


def _trap_scores(g: Graph) -> DataFrame:
    return lifecycle.trap_scores(_traps(g), _found(g).withColumnRenamed("world_id", "run_id"))


def _handles(g: Graph) -> DataFrame:
    n = F.col("assertion_id")
    handles = g.assertions.select("world_id", n.alias("handle_id"), F.concat(F.lit("about "), F.coalesce("object_value", F.lit("nothing")), F.lit(" or "), (n % 45).cast("string")).alias("handle"))
    facts = g.assertions.filter("object_value is not null").select("world_id", "fact_key", F.col("object_value").alias("fact")).distinct()
    return lifecycle.fact_matches(handles, facts)


def _sections(g: Graph) -> DataFrame:
    n = F.col("assertion_id")
    rows = g.assertions.select("world_id", F.concat(F.lit("F"), (n % 5 + 1).cast("string")).alias("family"), F.when(n % 4 == 0, "dismissed").otherwise("open").alias("status"), (n % 50).alias("salience"), n.cast("string").alias("note_key"), F.coalesce("object_value", F.lit("-")).alias("summary"))
    return report.sections(_found(g), views.load_bearing(g), rows)


def _gated(s: SparkSession, d: str) -> DataFrame:
    """The claims on last lines as extracted rows, by turns without object, of unknown predicate or with odd numbers."""
    n = F.col("doc_id")
    rows = _claims(s, d).select(
        "claim_id", "doc_id", "quote", F.when(n % 7 == 0, "flies").when(n % 7 == 1, "dies").otherwise("knows").alias("predicate"), F.when(n % 3 == 0, "it").alias("object_entity"), F.when(n % 5 == 0, "").otherwise(F.when(n % 4 == 0, "x")).alias("object_value"),
        F.when(n % 11 == 0, "ref").alias("object_fact_ref"), F.when(n % 13 == 0, "high").otherwise(((n % 30) / F.lit(20.0)).cast("string")).alias("confidence"),
        F.when(n % 2 == 0, n % 4 == 0).alias("polarity"), F.when(n % 3 == 0, n % 6 == 0).alias("starts_here"), F.when(n % 5 == 0, n % 10 == 0).alias("ends_here"),
    )
    return texts.gated_rows(rows, _table(s, d, "documents").select("doc_id", "text"))


QUERIES = {
    "constraint_violations": _constraints,
    "ruling_edits": _with(lambda g: _ruled(g)[0]),
    "ruling_audit": _with(lambda g: _ruled(g)[1]),
    "merged_entities": _with(lambda g: _merged(g)[0]),
    "merged_aliases": _with(lambda g: _merged(g)[1]),
    "consistency_summary": _with(_summary),
    "world_list_findings": _stored(lambda g: views.world_list(g, _found(g))),
    "account_manifest": _with(_owned),
    "findings_contract": _stored(lambda g: lifecycle.contract(_found(g))),
    "detected_findings": _with(lambda g: lifecycle.detected(_errors(g))),
    "scene_page": _with(views.scene_page),
    "assertion_page": _stored(lambda g: views.assertion_page(g, _found(g))),
    "finding_page": _stored(lambda g: views.finding_page(g, _found(g))),
    "trap_scores": _stored(_trap_scores),
    "fact_matches": _with(_handles),
    "report_sections": _stored(_sections),
    "gated_rows": _gated,
    "cut_reasons": _stored(lambda g: ripple.cut_reasons(g, change_table(g))),
    "bible_timeline": _with(dossier.timeline),
    "bible_destructions": _with(dossier.destructions),
    "bible_occupations": _with(dossier.occupations),
}

_RANGE = "CASE WHEN {0}lo >= {0}hi THEN 'empty' ELSE CASE WHEN {0}lo IS NULL THEN '(' ELSE '[' || {0}lo END || ',' || coalesce(CAST({0}hi AS VARCHAR), '') || ')' END"
_GLOSS = """CASE WHEN a.lo IS NULL AND a.hi IS NULL THEN 'all positions' WHEN a.lo >= a.hi THEN 'no position' WHEN a.hi IS NULL THEN 'pos ' || a.lo || ' onward' WHEN a.lo IS NULL THEN 'through pos ' || (a.hi - 1)
 WHEN a.lo = a.hi - 1 THEN 'pos ' || a.lo ELSE 'pos ' || a.lo || '–' || (a.hi - 1) END"""
_SAID = f"""{LABELS}, said AS (SELECT a.world_id, a.assertion_id, trim(concat_ws(' ', e.name, CASE WHEN NOT a.polarity THEN 'not' END, a.predicate, coalesce(o.name, a.object_value, x.object_value, ''))) AS sentence,
 {_RANGE.format("a.")} AS range, l.label, a.status FROM a JOIN entities e ON e.world_id = a.world_id AND e.entity_id = a.subject_id JOIN labels_ l ON l.world_id = a.world_id AND l.scene_id = a.scene_id
 LEFT JOIN entities o ON o.world_id = a.world_id AND o.entity_id = a.object_id LEFT JOIN a x ON x.world_id = a.world_id AND x.assertion_id = a.object_assertion_id)"""
_RULED = f"""n AS (SELECT assertion_id, status, predicate, object_value, CASE WHEN assertion_id % 4 < 3 THEN CASE assertion_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END ELSE 'reject' END AS verdict FROM a),
r AS (SELECT *, status = 'draft' AND NOT (verdict = 'edit' AND assertion_id % 5 = 0) AS ok FROM n)"""
_MERGED = """mg AS (SELECT world_id, entity_id AS o, entity_id - 4 AS n FROM entities WHERE kind = 'character' AND entity_id % 6 < 2 AND entity_id > 6),
e AS (SELECT t.*, CASE WHEN t.entity_id % 2 = 0 THEN 'n' || t.entity_id END AS note, coalesce(mg.n, t.entity_id) AS into_ FROM entities t LEFT JOIN mg ON mg.world_id = t.world_id AND mg.o = t.entity_id)"""
_FIRST = "arg_min({0}, CASE WHEN entity_id = into_ THEN -1 ELSE entity_id END) FILTER ({0} IS NOT NULL) AS {0}"
_QUOTE = r"""lower(trim(regexp_replace(translate({}, '‘’“”–—', '''''""--'), '\s+', ' ', 'g')))"""

ORACLES = {
    "constraint_violations": over_graph(r"""en AS (SELECT * FROM entities WHERE entity_id % 9 <> 0), sc AS (SELECT * FROM scenes WHERE story_position % 10 <> 0),
lk AS (SELECT 't' || (event_id - event_id % 7 % 2) AS token, k FROM ev)
SELECT 'links' AS table_name, 'unique_token' AS "constraint", token AS key FROM lk GROUP BY token HAVING count(*) > 1 UNION ALL SELECT 'links', 'kind_known', token FROM lk WHERE k % 3 = 2
UNION ALL SELECT 'assertions', 'confidence_range', CAST(assertion_id AS VARCHAR) FROM a WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'assertions', 'object_given', CAST(assertion_id AS VARCHAR) FROM a WHERE object_id IS NULL AND object_value IS NULL AND object_assertion_id IS NULL
UNION ALL SELECT 'aliases', 'entity_id_exists', world_id || '/' || entity_id || '/' || alias FROM aliases WHERE entity_id NOT IN (SELECT entity_id FROM en)
UNION ALL SELECT 'assertions', 'subject_id_exists', CAST(assertion_id AS VARCHAR) FROM a WHERE subject_id NOT IN (SELECT entity_id FROM en)
UNION ALL SELECT 'assertions', 'object_id_exists', CAST(assertion_id AS VARCHAR) FROM a WHERE object_id NOT IN (SELECT entity_id FROM en)
UNION ALL SELECT 'assertions', 'object_assertion_id_exists', CAST(assertion_id AS VARCHAR) FROM a WHERE object_assertion_id NOT IN (SELECT assertion_id FROM a)
UNION ALL SELECT 'assertions', 'scene_id_exists', CAST(assertion_id AS VARCHAR) FROM a WHERE scene_id NOT IN (SELECT scene_id FROM sc)
UNION ALL SELECT 'presence', 'scene_id_exists', scene_id || '/' || entity_id FROM presence WHERE scene_id NOT IN (SELECT scene_id FROM sc)
UNION ALL SELECT 'presence', 'entity_id_exists', scene_id || '/' || entity_id FROM presence WHERE entity_id NOT IN (SELECT entity_id FROM en)"""),
    "ruling_edits": over_graph(f"""{_RULED} SELECT assertion_id, CASE WHEN ok THEN CASE verdict WHEN 'reject' THEN 'rejected' ELSE 'canon' END ELSE status END AS status,
CASE WHEN ok AND verdict = 'edit' AND assertion_id % 5 = 1 THEN 'trait' ELSE predicate END AS predicate, CASE WHEN ok AND verdict = 'edit' AND assertion_id % 2 = 0 THEN 'edited' ELSE object_value END AS object_value FROM r"""),
    "ruling_audit": over_graph(f"{_RULED} SELECT assertion_id, verdict FROM r WHERE ok"),
    "merged_entities": over_graph(f"{_MERGED} SELECT world_id, into_ AS entity_id, bool_and(provisional) AS provisional, {_FIRST.format('name')}, {_FIRST.format('kind')}, {_FIRST.format('note')} FROM e GROUP BY 1, 2"),
    "merged_aliases": over_graph(f"{_MERGED} SELECT e.world_id, e.into_ AS entity_id, l.alias FROM aliases l JOIN e ON e.world_id = l.world_id AND e.entity_id = l.entity_id UNION SELECT world_id, into_, name FROM e WHERE into_ <> entity_id"),
    "consistency_summary": over_graph("""r AS (SELECT world_id AS system, fact_key AS c, assertion_id % 3 AS run, confidence > 0.3 AS caught FROM a WHERE fact_key IS NOT NULL), w AS (SELECT world_id AS system, work_id % 3 AS run, sum(work_id % 4) AS n FROM works GROUP BY 1, 2),
b AS (SELECT system, run, avg(CAST(caught AS INT)) AS recall FROM r GROUP BY 1, 2), m AS (SELECT system, count(*) AS runs, avg(recall) AS recall_mean, avg(coalesce(n, 0) / 30) AS wrong_per_episode_mean FROM b LEFT JOIN w USING (system, run) GROUP BY 1),
c AS (SELECT system, c, count(DISTINCT run) FILTER (caught) AS k FROM r GROUP BY 1, 2)
SELECT system, runs, round(any_value(recall_mean), 6) AS recall_mean, round(any_value(wrong_per_episode_mean), 6) AS wrong_per_episode_mean, count(*) FILTER (k = runs) AS every_run, count(*) FILTER (k > 0 AND k < runs) AS some_runs, count(*) FILTER (k = 0) AS never, count(*) AS cases,
round(count(*) FILTER (k = runs) / count(*), 6) AS recall_every_run FROM c JOIN m USING (system) GROUP BY 1, 2"""),
    "world_list_findings": over_graph(FINDINGS_CTE + """ SELECT world_id, count(*) AS works, (SELECT count(*) FROM scenes s WHERE s.world_id = w.world_id) AS scenes, (SELECT count(*) FROM entities s WHERE s.world_id = w.world_id) AS entities,
(SELECT count(*) FROM a s WHERE s.world_id = w.world_id) AS assertions, (SELECT count(*) FROM findings s WHERE s.world_id = w.world_id AND NOT sealed) AS findings FROM works w GROUP BY 1"""),
    "account_manifest": over_graph("""t AS (SELECT 'assertions' AS table_name, world_id FROM a UNION ALL SELECT 'entities', world_id FROM entities UNION ALL SELECT 'presence', world_id FROM presence)
SELECT 'acc' || world_id % 2 AS account_id, world_id, table_name, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'acc' || world_id % 2, NULL, table_name, count(*) FROM t GROUP BY ALL"""),
    "findings_contract": over_graph(FINDINGS_CTE + " SELECT world_id, CAST(to_json({'check': check_name, 'severity': severity, 'explanation': explanation, 'sealed': sealed, 'scene_id': scene_id, 'assertion_a': assertion_a, 'assertion_b': assertion_b}) AS VARCHAR) AS finding FROM findings"),
    "detected_findings": over_graph(ONE + """ SELECT world_id, CASE assertion_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'capability_violation' ELSE 'dead_speaker' END AS check_name, CASE WHEN assertion_id % 5 = 1 THEN 'warning' ELSE 'critical' END AS severity,
'who ' || subject_id || ': ' || supporting_quote || ' (contradicts: ' || coalesce(object_value, '') || ')' AS explanation, NULL::BIGINT AS scene_id, NULL::BIGINT AS assertion_a, NULL::BIGINT AS assertion_b, false AS sealed FROM a"""),
    "scene_page": over_graph(f"""{LABELS}, p AS (SELECT world_id, scene_id, string_agg(name, ', ' ORDER BY name) AS present FROM presence JOIN entities USING (world_id, entity_id) GROUP BY 1, 2),
q AS (SELECT world_id, scene_id, count(*) AS established, array_to_string(list_sort(list_distinct(list(predicate))), ', ') AS predicates FROM a GROUP BY 1, 2)
SELECT world_id, scene_id, label, slug, story_position, coalesce(present, '') AS present, coalesce(established, 0) AS established, coalesce(predicates, '') AS predicates FROM labels_ LEFT JOIN p USING (world_id, scene_id) LEFT JOIN q USING (world_id, scene_id)"""),
    "assertion_page": over_graph(FINDINGS_CTE + f""", {_SAID}, c AS (SELECT world_id, check_name, sealed, assertion_a AS id FROM findings UNION ALL SELECT world_id, check_name, sealed, assertion_b FROM findings WHERE assertion_b <> assertion_a),
t AS (SELECT world_id, id, count(*) FILTER (NOT sealed) AS live, count(*) FILTER (sealed) AS sealed, array_to_string(list_sort(list_distinct(list(check_name))), ', ') AS checks FROM c GROUP BY 1, 2)
SELECT said.*, coalesce(live, 0) AS live, coalesce(sealed, 0) AS sealed, coalesce(checks, '') AS checks FROM said LEFT JOIN t ON t.world_id = said.world_id AND t.id = said.assertion_id"""),
    "finding_page": over_graph(FINDINGS_CTE + f""", {_SAID} SELECT f.world_id, check_name, severity, f.scene_id, l.label, assertion_a, p.sentence AS sentence_a, p.label AS label_a, assertion_b, q.sentence AS sentence_b, q.label AS label_b, sealed
FROM findings f LEFT JOIN said p ON p.world_id = f.world_id AND p.assertion_id = f.assertion_a LEFT JOIN said q ON q.world_id = f.world_id AND q.assertion_id = f.assertion_b LEFT JOIN labels_ l ON l.world_id = f.world_id AND l.scene_id = f.scene_id"""),
    "trap_scores": over_graph(FINDINGS_CTE + """, t AS (SELECT world_id, entity_id, name, CASE entity_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'premature_knowledge' ELSE 'presence_conflict' END AS c FROM entities WHERE kind = 'character')
SELECT world_id AS run_id, entity_id AS trap_id, c AS check_name, NOT EXISTS (SELECT 1 FROM findings f WHERE f.world_id = t.world_id AND NOT sealed AND c IN ('*', f.check_name) AND contains(lower(explanation), lower(name || ' '))) AS respected FROM t"""),
    "fact_matches": over_graph(ONE + """, v AS (SELECT DISTINCT world_id, fact_key, CAST(regexp_extract(fact_key, '([0-9]+)', 1) AS INT) AS f FROM a WHERE fact_key IS NOT NULL),
h AS (SELECT world_id, assertion_id, object_value, CAST(regexp_extract(object_value, '([0-9]+)', 1) AS INT) AS f FROM a WHERE object_value IS NOT NULL)
SELECT h.world_id, assertion_id AS handle_id, fact_key FROM h JOIN v ON v.world_id = h.world_id AND v.f = h.f UNION SELECT h.world_id, assertion_id, fact_key FROM h JOIN v ON v.world_id = h.world_id AND v.f = assertion_id % 45"""),
    "report_sections": over_graph(FINDINGS_CTE + """, d AS (SELECT world_id, subject_id AS id, scene_id FROM a UNION ALL SELECT world_id, object_id, scene_id FROM a WHERE object_id IS NOT NULL),
b AS (SELECT d.world_id, name, count(*) AS n, count(DISTINCT scene_id) AS s, row_number() OVER (PARTITION BY d.world_id ORDER BY count(*) DESC, name, id) AS p FROM d JOIN entities e ON e.world_id = d.world_id AND e.entity_id = id GROUP BY d.world_id, id, name)
SELECT world_id, '1 findings' AS section, CAST(row_number() OVER (PARTITION BY world_id ORDER BY severity, check_name, explanation, assertion_a NULLS FIRST, assertion_b NULLS FIRST, scene_id NULLS FIRST) AS INT) AS ord, '[' || severity || '] ' || check_name || ': ' || explanation AS line FROM findings WHERE NOT sealed
UNION ALL SELECT world_id, '2 load-bearing', CAST(p AS INT), name || ': ' || n || ' rows in ' || s || ' scenes' FROM b WHERE p <= 10
UNION ALL SELECT world_id, '3 notes F' || (assertion_id % 5 + 1), CAST(row_number() OVER (PARTITION BY world_id, assertion_id % 5 ORDER BY assertion_id % 50 DESC, CAST(assertion_id AS VARCHAR)) AS INT), coalesce(object_value, '-') FROM a WHERE assertion_id % 5 < 4 AND assertion_id % 4 <> 0"""),
    "gated_rows": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[-1] AS line FROM documents), c AS (SELECT 'own-' || doc_id AS claim_id, doc_id, replace(line, ' ', '  ') AS quote FROM l UNION ALL SELECT 'next-' || doc_id, doc_id + 1, line FROM l)
SELECT claim_id, c.doc_id, CASE WHEN trim(quote) = '' THEN 'no_quote' WHEN c.doc_id % 7 = 0 THEN 'bad_predicate' WHEN c.doc_id % 7 <> 1 AND c.doc_id % 3 <> 0 AND NOT (c.doc_id % 5 <> 0 AND c.doc_id % 4 = 0) AND c.doc_id % 11 <> 0 THEN 'no_object'
 WHEN NOT coalesce(contains({_QUOTE.format("text")}, {_QUOTE.format("quote")}), false) THEN 'quote_not_found' ELSE 'keep' END AS verdict,
 CASE WHEN c.doc_id % 13 = 0 THEN 0.0 ELSE least(1.0, CAST(c.doc_id % 30 AS DOUBLE) / 20.0) END AS confidence, CASE WHEN c.doc_id % 2 = 0 THEN c.doc_id % 4 = 0 ELSE true END AS polarity,
 CASE WHEN c.doc_id % 3 = 0 THEN c.doc_id % 6 = 0 ELSE true END AS starts_here, CASE WHEN c.doc_id % 5 = 0 THEN c.doc_id % 10 = 0 ELSE false END AS ends_here FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id""",
    "cut_reasons": over_graph(_CHANGES + f""", r AS (SELECT u.*, a.scene_id, CASE WHEN a.subject_id = c.entity_id THEN 'subject' WHEN a.object_id = c.entity_id THEN 'object' ELSE 'named' END AS reason, {_RANGE.format("a.")} AS range
 FROM cut u JOIN changes c ON c.change_id = u.change_id AND c.world_id = u.world_id JOIN a ON a.world_id = u.world_id AND a.assertion_id = u.id WHERE u.kind = 'assertion')
SELECT change_id, world_id, kind, id, reason, range FROM r UNION ALL SELECT change_id, world_id, kind, id, 'present', NULL FROM cut WHERE kind = 'scene' UNION ALL SELECT DISTINCT change_id, world_id, 'scene', scene_id, 'cited', NULL FROM r"""),
    "bible_timeline": over_graph(f"""{LABELS} SELECT a.world_id, story_position, label, CAST(row_number() OVER (PARTITION BY a.world_id, label ORDER BY assertion_id) AS INT) AS ord, name, predicate, object_value, assertion_id
FROM a JOIN labels_ l ON l.world_id = a.world_id AND l.scene_id = a.scene_id JOIN entities e ON e.world_id = a.world_id AND e.entity_id = a.subject_id WHERE status IN ('canon', 'sealed')"""),
    "bible_destructions": over_graph(f"""{LABELS} SELECT world_id, name, story_position, label, assertion_id FROM (SELECT a.world_id, name, story_position, label, assertion_id, row_number() OVER (PARTITION BY a.world_id, subject_id ORDER BY story_position, assertion_id) AS nth
FROM a JOIN labels_ l ON l.world_id = a.world_id AND l.scene_id = a.scene_id JOIN entities e ON e.world_id = a.world_id AND e.entity_id = a.subject_id WHERE predicate = 'destroyed' AND polarity AND status NOT IN ('retconned', 'rejected')) WHERE nth = 1"""),
    "bible_occupations": over_graph(f"""{ONE} SELECT a.world_id, name, CAST(row_number() OVER (PARTITION BY a.world_id, subject_id ORDER BY lo NULLS FIRST, assertion_id) AS INT) AS ord, object_value, {_GLOSS} AS gloss, assertion_id
FROM a JOIN entities e ON e.world_id = a.world_id AND e.entity_id = a.subject_id WHERE predicate = 'occupation' AND status NOT IN ('retconned', 'rejected')"""),
}
