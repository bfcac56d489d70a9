"""Registered queries on policies, families, rule logs, printed pages, documents of findings and scores of notes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import lifecycle, notes, report, ripple, rules, usage, views
from storyloom.plans import queries_lifecycle, queries_notes
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import FINDINGS_CTE, _DESTROYED
from storyloom.plans.queries_tables import _found
from storyloom.sources import scripts, stored
from storyloom.sources.graph import Graph, derive, events


def _with(fn):
    return lambda s, d: fn(derive(s, d))


# Tighter limits than the usual ones, so that the events meet them.
LIMITS = {
    "free": {"world_create": (1, None), "script_ingest": (2, None), "report_run": (1, usage.DAY), "ask": (1, 12 * usage.HOUR)},
    "paid": {"world_create": (3, None), "script_ingest": (4, None), "report_run": (2, usage.DAY), "ask": (3, 12 * usage.HOUR)},
}
ACTION = "CASE event_type WHEN 'signup' THEN 'world_create' WHEN 'purchase' THEN 'script_ingest' WHEN 'view' THEN 'report_run' WHEN 'click' THEN 'ask' ELSE 'other' END"


def _policies(s: SparkSession, d: str) -> DataFrame:
    """Every event is an action, and asks a minute later for another one like it."""
    e = events(s, d)
    log = e.select("event_id", "user_id", F.expr(ACTION).alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    asks = log.select(F.col("event_id").alias("request_id"), "user_id", "kind", (F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("ts"))
    tiers = e.select("user_id", F.expr("CASE user_id % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'free' END").alias("tier")).distinct()
    return usage.decisions(asks, log, tiers, LIMITS)


def _pages(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 25).alias("user_id"), "text")
    tiers = docs.select("user_id", F.when(F.col("user_id") % 2 == 0, "paid").alias("tier")).distinct()
    return usage.page_decisions(docs, tiers, {"free": 1, "paid": 2})


CONFIG = (("F1 ", 0), ("Idle-Setup", 1), ("presence_conflict", 2), ("f3", 3), ("DEAD-SPEAKER", 1))


def _families(g: Graph) -> DataFrame:
    """Each world switches off a part of the families, however it spells them."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("n")) for f, n in CONFIG])
    config = g.works.select("world_id").distinct().select("world_id", F.explode(each).alias("c")).select("world_id", "c.family", ((F.col("world_id") + F.col("c.n")) % 2 == 0).alias("enabled"))
    return views.family_list(g.with_(family_config=config))


RULE_OP = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'disable' WHEN 'view' THEN 'enable' WHEN 'error' THEN CASE WHEN k < 20 THEN 'delete' ELSE 'create' END ELSE 'create' END"


def _rule_log(s: SparkSession, d: str) -> DataFrame:
    return rules.rule_list(events(s, d).select("world_id", F.col("user_id").alias("rule_id"), F.expr(RULE_OP).alias("op"), F.col("event_id").alias("at"), F.expr("CASE k % 3 WHEN 0 THEN 'cannot' WHEN 1 THEN 'only' ELSE 'exception' END").alias("kind"), F.concat(F.lit("rule "), "k").alias("label")))


# Printed pages of every work: no empty lines, page numbers and marks between them, headings in capitals; a flashback ends with its scene.
PRINTED = (
    "concat(CASE WHEN is_flashback THEN concat('FLASHBACK:', chr(10)) ELSE '' END, slug, ' #', CAST(story_position AS VARCHAR(10)), '#', chr(10), raw_text, chr(10), '12.', chr(10), '(CONTINUED)', chr(10), "
    "'Page 3 of 9', chr(10), 'int. not a heading', chr(10), ' [PLANTED: x] a tail', chr(10), 'MORE: (2)', chr(10), CASE WHEN is_flashback THEN concat('BACK TO PRESENT', chr(10)) ELSE '' END)"
)


def _printed(g: Graph) -> DataFrame:
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("story_position", F.expr(PRINTED).alias("piece")))), lambda x: x["piece"]), "")
    pages = g.scenes.groupBy("work_id").agg(pieces.alias("pieces")).select(F.col("work_id").alias("doc_id"), F.concat(F.lit("Title: a show\nby someone\n1\n"), "pieces").alias("text"))
    return scripts.scenes(pages, printed=True)


def _slugs(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/pages.parquet")
    source = F.concat(F.col("url"), F.lit("?é.v2.fountain"))
    episode = F.when(F.col("page_id") % 4 == 0, F.col("page_id").cast("int"))
    return p.select("page_id", text.safe_slug("url").alias("safe"), text.world_slug(source).alias("world"), text.work_key(episode, source, F.lit("a title")).alias("work"))


def _values(g: Graph) -> DataFrame:
    """What is stored for an assertion's value, and what is told again of it."""
    kept = text.object_placeholder(F.col("object_value"), F.col("object_id"), F.col("predicate"))
    return g.assertions.select("assertion_id", kept.alias("kept"), text.without_placeholder(kept, F.col("predicate")).alias("told"))


def _who(g: Graph) -> DataFrame:
    """Every character, from a position or up to one, or anywhere."""
    n = F.col("entity_id")
    return g.entities.select(n.alias("change_id"), "world_id", "entity_id", F.when(n % 3 != 0, n % 60).cast("int").alias("pos_from"), F.when(n % 4 != 0, n % 60 + n % 40).cast("int").alias("pos_to"))


NAMES = ("F1", "Open Question", "F2", "idle_setup", "f3", "Dormant-Knowledge", "F4", "unmotivated turn")


def _coverage(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every assertion as a note; expected is one a scene for where somebody is, a decoy one a scene for what somebody can't do."""
    n = F.col("assertion_id")
    family = F.element_at(F.array(*[F.lit(f) for f in NAMES]), (n % 8 + 1).cast("int")).alias("family")
    body = F.concat(F.coalesce("object_value", F.lit("-")), F.lit(": "), "supporting_quote")
    status = F.when(n % 5 == 0, "Sealed").when(n % 5 == 1, "dismissed").when(n % 10 == 2, "open").alias("status")
    all_ = g.assertions.select("world_id", n.alias("note_id"), family, status, F.array("scene_id", "scene_id", F.col("scene_id") + 1).alias("scene_ids"), body.alias("body"))

    def wanted(predicate: str) -> DataFrame:
        first = g.assertions.filter(F.col("predicate") == predicate).groupBy("world_id", "scene_id").agg(F.min_by(F.struct("assertion_id", "supporting_quote"), "assertion_id").alias("a")).select("world_id", "scene_id", "a.*")
        words = F.array(F.concat(F.lit("LINE "), (n % 50).cast("string"), F.lit(" of")), F.lit("Fact"), F.lit(""))
        return first.select("world_id", n.alias("expected_id"), family, F.when(n % 3 != 0, F.col("scene_id") + F.when(n % 3 == 1, 0).otherwise(10**7)).alias("scene_id"), F.when(n % 2 == 0, F.col("supporting_quote")).alias("line"), words.alias("words"))

    return wanted("located_at"), all_, wanted("cannot")


def _stored_notes(s: SparkSession, d: str) -> DataFrame:
    g = stored.derived(s, d)
    found = notes.candidates(g, queries_notes.IGNORE)
    return notes.unsuppressed(found, queries_notes._old_notes(g)).select("world_id", "note_key", "family", "prior_status")


QUERIES = {
    "policy_decisions": _policies,
    "page_decisions": _pages,
    "family_list": _with(_families),
    "capability_probes": _with(lifecycle.capability_probes),
    "findings_documents": lambda s, d: lifecycle.document_lines(_found(g := stored.derived(s, d)), g.works),
    "rule_list": _rule_log,
    "printed_scenes": _with(_printed),
    "text_slugs": _slugs,
    "object_placeholders": _with(_values),
    "presence_in_range": _with(lambda g: ripple.presence_scenes(g, _who(g), "present")),
    "coverage_scores": _with(lambda g: report.coverage_scores(*_coverage(g))),
    "unsuppressed_notes": _stored_notes,
}


def _walk(groups: str) -> str:
    """From w (grp, i from 1, offers sorted): one step an expectation, with what is taken so far."""
    return f"""{groups},
walk(grp, i, used) AS (SELECT DISTINCT grp, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM w UNION ALL
  SELECT grp, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT w.grp, w.i, walk.used, list_filter(w.offers, lambda o: NOT list_contains(walk.used, o))[1] AS pick FROM walk JOIN w ON w.grp = walk.grp AND w.i = walk.i + 1)),
taken AS (SELECT grp, arg_max(used, i) AS used FROM walk GROUP BY 1)"""


def _recursive(sql: str) -> str:
    return over_graph(sql).replace("WITH", "WITH RECURSIVE", 1)


_ONE = "one AS (SELECT 1)"
_LIMIT = " UNION ALL ".join(f"SELECT '{t}' AS tier, '{k}' AS kind, {most} AS most, {'NULL' if w is None else w} AS span, '{t} tier allows {most} {k} {usage._span(w)}' AS why" for t, kinds in LIMITS.items() for k, (most, w) in kinds.items())
_TOKENS = queries_lifecycle._TOK
_FAMILY = "CASE n % 8 // 2 WHEN 0 THEN 'f1' WHEN 1 THEN 'f2' WHEN 2 THEN 'f3' ELSE 'f4' END"


def _wanted(name: str, predicate: str) -> str:
    return f"""{name} AS (SELECT world_id, n AS expected_id, {_FAMILY} AS fam, CASE WHEN n % 3 <> 0 THEN scene_id + CASE WHEN n % 3 = 1 THEN 0 ELSE 10000000 END END AS scene_id, CASE WHEN n % 2 = 0 THEN {_TOKENS.format('supporting_quote')} END AS line, 'line ' || n % 50 || ' of' AS word
  FROM a JOIN (SELECT world_id, min(assertion_id) AS n FROM a WHERE predicate = '{predicate}' GROUP BY world_id, scene_id) USING (world_id) WHERE assertion_id = n),
{name}_met AS (SELECT e.world_id, e.fam, e.expected_id, c.n FROM {name} e JOIN c ON c.world_id = e.world_id AND c.fam = e.fam
  WHERE CASE WHEN e.scene_id IS NOT NULL THEN c.scene_id IN (e.scene_id, e.scene_id - 1) OR coalesce(len(e.line) >= 3 AND len(list_intersect(e.line, c.said)) / len(e.line) >= 0.55, false) ELSE contains(c.body, e.word) AND contains(c.body, 'fact') END)"""


ORACLES = {
    "policy_decisions": over_graph(f"""l AS ({_LIMIT}), t AS (SELECT event_id, user_id, {ACTION} AS kind, epoch_us(ts) AS us, CASE user_id % 3 WHEN 0 THEN 'paid' ELSE 'free' END AS tier FROM ev),
u AS (SELECT r.event_id, r.user_id, r.kind, r.tier, l.most, l.span, l.why, r.us + 60000000 AS us, count(g.event_id) AS used, min(g.us) AS oldest FROM t r LEFT JOIN l ON l.tier = r.tier AND l.kind = r.kind
  LEFT JOIN t g ON g.user_id = r.user_id AND g.kind = r.kind AND g.us <= r.us + 60000000 AND (l.span IS NULL OR g.us >= r.us + 60000000 - CAST(l.span AS BIGINT) * 1000000) GROUP BY ALL)
SELECT event_id AS request_id, user_id, kind, tier, CASE WHEN most IS NOT NULL THEN used END AS used, coalesce(used < most, true) AS allowed, CASE WHEN used >= most AND span IS NOT NULL THEN CAST(greatest(1, ceil((oldest + CAST(span AS BIGINT) * 1000000 - us) / 1000000.0)) AS BIGINT) END AS retry_after, CASE WHEN used >= most THEN why END AS reason FROM u"""),
    "page_decisions": """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 25 % 2 = 0 THEN 'paid' ELSE 'free' END AS tier, CAST(greatest(1, ceil((length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) / 55.0)) AS BIGINT) AS pages FROM documents), m AS (SELECT *, CASE tier WHEN 'paid' THEN 2 ELSE 1 END AS most FROM p)
SELECT doc_id, tier, pages, pages <= most AS allowed, CASE WHEN pages > most THEN tier || ' tier accepts scripts up to ' || most || ' pages (got ' || pages || ')' END AS reason FROM m""",
    "family_list": over_graph(f"""c AS (SELECT unnest([{", ".join(f"{{'f': '{f.strip().upper() if f.strip().upper() in text.NOTE_FAMILIES else f.strip().lower().replace('-', '_')}', 'n': {n}}}" for f, n in CONFIG)}], recursive := true)),
x AS (SELECT DISTINCT world_id, family FROM works, (SELECT unnest([{", ".join(f"'{f}'" for f in views.FAMILIES)}]) AS family))
SELECT world_id, family, CASE WHEN family LIKE 'F_' THEN 'note' ELSE 'check' END AS kind, NOT EXISTS (SELECT 1 FROM c WHERE c.f = family AND (world_id + c.n) % 2 <> 0) AS enabled FROM x"""),
    "capability_probes": over_graph("""k AS (SELECT * FROM a WHERE status NOT IN ('rejected', 'retconned')), r AS (SELECT DISTINCT world_id, subject_id, fact_key AS handle FROM k WHERE predicate = 'cannot' AND polarity AND fact_key <> '')
SELECT r.world_id, r.subject_id, handle, count(k.assertion_id) AS acts, CASE WHEN count(k.assertion_id) = 0 THEN 'not_extracted' ELSE 'check' END AS layer
FROM r LEFT JOIN k ON k.world_id = r.world_id AND k.subject_id = r.subject_id AND ((k.polarity AND k.predicate <> 'cannot' AND contains(k.fact_key, handle)) OR (NOT k.polarity AND k.predicate = 'cannot' AND k.fact_key = handle)) GROUP BY 1, 2, 3"""),
    "findings_documents": over_graph(FINDINGS_CTE + """, o AS (SELECT world_id, row_number() OVER (PARTITION BY world_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, check_name, scene_id NULLS FIRST, assertion_a NULLS FIRST, assertion_b NULLS FIRST, explanation) AS place,
  CAST(to_json({'check': check_name, 'severity': severity, 'explanation': explanation, 'sealed': sealed, 'scene_id': scene_id, 'assertion_a': assertion_a, 'assertion_b': assertion_b}) AS VARCHAR) AS j FROM findings)
SELECT world_id, place, CASE WHEN place > 1 THEN ',' ELSE '' END || j AS line FROM o UNION ALL SELECT DISTINCT world_id, 0, '{"findings": [' FROM works UNION ALL SELECT w.world_id, count(o.place) + 1, ']}' FROM (SELECT DISTINCT world_id FROM works) w LEFT JOIN o USING (world_id) GROUP BY 1"""),
    "rule_list": over_graph(f"""g AS (SELECT world_id, user_id AS rule_id, {RULE_OP} AS op, event_id AS pos, CASE k % 3 WHEN 0 THEN 'cannot' WHEN 1 THEN 'only' ELSE 'exception' END AS kind, 'rule ' || k AS label FROM ev),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world_id, rule_id ORDER BY pos) AS nth FROM g WHERE op = 'create') WHERE nth = 1),
s AS (SELECT m.*, (SELECT arg_max({{'op': g.op, 'us': g.pos}}, g.pos) FROM g WHERE g.world_id = m.world_id AND g.rule_id = m.rule_id AND g.pos > m.pos AND g.op IN ('enable', 'disable')) AS turn FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.world_id = m.world_id AND g.rule_id = m.rule_id AND g.op = 'delete' AND g.pos > m.pos))
SELECT world_id, rule_id, kind, label, pos AS created_at, CASE WHEN turn.op = 'disable' THEN turn.us END AS disabled_at, CAST(row_number() OVER (PARTITION BY world_id ORDER BY pos, rule_id) AS INT) AS place FROM s"""),
    "printed_scenes": over_graph(f"""{_ONE} SELECT work_id AS doc_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY story_position) AS INT) AS scene, slug, is_flashback,
  slug || ' #' || story_position || '#' || chr(10) || raw_text || chr(10) || 'int. not a heading' || chr(10) || 'a tail' AS raw_text FROM scenes"""),
    "text_slugs": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') || '?é.v2' AS stem FROM pages)
SELECT page_id, coalesce(nullif(trim(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'world') AS safe,
  CASE WHEN url IS NULL THEN 'script' ELSE left(coalesce(nullif(trim(regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'script'), 60) END AS world,
  CASE WHEN page_id % 4 = 0 THEN 'E' || page_id WHEN url IS NULL THEN 'a-title' ELSE coalesce(nullif(trim(regexp_replace(stem, '[^A-Za-z0-9_-]+', '-', 'g'), '-'), ''), 'work') END AS work FROM p""",
    "object_placeholders": over_graph(f"{_ONE} SELECT assertion_id, CASE WHEN object_value IS NULL AND object_id IS NULL THEN predicate ELSE object_value END AS kept, object_value AS told FROM a"),
    "presence_in_range": over_graph(f"""{_ONE} SELECT DISTINCT p.entity_id AS change_id, p.world_id, p.scene_id, s.story_position, 'present' AS reason FROM presence p JOIN scenes s USING (world_id, scene_id)
WHERE p.entity_id IN (SELECT entity_id FROM entities) AND (p.entity_id % 3 = 0 OR s.story_position >= p.entity_id % 60) AND (p.entity_id % 4 = 0 OR s.story_position < p.entity_id % 60 + p.entity_id % 40)"""),
    "coverage_scores": _recursive(_walk(f"""c AS (SELECT world_id, n, {_FAMILY} AS fam, scene_id, lower(coalesce(object_value, '-') || ': ' || supporting_quote) AS body, {_TOKENS.format("coalesce(object_value, '-') || ': ' || supporting_quote")} AS said FROM (SELECT *, assertion_id AS n FROM a) WHERE n % 5 > 1),
{_wanted('e', 'located_at')},
{_wanted('d', 'cannot')},
w AS (SELECT world_id || fam AS grp, row_number() OVER (PARTITION BY world_id, fam ORDER BY expected_id) AS i, coalesce(offers, CAST([] AS BIGINT[])) AS offers FROM e LEFT JOIN (SELECT world_id, fam, expected_id, list_sort(list(n)) AS offers FROM e_met GROUP BY 1, 2, 3) USING (world_id, fam, expected_id))""") + """,
m AS (SELECT world_id, CAST(sum(len(used)) AS BIGINT) AS met FROM taken JOIN (SELECT DISTINCT world_id, fam FROM e) f ON grp = f.world_id || f.fam GROUP BY 1),
x AS (SELECT e.world_id, count(*) AS expected, any_value(coalesce(met, 0)) AS met, any_value((SELECT count(*) FROM c WHERE c.world_id = e.world_id)) - any_value(coalesce(met, 0)) AS left_over, any_value((SELECT count(*) FROM d_met d WHERE d.world_id = e.world_id)) AS decoy_hits FROM e LEFT JOIN m USING (world_id) GROUP BY 1)
SELECT world_id, expected, met, left_over, decoy_hits, met / expected AS recall, coalesce(CAST(met AS DOUBLE) / nullif(met + left_over, 0), 1.0) AS precision FROM x"""),
    "unsuppressed_notes": over_graph(f"{queries_notes._CAND}, {queries_notes._OLD} SELECT n.world_id, n.note_key, n.family, o.status AS prior_status FROM cand n LEFT JOIN old_ o ON o.world_id = n.world_id AND o.note_key = n.note_key WHERE o.status IS NULL OR o.status NOT IN ('sealed', 'dismissed')"),
}
# Each expectation has its scene alone or the words that all findings hold, so its offers are all findings of its world.
ORACLES["score_findings"] = _recursive(_walk(f"""f AS (SELECT world_id, row_number() OVER (PARTITION BY world_id ORDER BY assertion_a, scene_id) AS n, severity FROM ({_DESTROYED})),
w AS (SELECT world_id AS grp, row_number() OVER (PARTITION BY world_id ORDER BY n) AS i, (SELECT list_sort(list(x.n)) FROM f x WHERE x.world_id = f.world_id) AS offers FROM f WHERE n % 3 = 0)""") + """,
t AS (SELECT world_id, count(*) AS all_, count(*) FILTER (n % 3 = 0) AS expected FROM f GROUP BY 1)
SELECT world_id AS run_id, expected, len(used) AS met, all_ - len(used) AS false_positives, CAST(len(used) AS DOUBLE) / expected AS recall FROM t JOIN taken ON grp = world_id WHERE expected > 0""")
