"""Registered queries on notes, questions, the dossier, usage and texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import ask, dossier, notes, usage
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import LABELS
from storyloom.sources import stored, texts
from storyloom.sources.graph import Graph, derive, events

ONE = "one AS (SELECT 1)"
IGNORE = ("fact", "line", "scene")  # words that every derived value has


def _with(fn):
    return lambda s, d: fn(derive(s, d))


def _stored(fn):
    return lambda s, d: fn(stored.derived(s, d))


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _vowed(g: Graph) -> Graph:
    """Every fourth fact is a word of its own, so that some setups are never heard of again."""
    own = F.when(F.col("assertion_id") % 4 == 0, F.concat(F.lit("V"), "assertion_id")).otherwise(F.col("object_value"))
    return g.with_(assertions=g.assertions.withColumn("object_value", own))


def _old_notes(g: Graph) -> DataFrame:
    c = notes.candidates(g, IGNORE)
    n = F.conv(F.substring(F.split("note_key", ":").getItem(1), 1, 4), 16, 10).cast("int")
    status = F.when(n % 5 == 0, "sealed").when(n % 5 == 1, "dismissed").when(n % 5 == 2, "addressed").otherwise("open")
    return c.filter(n % 3 != 0).select("world_id", "note_key", "family", (F.col("salience") + 1).alias("salience"), status.alias("status"), F.lit("run1").alias("first_seen_run"), F.lit("run1").alias("last_seen_run"))


def _new_notes(g: Graph) -> DataFrame:
    n = F.conv(F.substring(F.split("note_key", ":").getItem(1), 5, 4), 16, 10).cast("int")
    return notes.candidates(g, IGNORE).filter(n % 4 != 0)


def _questions(g: Graph) -> DataFrame:
    forms = ("What does {} know?", "What does {} know about fact 3 at scene 40?", "What does {} believe?", "When does {} die?", "Where is the {} located?", "What can't {} do?", "What open promises does {} have?", "What is {}'s job?", "What happened to {}?", "Where does {} appear after her death?", "What does {} know about the Fact 4 and when did it learn?", "What does {} believe these days?", "Why is {} sad?")
    e = g.entities.filter("kind = 'character'")
    per = e.select("world_id", "entity_id", F.posexplode(F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("name"), F.lit(f.split("{}")[1])) for f in forms])).alias("nth", "question"))
    one = per.select(F.concat_ws("-", "world_id", "entity_id", "nth").alias("question_id"), "world_id", "question")
    asked = ("Who knows Fact 7?", "Who knows the Fact 12 in the order they learned it?", "Who knows Fact 2's location?", "Who knows f?")
    who = g.works.select("world_id").distinct().select("world_id", F.posexplode(F.array(*[F.lit(q) for q in asked])).alias("nth", "question"))
    who = who.select(F.concat_ws("-", "world_id", F.lit("who"), "nth").alias("question_id"), "world_id", "question")
    return one.unionByName(who)


# Every job is also told as one of the seven relations, with a place; the same text serves both engines.
RELATION_COLUMNS = {
    "assertion_id": "assertion_id + 1000000000",
    "predicate": "CASE assertion_id % 7 WHEN 0 THEN 'member_of' WHEN 1 THEN 'married_to' WHEN 2 THEN 'parent_of' WHEN 3 THEN 'sibling_of' WHEN 4 THEN 'romantic_with' WHEN 5 THEN 'allied_with' ELSE 'enemy_of' END",
    "object_id": "world_id * 100 + 900000 + assertion_id % 20",
    "object_value": "CAST(NULL AS VARCHAR(9))",
    "fact_key": "CAST(NULL AS VARCHAR(9))",
}


def _with_relations(g: Graph) -> Graph:
    jobs = g.assertions.filter("predicate = 'occupation'")
    return g.with_(assertions=g.assertions.unionByName(jobs.withColumns({c: F.expr(e) for c, e in RELATION_COLUMNS.items()})))


def _usage(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return e.select("event_id", "ts", "user_id", "world_id", F.col("event_type").alias("kind"), F.when(F.col("k") % 3 == 0, "small").when(F.col("k") % 3 == 1, "large").otherwise("other").alias("model"), F.floor(F.abs("value") * 10).cast("long").alias("tokens_in"), F.col("k").cast("long").alias("tokens_out"), (F.col("k") / 100.0).alias("spend"))


def _prices(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES ('small', 0.25BD, 1.25BD), ('large', 3.00BD, 15.00BD) AS t(model, price_in, price_out)").select("model", F.col("price_in").cast("decimal(10,4)").alias("price_in"), F.col("price_out").cast("decimal(10,4)").alias("price_out"))


def price_usage(s: SparkSession, d: str) -> DataFrame:
    p = usage.priced(_usage(s, d), _prices(s))
    return p.groupBy("kind", "model").agg(F.count("*").alias("n"), F.sum("cost").cast("double").alias("cost"))


def usage_rollup(s: SparkSession, d: str) -> DataFrame:
    p = usage.priced(_usage(s, d), _prices(s))
    return usage.rollup(p).withColumn("cost", F.col("cost").cast("double"))


def quota_check(s: SparkSession, d: str) -> DataFrame:
    limits = s.createDataFrame([("click", 3), ("view", 2), ("purchase", 5)], "kind string, limit int")
    q = usage.quota(_usage(s, d), limits, 86400)
    return q.select("event_id", "used", "denied", "retry_after")


def _members(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, o = _table(s, d, "customer"), _table(s, d, "orders")
    worlds = c.select(F.col("c_custkey").alias("world_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("owner_id"))
    role = F.when(F.col("o_orderkey") % 3 == 0, "viewer").when(F.col("o_orderkey") % 3 == 1, "editor").otherwise("owner")
    return worlds, o.select(F.col("o_custkey").alias("world_id"), (F.col("o_orderkey") % 25).cast("string").alias("user_id"), role.alias("role"), F.col("o_orderkey").alias("created_at"))


def account_purge(s: SparkSession, d: str) -> DataFrame:
    worlds, members = _members(s, d)
    return usage.heirs(worlds, members, s.createDataFrame([(str(x),) for x in (1, 2, 3, 7)], "user_id string"))


def last_state_fold(s: SparkSession, d: str) -> DataFrame:
    e = _usage(s, d).withColumn("status", F.when(F.col("kind") == "purchase", "active").when(F.col("kind") == "error", "canceled").when(F.col("kind") == "signup", "trialing").otherwise("past_due")).withColumn("period_end", F.when(F.col("event_id") % 2 == 0, F.unix_timestamp(F.col("ts").cast("timestamp")) + 864000))
    last = usage.last_state(e, "user_id", ["ts", "event_id"], ["status", "period_end", "event_id"])
    return usage.tiers(last, F.lit(1706000000))


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Two claims a document on its last line: about itself, in other spacing, and about the document behind it."""
    docs = _table(s, d, "documents")
    last = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1)
    own = docs.select(F.concat(F.lit("own-"), F.col("doc_id")).alias("claim_id"), "doc_id", F.regexp_replace(last, " ", "  ").alias("quote"))
    return own.unionByName(docs.select(F.concat(F.lit("next-"), F.col("doc_id")).alias("claim_id"), (F.col("doc_id") + 1).alias("doc_id"), last.alias("quote")))


def _headed(pages: DataFrame) -> DataFrame:
    """Pages as texts with a title page of their own title and address."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("Title: "), title, F.lit("\nSource: "), "url", F.lit("\n\n"), "html").alias("text"))


def _results(g: Graph) -> DataFrame:
    return g.assertions.select(F.col("fact_key").alias("case_id"), (F.col("assertion_id") % 3).alias("run"), (F.col("confidence") > 0.3).alias("caught")).filter("case_id is not null")


QUERIES = {
    "note_idle_setup": _with(lambda g: notes.idle_setups(_vowed(g), IGNORE)),
    "note_dormant_knowledge": _with(lambda g: notes.dormant_knowledge(g, IGNORE)),
    "note_unmotivated_turn": _with(notes.unmotivated_turns),
    "note_caps": _stored(lambda g: notes.capped(notes.candidates(g, IGNORE)).select("world_id", "family", "note_key", "salience", "place", "overflow")),
    "note_merge": _stored(lambda g: notes.merge_notes(_old_notes(g), _new_notes(g), "run2")),
    "family_dismissal_rate": _with(lambda g: notes.dismissal_rates(_old_notes(g), 0.2)),
    "ask_route": _with(lambda g: ask.route(_questions(g)).select("question_id", "intent", "subject", "thing", "at")),
    "ask_cited": _with(lambda g: ask.cited(g, _questions(g))),
    "bible_lines": _with(lambda g: dossier.lines(_with_relations(g))),
    "price_usage": price_usage,
    "usage_rollup": usage_rollup,
    "quota_check": quota_check,
    "daily_spend_alert": lambda s, d: usage.spend_alerts(_usage(s, d).withColumn("cost", F.col("tokens_out")), 150.0).select("event_id", "spent"),
    "cost_guard": lambda s, d: usage.cost_guard(_usage(s, d).withColumn("run_id", F.col("user_id")).withColumn("cost", F.col("tokens_out")), 300.0).select("run_id", "event_id", "total"),
    "last_state_fold": last_state_fold,
    "role_visibility": lambda s, d: usage.visible_worlds(*_members(s, d), least="editor"),
    "account_purge": account_purge,
    "purge_world": _with(lambda g: usage.purge_worlds({"assertions": g.assertions, "scenes": g.scenes, "presence": g.presence}, g.works.filter("world_id in (1, 3)").select("world_id").distinct())[1]),
    "run_consistency": _with(lambda g: usage.run_consistency(_results(g))),
    "snapshot_diff": _with(lambda g: usage.snapshot_diff(g.entities.filter("entity_id % 5 <> 0"), g.entities.filter("entity_id % 7 <> 0").withColumn("name", F.when(F.col("entity_id") % 3 == 0, "renamed").otherwise(F.col("name"))), ["world_id", "entity_id"])),
    "scene_segmentation": lambda s, d: texts.segment(_table(s, d, "documents"), heading=r"^[A-ZÄÖÜÉÈÑÓ]\S*\.$|^The ", blank_before=False).withColumn("body", F.md5("body")),
    "title_page": lambda s, d: texts.title_page(_headed(_table(s, d, "pages"))),
    "story_positions": lambda s, d: texts.story_positions(derive(s, d).works, derive(s, d).scenes.select("work_id", F.col("scene_id").alias("scene"))),
    "evidence_gate": lambda s, d: texts.evidence_gate(_claims(s, d), _table(s, d, "documents").select("doc_id", "text")),
    "corpus_policy_scan": lambda s, d: texts.policy_scan(_table(s, d, "documents"), r"AKIA[0-9A-Z]{16}|password=|token = ", r"^The "),
    "leak_check": lambda s, d: texts.leak_check(_table(s, d, "documents"), "Licensed under"),
}

_TOK = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', 'fact', 'line', 'scene', " + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))"
_BASE = f"""{LABELS}, thr AS (SELECT world_id, CAST(greatest(15, max(n)) AS INT) AS threshold FROM (SELECT s.world_id, title, count(*) AS n FROM scenes s JOIN works w USING (world_id, work_id) GROUP BY 1, 2) GROUP BY 1),
mx AS (SELECT world_id, max(story_position) AS max_at FROM scenes GROUP BY 1),
base AS (SELECT a.*, s.story_position AS apos, max_at, threshold, e.name, l.label, {_TOK.format("coalesce(object_value, '')")} AS ov, {_TOK.format("concat_ws(' ', object_value, supporting_quote)")} AS ovq
 FROM a JOIN scenes s USING (world_id, scene_id) JOIN mx USING (world_id) JOIN thr USING (world_id) JOIN entities e ON e.world_id = a.world_id AND e.entity_id = a.subject_id JOIN labels_ l ON l.world_id = a.world_id AND l.scene_id = a.scene_id
 WHERE status NOT IN ('sealed', 'retconned', 'rejected')),
heard AS (SELECT world_id, term, max(apos) AS last_at FROM (SELECT world_id, apos, unnest(ovq) AS term FROM base) GROUP BY 1, 2),
acted AS (SELECT world_id, subject_id, term, max(apos) AS last_at FROM (SELECT world_id, subject_id, apos, unnest(ovq) AS term FROM base WHERE predicate NOT IN ('knows', 'believes')) GROUP BY 1, 2, 3)"""
_VOWED = _BASE.replace("FROM a JOIN scenes", "FROM (SELECT * REPLACE (CASE WHEN assertion_id % 4 = 0 THEN 'V' || assertion_id ELSE object_value END AS object_value) FROM a) a JOIN scenes", 1)
_KEY = "'{0}:' || left(sha256(coalesce(x.name, '') || chr(31) || coalesce(x.predicate, '') || chr(31) || coalesce(x.object_value, '') || chr(31) || coalesce(x.label, '') || chr(31) || coalesce(x.supporting_quote, '')), 24)"
_NOTE = "SELECT x.world_id, '{0}' AS family, " + _KEY + " AS note_key, CAST({1} AS BIGINT) AS salience, x.assertion_id, x.scene_id, x.label"
_F2 = _NOTE.format("F2", "(max_at - apos) * 10 + CASE WHEN predicate IN ('promised', 'goal') THEN 20 ELSE 0 END") + """ FROM base x WHERE predicate IN ('promised', 'goal', 'secret_of', 'created') AND max_at - apos >= threshold
 AND NOT EXISTS (SELECT 1 FROM heard h WHERE h.world_id = x.world_id AND list_contains(x.ov, h.term) AND h.last_at > x.apos)
 AND NOT EXISTS (SELECT 1 FROM base l WHERE l.world_id = x.world_id AND l.apos > x.apos AND x.object_id IS NOT NULL AND (l.subject_id = x.object_id OR l.object_id = x.object_id))"""
_WORDS = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', 'fact', 'line', 'scene', " + ", ".join(f"'{w}'" for w in (*text.STOP_WORDS, *text.THREAD_VERBS)) + "))"
CONCERNS = f"""ct AS (SELECT DISTINCT world_id, entity_id, term FROM (SELECT world_id, entity_id, unnest({_WORDS.format("name")}) AS term FROM (SELECT world_id, entity_id, name FROM entities UNION ALL SELECT world_id, entity_id, alias FROM aliases))),
cf AS (SELECT DISTINCT f.world_id, f.assertion_id, ct.entity_id FROM (SELECT world_id, assertion_id, subject_id, unnest({_WORDS.format("concat_ws(' ', object_value, supporting_quote)")}) AS term FROM a WHERE status NOT IN ('sealed', 'retconned', 'rejected')) f JOIN ct USING (world_id, term) WHERE ct.entity_id <> f.subject_id)"""
_F1KEY = _KEY.format("F1").replace(", 24)", ", 24)").replace("coalesce(x.supporting_quote, ''))", "coalesce(x.supporting_quote, '') || chr(31) || x.kind)")
_F1ROW = "SELECT x.world_id, 'F1' AS family, " + _F1KEY + " AS note_key, CAST({0} AS BIGINT) AS salience, x.assertion_id, x.scene_id, x.label FROM ({1}) x"
_NOT_HEARD = """NOT EXISTS (SELECT 1 FROM heard h WHERE h.world_id = b.world_id AND list_contains(b.ov, h.term) AND h.last_at > b.apos)
 AND NOT EXISTS (SELECT 1 FROM base l WHERE l.world_id = b.world_id AND l.apos > b.apos AND b.object_id IS NOT NULL AND (l.subject_id = b.object_id OR l.object_id = b.object_id))"""


def open_questions_sql(relations: tuple[str, ...]) -> str:
    rel = ", ".join(f"'{r}'" for r in relations)
    arms = (
        ("90", "SELECT *, 'unknown_entity' AS kind FROM (SELECT b.*, row_number() OVER (PARTITION BY b.world_id, e.entity_id ORDER BY apos, assertion_id) AS nth FROM base b JOIN entities e ON e.world_id = b.world_id AND (e.entity_id = b.subject_id OR e.entity_id = b.object_id) AND e.provisional) WHERE nth = 1"),
        ("65 + max_at - apos", f"SELECT b.*, 'open_thread' AS kind FROM base b WHERE predicate IN ('promised', 'goal', 'secret_of') AND max_at - apos >= threshold AND {_NOT_HEARD}"),
        ("40", f"SELECT *, 'single_relation' AS kind FROM (SELECT b.*, count(*) OVER (PARTITION BY world_id, subject_id, predicate, object_id, fact_key) AS told FROM base b) WHERE told = 1 AND predicate IN ({rel}) AND max_at - apos >= threshold"),
        ("35", "SELECT b.*, 'unexercised' AS kind FROM base b WHERE predicate IN ('cannot', 'trait') AND max_at - apos >= threshold AND NOT EXISTS (SELECT 1 FROM base l WHERE l.world_id = b.world_id AND l.subject_id = b.subject_id AND l.predicate IN ('fact', 'cannot') AND l.apos > b.apos AND len(list_intersect(l.ov, b.ov)) > 0)"),
    )
    return " UNION ALL ".join(_F1ROW.format(s, q) for s, q in arms)


_F3CTE = CONCERNS + """,
learned AS (SELECT world_id, subject_id, term, max(apos) AS last_at FROM (SELECT world_id, subject_id, apos, unnest(ov) AS term FROM base WHERE predicate IN ('knows', 'believes')) GROUP BY 1, 2, 3)"""
_F3 = _NOTE.format("F3", "55 + max_at - apos + 5 * (SELECT count(*) FROM cf WHERE cf.world_id = x.world_id AND cf.assertion_id = x.assertion_id)") + """ FROM base x WHERE predicate IN ('knows', 'believes') AND object_value IS NOT NULL AND max_at - apos >= greatest(3, floor(threshold / 2.0))
 AND NOT EXISTS (SELECT 1 FROM acted h WHERE h.world_id = x.world_id AND h.subject_id = x.subject_id AND list_contains(x.ov, h.term) AND h.last_at > x.apos)
 AND NOT EXISTS (SELECT 1 FROM cf JOIN learned h ON h.world_id = cf.world_id AND h.subject_id = cf.entity_id WHERE cf.world_id = x.world_id AND cf.assertion_id = x.assertion_id AND list_contains(x.ov, h.term) AND h.last_at > x.apos)"""
_MOTIVE = "(SELECT max(m.apos) FROM base m WHERE m.world_id = x.world_id AND m.subject_id = x.subject_id AND m.predicate IN ('goal', 'promised', 'believes', 'knows') AND m.apos < x.apos)"
_F4X = f"f4x AS (SELECT x.*, {_MOTIVE} AS motive_at FROM base x WHERE EXISTS (SELECT 1 FROM entities e WHERE e.world_id = x.world_id AND e.entity_id = x.subject_id AND e.kind = 'character') AND (predicate IN ('located_at', 'destroyed') OR (predicate = 'cannot' AND NOT polarity)))"
_F4 = _NOTE.format("F4", "CASE WHEN motive_at IS NULL THEN 50 ELSE greatest(10, 45 - (apos - motive_at)) END")
_CAND = f"""{_BASE}, {_F3CTE}, {_F4X}, raw_notes AS ({_F2} UNION ALL {_F3} UNION ALL {_F4} FROM f4x x UNION ALL {open_questions_sql(notes.RELATIONS)}),
cand AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY world_id, note_key ORDER BY salience DESC, assertion_id) AS nth FROM raw_notes r
 WHERE NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = r.world_id AND c.family = r.family AND NOT c.enabled)) WHERE nth = 1)"""
_HEX = "CAST('0x' || substr(note_key, {}, 4) AS INT)"
_OLD = f"""old_ AS (SELECT world_id, note_key, family, salience + 1 AS salience, CASE {_HEX.format(4)} % 5 WHEN 0 THEN 'sealed' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'addressed' ELSE 'open' END AS status FROM cand WHERE {_HEX.format(4)} % 3 <> 0),
new_ AS (SELECT * FROM cand WHERE {_HEX.format(8)} % 4 <> 0)"""
_Q = """qs AS (SELECT world_id, entity_id, name, nth, question FROM (SELECT *, unnest(range(0, 13)) AS nth, unnest(['What does ' || name || ' know?', 'What does ' || name || ' know about fact 3 at scene 40?', 'What does ' || name || ' believe?', 'When does ' || name || ' die?', 'Where is the ' || name || ' located?', 'What can''t ' || name || ' do?', 'What open promises does ' || name || ' have?', 'What is ' || name || '''s job?', 'What happened to ' || name || '?', 'Where does ' || name || ' appear after her death?', 'What does ' || name || ' know about the Fact 4 and when did it learn?', 'What does ' || name || ' believe these days?', 'Why is ' || name || ' sad?']) AS question FROM entities WHERE kind = 'character')),
rt AS (SELECT world_id || '-' || entity_id || '-' || nth AS question_id, world_id, entity_id, ['knows', 'knows', 'believes', 'dies', 'located_at', 'cannot', 'open_promised', 'occupation', 'event', 'after_death', 'knows', 'believes', NULL][nth + 1] AS intent, CASE WHEN nth < 12 THEN lower(name) END AS subject, CASE nth WHEN 1 THEN 'fact 3' WHEN 10 THEN 'fact 4' END AS thing, CASE WHEN nth = 1 THEN 40 END AS "at" FROM qs
 UNION ALL SELECT DISTINCT world_id || '-who-' || nth, world_id, NULL, 'who_knows', NULL, thing, NULL FROM works, (VALUES (0, 'fact 7'), (1, 'fact 12'), (2, 'fact 2 location'), (3, 'f')) t(nth, thing))"""
_ASK = f"""{_Q}, {LABELS}, live AS (SELECT a.*, s.story_position, trim(regexp_replace(lower(object_value), '[^a-z0-9]+', ' ', 'g')) AS nv FROM a JOIN scenes s USING (world_id, scene_id) WHERE status NOT IN ('rejected', 'retconned')),
rows_ AS (
 SELECT r.question_id, r.world_id, l.assertion_id, l.scene_id, l.lo, l.story_position AS pos FROM rt r JOIN live l ON l.world_id = r.world_id AND l.subject_id = r.entity_id
  WHERE (CASE r.intent WHEN 'event' THEN l.predicate IN ('dies', 'destroyed', 'created', 'fact') WHEN 'open_promised' THEN l.predicate = 'promised' AND l.hi IS NULL WHEN 'located_at' THEN l.predicate = 'located_at' AND l.object_id IS NOT NULL ELSE l.predicate = r.intent END)
   AND (r.thing IS NULL OR contains(l.nv, r.thing)) AND (r."at" IS NULL OR ((l.lo IS NULL OR l.lo <= r."at") AND (l.hi IS NULL OR r."at" < l.hi)))
 UNION ALL SELECT r.question_id, r.world_id, l.assertion_id, l.scene_id, l.lo, l.story_position FROM rt r JOIN live l ON l.world_id = r.world_id AND l.predicate = 'knows' AND contains(l.nv, r.thing) WHERE r.intent = 'who_knows'
 UNION ALL SELECT r.question_id, r.world_id, l.assertion_id, s.scene_id, s.story_position, s.story_position FROM rt r JOIN live l ON l.world_id = r.world_id AND l.subject_id = r.entity_id AND l.predicate = 'dies' AND l.lo IS NOT NULL JOIN presence p ON p.world_id = r.world_id AND p.entity_id = r.entity_id JOIN scenes s ON s.world_id = p.world_id AND s.scene_id = p.scene_id WHERE r.intent = 'after_death' AND s.story_position > l.lo),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lo NULLS LAST, pos, assertion_id, scene_id) AS place, count(*) OVER (PARTITION BY question_id) > 50 AS truncated FROM rows_),
agg AS (SELECT question_id, count(*) AS n, bool_or(truncated) AS truncated, string_agg(label, ',' ORDER BY place) AS citations FROM ranked JOIN labels_ USING (world_id, scene_id) WHERE place <= 50 GROUP BY 1)
SELECT r.question_id, r.world_id, r.intent, CASE WHEN r.intent IS NULL THEN 'refused' WHEN n IS NULL THEN 'no_support' ELSE 'answered' END AS status, coalesce(n, 0) AS n, coalesce(truncated, false) AS truncated, citations FROM rt r LEFT JOIN agg USING (question_id)"""
_RELATED = f"""ar AS (SELECT * FROM a UNION ALL BY NAME SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in RELATION_COLUMNS.items())}) FROM a WHERE predicate = 'occupation')"""
_BIBLE = f"""{LABELS}, {_RELATED},
b AS (SELECT ar.*, CASE WHEN predicate IN ('trait', 'occupation', 'goal', 'fact') THEN predicate WHEN predicate IN ('knows', 'believes') THEN 'knowledge' WHEN predicate = 'destroyed' THEN 'place' WHEN predicate = 'cannot' THEN 'rule'
      WHEN predicate = 'promised' THEN 'open' WHEN predicate IN ('member_of', 'married_to', 'parent_of', 'sibling_of', 'romantic_with', 'allied_with', 'enemy_of') THEN 'relationship' END AS section FROM ar WHERE status NOT IN ('retconned', 'rejected'))
SELECT b.world_id, section, e.name, CAST(row_number() OVER (PARTITION BY b.world_id, section, b.subject_id ORDER BY story_position, b.assertion_id) AS INT) AS ord,
 concat_ws(' ', CASE WHEN NOT b.polarity THEN 'not' END, replace(b.predicate, '_', ' '), coalesce(o.name, b.object_value, n.object_value, ''), CASE WHEN section = 'knowledge' THEN 'learned at ' || label END) AS text,
 label, CASE WHEN b.status IN ('draft', 'sealed') THEN b.status ELSE '' END AS note, b.assertion_id
FROM b JOIN labels_ l ON l.world_id = b.world_id AND l.scene_id = b.scene_id JOIN entities e ON e.world_id = b.world_id AND e.entity_id = b.subject_id
LEFT JOIN entities o ON o.world_id = b.world_id AND o.entity_id = b.object_id LEFT JOIN a n ON n.world_id = b.world_id AND n.assertion_id = b.object_assertion_id WHERE section IS NOT NULL"""
_U = "u AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id, world_id, event_type AS kind, CASE k % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, CAST(floor(abs(value) * 10) AS BIGINT) AS tokens_in, CAST(k AS BIGINT) AS tokens_out FROM ev)"
_P = _U + ", p AS (SELECT u.*, kind || CASE WHEN model = 'other' THEN ':unpriced' ELSE '' END AS kind2, CASE model WHEN 'small' THEN (tokens_in * 25 + tokens_out * 125 + 5000) // 10000 WHEN 'large' THEN (tokens_in * 300 + tokens_out * 1500 + 5000) // 10000 ELSE 0 END AS cost FROM u)"
_MEMBERS = """WITH worlds AS (SELECT c_custkey AS world_id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS owner_id FROM customer),
members AS (SELECT o_custkey AS world_id, CAST(o_orderkey % 25 AS VARCHAR) AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'owner' END AS role, o_orderkey AS created_at FROM orders)"""

ORACLES = {
    "note_idle_setup": over_graph(f"{_VOWED} {_F2}"),
    "note_dormant_knowledge": over_graph(f"{_BASE}, {_F3CTE} {_F3}"),
    "note_unmotivated_turn": over_graph(f"{_BASE}, {_F4X} {_F4}, motive_at, CASE WHEN motive_at IS NULL THEN 'absent' ELSE 'distant' END AS motivation_status FROM f4x x"),
    "note_caps": over_graph(f"{_CAND} SELECT world_id, family, note_key, salience, CAST(place AS INT) AS place, greatest(0, n - cap) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY world_id, family ORDER BY salience DESC, note_key) AS place, count(*) OVER (PARTITION BY world_id, family) AS n, CASE family WHEN 'F1' THEN 12 WHEN 'F2' THEN 8 WHEN 'F3' THEN 6 ELSE 5 END AS cap FROM cand) WHERE place <= cap"),
    "note_merge": over_graph(f"{_CAND}, {_OLD} SELECT coalesce(o.world_id, n.world_id) AS world_id, coalesce(o.note_key, n.note_key) AS note_key, coalesce(o.family, n.family) AS family, CASE WHEN o.status IN ('sealed', 'dismissed') OR n.note_key IS NULL THEN o.salience ELSE n.salience END AS salience, CASE WHEN o.status IN ('sealed', 'dismissed') THEN o.status WHEN n.note_key IS NOT NULL THEN 'open' ELSE 'addressed' END AS status, CASE WHEN o.note_key IS NULL THEN 'run2' ELSE 'run1' END AS first_seen_run, CASE WHEN o.status IN ('sealed', 'dismissed') OR (n.note_key IS NULL AND o.status = 'addressed') THEN 'run1' ELSE 'run2' END AS last_seen_run FROM old_ o FULL JOIN new_ n ON n.world_id = o.world_id AND n.note_key = o.note_key"),
    "family_dismissal_rate": over_graph(f"{_CAND}, {_OLD} SELECT world_id, family, count(*) FILTER (status = 'dismissed') AS dismissed, count(*) AS n, count(*) FILTER (status = 'dismissed') > 0.2 * count(*) AS switch_off FROM old_ GROUP BY 1, 2"),
    "ask_route": over_graph(f"{_Q} SELECT question_id, intent, subject, thing, \"at\" FROM rt"),
    "ask_cited": over_graph(_ASK),
    "bible_lines": over_graph(_BIBLE),
    "price_usage": over_graph(f"{_P} SELECT kind2 AS kind, model, count(*) AS n, CAST(sum(cost) AS DOUBLE) / 10000 AS cost FROM p GROUP BY 1, 2"),
    "usage_rollup": over_graph(f"{_P} SELECT world_id, user_id, count(*) AS events, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost) AS DOUBLE) / 10000 AS cost FROM p GROUP BY GROUPING SETS ((world_id), (user_id))"),
    "quota_check": over_graph(f"{_U}, w AS (SELECT *, count(*) OVER x AS used, min(sec) OVER x AS oldest, CASE kind WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 END AS lim FROM u WINDOW x AS (PARTITION BY user_id, kind ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)) SELECT event_id, used, coalesce(used > lim, false) AS denied, CASE WHEN used > lim THEN oldest + 86400 - sec END AS retry_after FROM w"),
    "daily_spend_alert": over_graph(f"{_U} SELECT event_id, CAST(spent AS BIGINT) AS spent FROM (SELECT event_id, sum(tokens_out) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS spent FROM u) WHERE spent > 150"),
    "cost_guard": over_graph(f"{_U} SELECT user_id AS run_id, event_id, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT *, sum(tokens_out) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM u) WHERE total > 300) WHERE nth = 1"),
    "last_state_fold": over_graph(f"{_U}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM u), s AS (SELECT user_id, CASE kind WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'canceled' WHEN 'signup' THEN 'trialing' ELSE 'past_due' END AS status, CASE WHEN event_id % 2 = 0 THEN sec + 864000 END AS period_end, event_id FROM l WHERE nth = 1) SELECT *, CASE WHEN status IN ('active', 'trialing') AND (period_end IS NULL OR period_end > 1706000000) THEN 'paid' ELSE 'free' END AS tier FROM s"),
    "role_visibility": _MEMBERS + ", b AS (SELECT world_id, owner_id AS user_id, 3 AS r FROM worlds UNION ALL SELECT world_id, user_id, CASE role WHEN 'viewer' THEN 1 WHEN 'editor' THEN 2 ELSE 3 END FROM members) SELECT user_id, world_id, CASE max(r) WHEN 2 THEN 'editor' ELSE 'owner' END AS role FROM b WHERE user_id IS NOT NULL GROUP BY 1, 2 HAVING max(r) >= 2",
    "account_purge": _MEMBERS + ", h AS (SELECT world_id, arg_min(user_id, created_at) AS heir FROM members WHERE role = 'owner' AND user_id NOT IN ('1', '2', '3', '7') GROUP BY 1) SELECT w.world_id, w.owner_id, heir, CASE WHEN heir IS NULL THEN 'purge' ELSE 'reassign' END AS action FROM worlds w LEFT JOIN h USING (world_id) WHERE owner_id IN ('1', '2', '3', '7')",
    "purge_world": over_graph(ONE + " SELECT 'assertions' AS table_name, world_id, count(*) AS n FROM a WHERE world_id IN (1, 3) GROUP BY 2 UNION ALL SELECT 'scenes', world_id, count(*) FROM scenes WHERE world_id IN (1, 3) GROUP BY 2 UNION ALL SELECT 'presence', world_id, count(*) FROM presence WHERE world_id IN (1, 3) GROUP BY 2"),
    "run_consistency": over_graph(ONE + " SELECT fact_key AS case_id, count(*) FILTER (confidence > 0.3) AS caught, count(*) AS runs, CASE WHEN count(*) FILTER (confidence > 0.3) = count(*) THEN 'every' WHEN count(*) FILTER (confidence > 0.3) > 0 THEN 'some' ELSE 'never' END AS verdict FROM a WHERE fact_key IS NOT NULL GROUP BY 1"),
    "snapshot_diff": over_graph(ONE + ", o AS (SELECT * FROM entities WHERE entity_id % 5 <> 0), n AS (SELECT world_id, entity_id, CASE WHEN entity_id % 3 = 0 THEN 'renamed' ELSE name END AS name FROM entities WHERE entity_id % 7 <> 0) SELECT coalesce(o.world_id, n.world_id) AS world_id, coalesce(o.entity_id, n.entity_id) AS entity_id, CASE WHEN o.entity_id IS NULL THEN 'added' WHEN n.entity_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON n.world_id = o.world_id AND n.entity_id = o.entity_id WHERE o.entity_id IS NULL OR n.entity_id IS NULL OR o.name <> n.name"),
    "scene_segmentation": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
h AS (SELECT *, regexp_matches(trim(line), '^[A-ZÄÖÜÉÈÑÓ]\S*\.$|^The ') AS head FROM l), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS scene FROM h),
g AS (SELECT doc_id, scene, max(trim(line)) FILTER (head) AS heading, count(*) AS n_lines, coalesce(string_agg(regexp_replace(line, '\s+$', ''), chr(10) ORDER BY pos) FILTER (NOT head), '') AS body FROM s WHERE scene > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(scene AS BIGINT) AS scene, heading, false AS is_flashback, n_lines, md5(regexp_replace(regexp_replace(body, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS body FROM g""",
    "title_page": r"""WITH h AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, url FROM pages)
SELECT page_id AS doc_id, 'title' AS key, title AS value FROM h WHERE title <> '' UNION ALL SELECT page_id, 'source', url FROM h WHERE trim(url) <> ''""",
    "story_positions": over_graph(ONE + " SELECT s.world_id, s.work_id, scene_id AS scene, row_number() OVER (PARTITION BY s.world_id ORDER BY CAST(regexp_extract(title, '([0-9]+)', 1) AS INT), s.work_id, scene_id) AS position FROM scenes s JOIN works w USING (world_id, work_id)"),
    "evidence_gate": r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[-1] AS line FROM documents),
c AS (SELECT 'own-' || doc_id AS claim_id, doc_id, replace(line, ' ', '  ') AS quote FROM l UNION ALL SELECT 'next-' || doc_id, doc_id + 1, line FROM l)
SELECT claim_id, c.doc_id, CASE WHEN trim(quote) = '' THEN 'no_quote' WHEN d.text IS NULL THEN 'no_source' WHEN NOT contains(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '\s+', ' ', 'g'))), lower(trim(regexp_replace(translate(quote, '‘’“”–—', '''''""--'), '\s+', ' ', 'g')))) THEN 'quote_not_found' ELSE 'keep' END AS verdict FROM c LEFT JOIN documents d USING (doc_id)""",
    "corpus_policy_scan": "SELECT doc_id, h AS headings, s AS has_secret, h >= 3 OR s AS flagged FROM (SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^The '))) AS BIGINT) AS h, coalesce(regexp_matches(text, 'AKIA[0-9A-Z]{16}|password=|token = '), false) AS s FROM documents)",
    "leak_check": "SELECT doc_id, CAST(len(regexp_extract_all(text, 'Licensed under')) AS BIGINT) AS n FROM documents WHERE contains(text, 'Licensed under')",
}
