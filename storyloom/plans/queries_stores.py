"""Registered queries on scripts, marked quotes, versioned worlds, isolated checks and SQL functions, and their SQL."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import sql as sql_functions
from storyloom.functions import text
from storyloom.operators import checks, dossier, lifecycle, versions
from storyloom.operators.lineage import folder
from storyloom.plans import queries_tables
from storyloom.plans.oracle_graph import over_graph
from storyloom.plans.queries_checks import _CAPABILITY, _CONFLICT, _DANGLING, _DEAD, _DESTROYED
from storyloom.sources import scripts, stored
from storyloom.sources.graph import Graph, derive

# A script for every work, as one expression for both engines: a title page, and per scene a heading with a number, lines with annotations, a line that only
# looks like a heading, and a flashback that every other time runs on into the next scenes.
PIECE = (
    "concat(CASE WHEN is_flashback THEN concat('FLASHBACK:', chr(10), chr(10)) ELSE '' END, slug, ' #', CAST(story_position AS VARCHAR(10)), '#', chr(10), raw_text, ' [PLANTED: x] more', chr(10), chr(10), "
    "'[PLANTED: a whole line]', chr(10), 'a tail line', chr(10), 'INT. NO HEADING - DAY', chr(10), chr(10), CASE WHEN is_flashback AND story_position % 22 <> 0 THEN concat('END FLASHBACK', chr(10), chr(10)) ELSE '' END)"
)
PAGE = "concat('Title: SHOW ', CAST(world_id AS VARCHAR(10)), chr(10), 'Episode: ', CAST(100 + work_id % 100 AS VARCHAR(10)), ' \"Day ', chr(10), '  and night\"', chr(10), chr(10))"


def _scripts(g: Graph) -> DataFrame:
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("story_position", F.expr(PIECE).alias("piece")))), lambda x: x["piece"]), "")
    return g.scenes.groupBy("world_id", "work_id").agg(pieces.alias("pieces")).select(F.col("work_id").alias("doc_id"), F.concat(F.expr(PAGE), "pieces").alias("text"))


def _marked(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    # A quote of each text in another hand: capitals, curly quotes and long dashes.
    quote = F.translate(text.first_quote("text"), string.ascii_lowercase + "'\"-", string.ascii_uppercase + "’”—")
    marked = text.highlight("text", quote)
    span = text.quote_span("text", quote)
    return docs.select("doc_id", F.col("text").isNotNull().alias("has_text"), span["start"].cast("long").alias("starts"), (F.size(F.split(marked, "<mark>")) - 1).cast("long").alias("marks"), F.sha2(marked.cast("binary"), 256).alias("html_sha256"))


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """Uses after death of all worlds, then conflicts of place instead in worlds 1 and 2, of which the second has none."""
    g = derive(s, d)
    path = folder(s, "findings")
    first, second = checks.dead_speaker(g), checks.presence_conflict(g)
    worlds = g.works.select("world_id").distinct()
    versions.replace(first, worlds, path)
    versions.replace(second, worlds.filter(F.col("world_id").isin(1, 2)), path)
    return versions.read(s, path, first.schema.simpleString()[len("struct<") : -1].replace(":", " "))


def _isolated(s: SparkSession, d: str) -> DataFrame:
    def broken(g: Graph) -> DataFrame:
        """Plans well, and fails on the first row: a quote is no number."""
        return checks.dead_speaker(g).withColumn("severity", F.raise_error(F.concat(F.lit("no severity for "), "explanation")).cast("string"))

    own = {"dead_speaker": checks.dead_speaker, "destroyed_location_use": checks.destroyed_location_use, "dangling_reference": checks.dangling_reference, "broken": broken}
    found, failed = checks.isolated(derive(s, d), own)
    return checks.run_report(found, list(own), failed)


def _asked(s: SparkSession, d: str) -> DataFrame:
    sql_functions.register(s)
    a = derive(s, d).assertions
    return s.sql(
        """
        SELECT x.assertion_id, y.assertion_id AS other, norm_strip(x.object_value) AS fact, quote_norm(concat('  “', x.supporting_quote, '”  ')) AS quote, range_gloss(x.lo, x.hi) AS gloss, slugify(x.object_value) AS slug
        FROM {a} x JOIN {a} y ON x.world_id = y.world_id AND x.subject_id = y.subject_id AND norm_strip(x.object_value) = norm_strip(y.object_value)
        WHERE x.assertion_id < y.assertion_id AND range_overlaps(x.lo, x.hi, y.lo, y.hi) AND NOT range_is_empty(x.lo, x.hi)
        """,
        a=a,
    )


def _files(g: Graph) -> DataFrame:
    """Candidate files as tools write them: a world's scenes, each with its assertions inside."""
    one = g.assertions.join(g.scenes.select("world_id", "scene_id", "story_position"), ["world_id", "scene_id"])
    scene = one.groupBy("world_id", "scene_id", "story_position").agg(F.collect_list(F.struct("assertion_id", "predicate", "object_value")).alias("assertions"))
    return scene.groupBy(F.col("world_id").alias("world")).agg(F.collect_list(F.struct("scene_id", "story_position", "assertions")).alias("scenes"))


def _ordered(g: Graph) -> DataFrame:
    """Findings in the order of a report: the worst first, then by check, scene and ids."""
    found = reduce(DataFrame.unionByName, (f(g) for f in (checks.dead_speaker, checks.destroyed_location_use, checks.capability_violation, checks.dangling_reference)))
    order = Window.partitionBy("world_id").orderBy(checks.severity_rank(), "check_name", "scene_id", "assertion_a", F.asc_nulls_first("assertion_b"))
    return found.select("world_id", F.row_number().over(order).alias("place"), "severity", "check_name", "scene_id", "assertion_a", "assertion_b")


QUERIES = {
    "flat_candidates": lambda s, d: lifecycle.flatten_candidates(_files(derive(s, d))),
    "drop_counts": lambda s, d: lifecycle.drop_counts(queries_tables.QUERIES["gated_rows"](s, d)),
    "bible_omitted": lambda s, d: dossier.omitted((g := derive(s, d)).with_(scenes=g.scenes.filter("NOT is_flashback"))),
    "finding_order": lambda s, d: _ordered(stored.derived(s, d)),
    "script_scenes": lambda s, d: scripts.scenes(_scripts(derive(s, d))),
    "script_works": lambda s, d: scripts.works(_scripts(derive(s, d))),
    "quote_marks": _marked,
    "replaced_worlds": _replaced,
    "isolated_checks": _isolated,
    "sql_functions": _asked,
}

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_QN = "lower(trim(regexp_replace(translate({0}, '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g')))"
COLS = "world_id, check_name, severity, explanation, scene_id, assertion_a, assertion_b"
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS check_name, 'ran' AS status, (SELECT count(*) FROM ({q})) AS n_findings" for n, q in (("dead_speaker", _DEAD), ("destroyed_location_use", _DESTROYED), ("dangling_reference", _DANGLING)))
ORACLES = {
    "flat_candidates": over_graph("one AS (SELECT 1) SELECT a.world_id AS world, a.scene_id, story_position, assertion_id, predicate, object_value FROM a JOIN scenes USING (world_id, scene_id)"),
    "drop_counts": f"SELECT verdict, count(*) AS n FROM ({queries_tables.ORACLES['gated_rows']}) GROUP BY 1",
    "bible_omitted": over_graph("one AS (SELECT 1) SELECT world_id, count(*) AS omitted FROM a WHERE status NOT IN ('retconned', 'rejected') AND NOT EXISTS (SELECT 1 FROM scenes s WHERE s.world_id = a.world_id AND s.scene_id = a.scene_id AND NOT is_flashback) GROUP BY 1"),
    "finding_order": over_graph(f"""one AS (SELECT 1)
SELECT world_id, CAST(row_number() OVER (PARTITION BY world_id ORDER BY list_position(['critical', 'warning', 'note'], severity), check_name, scene_id, assertion_a, assertion_b NULLS FIRST) AS INT) AS place, severity, check_name, scene_id, assertion_a, assertion_b
FROM ({" UNION ALL ".join(f"SELECT {COLS} FROM ({q})" for q in (_DEAD, _DESTROYED, _CAPABILITY, _DANGLING))})"""),
    # What the scripts were made of, without reading them.
    "script_scenes": over_graph("""one AS (SELECT 1)
SELECT work_id AS doc_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY story_position) AS INT) AS scene, slug,
       is_flashback OR EXISTS (SELECT 1 FROM scenes f WHERE f.work_id = s.work_id AND f.is_flashback AND f.story_position % 22 = 0 AND f.story_position < s.story_position
         AND NOT EXISTS (SELECT 1 FROM scenes e WHERE e.work_id = s.work_id AND e.is_flashback AND e.story_position % 22 <> 0 AND e.story_position > f.story_position AND e.story_position < s.story_position)) AS is_flashback,
       slug || ' #' || story_position || '#' || chr(10) || raw_text || '  more' || chr(10) || chr(10) || 'a tail line' || chr(10) || 'INT. NO HEADING - DAY' AS raw_text
FROM scenes s"""),
    "script_works": over_graph("""one AS (SELECT 1)
SELECT work_id AS doc_id, 'E' || (100 + work_id % 100) || ' — Day  and night' AS title, 'SHOW ' || world_id AS show_title, CAST(100 + work_id % 100 AS INT) AS episode, 2 * count(*) AS n_stripped
FROM scenes GROUP BY work_id, world_id""".replace("Day  and", "Day and")),
    "replaced_worlds": over_graph(f"""one AS (SELECT 1)
SELECT {COLS} FROM ({_DEAD}) WHERE world_id NOT IN (1, 2) UNION ALL SELECT {COLS} FROM ({_CONFLICT}) WHERE world_id IN (1, 2)"""),
    "isolated_checks": over_graph(f"one AS (SELECT 1) {_COUNTS} UNION ALL SELECT 'broken', 'failed', 0"),
    "sql_functions": over_graph("""one AS (SELECT 1)
SELECT x.assertion_id, y.assertion_id AS other, x.fact_key AS fact, '"' || lower(x.supporting_quote) || '"' AS quote,
       CASE WHEN x.lo IS NULL AND x.hi IS NULL THEN 'all positions' WHEN x.hi IS NULL THEN 'pos ' || x.lo || ' onward' WHEN x.lo IS NULL THEN 'through pos ' || (x.hi - 1) WHEN x.lo = x.hi - 1 THEN 'pos ' || x.lo ELSE 'pos ' || x.lo || '–' || (x.hi - 1) END AS gloss,
       trim(regexp_replace(lower(x.object_value), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM a x JOIN a y ON x.world_id = y.world_id AND x.subject_id = y.subject_id AND x.fact_key = y.fact_key AND x.assertion_id < y.assertion_id
WHERE (x.lo IS NULL OR y.hi IS NULL OR x.lo < y.hi) AND (y.lo IS NULL OR x.hi IS NULL OR y.lo < x.hi) AND NOT coalesce(x.lo >= x.hi, false) AND NOT coalesce(y.lo >= y.hi, false)"""),
    # The quote's first words are matched letter by letter by DuckDB's own expressions.
    "quote_marks": rf"""
WITH q AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: length(l) >= 8)[1][1:240] AS line FROM documents),
p AS (SELECT doc_id, text, {_QN.format("line")} AS n FROM q),
r AS (SELECT doc_id, text, CASE WHEN n <> '' THEN '(?i)' || replace(replace(replace(regexp_replace(n, '([][.*+?(){{}}|^$\\])', '\\\1', 'g'), '-', '[-–—]'), '''', '[''‘’]'), '"', '["“”]') END AS e FROM p),
w AS (SELECT doc_id, text, regexp_replace(e, '\s', '\\s+', 'g') AS e FROM r),
m AS (SELECT doc_id, text, CASE WHEN e IS NULL THEN coalesce(text, '') ELSE regexp_replace(text, '(' || e || ')', chr(57344) || '\1' || chr(57345), 'g') END AS marked FROM w),
h AS (SELECT doc_id, text, marked, replace(replace({_ESC.format("marked")}, chr(57344), '<mark>'), chr(57345), '</mark>') AS html FROM m)
SELECT doc_id, text IS NOT NULL AS has_text, nullif(CAST(strpos(marked, chr(57344)) AS BIGINT), 0) AS starts, CAST((length(html) - length(replace(html, '<mark>', ''))) // 6 AS BIGINT) AS marks, sha256(html) AS html_sha256 FROM h""",
}
