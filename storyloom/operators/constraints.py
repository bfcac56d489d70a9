"""Constraints of the stored tables, checked as joins and aggregates: unique keys, references, value domains, conditions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.lineage import cut
from storyloom.sources.graph import KINDS, PREDICATES

PART_ROWS = 500_000  # about as many rows of a table go to one task

# Columns that tell the rows of a table apart.
UNIQUE = {
    "works": ("work_id",),
    "scenes": ("work_id", "story_position"),
    "entities": ("world_id", "name", "kind"),
    "assertions": ("assertion_id",),
    "presence": ("scene_id", "entity_id"),
    "family_config": ("world_id", "family"),
    "seals": ("world_id", "check_name", "assertion_a", "assertion_b"),
    "notes": ("note_key",),
    "members": ("world_id", "user_id"),
    "links": ("token",),
    "runs": ("run_id",),
    "run_events": ("run_id", "seq"),
    "rules": ("rule_id",),
}
# Fixed values: (table, column, table and column that it refers to).
REFERENCES = (
    ("scenes", "work_id", "works", "work_id"),
    ("aliases", "entity_id", "entities", "entity_id"),
    ("assertions", "subject_id", "entities", "entity_id"),
    ("assertions", "object_id", "entities", "entity_id"),
    ("assertions", "object_assertion_id", "assertions", "assertion_id"),
    ("assertions", "scene_id", "scenes", "scene_id"),
    ("presence", "scene_id", "scenes", "scene_id"),
    ("presence", "entity_id", "entities", "entity_id"),
    ("findings", "scene_id", "scenes", "scene_id"),
    ("findings", "assertion_a", "assertions", "assertion_id"),
    ("findings", "assertion_b", "assertions", "assertion_id"),
    ("seals", "assertion_a", "assertions", "assertion_id"),
    ("seals", "assertion_b", "assertions", "assertion_id"),
    ("run_events", "run_id", "runs", "run_id"),
)
# The values that a column may take; null passes.
DOMAINS = (
    ("entities", "kind", KINDS),
    ("assertions", "predicate", PREDICATES),
    ("assertions", "status", ("draft", "canon", "sealed", "retconned", "rejected")),
    ("findings", "severity", ("critical", "warning", "note")),
    ("notes", "family", ("F1", "F2", "F3", "F4")),
    ("notes", "status", ("open", "sealed", "dismissed", "addressed")),
    ("members", "role", ("owner", "editor", "viewer")),
    ("links", "kind", ("report", "bible")),
    ("subscriptions", "tier", ("free", "paid")),
    ("rules", "kind", ("cannot", "only", "exception")),
    ("runs", "status", ("running", "done", "failed", "aborted")),
    ("runs", "phase", ("reading", "extracting", "resolving", "checking", "reporting", "done")),
)
# Conditions on a row by name; an unknown one passes.
CONDITIONS = (
    ("assertions", "confidence_range", "confidence >= 0 AND confidence <= 1"),
    ("assertions", "object_given", "object_id IS NOT NULL OR object_value IS NOT NULL OR object_assertion_id IS NOT NULL"),
    ("family_config", "family_name", "family RLIKE '^[A-Za-z0-9_]+$'"),
)


def _key(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("key")


def violations(tables: dict[str, DataFrame], part_rows: int = PART_ROWS) -> DataFrame:
    """(table_name, constraint, key) of all that is wrong in the given tables; constraints on tables not given are left out.

    A repeated key is named once.  Domains and conditions of a table are judged in one pass; a row is named by the key
    of its table.  Nulls refer to nothing and are in every domain; two nulls in a key are equal.

    Tables are written once and exchanged by key into parts of ``part_rows`` rows: rows of few scenes or places are
    small when compressed, so Spark, left to itself, would sort ever more of them in one task as tables grow.
    """
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:  # tables are written at once, each by jobs of its own
        tables = dict(zip(tables, pool.map(inheritable_thread_target(spark)(cut), tables.values())))
    rows = {table: df.count() for table, df in tables.items()}
    parts_of = lambda *names: max(1, *(-(-rows[x] // part_rows) for x in names))
    row = lambda df, table, name, key: df.select(F.lit(table).alias("table_name"), F.lit(name).alias("constraint"), key)
    parts = []
    for table, df in tables.items():
        columns = UNIQUE.get(table, ())
        if columns:
            parts.append(row(df.select(*columns).repartition(parts_of(table), *columns).groupBy(*columns).count().filter("count > 1"), table, "unique_" + "_".join(columns), _key(columns)))
        bad = [F.when(~F.col(c).isin(*values), F.lit(f"{c}_known")) for t, c, values in DOMAINS if t == table]
        bad += [F.when(~F.expr(holds), F.lit(name)) for t, name, holds in CONDITIONS if t == table]
        if bad:
            key = _key(columns or tuple(df.columns))
            parts.append(df.select(F.lit(table).alias("table_name"), F.explode(F.array_compact(F.array(*bad))).alias("constraint"), key))
    for table, c, other, column in REFERENCES:
        if table in tables and other in tables:
            n = parts_of(table, other)
            known = tables[other].select(F.col(column).alias(c)).repartition(n, c).distinct()
            columns = UNIQUE.get(table) or tuple(tables[table].columns)
            asked = tables[table].filter(F.col(c).isNotNull()).select(F.col(c), _key(columns)).repartition(n, c)
            parts.append(row(asked.join(known.hint("merge"), c, "left_anti"), table, f"{c}_exists", F.col("key")))
    return reduce(DataFrame.unionByName, parts)
