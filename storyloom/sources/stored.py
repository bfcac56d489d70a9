"""Graphs stored for joins: every table with its schema, in buckets of (world, entity), sorted in each.

Assertions, presence, entities and aliases are cut into the same buckets by the ends that checks join
on, so these joins need no exchange; scenes and works are in buckets of (world, scene) and (world, work).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.lineage import folder
from storyloom.sources.graph import Graph, derive

SCHEMAS = {
    "assertions": "assertion_id long, world_id long, subject_id long, predicate string, object_id long, object_value string, object_assertion_id long, polarity boolean, lo int, hi int, scene_id long, supporting_quote string, confidence double, status string, fact_key string",
    "scenes": "scene_id long, work_id long, world_id long, slug string, story_position int, is_flashback boolean, raw_text string",
    "entities": "entity_id long, world_id long, kind string, name string, provisional boolean",
    "aliases": "world_id long, entity_id long, alias string",
    "presence": "world_id long, scene_id long, entity_id long",
    "works": "work_id long, world_id long, title string, sort_order int",
    "family_config": "world_id long, family string, enabled boolean",
    "seals": "world_id long, check_name string, assertion_a long, assertion_b long",
}
BUCKETS = {
    "assertions": ("world_id", "subject_id"), "presence": ("world_id", "entity_id"), "entities": ("world_id", "entity_id"), "aliases": ("world_id", "entity_id"),
    "scenes": ("world_id", "scene_id"), "works": ("world_id", "work_id"),
}


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast to its types; a column that is missing is an error."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in schema.split(", "))])


def save(g: Graph, name: str, path: str | None = None, buckets: int | None = None) -> Graph:
    """Writes all tables under a path, in the session's catalog as ``name_table``, and gives the graph that reads them.

    ``buckets`` should make buckets that fit a task's memory; by default there are as many as shuffle partitions.
    """
    spark = g.assertions.sparkSession
    path = path or folder(spark, name)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(table: str) -> None:
        rows = typed(getattr(g, table), SCHEMAS[table])
        keys = BUCKETS.get(table)
        if keys:
            # One file a bucket, so that its order holds.
            out = rows.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
        else:
            out = rows.coalesce(1).write
        out.mode("overwrite").option("path", f"{path}/{table}").format("parquet").saveAsTable(f"{name}_{table}")

    with ThreadPoolExecutor(len(SCHEMAS)) as pool:  # tables are written at once, each by jobs of its own
        list(pool.map(inheritable_thread_target(spark)(write), SCHEMAS))
    return load(spark, name)


def load(spark: SparkSession, name: str) -> Graph:
    """A graph that was saved in this catalog."""
    return Graph(**{table: spark.table(f"{name}_{table}") for table in SCHEMAS})


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over an event log, stored once for jobs that read its tables many times."""
    return save(derive(spark, sf_dir), f"graph_{uuid.uuid4().hex}")
