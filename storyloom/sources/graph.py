"""The tables of a fact graph, and their derivation from an event log.

Every table carries ``world_id``; every job handles all worlds at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text

# The closed vocabulary of predicates.
PREDICATES = (
    "alive", "dies", "located_at", "present_in_scene", "member_of", "possesses", "married_to", "parent_of", "sibling_of", "romantic_with", "allied_with", "enemy_of",
    "knows", "believes", "secret_of", "destroyed", "created", "occupation", "trait", "cannot", "goal", "promised", "fact",
)
# Relations between entities.
RELATIONS = ("member_of", "married_to", "parent_of", "sibling_of", "romantic_with", "allied_with", "enemy_of")
# Kinds of entities, those that win a tie first.
KINDS = ("character", "location", "object", "faction", "event", "rule", "other")


@dataclass(frozen=True)
class Graph:
    assertions: DataFrame
    scenes: DataFrame
    entities: DataFrame
    aliases: DataFrame
    presence: DataFrame
    works: DataFrame
    family_config: DataFrame
    seals: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


# The derivation as plain expressions over the event log; {at} is the event's age in seconds.
COLUMNS = {
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "world_id": "CAST(user_id % 4 AS BIGINT)",
    "position": "CAST(floor({at} / 21600.0) AS INT) + 1",
}
ASSERTION = {
    "assertion_id": "event_id + 1",
    "world_id": "world_id",
    "subject_id": "CASE WHEN event_type = 'error' AND k >= 30 AND k < 40 THEN world_id * 100 + 900000 + k % 20 ELSE user_id + 1 END",
    "predicate": "CASE event_type WHEN 'purchase' THEN 'located_at' WHEN 'click' THEN 'knows' "
    "WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'believes' WHEN 1 THEN 'promised' ELSE 'goal' END "
    "WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'alive' WHEN 1 THEN 'trait' ELSE 'occupation' END "
    "ELSE CASE WHEN k < 3 THEN 'dies' WHEN k < 30 THEN 'cannot' WHEN k < 40 THEN 'destroyed' ELSE 'fact' END END",
    "object_id": "CASE WHEN event_type = 'purchase' THEN world_id * 100 + 900000 + k % 20 END",
    "object_value": "CASE WHEN event_type = 'click' OR event_type = 'signup' THEN concat('Fact ', CAST(k % 30 AS VARCHAR(10)), '!') "
    "WHEN event_type = 'view' THEN concat('Fact ', CAST(k % 45 AS VARCHAR(10)), '!') "
    "WHEN event_type = 'error' AND k >= 3 AND (k < 30 OR k >= 40) THEN concat('Fact ', CAST(k % 30 AS VARCHAR(10)), '!') END",
    "object_assertion_id": "CASE WHEN event_type = 'view' AND event_id % 7 = 0 AND event_id > 0 THEN event_id END",
    "polarity": "event_id % 19 <> 0",
    "lo": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE position END",
    "hi": "CASE WHEN event_id % 3 = 0 THEN position + 1 + k % 5 END",
    "scene_id": "world_id * 1000 + position",
    "supporting_quote": "concat('line ', CAST(event_id % 50 AS VARCHAR(10)), ' of scene ', CAST(position AS VARCHAR(10)))",
    "confidence": "CAST((k + 1) / 100.0 AS DOUBLE)",
    "status": "CASE WHEN event_id % 23 = 0 THEN 'sealed' WHEN event_id % 29 = 0 THEN 'rejected' WHEN event_id % 31 = 0 THEN 'retconned' WHEN k >= 84 THEN 'canon' ELSE 'draft' END",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("*", *[F.expr(e.format(at=seconds)).alias(c) for c, e in COLUMNS.items()])


def derive(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over an event log: users as characters, places by property, one assertion an event."""
    e = events(spark, sf_dir)
    assertions = e.select(*[F.expr(x).alias(c) for c, x in ASSERTION.items()]).withColumn("fact_key", text.norm_strip("object_value"))
    spots = e.select("world_id", "position").distinct()
    work = F.expr("world_id * 100 + CAST(floor((position - 1) / 4.0) AS BIGINT)")
    scenes = spots.select(
        F.expr("world_id * 1000 + position").alias("scene_id"), work.alias("work_id"), "world_id", F.format_string("INT. PLACE %d - DAY", F.col("position") % 20).alias("slug"),
        F.col("position").alias("story_position"), (F.col("position") % 11 == 0).alias("is_flashback"), F.format_string("line %d of scene %d", F.col("position") % 50, F.col("position")).alias("raw_text"),
    )
    works = scenes.select("work_id", "world_id").distinct().withColumn("title", F.format_string("E%d - day", 100 + F.col("work_id") % 100)).withColumn("sort_order", (F.col("work_id") % 100).cast("int"))
    users = e.select(
        (F.col("user_id") + 1).alias("entity_id"), "world_id", F.lit("character").alias("kind"), F.format_string("User %d", "user_id").alias("name"), (F.col("user_id") % 13 == 0).alias("provisional"),
    ).distinct()
    place = F.expr("world_id * 100 + 900000 + k % 20")
    places = e.select(place.alias("entity_id"), "world_id", F.lit("location").alias("kind"), F.format_string("Place %d of %d", F.col("k") % 20, "world_id").alias("name"), F.lit(False).alias("provisional")).distinct()
    aliases = users.select("world_id", "entity_id", F.format_string("U%d", F.col("entity_id") - 1).alias("alias")).unionByName(
        users.filter("entity_id % 3 = 1").select("world_id", "entity_id", F.format_string("Fact %d", F.col("entity_id") % 60).alias("alias"))
    )
    presence = e.select("world_id", F.expr("world_id * 1000 + position").alias("scene_id"), (F.col("user_id") + 1).alias("entity_id")).unionByName(
        e.select("world_id", F.expr("world_id * 1000 + position").alias("scene_id"), place.alias("entity_id"))
    ).distinct()
    config = spark.createDataFrame([(2, "presence_conflict", False), (3, "destroyed_location_use", False), (1, "dead_speaker", True), (1, "F2", False)], "world_id long, family string, enabled boolean")
    seals = e.filter("event_id % 5 = 0").select("world_id", F.lit("dead_speaker").alias("check_name"), (F.col("event_id") + 1).alias("assertion_a"), F.lit(None).cast("long").alias("assertion_b"))
    return Graph(assertions, scenes, users.unionByName(places), aliases, presence, works, config, seals)
