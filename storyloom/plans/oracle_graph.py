"""The derived graph as DuckDB common table expressions."""

from __future__ import annotations

from storyloom.sources.graph import ASSERTION, COLUMNS

SECONDS = "date_diff('second', TIMESTAMP '2024-01-01', ts)"
_cols = ", ".join(f"{e.format(at=SECONDS)} AS {c}" for c, e in COLUMNS.items())
_asserted = ", ".join(f"{e} AS {c}" for c, e in ASSERTION.items())

GRAPH = f"""
ev AS (SELECT *, {_cols} FROM events),
a AS (SELECT *, regexp_replace(lower(object_value), '[^a-z0-9 ]', '', 'g') AS fact_key FROM (SELECT {_asserted} FROM ev)),
scenes AS (
  SELECT DISTINCT world_id * 1000 + position AS scene_id, world_id * 100 + CAST(floor((position - 1) / 4.0) AS BIGINT) AS work_id, world_id,
         'INT. PLACE ' || position % 20 || ' - DAY' AS slug, position AS story_position, position % 11 = 0 AS is_flashback,
         'line ' || position % 50 || ' of scene ' || position AS raw_text FROM ev
),
works AS (SELECT DISTINCT work_id, world_id, 'E' || (100 + work_id % 100) || ' - day' AS title, CAST(work_id % 100 AS INT) AS sort_order FROM scenes),
entities AS (
  SELECT DISTINCT user_id + 1 AS entity_id, world_id, 'character' AS kind, 'User ' || user_id AS name, user_id % 13 = 0 AS provisional FROM ev
  UNION ALL SELECT DISTINCT world_id * 100 + 900000 + k % 20, world_id, 'location', 'Place ' || k % 20 || ' of ' || world_id, false FROM ev
),
aliases AS (
  SELECT world_id, entity_id, 'U' || (entity_id - 1) AS alias FROM entities WHERE kind = 'character'
  UNION ALL SELECT world_id, entity_id, 'Fact ' || entity_id % 60 FROM entities WHERE kind = 'character' AND entity_id % 3 = 1
),
presence AS (
  SELECT DISTINCT world_id, world_id * 1000 + position AS scene_id, unnest([user_id + 1, world_id * 100 + 900000 + k % 20]) AS entity_id FROM ev
),
config AS (SELECT * FROM (VALUES (2, 'presence_conflict', false), (3, 'destroyed_location_use', false), (1, 'dead_speaker', true), (1, 'F2', false)) t(world_id, family, enabled)),
seals AS (SELECT world_id, 'dead_speaker' AS check_name, event_id + 1 AS assertion_a, CAST(NULL AS BIGINT) AS assertion_b FROM ev WHERE event_id % 5 = 0)
"""


def over_graph(sql: str) -> str:
    return f"WITH {GRAPH.strip()},\n{sql.strip()}"


def off(family: str, world: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM config c WHERE c.world_id = {world} AND c.family = '{family}' AND NOT c.enabled)"
