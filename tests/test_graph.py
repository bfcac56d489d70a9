"""Small graphs of our own: one positive and near misses, in two worlds."""

from storyloom.operators import checks, rules, usage
from storyloom.sources.graph import Graph

A = "assertion_id long, world_id long, subject_id long, predicate string, object_id long, object_value string, object_assertion_id long, polarity boolean, lo int, hi int, scene_id long, supporting_quote string, confidence double, status string"


def graph(spark, rows, presence=(), config=(), seals=(), provisional=()):
    base = [(i, w, s, p, o, v, None, pol, lo, hi, sc, "quote", 0.9, st) for i, w, s, p, o, v, pol, lo, hi, sc, st in rows]
    from storyloom.functions import text

    assertions = spark.createDataFrame(base, A).withColumn("fact_key", text.norm_strip("object_value"))
    scenes = spark.createDataFrame([(w * 100 + p, w * 10, w, f"S{p}", p, p == 9, "text") for w in (1, 2) for p in range(1, 12)], "scene_id long, work_id long, world_id long, slug string, story_position int, is_flashback boolean, raw_text string")
    works = spark.createDataFrame([(10, 1, "E1 one", 1), (20, 2, "E1 two", 1)], "work_id long, world_id long, title string, sort_order int")
    entities = spark.createDataFrame([(e, w, "location" if e >= 50 else "character", f"N{e}", e in provisional) for w in (1, 2) for e in (1, 2, 3, 50, 51)], "entity_id long, world_id long, kind string, name string, provisional boolean")
    aliases = spark.createDataFrame([(1, 1, "Nan")], "world_id long, entity_id long, alias string")
    seen = spark.createDataFrame([(w, w * 100 + p, e) for w, p, e in presence], "world_id long, scene_id long, entity_id long")
    cfg = spark.createDataFrame(list(config), "world_id long, family string, enabled boolean")
    seal = spark.createDataFrame(list(seals), "world_id long, check_name string, assertion_a long, assertion_b long")
    return Graph(assertions, scenes, entities, aliases, seen, works, cfg, seal)


def ids(df):
    return sorted((r.world_id, r.assertion_a, r.scene_id) for r in df.collect())


def test_dead_speaker(spark):
    rows = [
        (1, 1, 1, "dies", None, None, True, 3, None, 103, "canon"), (2, 1, 2, "dies", None, None, True, 3, None, 103, "canon"), (3, 1, 2, "alive", None, None, True, 5, None, 105, "canon"),
        (4, 2, 1, "dies", None, None, True, None, None, 203, "canon"), (5, 2, 2, "dies", None, None, False, 3, None, 203, "canon"), (6, 2, 3, "dies", None, None, True, 3, None, 203, "sealed"),
    ]
    seen = [(1, 3, 1), (1, 6, 1), (1, 9, 1), (1, 6, 2), (1, 4, 2), (2, 6, 1), (2, 6, 2), (2, 6, 3)]
    assert ids(checks.dead_speaker(graph(spark, rows, seen))) == [(1, 1, 106), (1, 2, 104)]
    assert ids(checks.dead_speaker(graph(spark, rows, seen, config=[(1, "dead_speaker", False)]))) == []


def test_presence_conflict_and_bins(spark):
    rows = [
        (1, 1, 1, "located_at", 50, None, True, 1, 4, 101, "canon"), (2, 1, 1, "located_at", 51, None, True, 3, 5, 103, "canon"), (3, 1, 1, "located_at", 50, None, True, 5, 6, 105, "canon"),
        (4, 1, 1, "located_at", 51, None, True, None, None, 105, "canon"), (5, 2, 1, "located_at", 50, None, True, 1, 3, 201, "canon"), (6, 2, 1, "located_at", 51, None, True, 3, 5, 203, "canon"), (7, 2, 1, "located_at", 50, None, True, 4, 4, 203, "canon"),
    ]
    g = graph(spark, rows)
    assert ids(checks.presence_conflict(g)) == [(1, 1, 103)]
    assert ids(checks.presence_conflict(g, hot_rows=1)) == [(1, 1, 103)]


def test_premature_knowledge(spark):
    rows = [
        (1, 1, 1, "knows", None, "The Code!", True, 1, None, 101, "canon"), (2, 1, 2, "knows", None, "the code", True, 5, None, 105, "canon"), (3, 1, 3, "knows", None, "The code.", True, 6, None, 106, "canon"),
        (4, 2, 2, "knows", None, "the code", True, 5, None, 205, "canon"),
    ]
    g = graph(spark, rows, [(1, 4, 1), (1, 4, 3), (1, 2, 2)])
    assert ids(checks.premature_knowledge(g)) == [(1, 2, 105)]


def test_seals_and_registration(spark):
    rows = [(1, 1, 1, "dies", None, None, True, 3, None, 103, "canon")]
    g = graph(spark, rows, [(1, 6, 1)], seals=[(1, "dead_speaker", 1, None)])
    found, failed = checks.run_checks(g, ["dead_speaker"])
    assert [r.sealed for r in found.collect()] == [True] and not failed
    checks.register_check("broken", lambda g: g.nothing)
    try:
        found, failed = checks.run_checks(g, ["dead_speaker", "broken"])
        assert found.count() == 1 and set(failed) == {"broken"}
    finally:
        del checks.CHECKS["broken"]


def test_rule_errors(spark):
    schema = "rule_id string, world_id long, kind string, predicate string, subject_entity_id long, subject_trait string, entity_id long, object_entity_id long, check_name string, pos_from int, pos_to int, severity string, label string, disabled boolean"
    rows = [
        ("ok", 1, "cannot", "knows", 1, None, None, None, None, None, None, "note", None, False), ("scope", 1, "cannot", "knows", 1, "x", None, None, None, None, None, "note", None, False),
        ("word", 1, "cannot", "flies", 1, None, None, None, None, None, None, "note", None, False), ("object", 1, "cannot", "dies", 1, None, None, 2, None, None, None, "note", None, False),
        ("range", 1, "exception", None, None, None, 1, None, "dead_speaker", 5, 2, None, None, False), ("family", 1, "exception", None, None, None, 1, None, "none", None, None, None, None, False),
    ]
    errors = {r.rule_id: r.errors for r in rules.validated(spark.createDataFrame(rows, schema)).collect()}
    assert errors == {"ok": [], "scope": ["scope"], "word": ["predicate"], "object": ["object"], "range": ["range"], "family": ["family"]}


def test_quota_is_exact_at_the_window(spark):
    rows = [(1, "u", "k", "2024-01-01 00:00:00"), (2, "u", "k", "2024-01-01 00:00:50"), (3, "u", "k", "2024-01-01 00:01:39"), (4, "u", "k", "2024-01-01 00:01:40")]
    e = spark.createDataFrame(rows, "event_id long, user_id string, kind string, ts string")
    limits = spark.createDataFrame([("k", 2)], "kind string, limit int")
    got = {r.event_id: (r.used, r.denied, r.retry_after) for r in usage.quota(e, limits, 100).collect()}
    assert got == {1: (1, False, None), 2: (2, False, None), 3: (3, True, 1), 4: (3, True, 50)}
