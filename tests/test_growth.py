"""Rows that joins make where many share one scene, place or fact: they grow with the input, not with its pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import checks, constraints, folds, lifecycle, lineage, matching, needles, notes, ripple
from storyloom.plans import registry
from storyloom.sources import texts
import test_graph
from test_graph import graph

DATA = "/root/testdata/sf0.001"


def most_rows(df):
    """The rows of a frame that has not run yet, and the most that any operator of its plan puts out."""
    found = df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found, most


@pytest.fixture
def planned(spark):
    """Plans stay as they are, so that their counts can be read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_crowd_that_knows_one_fact_makes_no_pairs(planned):
    """300 know it, all at one scene, but the last one, who hears it from nobody."""
    rows = [(i, 1, i, "knows", None, "the code", True, 1 + (i > 1), None, 102, "canon") for i in range(1, 301)]
    g = graph(planned, rows, [(1, 2, i) for i in range(1, 300)])
    names = planned.createDataFrame([(i, 1, "character", f"N{i}", False) for i in range(1, 301)], "entity_id long, world_id long, kind string, name string, provisional boolean")
    found, most = most_rows(checks.premature_knowledge(g.with_(entities=names)))
    assert [(r.assertion_a, r.scene_id) for r in found] == [(300, 102)] and most < 3000


def test_expectations_of_one_scene_or_line_share_their_findings(spark, monkeypatch):
    """60 findings at a scene and 60 that repeat a line, 20 expectations of each: no pair of both is made, and all are met."""
    handed = []

    def watched(links, pools, members):
        handed.append(sum(df.count() for df in (links, pools, members) if df is not None))
        return matching.first_free(links, pools, members)

    monkeypatch.setattr(lifecycle, "first_free", watched)
    want = [(1, i, "c", 7 if i % 2 else None, None if i % 2 else "The river takes the bridge", []) for i in range(40)]
    have = [(1, 100 + i, "c", 7 if i % 2 else 8, "silence" if i % 2 else "the bridge takes the river", "critical") for i in range(120)]
    expected = spark.createDataFrame(want, "run_id long, expected_id long, check_name string, scene_id long, line string, words array<string>")
    found = spark.createDataFrame(have, "run_id long, finding_id long, check_name string, scene_id long, explanation string, severity string")
    r = lifecycle.score_findings(expected, found).first()
    assert (r.expected, r.met, r.false_positives) == (40, 40, 80)
    assert sum(handed) < 400


def test_tables_that_grow_are_not_broadcast(spark):
    """a million equal rows are a few kilobytes on disk, and Spark judges tables by their files."""
    rows = spark.range(10).select("id")
    alike = spark.range(1_000_000).select((F.col("id") % 2).alias("id"), F.lit(1).alias("x"))
    plan = lambda grows: lineage.cut(alike, grows=grows).select("id", "x").join(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(False) and "Broadcast" not in plan(True)


def test_traps_meet_findings_by_words(spark):
    """each of 400 names stands in one finding, and 'User 1 ' in no 'User 11 '."""
    hays = spark.createDataFrame([(1, f"user {i} is seen") for i in range(400)], "world_id long, hay string")
    asked = spark.createDataFrame([(1, f"user {i} ") for i in range(450)] + [(1, "er 7"), (1, "")], "world_id long, needle string")
    pairs = {(r.hay, r.needle) for r in needles.holding(hays, asked).collect()}
    assert pairs == {(h.hay, n.needle) for h in hays.collect() for n in asked.collect() if n.needle and n.needle in h.hay}
    found = spark.createDataFrame([(1, "a", "User 1 is seen", False), (1, "b", "User 11 is seen", False), (1, "b", "User 2 is seen", True)], "run_id long, check_name string, explanation string, sealed boolean")
    traps = [("*", ["User 1 "]), ("b", ["User 1 "]), ("b", ["User 11 ", "SEEN"]), ("*", ["User 2 "]), ("b", []), ("c", [""]), ("a", [None]), ("*", None), (None, ["user"]), ("a", ["ser 1"]), ("a", ["User 1 ", "gone"])]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(traps)], "run_id long, trap_id long, check_name string, words array<string>")
    got = {r.trap_id: r.respected for r in lifecycle.trap_scores(rows, found).collect()}
    assert [i for i in range(len(traps)) if not got[i]] == [0, 2, 4, 9] and len(got) == len(traps)


def test_touched_findings_are_not_made_distinct(planned):
    """against a loop; what is touched by scene goes through no further exchange."""
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)])
    found = [(1, rng.choice("ab"), some(4), rng.randrange(30), some(30), False) for _ in range(80)]
    touched = [(f"c{rng.randrange(60)}", 1, some(30), some(4)) for _ in range(100)]
    f = planned.createDataFrame(found, "world_id long, check_name string, scene_id long, assertion_a long, assertion_b long, sealed boolean")
    t = planned.createDataFrame(touched, "change_id string, world_id long, assertion_id long, scene_id long")
    out = ripple.touching(graph(planned, [(1, 1, 1, "dies", None, None, True, 3, None, 103, "canon")], [(1, 1, 1)], config=[(1, "a", True)], seals=[(1, "a", 1, None)]), f, t)
    got = sorted(map(str, out.select("change_id", "check_name", "scene_id", "assertion_a", "assertion_b").collect()))
    want = {(c, k, s, a, b) for _, k, s, a, b, _ in found for c, _, i, at in touched if (i is not None and i in (a, b)) or (at is not None and at == s)}
    assert len(got) == len(want) == len(set(got))
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString().split("\n", 1)[0]


def test_concerned_classes_count_what_facts_concern(spark):
    """90 entities named alike are one class, so a fact meets one row; the counts are those of the pairs."""
    people = spark.createDataFrame([(i, 1, "character", f"Ship{i % 3} Crew", False) for i in range(1, 91)], "entity_id long, world_id long, kind string, name string, provisional boolean")
    rows = [(i, 1, i, "knows", None, f"ship{i % 4} ship{i % 3}", True, 1, None, 101, "canon") for i in range(1, 31)]
    g = graph(spark, rows, [(1, 1, 1)], [(1, "a", True)], [(1, "a", 1, None)]).with_(entities=people)
    classes, members = notes.concerned_classes(g)
    met = classes.collect()
    assert len(met) <= 60
    of = {r.entity_id: r["class"] for r in members.collect()}
    got = {}
    for r in met:
        got[r.assertion_id] = got.get(r.assertion_id, 0) + r.n - (of.get(r.assertion_id) == r["class"])
    pairs = {r.assertion_id: r.n for r in notes.fact_concerns(g).groupBy("assertion_id").agg(F.count("*").alias("n")).collect()}
    assert pairs and {k: n for k, n in got.items() if n} == pairs


@pytest.mark.parametrize("name", ["report_sections", "world_list_findings", "assertion_page", "finding_page", "findings_contract"])
def test_all_checks_read_a_stored_graph(spark, name):
    """seven checks that each parse the event log again, and part and sort its rows again for each join."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert not [f for f in registry.QUERIES[name](spark, DATA).inputFiles() if "events.parquet" in f]


def test_effects_of_changes_are_counted_without_their_pairs(spark, monkeypatch):
    """120 changes at two places, two facts and two aliases; the counts are those of the pairs, and no pair is made."""
    rng = random.Random(7)
    at = lambda: rng.choice([None, 1, 2, 3, 4, 5, 6])
    some = lambda *of: rng.choice([None, *of])
    base = [(i, 1 + i % 2, rng.choice([1, 2, 3, 50]), rng.choice(["knows", "believes", "located_at", "fact"]), some(50, 51, 1), some("Nan hid it", "Nan and Bo", "it"), some(i, 3, 4, 5, 6), True, at(), at(), 101, "quote", 0.9, rng.choice(["canon", "canon", "sealed"])) for i in range(1, 121)]
    g = graph(spark, [], [(1, 2, 1), (1, 3, 1), (1, 3, 50), (2, 4, 3)])
    rows = spark.createDataFrame(base, test_graph.A).withColumn("fact_key", text.norm_strip("object_value"))
    g = g.with_(assertions=rows, aliases=spark.createDataFrame([(1, 1, "Nan"), (1, 1, "Bo "), (1, 1, "gone"), (1, 2, "Nan"), (1, 50, "it")], "world_id long, entity_id long, alias string"))
    asked = [(f"c{i}", 1 + i % 2, rng.choice(["move", "remove"]), i, rng.randrange(1, 7), None) for i in range(1, 121)] + [(f"e{w}{e}", w, "cut", None, None, e) for w in (1, 2) for e in (1, 2, 3, 50, 51)]
    changes = spark.createDataFrame(asked, "change_id string, world_id long, type string, assertion_id long, to_position int, entity_id long")
    want = {c[0]: [0] * 4 for c in asked}
    for k, df in enumerate((ripple.related(g, changes), ripple.cut_entity(g, changes).filter("kind = 'assertion'"), ripple.cut_entity(g, changes).filter("kind = 'scene'"), ripple.epistemic_overlap(g, changes))):
        for r in df.groupBy("change_id").count().collect():
            want[r.change_id][k] = r["count"]
    assert all(sum(x[k] for x in want.values()) > 2 for k in range(4))
    for pairs in ("related", "cut_entity", "epistemic_overlap"):
        monkeypatch.setattr(ripple, pairs, None)
    got = {r.change_id: [r.related, r.cut_assertions, r.cut_scenes, r.epistemic] for r in ripple.summary(g, changes).collect()}
    assert got == want


def test_scoring_streams_its_groups(spark):
    """against a loop; groups, many and small, aren't handed to Python one by one."""
    rng = random.Random(3)
    value = lambda: rng.choice(["a", "ab", "abc", "b", "c", None])
    want = [(rng.randrange(2), i, rng.choice(["x", "Y"]), rng.choice(["knows", "fact"]), value()) for i in range(60)]
    have = [(rng.randrange(2), i, rng.choice(["X", "y"]), rng.choice(["knows", "fact"]), value()) for i in range(50)]
    met = {0: 0, 1: 0}
    used = set()
    for run, _, s, p, v in want:
        free = [y for r, y, t, q, w in have if (r, t.lower(), q) == (run, s.lower(), p) and None not in (v, w) and (v in w or w in v) and (r, y) not in used]
        if free:
            used.add((run, free[0]))
            met[run] += 1
    schema = "run_id long, {} long, subject string, predicate string, value string"
    out = folds.score_extraction(spark.createDataFrame(want, schema.format("expected_id")), spark.createDataFrame(have, schema.format("actual_id")))
    assert {r.run_id: r.matched for r in out.collect()} == met and min(met.values()) > 5
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["check_presence_conflict_binned", "check_idle_setup"])
def test_checks_of_many_joins_read_a_stored_graph(spark, name):
    """each join parsed the event log anew."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert not [f for f in registry.QUERIES[name](spark, DATA).inputFiles() if "events.parquet" in f]


def exchanged(df, metric_="shuffleRecordsWritten", of="Exchange"):
    """The rows of a frame that has not run yet, and the most that any exchange, or other operator, of its plan passes on."""
    found = df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        metric = node.metrics().get(metric_)
        most = max(most, metric.get().value() if metric.isDefined() and of in node.nodeName() else 0)
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found, most


def crowd(spark):
    """120 at one place who know one fact, of whom every third is called by it."""
    rows = [(i, 1, i, "knows" if i % 2 else "located_at", 500, "Fact 7", True, 1, None, 101, "canon") for i in range(1, 121)]
    aliases = spark.createDataFrame([(1, i, "Fact 7") for i in range(3, 121, 3)], "world_id long, entity_id long, alias string")
    named = spark.createDataFrame([(i, 1, "character", f"N{i}", False) for i in range(1, 121)], "entity_id long, world_id long, kind string, name string, provisional boolean")
    return graph(spark, rows, []).with_(aliases=aliases, entities=named)


CHANGE = "change_id string, world_id long, type string, assertion_id long, to_position int, entity_id long"


def moves(spark):
    return spark.createDataFrame([(f"c{i}", 1, "remove", i, None, None) for i in range(1, 121)], CHANGE)


def test_related_pairs_are_not_exchanged(planned):
    """120 changes of rows at one place, 119 others each."""
    found, most = exchanged(ripple.related(crowd(planned), moves(planned)))
    assert len(found) == len(set(found)) == 120 * 119 and 0 < most < 1000


def test_a_change_of_two_rows_meets_each_other_row_once(planned):
    """an id that two changes share."""
    two = planned.createDataFrame([("c", 1, "remove", 1, None, None), ("c", 1, "remove", 2, None, None)], CHANGE)
    assert sorted(r.assertion_id for r in ripple.related(crowd(planned), two).collect()) == list(range(1, 121))


def test_epistemic_pairs_compare_ranges_once_a_list(planned):
    """60 knowers of one fact and range: 60 comparisons, and one row a pair only at the end."""
    found, most = exchanged(ripple.epistemic_overlap(crowd(planned), moves(planned)), "numOutputRows", "Join")
    assert len(found) == 60 * 59 and 0 < most < 1000


@pytest.mark.parametrize("fn", [ripple.cut_entity, ripple.cut_reasons])
def test_cut_pairs_are_not_exchanged(planned, fn):
    """40 cuts that are named in all 120 rows."""
    cuts = planned.createDataFrame([(f"e{i}", 1, "cut", None, None, i) for i in range(3, 121, 3)], CHANGE)
    found, most = exchanged(fn(crowd(planned), cuts))
    facts = [r for r in found if r.kind == "assertion"]
    assert len(facts) == len(set(facts)) == 40 * 120 and 0 < most < 1500
    if fn is ripple.cut_reasons:
        assert sorted({(r.reason, sum(x.reason == r.reason for x in facts)) for r in facts}) == [("named", 40 * 119), ("subject", 40)]


def test_concerned_pairs_are_not_exchanged(planned):
    """120 facts with the word of 40 others."""
    found, most = exchanged(notes.fact_concerns(crowd(planned), ("fact",)))
    assert len(found) == len(set(found)) == 120 * 40 - 40 and 0 < most < 1500


def test_words_are_judged_once_each(planned):
    """200 documents of the same three words: the plan judges behind the grouping."""
    docs = planned.createDataFrame([(i, "uncle, J.R. walks") for i in range(200)], "doc_id long, text string")
    df = texts.role_references(docs)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.surface for r in df.collect()) == ["J.R.", "uncle"] and plan.index("RLIKE" if "RLIKE" in plan else "regexp_replace") < plan.index("Aggregate")


def test_constraints_are_checked_in_parts_that_do_not_grow(spark):
    """3,000 rows of one small range of values, which adaptive plans would join in one task, go to parts of 100."""
    rows = spark.range(3000).select(F.col("id").alias("assertion_id"), (F.col("id") % 7).alias("subject_id"))
    entities = spark.range(6).select(F.col("id").alias("entity_id"), F.lit(1).alias("world_id"), F.concat(F.lit("N"), "id").alias("name"), F.lit("character").alias("kind"))
    found = constraints.violations({"assertions": rows.withColumn("predicate", F.lit("knows")).withColumn("status", F.lit("draft")).withColumns({"confidence": F.lit(0.5), "object_id": F.lit(None).cast("long"), "object_value": F.lit("x"), "object_assertion_id": F.lit(None).cast("long")}), "entities": entities}, part_rows=100)
    lost = found.filter("constraint = 'subject_id_exists'")
    assert lost.count() == 3000 // 7 and found.count() == lost.count()
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(subject_id" in plan and ", 30), REPARTITION_BY_NUM" in plan


def test_findings_meet_only_assertions_of_excepted_entities(spark, monkeypatch):
    """of 200 assertions those of the one excepted entity go on to meet the findings."""
    from storyloom.operators import rules
    from storyloom.sources.graph import Graph

    kept = []
    cut = rules.cut
    monkeypatch.setattr(rules, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    assertions = spark.createDataFrame([(1, i, i % 50, i % 10) for i in range(200)], "world_id long, assertion_id long, subject_id long, scene_id long")
    scenes = spark.createDataFrame([(1, i, 10 * i) for i in range(9)], "world_id long, scene_id long, story_position int")
    schema = "rule_id string, world_id long, kind string, predicate string, subject_entity_id long, subject_trait string, entity_id long, object_entity_id long, check_name string, pos_from int, pos_to int, severity string, label string, disabled boolean"
    rule = spark.createDataFrame([("r", 1, "exception", None, None, None, 7, None, "idle_setup", 30, 70, None, None, False)], schema)
    cases = [(1, "idle_setup", scene, a) for a in (7, 8, 57, 107, 199) for scene in (2, 3, None)] + [(1, "dead_speaker", 3, 7), (2, "idle_setup", 3, 7)]
    found = spark.createDataFrame(cases, "world_id long, check_name string, scene_id long, assertion_a long")
    g = Graph(assertions, scenes, None, None, None, None, None, None)
    position = lambda scene, a: 10 * (a % 10 if scene is None else scene)
    want = [c for c in cases if not (c[:2] == (1, "idle_setup") and c[3] % 50 == 7 and 30 <= position(*c[2:]) <= 70)]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, rules.without_exceptions(g, found, rule).collect()), key=key) == sorted(want, key=key)
    assert kept[0].count() == 4


def test_documents_are_numbered_without_sorting_a_world_in_one_task(spark):
    """places are those of one sort a world, and no window runs over the findings."""
    rows = [(1 + (i % 10 == 0), "c", ("critical", "warning", "note")[i % 3], f"e{i % 7}", None if i % 11 == 0 else i % 13, i, None, i % 2 == 0) for i in range(3000)]
    schema = "world_id long, check_name string, severity string, explanation string, scene_id long, assertion_a long, assertion_b long, sealed boolean"
    found = spark.createDataFrame(rows, schema).repartition(5)
    rank = {"critical": 0, "warning": 1, "note": 2}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lifecycle.document_lines(found, found.select("world_id"))
        got = {(r.world_id, r.place): r.line for r in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "row_number" not in plan
    for world in (1, 2):
        own = sorted((r for r in rows if r[0] == world), key=lambda r: (rank[r[2]], r[1], -1 if r[4] is None else r[4], r[5]))
        assert len(own) + 2 == sum(w == world for w, _ in got)
        assert all(f'"assertion_a":{r[5]},' in got[world, i + 1] and (i > 0) == got[world, i + 1].startswith(",") for i, r in enumerate(own))
        assert got[world, 0] == '{"findings": [' and got[world, len(own) + 1] == "]}"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_reasons_of_cuts_read_a_stored_graph(spark):
    """F1 of round 4: the driver plans the parts over stored tables and cuts, none over the event log."""
    found = registry.QUERIES["cut_reasons"](spark, DATA)
    assert not any("events.parquet" in f for f in found.inputFiles()) and found.count() > 0


@pytest.mark.parametrize("fn", [ripple.related, ripple.epistemic_overlap])
def test_pairs_are_dealt_over_tasks_by_their_number(planned, monkeypatch, fn):
    """F3, F4 of round 4: the few rows that make all pairs of one place or fact were dealt by their bytes, to one task."""
    from storyloom.operators import overlap

    g, changes = crowd(planned).with_(), moves(planned)
    pair = lambda r: (r.change_id, r.assertion_id)
    want = sorted(map(pair, fn(g, changes).collect()))
    monkeypatch.setattr(overlap, "TASK_PAIRS", 200)
    monkeypatch.setattr(overlap, "CHUNK_ROWS", 8)
    dealt = fn(g, changes).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(map(pair, dealt)) == want
    tasks = [sum(r.task == t for r in dealt) for t in {r.task for r in dealt}]
    assert len(tasks) >= 5 and max(tasks) < 0.5 * len(dealt)


def test_findings_of_a_scene_meet_lists_of_its_changes(planned, monkeypatch):
    """F2 of round 4: 60 findings and 80 changes of one scene are 4,800 rows at the end only, made in several tasks, and the findings are found once."""
    from storyloom.operators import overlap

    monkeypatch.setattr(overlap, "TASK_PAIRS", 200)
    monkeypatch.setattr(overlap, "CHUNK_ROWS", 8)
    f = planned.createDataFrame([(1, "a", 7 if i < 60 else None, i, None, False) for i in range(61)], "world_id long, check_name string, scene_id long, assertion_a long, assertion_b long, sealed boolean")
    t = planned.createDataFrame([(f"c{i}", 1, 59 + i, 7) for i in range(80)], "change_id string, world_id long, assertion_id long, scene_id long")
    found, most = exchanged(ripple.touching(graph(planned, []), f, t).withColumn("task", F.spark_partition_id()), "numOutputRows", "Join")
    assert {(r.change_id, r.scene_id, r.assertion_a) for r in found} == {(f"c{i}", 7, a) for i in range(80) for a in range(60)} | {("c1", None, 60)}
    assert len(found) == 4801 and 0 < most < 1000
    assert max(sum(r.task == t for r in found) for t in {r.task for r in found}) < 2400


def test_lists_of_named_assertions_are_not_copied(planned, monkeypatch):
    """F5 of round 4: 40 cuts that are named in all 120 rows, in lists of 10: the cuts go to the lists, each of which is exchanged once."""
    from storyloom.operators import overlap

    monkeypatch.setattr(overlap, "TASK_PAIRS", 200)
    monkeypatch.setattr(ripple, "LIST_ROWS", 10)
    monkeypatch.setattr(ripple, "lists", lambda *a: overlap.lists(*a, most=10))
    monkeypatch.setattr(ripple, "TASK_LISTS", 2)
    given = []
    join = ripple.spread_join
    monkeypatch.setattr(ripple, "spread_join", lambda a, b, *rest: given.append((a.columns, b.columns)) or join(a, b, *rest))
    cuts = planned.createDataFrame([(f"e{i}", 1, "cut", None, None, i) for i in range(3, 121, 3)], CHANGE)
    found = ripple.cut_entity(crowd(planned), cuts).withColumn("task", F.spark_partition_id()).collect()
    facts = {(r.change_id, r.id) for r in found if r.kind == "assertion"}
    assert len(facts) == sum(r.kind == "assertion" for r in found) == 40 * 120
    assert "__rows" in given[0][0] and "change_id" in given[0][1]
    assert max(sum(r.task == t for r in found) for t in {r.task for r in found}) < 2400
