"""Loading, chains, guards and helpers on rows written out by hand."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import ask, constraints, folds, lifecycle, lineage, loading, usage
from storyloom.sources.graph import derive

DATA = "/root/testdata/sf0.001"


def test_chains_and_circles(spark):
    steps = spark.createDataFrame([(1, i, i + 1) for i in range(200)] + [(2, 5, 9)], "world_id long, old_id long, new_id long")
    got = {(r.world_id, r.old_id): r.new_id for r in folds.merge_targets(steps).collect()}
    assert got == {(1, i): 200 for i in range(200)} | {(2, 5): 9}
    with pytest.raises(ValueError):
        folds.merge_targets(spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1)], "world_id long, old_id long, new_id long"))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)] + [("x", "y")], "a string, b string")
    got = {r.node: r.component for r in lineage.components(links).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(201)} | {"x": "x", "y": "x"}


def test_snapshot_diff_tells_nulls_apart(spark):
    kind = "k int, a string, b string"
    old = spark.createDataFrame([(1, None, "a"), (2, "x", None), (None, "n", None)], kind)
    new = spark.createDataFrame([(1, "a", None), (2, "x", None), (None, "n", None), (3, None, None)], kind)
    assert sorted((r.k, r.change) for r in usage.snapshot_diff(old, new, ["k"]).collect()) == [(1, "changed"), (3, "added")]


def rows(spark, facts):
    full = [(1, i, p, s, "character", pred, o, "location" if o else None, v, True, st, en, f"q{i}", 0.9) for i, (p, s, pred, o, v, st, en) in enumerate(facts)]
    return spark.createDataFrame(full, "world_id long, row_id long, position int, subject_id long, subject_kind string, predicate string, object_id long, object_kind string, object_value string, polarity boolean, starts_here boolean, ends_here boolean, quote string, confidence double")


def test_places_follow_one_another(spark):
    """A move closes the stay before it; a restatement goes; two places at once stay; a stay told backwards begins where it began."""
    facts = [
        (1, 7, "located_at", 50, None, True, False), (2, 7, "located_at", 50, None, True, False), (4, 7, "located_at", 51, None, True, False), (4, 7, "located_at", 52, None, True, False),
        (9, 7, "located_at", 51, None, False, True), (3, 8, "dies", None, None, False, False), (5, 8, "dies", None, None, True, False), (99, 8, "trait", None, "x", True, False), (6, None, "trait", None, "x", True, False),
    ]
    scenes = spark.createDataFrame([(1, p * 10, p) for p in range(1, 20)], "world_id long, scene_id long, story_position int")
    got = {r.assertion_id: (r.lo, r.hi, r.object_value, r.mirrored) for r in loading.load_assertions(rows(spark, facts), scenes).collect()}
    assert got == {0: (1, 4, None, True), 2: (4, None, None, True), 3: (4, None, None, False), 5: (3, None, "dies", False)}


def test_findings_are_written_as_json_lines(spark, tmp_path):
    lifecycle.write_findings(spark.createDataFrame([(1, "a")], "scene_id long, check_name string"), str(tmp_path / "j"))
    assert [r.check_name for r in spark.read.json(str(tmp_path / "j")).collect()] == ["a"]


def test_cited_sql_guards(spark):
    g = derive(spark, DATA)
    out = ask.cited_sql(g, "SELECT world_id, scene_id, count(*) AS n FROM {assertions} GROUP BY 1, 2", [1])
    assert {r.world_id for r in out.collect()} == {1} and all(r.label for r in out.collect())
    loose = "SELECT world_id, CASE WHEN world_id = 1 THEN -1 ELSE scene_id END AS scene_id FROM {scenes}"
    assert {r.world_id for r in ask.cited_sql(g, loose, [1, 2]).collect()} == {2}
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT world_id FROM {scenes}"):
        with pytest.raises(Exception):
            ask.cited_sql(g, bad, [1])


def test_text_helpers(spark):
    df = spark.createDataFrame([("C.B.", True), ("the Sheriff", True), ("Uncle", True), ("She", True), ("The", True), ("Anna", False), (None, True), ("", True)], "s string, want boolean")
    assert all(r.got == r.want for r in df.select("want", text.is_role_reference("s").alias("got")).collect())
    one = spark.range(1).select(
        text.display_name(F.lit("ANNA BELL")).alias("name"), text.display_name(F.lit("Anna")).alias("same"), text.slug_place(F.lit("INT. Old Mill - NIGHT")).alias("place"), text.first_quote(F.lit("short\n  a longer line 10  ")).alias("quote"),
        text.clamp_confidence(F.lit("7")).alias("top"), text.quote_offset(F.lit("a “b”  c"), F.lit('"B" c')).alias("at"), text.object_placeholder(F.lit(""), F.lit(None).cast("long"), F.lit("dies")).alias("thing"),
        F.array_sort(text.thread_terms(F.lit("Find the lost key"), F.lit("Make it"))).alias("terms"),
    ).first()
    assert (one.name, one.same, one.place, one.quote, one.top, one.at, one.thing, one.terms) == ("Anna Bell", "Anna", "OLD MILL", "a longer line 10", 1.0, 3, "dies", ["key", "lost"])


def test_edits_and_refused_edits(spark):
    """The newest ruling counts; an edit keeps what it leaves null; an unknown predicate and a settled row stay as they are."""
    rows = spark.createDataFrame([(1, "draft", "knows", "a"), (2, "draft", "knows", "b"), (3, "canon", "knows", "c"), (4, "draft", "knows", "d"), (5, "draft", "knows", "e")], "assertion_id long, status string, predicate string, object_value string")
    ruled = spark.createDataFrame(
        [(1, "reject", 1, None, None), (1, "edit", 2, "trait", None), (2, "edit", 1, "no such", "x"), (3, "reject", 1, None, None), (4, "reject", 1, None, "x")],
        "assertion_id long, verdict string, seq int, predicate string, object_value string",
    )
    out, applied = folds.apply_rulings(rows, ruled)
    assert {r.assertion_id: tuple(r)[1:] for r in out.collect()} == {1: ("canon", "trait", "a"), 2: ("draft", "knows", "b"), 3: ("canon", "knows", "c"), 4: ("rejected", "knows", "d"), 5: ("draft", "knows", "e")}
    assert {tuple(r) for r in applied.collect()} == {(1, "edit"), (4, "reject")}


def test_merged_entities_take_what_is_missing(spark):
    entities = spark.createDataFrame([(1, 1, "Ann", None, True), (1, 2, "Annie", "x", False), (1, 3, "A.", "y", True), (1, 4, "Bob", None, True)], "world_id long, entity_id long, name string, note string, provisional boolean")
    aliases = spark.createDataFrame([(1, 3, "Nan"), (1, 1, "A."), (1, 4, "Rob")], "world_id long, entity_id long, alias string")
    merges = spark.createDataFrame([(1, 3, 2), (1, 2, 1)], "world_id long, old_id long, new_id long")
    e, a = folds.merge_entities(entities, aliases, merges)
    assert {tuple(r) for r in e.collect()} == {(1, 1, "Ann", "x", False), (1, 4, "Bob", None, True)}
    assert {tuple(r)[1:] for r in a.collect()} == {(1, "Nan"), (1, "A."), (1, "Annie"), (4, "Rob")}


def test_facts_that_share_one_name_do_not_match(spark):
    handles = spark.createDataFrame([(1, 1, "the gold of Vera"), (1, 2, "Vera"), (1, 3, "gold"), (1, 4, None), (2, 5, "Vera gold")], "world_id long, handle_id long, handle string")
    facts = spark.createDataFrame([(1, "f", "Vera stole the gold"), (1, "g", "gold"), (1, "h", "")], "world_id long, fact_key string, fact string")
    assert {(r.handle_id, r.fact_key) for r in lifecycle.fact_matches(handles, facts).collect()} == {(1, "f"), (1, "g"), (3, "g")}


def test_traps_and_repeated_lines(spark):
    found = spark.createDataFrame([(1, 1, "dead_speaker", 7, "Ann is seen at 9", "critical", False), (1, 2, "dead_speaker", 8, "Bob walks the long old road", "note", True)], "run_id long, finding_id long, check_name string, scene_id long, explanation string, severity string, sealed boolean")
    traps = spark.createDataFrame([(1, 1, "*", ["ann"]), (1, 2, "dead_speaker", ["ann", "bob"]), (1, 3, "dead_speaker", ["bob"]), (1, 4, "other", ["ann"]), (2, 5, "*", ["ann"])], "run_id long, trap_id long, check_name string, words array<string>")
    assert {r.trap_id: r.respected for r in lifecycle.trap_scores(traps, found).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    want = spark.createDataFrame([(1, 1, "dead_speaker", 99, [], "walks a long old road"), (1, 2, "dead_speaker", 99, [], "Bob")], "run_id long, expected_id long, check_name string, scene_id long, words array<string>, line string")
    got = lifecycle.score_findings(want, found.drop("sealed")).collect()[0]
    assert (got.expected, got.met, got.false_positives) == (2, 1, 1)


def test_constraints_of_tables(spark):
    entities = spark.createDataFrame([(1, 1, "a", "character"), (1, 2, "a", "character"), (1, 3, "b", "ghost")], "world_id long, entity_id long, name string, kind string")
    aliases = spark.createDataFrame([(1, 1, "x"), (1, 9, "y"), (1, None, "z")], "world_id long, entity_id long, alias string")
    runs = spark.createDataFrame([("r", "lost", None)], "run_id string, status string, phase string")
    got = {tuple(r) for r in constraints.violations({"entities": entities, "aliases": aliases, "runs": runs}).collect()}
    assert got == {("entities", "unique_world_id_name_kind", "1/a/character"), ("entities", "kind_known", "1/b/ghost"), ("aliases", "entity_id_exists", "1/9/y"), ("runs", "status_known", "r")}


def test_account_export_nests_worlds(spark, tmp_path):
    owners = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "account_id string, world_id long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (4, "d")], "world_id long, name string")
    out = lifecycle.export_accounts(owners, {"names": table}, str(tmp_path))
    assert {tuple(r) for r in out.select("account_id", "world_id", "n").collect()} == {("u", 1, 1), ("u", 2, 2), ("u", None, 3)}
    back = spark.read.json(f"{tmp_path}/names")
    assert {(r.account_id, r.world_id, r.name) for r in back.collect()} == {("u", 1, "a"), ("u", 2, "b"), ("u", 2, "c")}
