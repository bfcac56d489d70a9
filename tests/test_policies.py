"""Policies, switches of families, rule logs, printed pages, scores with notes, documents of findings: small cases by hand or brute force."""

import json
import random

from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import lifecycle, matching, notes, report, rules, usage
from storyloom.sources import scripts


def test_windows_and_ever(spark):
    log = [("u", "ask", 0), ("u", "ask", 10), ("u", "world_create", 0), ("p", "ask", 0), ("u", "other", 1), ("u", "ask", 200)]
    ask = [(1, "u", "ask", 9), (2, "u", "ask", 10), (3, "u", "ask", 100), (4, "u", "ask", 101), (5, "u", "world_create", 99999), (6, "p", "ask", 50), (7, "u", "other", 5), (8, "new", "ask", 5), (9, None, "ask", 5)]
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds("ts"))
    policies = {"free": {"ask": (2, 100), "world_create": (1, None)}, "paid": {"ask": (9, 100)}}
    got = usage.decisions(stamp(spark.createDataFrame(ask, "request_id long, user_id string, kind string, ts long")), stamp(spark.createDataFrame(log, "user_id string, kind string, ts long")), spark.createDataFrame([("p", "paid")], "user_id string, tier string"), policies)
    rows = {r.request_id: (r.used, r.allowed, r.retry_after, r.reason) for r in got.collect()}
    assert rows[1] == (1, True, None, None) and rows[4] == (1, True, None, None) and rows[6] == (1, True, None, None) and rows[8] == (0, True, None, None) and rows[9] == (0, True, None, None)
    assert rows[2] == (2, False, 90, "free tier allows 2 ask per 100s") and rows[3] == (2, False, 1, "free tier allows 2 ask per 100s")
    assert rows[5] == (1, False, None, "free tier allows 1 world_create per account") and rows[7] == (None, True, None, None)


def test_pages_of_scripts(spark):
    docs = spark.createDataFrame([(1, "a", "\n" * 54), (2, "a", "\n" * 55), (3, "b", None)], "doc_id long, user_id string, text string")
    got = usage.page_decisions(docs, spark.createDataFrame([("b", "gold")], "user_id string, tier string"), {"free": 1}).collect()
    assert {(r.doc_id, r.pages, r.allowed, r.reason) for r in got} == {(1, 1, True, None), (2, 2, False, "free tier accepts scripts up to 1 pages (got 2)"), (3, 1, True, None)}


def test_names(spark):
    rows = [("a/b/Old Show.v2.fountain", "Old-Show-v2"), ("/x/.hidden", "hidden"), ("", "t-1"), (None, "t-1"), ("é/é", "work")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "p string")
    got = df.select("p", text.work_key(F.lit(None).cast("int"), F.col("p"), F.lit("t 1")).alias("k"), text.world_slug("p").alias("w"), text.safe_slug("p").alias("s")).collect()
    assert {(r.p, r.k) for r in got} == set(rows)
    assert {r.p: (r.w, r.s) for r in got} == {"a/b/Old Show.v2.fountain": ("old_show_v2", "a_b_Old_Show.v2.fountain"), "/x/.hidden": ("hidden", "x_.hidden"), "": ("script", "world"), None: ("script", "world"), "é/é": ("script", "world")}
    lines = spark.createDataFrame([(x,) for x in ("12", " 7. ", "(CONTINUED)", "more:", "CONTINUED: (3)", "Page 3", "page 3 of 9", "Page three", "12 men", "", None)], "x string")
    assert {r.x for r in lines.filter(text.is_furniture("x")).collect()} == {"12", " 7. ", "(CONTINUED)", "more:", "CONTINUED: (3)", "Page 3", "page 3 of 9"}
    families = spark.createDataFrame([(x,) for x in (" f1", "Dead-Speaker", "F9", None)], "x string").select(text.family_name("x").alias("y"))
    assert [r.y for r in families.collect()] == ["F1", "dead_speaker", "f9", ""]


def test_printed_pages(spark):
    page = "Title: x\nnone\nINT. HALL - DAY #4#\n12.\nshe waits\n(CONTINUED)\nint. no\nFLASHBACK:\n.FORCED\nEXT. ROAD\n[PLANTED: y]\n  rain  \nBACK TO PRESENT\nI/E. CAR"
    got = scripts.scenes(spark.createDataFrame([(1, page), (2, None), (3, "only\ntext")], "doc_id long, text string"), printed=True).orderBy("scene").collect()
    assert [(r.slug, r.is_flashback, r.raw_text) for r in got] == [
        ("INT. HALL - DAY", False, "INT. HALL - DAY #4#\nshe waits\nint. no\n.FORCED"), ("EXT. ROAD", True, "EXT. ROAD\n\n  rain"), ("I/E. CAR", False, "I/E. CAR"),
    ]


def test_rules_over_their_log(spark):
    log = [(1, "a", "create", 1, "only", "A"), (1, "a", "disable", 3, None, None), (1, "b", "disable", 1, None, None), (1, "b", "create", 2, "cannot", "B"), (1, "c", "create", 1, "only", None), (1, "c", "delete", 5, None, None),
           (1, "d", "enable", 4, None, None), (1, "e", "create", 1, "only", "E"), (1, "e", "disable", 2, None, None), (1, "e", "enable", 3, None, None)]
    got = rules.rule_list(spark.createDataFrame(log, "world_id long, rule_id string, op string, at long, kind string, label string")).orderBy("place").collect()
    assert [(r.rule_id, r.kind, r.label, r.created_at, r.disabled_at) for r in got] == [("a", "only", "A", 1, 3), ("e", "only", "E", 1, None), ("b", "cannot", "B", 2, None)]


def greedy(links):
    taken, out = set(), set()
    for g, w in sorted({(g, w) for g, w, _ in links}):
        free = [o for o in sorted(o for a, b, o in links if (a, b) == (g, w)) if (g, o) not in taken]
        if free:
            taken.add((g, free[0]))
            out.add((g, w, free[0]))
    return out


def test_first_free_equals_brute_force(spark):
    r = random.Random(5)
    links = [(g, r.randrange(30), r.randrange(1, 25)) for g in range(4) for _ in range(60)] + [(9, w, o) for w in range(12) for o in range(9)]
    df = spark.createDataFrame(links + links[:20], "group long, wanted long, offered long").repartition(5)
    for hot in (10**6, 0):  # a group as it is, and in its connected sets
        assert {tuple(x) for x in matching.first_free(df, hot=hot).collect()} == greedy(links)
    assert matching.first_free(df.limit(0)).count() == 0
    pools = [(g, p, r.randrange(1, 25)) for g in range(4) for p in range(5) for _ in range(6)]
    members = [(g, r.randrange(40), r.randrange(6)) for g in range(4) for _ in range(30)]  # some of no pool, some of two, some without links
    long = links + [(g, w, o) for g, w, p in members for h, q, o in pools if (h, q) == (g, p)]
    three = [df, spark.createDataFrame(pools, "group long, pool long, offered long"), spark.createDataFrame(members, "group long, wanted long, pool long")]
    for hot in (10**6, 0):
        assert {tuple(x) for x in matching.first_free(*three, hot).collect()} == greedy(long)


def test_notes_are_met_by_notes_and_last(spark):
    found = spark.createDataFrame([(1, 1, "c", 7, "Ann falls", "note", None), (1, 2, "c", 7, "Ann sings", "critical", False), (1, 3, "c", 7, "Ann sings", "critical", True), (1, 4, "C!", 9, "Bob's long old road", "warning", False)], "run_id long, finding_id long, check_name string, scene_id long, explanation string, severity string, sealed boolean")
    schema = "run_id long, expected_id long, check_name string, scene_id long, words array<string>, line string, kind string"
    want = [(1, 1, "c", None, ["ANN"], None, "note"), (1, 2, "c", 7, [], None, "finding"), (1, 3, "c", None, ["road", "bob"], None, None), (1, 4, "c", 99, [""], None, "finding")]
    got = lifecycle.score_findings(spark.createDataFrame(want, schema), found).collect()[0]
    # 2 takes finding 1, the first at its scene, so no note is left for 1; 3 takes 4; finding 2 is left over, the sealed 3 counts for nothing.
    assert (got.expected, got.met, got.false_positives) == (4, 2, 1)
    line = [(1, 1, "c", None, None, " ".join(f"w{i}" for i in range(20)), "finding")]
    eleven = found.limit(1).withColumn("explanation", F.lit(" ".join(f"w{i}" for i in range(11))))
    assert lifecycle.score_findings(spark.createDataFrame(line, schema), eleven).collect()[0].met == 1


def test_coverage_with_aliases_lines_and_decoys(spark):
    schema = "world_id long, expected_id long, family string, scene_id long, line string, words array<string>"
    want = spark.createDataFrame([(1, 1, "F1", 5, None, []), (1, 2, "F1", 6, "the long old road north", []), (1, 3, "f3", None, None, ["vera", "gold"]), (1, 4, "F4", None, None, None), (1, 5, "F2", 5, None, ["vera"])], schema)
    decoys = spark.createDataFrame([(1, 1, "F3", None, None, ["vera"]), (1, 2, "F1", 5, None, [])], schema)
    rows = [(1, 1, "Open_Question", None, [5, 5], "why"), (1, 2, "open question", "open", [9], "a long old road"), (1, 3, "dormant-knowledge", "OPEN", [], "VERA hid gold"), (1, 4, "F1", "Sealed", [5], "x"), (1, 5, "F2", "open", [8], "vera")]
    got = report.coverage_scores(want, spark.createDataFrame(rows, "world_id long, note_id long, family string, status string, scene_ids array<long>, body string"), decoys).collect()[0]
    assert (got.expected, got.met, got.left_over, got.decoy_hits, got.precision) == (5, 3, 1, 2, 0.75)


def test_keys_that_are_sealed_are_no_candidates(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "world_id long, note_key string")
    known = spark.createDataFrame([(1, "a", "sealed"), (1, "b", "addressed"), (1, "z", "open")], "world_id long, note_key string, status string")
    assert {tuple(r) for r in notes.unsuppressed(found, known).collect()} == {(1, "b", "addressed"), (1, "c", None), (2, "a", None)}


def test_a_document_of_findings_is_json(spark, tmp_path):
    found = spark.createDataFrame([(1, "b", "note", 'say "x"', False, 3, 1, None), (1, "a", "critical", "é\n", True, None, 2, 3)], "world_id long, check_name string, severity string, explanation string, sealed boolean, scene_id long, assertion_a long, assertion_b long")
    worlds = spark.createDataFrame([(1,), (2,)], "world_id long")
    lifecycle.write_documents(found, worlds, str(tmp_path / "docs"))
    said = {int(p.name.split("=")[1]): json.loads("".join(f.read_text() for f in p.glob("*.txt"))) for p in (tmp_path / "docs").glob("world_id=*")}
    assert [f["check"] for f in said[1]["findings"]] == ["a", "b"] and said[1]["findings"][1]["explanation"] == 'say "x"' and said[2] == {"findings": []}
