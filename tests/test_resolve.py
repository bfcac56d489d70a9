from random import Random

from storyloom.operators import folds, lifecycle, resolve


def test_resolution_grows_names(spark):
    rows = [(1, "Anna", "character", 1), (1, "ANNA KEEL", "character", 2), (1, "Keel", "character", 3), (1, "Tom Keel", "character", 4), (1, "deputy", "character", 5), (1, "Old Mill", "location", 6), (2, "Keel", "character", 1)]
    m = spark.createDataFrame(rows, "world_id long, surface string, kind string, position int")
    present = spark.createDataFrame([(1, "anna"), (2, "none")], "world_id long, norm string")
    out = resolve.resolve(m, present)
    got = {(r.world_id, r.norm): (r.entity, r.outcome, r.provisional) for r in out.collect()}
    assert got[1, "anna"] == ("ANNA KEEL", "new", False) and got[1, "anna keel"] == ("ANNA KEEL", "alias", False)
    assert got[1, "keel"][:2] == ("ANNA KEEL", "alias") and got[1, "deputy"] == (None, "role", False)
    assert got[1, "old mill"] == ("Old Mill", "new", False) and got[2, "keel"] == ("Keel", "new", True)
    assert {(r.norm, r.positions) for r in resolve.queue(out, m).collect()} >= {("deputy", "5")}


def test_seeds_keep_their_name(spark):
    m = spark.createDataFrame([(1, "Anna Maria Keel", "character", 1)], "world_id long, surface string, kind string, position int")
    seed = spark.createDataFrame([(1, "anna keel", "Anna Keel", "character")], "world_id long, norm string, surface string, kind string")
    present = spark.createDataFrame([], "world_id long, norm string")
    got = {r.norm: (r.entity, r.provisional) for r in resolve.resolve(m, present, seed).collect()}
    assert got == {"anna keel": ("Anna Keel", False), "anna maria keel": ("Anna Keel", False)}


def test_interval_fold(spark):
    rows = [(1, 1, 1, 50, 1, True), (1, 1, 2, 50, 2, True), (1, 1, 3, 51, 4, True), (1, 1, 4, 52, 4, True), (1, 1, 5, 50, 6, False), (1, 1, 6, 50, None, True), (1, 2, 7, 50, 3, True)]
    df = spark.createDataFrame(rows, "world_id long, subject_id long, assertion_id long, object_id long, position int, starts boolean").repartition(3)
    got = {r.assertion_id: (r.lo, r.hi, r.action) for r in folds.interval_fold(df).collect()}
    assert got == {1: (1, 4, "closed"), 2: (2, None, "skipped"), 3: (4, None, "open"), 4: (4, None, "conflict"), 5: (6, 7, "anchored"), 6: (None, None, "anchored"), 7: (3, None, "open")}


def test_alias_layouts_and_export(spark, tmp_path):
    nested = spark.createDataFrame([("Anna", "character", [("Ann", "short")]), ("Mill", "location", [])], "name string, kind string, aliases array<struct<alias:string,kind:string>>")
    flat = spark.createDataFrame([("Anna", "A.", "character")], "entity string, alias string, kind string")
    got = {(r.name, r.alias) for r in lifecycle.seed_aliases(nested, flat).collect()}
    assert got == {("Anna", "Anna"), ("Anna", "Ann"), ("Anna", "A."), ("Mill", "Mill")}
    t = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "world_id long, entity_id long")
    counts = {(r.world_id, r.n) for r in lifecycle.export({"entities": t}, str(tmp_path / "x")).collect()}
    assert counts == {(1, 2), (2, 1)} and spark.read.json(str(tmp_path / "x/entities")).count() == 3


def test_merge_chains(spark):
    m = spark.createDataFrame([(1, 3, 2), (1, 2, 1)], "world_id long, old_id long, new_id long")
    rows = spark.createDataFrame([(1, 3, 9), (1, 1, 2), (2, 3, 3)], "world_id long, subject_id long, object_id long")
    got = sorted(tuple(r) for r in folds.apply_merges(rows, m, ["subject_id", "object_id"]).select("world_id", "subject_id", "object_id").collect())
    assert got == [(1, 1, 1), (1, 1, 9), (2, 3, 3)]


def test_interval_fold_against_a_loop(spark):
    """Windows and a loop over the rows in order agree, with few places and many rows at one position."""
    random = Random(7)
    rows = [(1, s, i, random.randrange(1, 2 + s % 4), random.choice([None, *range(1, 3 + s % 9)]), random.random() < 0.9) for s in range(60) for i in random.sample(range(100), 25)]
    df = spark.createDataFrame(rows, "world_id long, subject_id long, assertion_id long, object_id long, position int, starts boolean")
    want = {}
    for s in range(60):
        live = None
        for _, _, i, place, at, starts in sorted((r for r in rows if r[1] == s and r[4] is not None and r[5]), key=lambda r: (r[4], r[2])):
            if live is not None and want[s, live][1] == place:
                want[s, i] = (at, place, None, "skipped")
            elif live is not None and want[s, live][0] == at:
                want[s, i] = (at, place, None, "conflict")
            else:
                if live is not None:
                    want[s, live] = (*want[s, live][:2], at, "closed")
                want[s, i], live = (at, place, None, "open"), i
    want |= {(r[1], r[2]): (r[4], r[3], None if r[4] is None else r[4] + 1, "anchored") for r in rows if r[4] is None or not r[5]}
    got = {(r.subject_id, r.assertion_id): (r.lo, r.object_id, r.hi, r.action) for r in folds.interval_fold(df).collect()}
    assert got == want


def resolved_in_a_loop(rows, present):
    """One pass over the names in order, each compared with all entities before it."""
    near = lambda t, u: t != u and len(t & u) > 0 and (len(t & u) == min(len(t), len(u)) or len(t & u) >= 0.5 * len(t | u))
    registry, out = [], {}
    for norm, surface, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        t = set(norm.split())
        hit = [e for e in registry if any(near(t, n) for n in e["names"])]
        if len(hit) > 1:
            out[norm] = (None, "ambiguous")
        elif hit:
            hit[0]["names"].append(t)
            hit[0]["shown"] |= norm in present
            if len(t) > len(hit[0]["name"].split()):
                hit[0]["name"] = surface
            out[norm] = (hit[0], "alias")
        else:
            registry.append({"names": [t], "name": surface, "shown": norm in present})
            out[norm] = (registry[-1], "new")
    return {n: (e and e["name"], how, bool(e and not e["shown"])) for n, (e, how) in out.items()}


def test_resolution_equals_a_loop_in_folds_and_in_rounds(spark):
    rng = Random(5)
    words = [f"n{i}" for i in range(30)] + ["old"] * 5
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(260)})
    names = [n for n in names if len(set(n.split())) == len(n.split())]
    rows = [(n, n.title(), rng.randint(1, 60)) for n in names]
    shown = set(rng.sample(names, 80))
    m = spark.createDataFrame([(1, s, "character", p) for _, s, p in rows], "world_id long, surface string, kind string, position int").repartition(3)
    present = spark.createDataFrame([(1, n) for n in shown], "world_id long, norm string")
    want = resolved_in_a_loop(rows, shown)
    assert {how for _, how, _ in want.values()} == {"new", "alias", "ambiguous"}
    for most in (resolve.MOST, 3):
        got = {r.norm: (r.entity, r.outcome, r.provisional) for r in resolve.resolve(m, present, most=most).collect()}
        assert got == want


def test_a_hundred_thousand_names_in_one_group(spark):
    """Names that share a first word, each near the one before: a single group, folded by its links."""
    from pyspark.sql import functions as F

    n = 100_000
    m = spark.range(n).select(F.lit(1).cast("long").alias("world_id"), F.concat(F.lit("Keel n"), F.col("id"), F.lit(" n"), F.col("id") + 1).alias("surface"), F.lit("character").alias("kind"), F.col("id").cast("int").alias("position"))
    found = resolve.resolve(m, spark.createDataFrame([], "world_id long, norm string"))
    got = {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()}
    assert got == {"new": 1, "alias": n - 1}


def test_long_names_and_names_with_the_same_words_equal_the_loop(spark):
    """Names of more than ``SHORT`` tokens meet in blocks of two; those of the same words in another order are not near."""
    rng = Random(11)
    words = [f"n{i}" for i in range(12)]
    names = sorted({" ".join(rng.sample(words, rng.choice([1, 2, 2, 3, 5, 6, 7, 9]))) for _ in range(150)} | {"n1 n2", "n2 n1", "n1 n2 n3", "n3 n1 n2", "n2 n3 n1"})
    rows = [(n, n.title(), rng.randint(1, 40)) for n in names]
    m = spark.createDataFrame([(1, s, "character", p) for _, s, p in rows], "world_id long, surface string, kind string, position int")
    present = spark.createDataFrame([], "world_id long, norm string")
    want = resolved_in_a_loop(rows, set())
    for most in (resolve.MOST, 3):
        assert {r.norm: (r.entity, r.outcome, r.provisional) for r in resolve.resolve(m, present, most=most).collect()} == want


def test_names_that_share_two_words_meet_without_pairs_and_in_few_rounds(spark):
    """All of these are near one another; their places grow with the names, and rounds don't wait for each name's turn."""
    n = 400
    rows = [(f"old user {i}", f"Old User {i}", i % 50) for i in range(n)] + [(f"user {i}", f"User {i}", (i * 7) % 50) for i in range(n)]
    found = spark.createDataFrame([(1, norm, False) for norm, _, _ in rows], "world_id long, norm string, is_role boolean")
    assert resolve.places(found).count() <= 8 * len(rows)
    m = spark.createDataFrame([(1, s, "character", p) for _, s, p in rows], "world_id long, surface string, kind string, position int")
    present = spark.createDataFrame([], "world_id long, norm string")
    got = {r.norm: (r.entity, r.outcome, r.provisional) for r in resolve.resolve(m, present, most=3).collect()}
    assert got == resolved_in_a_loop(rows, set())
