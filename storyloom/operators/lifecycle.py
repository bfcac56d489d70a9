"""What happens to rows over runs: rulings, seals, ledgers, exports, links; scores of findings; probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import checks
from storyloom.operators.lineage import cut
from storyloom.operators.matching import first_free
from storyloom.operators.needles import containing, holding
from storyloom.operators.overlap import overlap_join
from storyloom.sources.graph import Graph

# The order in which layers are blamed for a missed case.
LAYERS = ("not_extracted", "drifted", "not_present", "muted", "check")


def note_rulings(notes: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rulings (world_id, note_key, verdict, seq): the newest seals or dismisses a note, but only an open one."""
    last = rulings.filter(F.col("verdict").isin("sealed", "dismissed")).groupBy("world_id", "note_key").agg(F.max_by("verdict", "seq").alias("verdict"))
    both = notes.join(last, ["world_id", "note_key"], "left")
    return both.withColumn("status", F.when((F.col("status") == "open") & F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("status"))).drop("verdict")


def note_diff(notes: DataFrame) -> DataFrame:
    """What the newest run of each world did: new, resolved, sealed, dismissed or carried notes."""
    newest = F.max("last_seen_run").over(Window.partitionBy("world_id"))
    n = notes.withColumn("run", newest)
    change = (
        F.when(F.col("status").isin("sealed", "dismissed"), F.col("status")).when((F.col("status") == "addressed") & (F.col("last_seen_run") == F.col("run")), "resolved")
        .when((F.col("first_seen_run") == F.col("run")) & (F.col("last_seen_run") == F.col("run")), "new").otherwise("carried")
    )
    return n.select("world_id", "note_key", "family", change.alias("change"))


def notes_by_scene(notes: DataFrame) -> DataFrame:
    """Open notes at each scene they cite or anchor (arrays ``cited``, ``anchors``), citations first, every scene once."""
    scenes = F.array_distinct(F.concat(F.coalesce("cited", F.array().cast("array<bigint>")), F.coalesce("anchors", F.array().cast("array<bigint>"))))
    return notes.filter("status = 'open'").select("world_id", "note_key", F.posexplode(scenes).alias("nth", "scene_id"))


def seal_fold(events: DataFrame) -> DataFrame:
    """Seal and unseal events (world_id, check_name, assertion_a, assertion_b, kind, seq) -> the seals that stand."""
    key = ["world_id", "check_name", "assertion_a", "b0"]
    e = events.withColumn("b0", F.coalesce("assertion_b", F.lit(0)))
    return e.groupBy(*key).agg(F.max_by("kind", "seq").alias("kind")).filter("kind = 'seal'").select("world_id", "check_name", "assertion_a", F.nullif("b0", F.lit(0)).alias("assertion_b"))


def ledger(events: DataFrame) -> DataFrame:
    """Run events numbered within their run by time and id."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")))


def tail(numbered: DataFrame, after: DataFrame) -> DataFrame:
    """Ledger rows behind what each reader (run_id, after) has seen."""
    return numbered.join(after, "run_id").filter(F.col("seq") > F.col("after")).drop("after")


def live_links(links: DataFrame) -> DataFrame:
    """Share links (token, world_id, kind, created_at, revoked_at) that resolve: the newest of each world and kind, unless revoked."""
    last = links.groupBy("world_id", "kind").agg(F.max_by(F.struct("token", "revoked_at"), F.struct("created_at", "token")).alias("l"))
    return last.filter("l.revoked_at is null").select("world_id", "kind", "l.token")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of an export by table and world."""
    parts = [df.groupBy("world_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "world_id", "n") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def export(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Every table as JSON lines by world, and the manifest beside them."""
    for n, df in tables.items():
        df.sortWithinPartitions(*[c for c in df.columns if c.endswith("_id")]).write.mode("overwrite").partitionBy("world_id").json(f"{folder}/{n}")
    out = manifest(tables)
    out.write.mode("overwrite").json(f"{folder}/manifest")
    return out


def account_manifest(owners: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of each account's worlds (owners: account_id, world_id) by table; world_id null: all worlds of the account."""
    own = manifest(tables).join(owners.select("account_id", "world_id").distinct(), "world_id")
    total = own.groupBy("account_id", "table_name").agg(F.sum("n").alias("n")).withColumn("world_id", F.lit(None).cast("long"))
    return own.unionByName(total.select(*own.columns))


def export_accounts(owners: DataFrame, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Every table as JSON lines by account and, inside, by world; and the manifest beside them."""
    keys = owners.select("account_id", "world_id").distinct()
    for n, df in tables.items():
        df.join(keys, "world_id").write.mode("overwrite").partitionBy("account_id", "world_id").json(f"{folder}/{n}")
    out = account_manifest(owners, tables)
    out.write.mode("overwrite").json(f"{folder}/manifest")
    return out


def flatten_candidates(files: DataFrame) -> DataFrame:
    """Candidate files (world, scenes: array of structs with scene_id, story_position, assertions) -> one row an assertion."""
    scene = files.select("world", F.explode_outer("scenes").alias("s"))
    return scene.select("world", F.col("s.scene_id").alias("scene_id"), F.col("s.story_position").alias("story_position"), F.inline("s.assertions"))


def seed_aliases(entities: DataFrame, flat: DataFrame) -> DataFrame:
    """The two layouts of an alias file, nested (name, kind, aliases) and flat (entity, alias, kind), as (name, alias, kind)."""
    nested = entities.select("name", F.explode_outer("aliases").alias("a"), "kind").select("name", F.coalesce("a.alias", "name").alias("alias"), "kind")
    own = entities.select("name", F.col("name").alias("alias"), "kind")
    return nested.unionByName(own).unionByName(flat.select(F.col("entity").alias("name"), "alias", "kind")).dropDuplicates(["name", "alias"])


def drop_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def probes(g: Graph, muted: tuple[str, ...] = ("rejected", "retconned")) -> DataFrame:
    """Counts behind the checks, per world: late knowers, those that met a teller, overlapping places, scenes after an end."""
    n = lambda df, name: df.groupBy("world_id").agg(F.count("*").alias("n")).select("world_id", F.lit(name).alias("probe"), "n")
    late = checks.knowers(g, muted).filter("since > first_since")
    alone = checks.unsourced(g, muted)
    here = checks.active(g, muted).filter("predicate = 'located_at' and object_id is not null")
    other = here.select("world_id", "subject_id", F.col("assertion_id").alias("b"), F.col("object_id").alias("ob"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    over = overlap_join(here, other, ["world_id", "subject_id"], ("lo", "hi"), ("lb", "hb")).filter((F.col("b") > F.col("assertion_id")) & (F.col("ob") != F.col("object_id")))
    ended = checks.active(g, muted).filter("predicate in ('dies', 'destroyed') and lo is not null").select("world_id", "subject_id", "lo")
    after = ended.join(checks.presence_scenes(g), ["world_id", "subject_id"]).filter("at > lo")
    return reduce(DataFrame.unionByName, [n(late, "late_knowers"), n(alone, "late_without_source"), n(over, "overlapping_places"), n(after, "scenes_after_end")])


def capability_probes(g: Graph, muted: tuple[str, ...] = ("rejected", "retconned")) -> DataFrame:
    """What someone can't do (world_id, subject_id, handle) with the acts against it, whenever they are: an act whose words hold it, or its denial.

    Without any act the layer is the first of ``LAYERS``, the extraction's; with some, the last, the check's.
    """
    a = checks.active(g, muted)
    who = F.struct("world_id", "subject_id").alias("world_id")  # the needles of each subject meet its own words only
    rules = a.filter("predicate = 'cannot' and polarity and fact_key <> ''").select("world_id", "subject_id", F.col("fact_key").alias("handle")).distinct()
    acts = a.filter("predicate <> 'cannot' and polarity and fact_key <> ''").groupBy(who, F.col("fact_key").alias("hay")).agg(F.count("*").alias("n"))
    done = containing(acts, rules.select(who, F.col("handle").alias("needle"))).select("world_id.*", F.col("needle").alias("handle"), "n")
    denied = a.filter("predicate = 'cannot' and not polarity").groupBy("world_id", "subject_id", F.col("fact_key").alias("handle")).agg(F.count("*").alias("n"))
    key = ["world_id", "subject_id", "handle"]
    met = done.unionByName(denied).groupBy(*key).agg(F.sum("n").alias("acts"))
    n = F.coalesce("acts", F.lit(0))
    return rules.join(met, key, "left").select(*key, n.alias("acts"), F.when(n == 0, LAYERS[0]).otherwise(LAYERS[-1]).alias("layer"))


def met_links(wanted: DataFrame, said: DataFrame, scenes: DataFrame) -> DataFrame:
    """What may meet what: wanted (group, wanted, scene_id, line), said (group, offered, said) with scenes (group, offered, scene_id) -> (group, wanted, offered).

    At the same scene, or where a line of three tokens or more is repeated to 55 %; a line is looked up by its rarest tokens.
    """
    at = wanted.join(scenes, ["group", "scene_id"]).select("group", "wanted", "offered")
    long_ = wanted.filter(F.size(text.tokens("line")) >= 3).select(F.col("group").alias("world_id"), F.col("wanted").alias("fact_key"), F.col("line").alias("fact"))
    near = fact_matches(said.select(F.col("group").alias("world_id"), F.col("offered").alias("handle_id"), F.col("said").alias("handle")), long_, 0.55)
    return at.unionByName(near.select(F.col("world_id").alias("group"), F.col("fact_key").alias("wanted"), F.col("handle_id").alias("offered")))


def met_pools(wanted: DataFrame, said: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``met_links``, but who wants the same scene or a line of the same tokens wants from one pool: pools (group, pool, offered) and members (group, wanted, pool)."""
    at = wanted.filter("scene_id is not null").select("group", "wanted", "scene_id", F.xxhash64(F.lit("scene"), F.col("scene_id").cast("long")).alias("pool"))
    here = scenes.join(at.select("group", "scene_id", "pool").distinct(), ["group", "scene_id"]).select("group", "pool", "offered")
    own = F.array_sort(text.tokens("line"))
    long_ = wanted.filter(F.size(text.tokens("line")) >= 3).withColumn("pool", F.xxhash64(F.lit("line"), own))
    lines = long_.groupBy(F.col("group").alias("world_id"), F.col("pool").alias("fact_key")).agg(F.first("line").alias("fact"))
    near = fact_matches(said.select(F.col("group").alias("world_id"), F.col("offered").alias("handle_id"), F.col("said").alias("handle")), lines, 0.55)
    pools = here.unionByName(near.select(F.col("world_id").alias("group"), F.col("fact_key").alias("pool"), F.col("handle_id").alias("offered")))
    return pools, at.select("group", "wanted", "pool").unionByName(long_.select("group", "wanted", "pool"))


def word_pools(wanted: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who wants the same words (group, wanted, words) wants from one pool: pools (group, pool, offered) and members (group, wanted, pool).

    All words must stand in ``said``, in any case; no words, or none that isn't empty, stand nowhere.  Texts are found
    by the rarest gram of the longest word.
    """
    own = F.array_sort(F.array_distinct(F.filter(F.transform("words", lambda w: F.lower(F.trim(w))), lambda w: w != "")))
    each = wanted.select("group", "wanted", own.alias("own")).filter(F.size("own") > 0).withColumn("pool", F.xxhash64("own"))
    longest = F.get(F.sort_array(F.transform("own", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    needles = each.select(F.col("group").alias("world_id"), "pool", "own").dropDuplicates(["world_id", "pool"]).withColumn("needle", longest)
    hays = said.select(F.col("group").alias("world_id"), "offered", F.lower("said").alias("hay"))
    pools = containing(hays, needles).filter(F.forall("own", lambda w: F.col("hay").contains(w)))
    return pools.select(F.col("world_id").alias("group"), "pool", "offered"), each.select("group", "wanted", "pool")


def score_findings(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per run: how many expected findings (run_id, expected_id, check_name, scene_id, words) are met, and what is left over.

    A finding that isn't ``sealed`` meets an expectation of its check at its scene, one whose ``line`` (if that column
    is given) it repeats, or one whose words it all mentions; each at most one, in order of id.  Expectations whose
    ``kind`` is note come last and are met by notes alone.
    """
    has = lambda df, c, default: df if c in df.columns else df.withColumn(c, default)
    nothing = F.lit(None).cast("string")
    e = has(has(expected, "line", nothing), "kind", F.lit("finding")).withColumn("is_note", F.coalesce(F.col("kind") == "note", F.lit(False)))
    group = F.xxhash64("run_id", text.norm_collapse("check_name")).alias("group")
    nth = F.row_number().over(Window.partitionBy("group").orderBy("is_note", "expected_id")).cast("long")
    e = cut(e.select("*", group).withColumn("wanted", nth), grows=True)
    live = has(found, "sealed", F.lit(False)).filter("sealed is not true").select("run_id", F.col("finding_id").alias("offered"), "scene_id", F.col("explanation").alias("said"), "severity", group)
    live = cut(live, grows=True)  # each way of meeting reads it
    notes = live.filter("severity = 'note'")
    pools, members = [], []
    for want, have in ((e.filter(~F.col("is_note")), live), (e.filter("is_note"), notes)):
        # Notes' pools are others than those of findings with the same words.
        own = F.xxhash64("pool", F.lit(have is live)).alias("pool")
        for p, m in (met_pools(want, have, have.select("group", "offered", "scene_id")), word_pools(want, have)):
            pools.append(p.select("group", own, "offered"))
            members.append(m.select("group", "wanted", own))
    hit = cut(first_free(None, *(reduce(DataFrame.unionByName, x) for x in (pools, members))), grows=True)
    extra = live.filter(F.col("severity").isin("critical", "warning")).join(hit, ["group", "offered"], "left_anti").groupBy("run_id").agg(F.count("*").alias("false_positives"))
    met = e.join(hit, ["group", "wanted"], "left_semi").groupBy("run_id").agg(F.count("*").alias("met"))
    total = expected.groupBy("run_id").agg(F.count("*").alias("expected"))
    return total.join(met, "run_id", "left").join(extra, "run_id", "left").fillna(0).withColumn("recall", F.col("met") / F.col("expected"))


def attribute_misses(cases: DataFrame) -> DataFrame:
    """Missed cases (case_id, extracted, drift, present, muted) -> the earliest layer that explains each."""
    layer: Column = (
        F.when(~F.col("extracted"), LAYERS[0]).when(F.col("drift") < 0.5, LAYERS[1]).when(~F.col("present"), LAYERS[2]).when(F.col("muted"), LAYERS[3]).otherwise(LAYERS[4])
    )
    return cases.select("case_id", layer.alias("layer"))


def containment(a: Column | str, b: Column | str) -> Column:
    """The share of a's tokens that b has."""
    x, y = text.tokens(a), text.tokens(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(x)), F.lit(0.0))


def evaluate_runs(cases: DataFrame, extra: DataFrame, episodes: int, bar: tuple[float, float] = (0.8, 2.0)) -> DataFrame:
    """Cases (run_id, case_id, kind error|trap, hit) and wrong findings (run_id, n) -> recall, false positives per episode, traps respected, and whether the run passes."""
    error, trap = F.col("kind") == "error", F.col("kind") == "trap"
    sums = cases.groupBy("run_id").agg(
        F.count_if(error).alias("errors"), F.count_if(error & F.col("hit")).alias("caught"), F.count_if(trap).alias("traps"), F.count_if(trap & ~F.col("hit")).alias("respected"),
    )
    wrong = extra.groupBy("run_id").agg(F.sum("n").alias("wrong"))
    out = sums.join(wrong, "run_id", "left").withColumn("wrong", F.coalesce("wrong", F.lit(0)).cast("long"))
    out = out.withColumn("recall", F.try_divide("caught", "errors")).withColumn("wrong_per_episode", F.col("wrong") / F.lit(episodes))
    return out.withColumn("passed", (F.coalesce("recall", F.lit(1.0)) >= bar[0]) & (F.col("wrong_per_episode") <= bar[1]) & (F.col("respected") == F.col("traps")))


def trap_scores(traps: DataFrame, found: DataFrame) -> DataFrame:
    """Traps (run_id, trap_id, check_name or *, words) that no unsealed finding of the check with all the words may meet -> respected or not."""
    f = found.filter("not sealed and run_id is not null").select(F.col("run_id").alias("world_id"), F.col("check_name").alias("of"), F.lower("explanation").alias("hay"))
    hays = cut(f.filter("hay is not null").distinct(), grows=True)
    of_check = (F.col("check_name") == "*") | (F.col("check_name") == F.col("of"))
    low = F.transform("words", lambda w: F.lower(w))
    t = traps.filter("check_name is not null").select(F.col("run_id").alias("world_id"), "trap_id", "check_name", low.alias("low"))
    t = t.filter("low is not null").filter(~F.exists("low", lambda w: w.isNull()))
    longest = F.array_max(F.transform("low", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    t = t.withColumn("needle", F.coalesce(longest, F.lit("")))
    met = holding(hays, t).filter(of_check & F.forall("low", lambda w: F.col("hay").contains(w)))
    wordless = t.filter("needle = ''").join(hays.select("world_id", "of").distinct(), "world_id").filter(of_check)
    broken = met.select("world_id", "trap_id").unionByName(wordless.select("world_id", "trap_id")).distinct().select(F.col("world_id").alias("run_id"), "trap_id", F.lit(False).alias("respected"))
    return traps.join(broken, ["run_id", "trap_id"], "left").select("run_id", "trap_id", "check_name", F.coalesce("respected", F.lit(True)).alias("respected"))


def fact_matches(handles: DataFrame, facts: DataFrame, share: float = 0.5) -> DataFrame:
    """Handles (world_id, handle_id, handle) and facts (world_id, fact_key, fact) -> (world_id, handle_id, fact_key) that may mean the same.

    At least ``share`` of the fact's tokens stand in the handle, and at least two (of one-token facts: that one).  A
    fact of n tokens that needs m of them meets a handle in one of its n - m + 1 rarest, so only these are joined.
    """
    f = facts.select("world_id", "fact_key", text.tokens("fact").alias("t")).filter(F.size("t") > 0)
    size = F.size("t")
    f = f.withColumn("need", F.greatest(F.least(F.lit(2), size), F.ceil(F.round(size * F.lit(share), 9)).cast("int")))
    each = f.withColumn("token", F.explode("t"))
    often = each.groupBy("world_id", "token").agg(F.count("*").alias("n"))
    rare = F.row_number().over(Window.partitionBy("world_id", "fact_key", "t").orderBy("n", "token"))
    probe = each.join(often, ["world_id", "token"]).withColumn("nth", rare).filter(F.col("nth") <= size - F.col("need") + 1).drop("n", "nth")
    h = handles.select("world_id", "handle", text.tokens("handle").alias("u")).distinct().withColumn("token", F.explode("u"))
    met = h.join(probe, ["world_id", "token"]).filter(F.size(F.array_intersect("t", "u")) >= F.col("need")).select("world_id", "handle", "fact_key").distinct()
    return handles.join(met, ["world_id", "handle"]).select("world_id", "handle_id", "fact_key").distinct()


# The fields of a finding as other tools read it, and the severity of what a detector reports.
CONTRACT = {"check": "check_name", "severity": "severity", "explanation": "explanation", "sealed": "sealed", "scene_id": "scene_id", "assertion_a": "assertion_a", "assertion_b": "assertion_b"}
DETECTED_WARNINGS = ("capability_violation",)


def contract(found: DataFrame) -> DataFrame:
    """(world_id, finding): each finding as one JSON object of the contract's fields, nulls written out."""
    fields = F.struct(*[F.col(c).alias(name) for name, c in CONTRACT.items()])
    return found.select("world_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("finding"))


def document_lines(found: DataFrame, worlds: DataFrame) -> DataFrame:
    """(world_id, place, line): a world's lines in order of place are one JSON document, {"findings": [...]}, the worst findings first."""
    fields = F.to_json(F.struct(*[F.col(c).alias(name) for name, c in CONTRACT.items()]), {"ignoreNullFields": "false"})
    order = ["world_id", checks.severity_rank(), "check_name", "scene_id", "assertion_a", "assertion_b", "explanation"]
    ranked = numbered(cut(found), order, "world_id").select("world_id", "place", fields.alias("json"))
    body = ranked.select("world_id", "place", F.concat(F.when(F.col("place") > 1, ",").otherwise(""), "json").alias("line"))
    all_ = worlds.select("world_id").distinct()
    n = ranked.groupBy("world_id").agg(F.count("*").alias("n"))
    first = all_.select("world_id", F.lit(0).cast("long").alias("place"), F.lit('{"findings": [').alias("line"))
    last = all_.join(n, "world_id", "left").select("world_id", (F.coalesce("n", F.lit(0)) + 1).alias("place"), F.lit("]}").alias("line"))
    return body.unionByName(first).unionByName(last)


def numbered(df: DataFrame, order: list[Column | str], key: str) -> DataFrame:
    """Rows with their ``place`` from 1 in the order within each key, which ``order`` begins with, for few keys of many rows: no key is sorted in one task.

    Rows are parted by ranges of the order and numbered in each part; then a part's rows come after those of the key in
    the parts before.
    """
    # The lower 33 bits of this id number the rows of a part, the others the part itself.
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    sizes = parted.groupBy(key, part).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")
    starts = sizes.select(key, "__part", (F.col("__first") - before).alias("__start"))
    both = parted.withColumn("__part", part).join(F.broadcast(starts), [key, "__part"])
    return both.select(*df.columns, (F.col("__id") - F.col("__start") + 1).alias("place"))


def write_documents(found: DataFrame, worlds: DataFrame, path: str) -> None:
    """One JSON document a world, as text: rows stream into a world's file in their order."""
    lines = document_lines(found, worlds).repartition("world_id").sortWithinPartitions("world_id", "place")
    lines.select("world_id", "line").write.mode("overwrite").partitionBy("world_id").text(path)


def detected(errors: DataFrame) -> DataFrame:
    """Errors of another detector (world_id, check, who, explanation, contradicts) as findings without anchors."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.concat(F.trim(plain("who")), F.lit(": "), plain("explanation"), F.lit(" (contradicts: "), plain("contradicts"), F.lit(")"))
    nothing = lambda c: F.lit(None).cast("long").alias(c)
    check = F.coalesce("check", F.lit("other"))
    severity = F.when(check.isin(*DETECTED_WARNINGS), checks.WARNING).otherwise(checks.CRITICAL)
    return errors.select("world_id", check.alias("check_name"), severity.alias("severity"), said.alias("explanation"), nothing("scene_id"), nothing("assertion_a"), nothing("assertion_b"), F.lit(False).alias("sealed"))


def write_findings(found: DataFrame, path: str) -> None:
    """Findings as JSON lines, one a finding."""
    found.write.mode("overwrite").json(path)
