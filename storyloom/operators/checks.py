"""Contradiction checks.

Each takes a graph and returns findings (world_id, check_name, severity, explanation,
scene_id, assertion_a, assertion_b).  Joins are equi joins on the world and an entity or a
fact, with ranges as residuals; alternatives are joined arm by arm and united, so no check
plans a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import ranges, text
from storyloom.operators.lineage import cut
from storyloom.operators.needles import containing
from storyloom.operators.overlap import HOT_ROWS, overlap_join, point_join
from storyloom.sources.graph import Graph

CRITICAL, WARNING, NOTE = "critical", "warning", "note"
OPEN_PREDICATES = ("promised", "goal", "secret_of")
MUTED = ("sealed",)


def findings(df: DataFrame, check: str, severity: str, explanation: Column, scene: str, a: str, b: str | None = None) -> DataFrame:
    second = F.col(b) if b else F.lit(None)
    return df.select("world_id", F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), explanation.alias("explanation"), F.col(scene).cast("long").alias("scene_id"), F.col(a).cast("long").alias("assertion_a"), second.cast("long").alias("assertion_b"))


def switched_off(config: DataFrame) -> DataFrame:
    """(world_id, family) that worlds have switched off, in the families' one spelling."""
    return config.filter(~F.col("enabled")).select("world_id", text.family_name("family").alias("family")).distinct()


def enabled(df: DataFrame, config: DataFrame, family: str) -> DataFrame:
    """Rows of worlds that have not switched the family off; a missing row is on."""
    return df.join(switched_off(config).filter(F.col("family") == family).select("world_id"), "world_id", "left_anti")


def active(g: Graph, muted: tuple[str, ...] = MUTED) -> DataFrame:
    return g.assertions.filter(~F.col("status").isin(*muted))


def names(g: Graph) -> DataFrame:
    return g.entities.select("world_id", F.col("entity_id").alias("subject_id"), "name", F.col("kind").alias("entity_kind"))


def presence_scenes(g: Graph) -> DataFrame:
    """Where entities are seen: world_id, subject_id, scene_id, slug, at, is_flashback."""
    scenes = g.scenes.select("world_id", "scene_id", "slug", F.col("story_position").alias("at"), "is_flashback")
    return g.presence.select("world_id", "scene_id", F.col("entity_id").alias("subject_id")).join(scenes, ["world_id", "scene_id"])


def _seen_after(g: Graph, predicate: str, family: str) -> DataFrame:
    ended = enabled(active(g).filter((F.col("predicate") == predicate) & F.col("polarity") & F.col("lo").isNotNull()), g.family_config, family)
    ended = ended.select("world_id", "subject_id", "lo", F.col("assertion_id").alias("a"))
    seen = presence_scenes(g).filter(~F.col("is_flashback"))
    return ended.join(seen, ["world_id", "subject_id"]).filter("at > lo").join(names(g), ["world_id", "subject_id"])


def dead_speaker(g: Graph) -> DataFrame:
    """Someone is seen after their death and no later life covers the scene."""
    seen = _seen_after(g, "dies", "dead_speaker")
    lives = active(g).filter((F.col("predicate") == "alive") & F.col("polarity")).select("world_id", "subject_id", F.col("lo").alias("from_"), F.col("hi").alias("to_"))
    s, r = seen.alias("s"), lives.alias("r")
    back = (F.col("s.world_id") == F.col("r.world_id")) & (F.col("s.subject_id") == F.col("r.subject_id")) & (F.col("r.from_") > F.col("s.lo")) & ranges.contains(F.col("r.from_"), F.col("r.to_"), F.col("s.at"))
    said = F.concat("name", F.lit(" is seen at "), F.col("at").cast("string"), F.lit(" after dying at "), F.col("lo").cast("string"))
    return findings(s.join(r, back, "left_anti"), "dead_speaker", CRITICAL, said, "scene_id", "a")


def destroyed_location_use(g: Graph) -> DataFrame:
    """A place or thing is used after its destruction."""
    seen = _seen_after(g, "destroyed", "destroyed_location_use").filter(F.col("entity_kind").isin("location", "object"))
    said = F.concat("name", F.lit(" is used at "), F.col("at").cast("string"), F.lit(" after its destruction at "), F.col("lo").cast("string"))
    return findings(seen, "destroyed_location_use", CRITICAL, said, "scene_id", "a")


def presence_conflict(g: Graph, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One subject at two places in overlapping, anchored ranges."""
    here = enabled(active(g).filter((F.col("predicate") == "located_at") & F.col("object_id").isNotNull() & F.col("lo").isNotNull()), g.family_config, "presence_conflict")
    here = here.select("world_id", "subject_id", "assertion_id", "object_id", "lo", "hi", "scene_id")
    other = here.select("world_id", "subject_id", F.col("assertion_id").alias("b"), F.col("object_id").alias("object_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("scene_id").alias("scene_b"))
    pairs = overlap_join(here, other, ["world_id", "subject_id"], ("lo", "hi"), ("lo_b", "hi_b"), hot_rows).filter((F.col("b") > F.col("assertion_id")) & (F.col("object_id") != F.col("object_b")))
    place = lambda c: g.entities.select("world_id", F.col("entity_id").alias(c), F.col("name").alias(f"{c}_name"))
    pairs = pairs.join(names(g), ["world_id", "subject_id"]).join(place("object_id"), ["world_id", "object_id"]).join(place("object_b"), ["world_id", "object_b"])
    said = F.concat("name", F.lit(" is at "), "object_id_name", F.lit(" "), ranges.text(F.col("lo"), F.col("hi")), F.lit(" and at "), "object_b_name", F.lit(" "), ranges.text(F.col("lo_b"), F.col("hi_b")))
    return findings(pairs, "presence_conflict", CRITICAL, said, "scene_b", "assertion_id", "b")


def knowers(g: Graph, muted: tuple[str, ...]) -> DataFrame:
    """Who knows which fact since when, with the first time that anyone in the world did."""
    scenes = g.scenes.select("world_id", "scene_id", F.col("story_position").alias("cited_at"))
    known = g.assertions.filter(~F.col("status").isin(*muted) & (F.col("predicate") == "knows") & F.col("object_value").isNotNull()).join(scenes, ["world_id", "scene_id"])
    known = known.withColumn("since", F.coalesce("lo", "cited_at"))
    return known.withColumn("first_since", F.min("since").over(Window.partitionBy("world_id", "fact_key")))


def unsourced(g: Graph, muted: tuple[str, ...], family: str | None = None) -> DataFrame:
    """Later knowers of a fact who never met another that knew it, up to the scene that cites them."""
    known = knowers(g, muted)
    late = known.filter("since > first_since").select("world_id", "subject_id", "fact_key", "object_value", "assertion_id", "scene_id", "since")
    if family:
        late = enabled(late, g.family_config, family)
    at = g.scenes.select("world_id", F.col("scene_id").alias("met"), F.col("story_position").alias("met_at"))
    present = g.presence.withColumnRenamed("scene_id", "met").join(at, ["world_id", "met"])
    # Who could tell a fact in which scene; only facts with several knowers are of use.
    tellers = known.select("world_id", "fact_key", F.col("subject_id").alias("entity_id"), "lo", "hi")
    tellers = tellers.join(late.select("world_id", "fact_key").distinct(), ["world_id", "fact_key"], "left_semi")
    told = point_join(present, tellers, ["world_id", "entity_id"], "met_at", "lo", "hi").groupBy("world_id", "fact_key", "met").agg(F.min("entity_id").alias("teller"), F.max("entity_id").alias("other"))
    hearers = late.select("world_id", "subject_id", "fact_key").distinct().join(present.select("world_id", "met", "met_at", F.col("entity_id").alias("subject_id")), ["world_id", "subject_id"])
    # Another one tells the fact if the first or the last teller of a scene is another, so no pair of both is made.
    meetings = hearers.join(told, ["world_id", "fact_key", "met"]).filter("teller <> subject_id or other <> subject_id")
    first = meetings.groupBy("world_id", "subject_id", "fact_key").agg(F.min("met_at").alias("heard_at"))
    return late.join(first, ["world_id", "subject_id", "fact_key"], "left").filter(F.col("heard_at").isNull() | (F.col("heard_at") > F.col("since")))


def premature_knowledge(g: Graph) -> DataFrame:
    found = unsourced(g, MUTED, "premature_knowledge").join(names(g), ["world_id", "subject_id"])
    said = F.concat("name", F.lit(" knows \""), "object_value", F.lit("\" at "), F.col("since").cast("string"), F.lit(" without a source"))
    return findings(found, "premature_knowledge", CRITICAL, said, "scene_id", "assertion_id")


def first_references(g: Graph, muted: tuple[str, ...]) -> DataFrame:
    """The first assertion, by id, about each provisional entity."""
    ends = active(g, muted)
    both = ends.select("world_id", "assertion_id", F.col("subject_id").alias("entity_id")).unionByName(ends.filter("object_id is not null").select("world_id", "assertion_id", F.col("object_id").alias("entity_id")))
    open_ = g.entities.filter("provisional").select("world_id", "entity_id", "name")
    return both.join(open_, ["world_id", "entity_id"]).groupBy("world_id", "entity_id", "name").agg(F.min("assertion_id").alias("assertion_id"))


def dangling_reference(g: Graph) -> DataFrame:
    first = enabled(first_references(g, MUTED), g.family_config, "dangling_reference")
    cited = first.join(g.assertions.select("world_id", "assertion_id", "scene_id"), ["world_id", "assertion_id"])
    return findings(cited, "dangling_reference", NOTE, F.concat("name", F.lit(" is referred to but unresolved")), "scene_id", "assertion_id")


def capability_violation(g: Graph) -> DataFrame:
    """An act, or a denial, against what someone is said to be unable to do, in overlapping ranges."""
    base = active(g)
    no = enabled(base.filter((F.col("predicate") == "cannot") & F.col("polarity") & F.col("object_value").isNotNull()), g.family_config, "capability_violation")
    no = no.select("world_id", "subject_id", F.col("assertion_id").alias("a"), F.col("fact_key").alias("handle"), F.col("object_value").alias("cannot"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    act = base.withColumn("said", text.norm_strip(F.concat(F.coalesce("object_value", F.lit("")), F.lit(" "), F.coalesce("supporting_quote", F.lit("")))))
    both = overlap_join(no, act, ["world_id", "subject_id"], ("lo_a", "hi_a"), ("lo", "hi")).filter(F.col("a") != F.col("assertion_id"))
    done = F.col("polarity") & (F.col("predicate") != "cannot") & F.col("said").contains(F.col("handle"))
    denied = ~F.col("polarity") & (F.col("predicate") == "cannot") & (F.col("fact_key") == F.col("handle"))
    found = both.filter(done | denied).join(names(g), ["world_id", "subject_id"])
    said = F.concat("name", F.lit(" cannot \""), "cannot", F.lit("\" "), ranges.text(F.col("lo_a"), F.col("hi_a")), F.lit(" but: "), F.coalesce("supporting_quote", F.lit("")))
    return findings(found, "capability_violation", WARNING, said, "scene_id", "a", "assertion_id")


def open_setups(g: Graph, muted: tuple[str, ...]) -> DataFrame:
    """Open promises, goals and secrets, the first of each subject and fact, with their position."""
    kept = active(g, muted).filter(F.col("predicate").isin(*OPEN_PREDICATES) & F.col("object_value").isNotNull() & F.col("hi").isNull())
    same = Window.partitionBy("world_id", "subject_id", "fact_key")
    first = kept.withColumn("first_id", F.min("assertion_id").over(same)).filter("assertion_id = first_id").drop("first_id")
    return first.join(g.scenes.select("world_id", "scene_id", F.col("story_position").alias("at")), ["world_id", "scene_id"])


def idle_setup(g: Graph) -> DataFrame:
    """Open setups that nothing later touches: not the subject and fact, the object, an alias in the fact, nor the fact's words."""
    setups = enabled(open_setups(g, MUTED), g.family_config, "idle_setup")
    s = setups.select("world_id", F.col("assertion_id").alias("a"), F.col("subject_id").alias("by"), F.col("object_id").alias("thing"), F.col("fact_key").alias("key"), "at")
    at = g.scenes.select("world_id", "scene_id", F.col("story_position").alias("later_at"))
    later = active(g).join(at, ["world_id", "scene_id"]).withColumn("said", text.norm_strip(F.concat(F.coalesce("object_value", F.lit("")), F.lit(" "), F.coalesce("supporting_quote", F.lit("")))))
    # The latest position at which each key is touched decides; ids differ, as a setup is not later than itself.
    by_fact = later.filter("object_value is not null").groupBy("world_id", F.col("subject_id").alias("by"), F.col("fact_key").alias("key")).agg(F.max("later_at").alias("last"))
    one = s.join(by_fact, ["world_id", "by", "key"])
    ends = later.select("world_id", F.col("subject_id").alias("entity_id"), "later_at").unionByName(later.filter("object_id is not null").select("world_id", F.col("object_id").alias("entity_id"), "later_at"))
    last_end = ends.groupBy("world_id", "entity_id").agg(F.max("later_at").alias("last"))
    two = s.filter("thing is not null").join(last_end.withColumnRenamed("entity_id", "thing"), ["world_id", "thing"])
    # Texts are matched by distinct value.
    handles = g.aliases.select("world_id", "entity_id", text.norm_strip("alias").alias("needle")).filter(F.length("needle") >= 3).join(last_end, ["world_id", "entity_id"]).groupBy("world_id", "needle").agg(F.max("last").alias("last"))
    keys = s.select("world_id", "key").distinct()
    named = containing(keys.withColumnRenamed("key", "hay"), handles).groupBy("world_id", F.col("hay").alias("key")).agg(F.max("last").alias("last"))
    three = s.join(named, ["world_id", "key"])
    texts = later.filter("object_value is not null").groupBy("world_id", F.col("said").alias("hay")).agg(F.max("later_at").alias("last"))
    inner = containing(texts, keys.filter(F.length("key") >= 3).withColumnRenamed("key", "needle"))
    four = s.join(inner.groupBy("world_id", F.col("needle").alias("key")).agg(F.max("last").alias("last")), ["world_id", "key"])
    pick = lambda df: df.filter("last > at").select("a")
    touched = pick(one).union(pick(two)).union(pick(three)).union(pick(four)).distinct()
    idle = setups.join(touched, setups["assertion_id"] == touched["a"], "left_anti").join(names(g), ["world_id", "subject_id"])
    said = F.concat("name", F.lit(" has an open thread: "), "object_value")
    return findings(idle, "idle_setup", NOTE, said, "scene_id", "assertion_id")


CHECKS: dict[str, Callable[[Graph], DataFrame]] = {}


def register_check(name: str, fn: Callable[[Graph], DataFrame]) -> None:
    """Adds a check of one's own to those that run_checks runs."""
    CHECKS[name] = fn


for _fn in (dead_speaker, presence_conflict, premature_knowledge, destroyed_location_use, dangling_reference, capability_violation, idle_setup):
    register_check(_fn.__name__, _fn)


def mark_sealed(found: DataFrame, seals: DataFrame) -> DataFrame:
    keys = seals.select("world_id", "check_name", "assertion_a", F.coalesce("assertion_b", F.lit(0)).alias("b0"), F.lit(True).alias("sealed")).distinct()
    return found.withColumn("b0", F.coalesce("assertion_b", F.lit(0))).join(keys, ["world_id", "check_name", "assertion_a", "b0"], "left").drop("b0").withColumn("sealed", F.coalesce("sealed", F.lit(False)))


def run_checks(g: Graph, names_: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All findings with ``sealed``; and the checks whose plan could not be built, with the reason."""
    plans, failed = [], {}
    for name in names_ or list(CHECKS):
        try:
            plans.append(CHECKS[name](g))
        except Exception as error:  # one broken check must not stop the others
            failed[name] = str(error)
    if not plans:
        raise ValueError(f"no check could be planned: {failed}")
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return mark_sealed(out, g.seals), failed


def all_findings(g: Graph, names_: list[str] | None = None) -> DataFrame:
    """The findings of ``run_checks`` for those who read nothing else: a check that can't be planned is an error, as without its findings a world would look clean."""
    found, failed = run_checks(g, names_)
    if failed:
        raise ValueError("findings would be missing, as checks failed: " + "; ".join(f"{name}: {why}" for name, why in failed.items()))
    return found


def isolated(g: Graph, checks_: dict[str, Callable[[Graph], DataFrame]] | None = None, at_once: int = 4) -> tuple[DataFrame, dict[str, str]]:
    """As ``run_checks``, but each check runs as jobs of its own, some at once, into the shared folder: one that fails while it runs is reported, and the others' findings stay."""

    def one(item: tuple[str, Callable[[Graph], DataFrame]]) -> tuple[str, DataFrame | None, str]:
        try:
            return item[0], cut(item[1](g)), ""
        except Exception as error:  # whatever a check raises, planned or run, is its own
            return item[0], None, str(error)

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(inheritable_thread_target(g.assertions.sparkSession)(one), (checks_ or CHECKS).items()))
    plans = [df for _, df, _ in done if df is not None]
    failed = {name: why for name, df, why in done if df is None}
    if not plans:
        raise ValueError(f"no check ran: {failed}")
    return mark_sealed(reduce(DataFrame.unionByName, plans), g.seals), failed


def run_report(found: DataFrame, names_: list[str], failed: dict[str, str]) -> DataFrame:
    """(check_name, status ran|failed, n_findings) of every check, also of those that found nothing."""
    all_ = found.sparkSession.createDataFrame([(n, "failed" if n in failed else "ran") for n in names_], "check_name string, status string")
    n = found.groupBy("check_name").agg(F.count("*").alias("n_findings"))
    return all_.join(n, "check_name", "left").fillna(0, ["n_findings"])


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == CRITICAL, 0).when(F.col(c) == WARNING, 1).otherwise(2)
