"""Projections, searches, counts and pages over a graph, for all worlds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import ranges, text
from storyloom.operators import checks
from storyloom.operators.holes import scene_labels
from storyloom.sources.graph import Graph

# What a world can switch off.
FAMILIES = ("dead_speaker", "presence_conflict", "premature_knowledge", "destroyed_location_use", "capability_violation", "dangling_reference", "idle_setup", *text.NOTE_FAMILIES)


def enrich(g: Graph) -> DataFrame:
    """Assertions with the names and kinds of both ends, range flags, scene, work, label and the nested fact."""
    subject = g.entities.select("world_id", F.col("entity_id").alias("subject_id"), F.col("name").alias("subject"), F.col("kind").alias("subject_kind"))
    thing = g.entities.select("world_id", F.col("entity_id").alias("object_id"), F.col("name").alias("object"), F.col("kind").alias("object_kind"))
    nested = g.assertions.select("world_id", F.col("assertion_id").alias("object_assertion_id"), F.col("object_value").alias("nested_value"))
    at = scene_labels(g).select("world_id", "scene_id", "story_position", "title", "ordinal", "label")
    out = g.assertions.join(subject, ["world_id", "subject_id"]).join(at, ["world_id", "scene_id"]).join(thing, ["world_id", "object_id"], "left").join(nested, ["world_id", "object_assertion_id"], "left")
    return out.withColumn("lo_open", F.col("lo").isNull()).withColumn("hi_open", F.col("hi").isNull()).withColumn("range", ranges.text(F.col("lo"), F.col("hi"))).withColumn("gloss", ranges.gloss(F.col("lo"), F.col("hi")))


def phrase() -> Column:
    """A row of ``enrich`` as a short sentence."""
    what = F.coalesce("object", "object_value", "nested_value", F.lit(""))
    return F.trim(F.concat_ws(" ", "subject", F.when(F.col("polarity"), F.lit(None)).otherwise(F.lit("not")), "predicate", what))


def true_at(g: Graph, positions: DataFrame) -> DataFrame:
    """(world_id, at) -> the assertions that hold at each position."""
    return g.assertions.join(positions, "world_id").filter(ranges.contains(F.col("lo"), F.col("hi"), F.col("at"))).filter(~F.col("status").isin("rejected", "retconned"))


def still_open(g: Graph) -> DataFrame:
    return g.assertions.filter(F.col("hi").isNull() & ~F.col("status").isin("rejected", "retconned"))


def page(df: DataFrame, by: list[str], order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page of each group, with the group's ``total`` and whether it was cut."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("total", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order)))
    return ranked.filter((F.col("place") > number * size) & (F.col("place") <= (number + 1) * size)).withColumn("truncated", F.col("total") > size)


def assertion_search(g: Graph, words: str, predicates: tuple[str, ...] = (), statuses: tuple[str, ...] = (), size: int = 50) -> DataFrame:
    found = g.assertions.filter(F.col("object_value").ilike(f"%{words}%") | F.col("supporting_quote").ilike(f"%{words}%"))
    if predicates:
        found = found.filter(F.col("predicate").isin(*predicates))
    if statuses:
        found = found.filter(F.col("status").isin(*statuses))
    return page(found, ["world_id"], [F.asc_nulls_last("lo"), F.asc("assertion_id")], size)


def entity_search(g: Graph, words: str, kind: str | None = None) -> DataFrame:
    """Entities whose name or an alias matches, with their counts of aliases and of assertions at either end."""
    like = f"%{words}%"
    hit = g.entities.filter(F.col("name").ilike(like)).select("world_id", "entity_id").union(g.aliases.filter(F.col("alias").ilike(like)).select("world_id", "entity_id")).distinct()
    found = g.entities.join(hit, ["world_id", "entity_id"], "left_semi")
    if kind:
        found = found.filter(F.col("kind") == kind)
    count = lambda df, c, n: df.groupBy("world_id", F.col(c).alias("entity_id")).agg(F.count("*").alias(n))
    for part in (count(g.aliases, "entity_id", "aliases"), count(g.assertions, "subject_id", "as_subject"), count(g.assertions.filter("object_id is not null"), "object_id", "as_object")):
        found = found.join(part, ["world_id", "entity_id"], "left")
    return found.fillna(0, ["aliases", "as_subject", "as_object"])


def resolve_names(g: Graph, refs: DataFrame) -> DataFrame:
    """(world_id, ref) -> found with the entity, ambiguous, or missing; names and aliases compare normalised."""
    keys = g.entities.select("world_id", "entity_id", text.norm_strip("name").alias("key")).union(g.aliases.select("world_id", "entity_id", text.norm_strip("alias").alias("key"))).distinct()
    found = refs.withColumn("key", text.norm_strip("ref")).join(keys, ["world_id", "key"], "left").groupBy("world_id", "ref").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return found.select("world_id", "ref", status.alias("status"), F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"))


def resolve_positions(g: Graph, refs: DataFrame) -> DataFrame:
    """(world_id, ref) -> position of "17", "E101/sc3", "1.03" (work and scene by order) or "E101" (its first scene)."""
    labels = scene_labels(g).select("world_id", F.lower("label").alias("ref_label"), "story_position", F.lower(F.substring_index("title", " ", 1)).alias("work"))
    order = g.works.select("world_id", "work_id", F.dense_rank().over(Window.partitionBy("world_id").orderBy("sort_order")).alias("nth"))
    dotted = scene_labels(g).join(order, ["world_id", "work_id"]).select("world_id", F.format_string("%d.%02d", "nth", "ordinal").alias("dot"), F.col("story_position").alias("by_dot"))
    first = labels.groupBy("world_id", F.col("work").alias("ref_work")).agg(F.min("story_position").alias("by_work"))
    r = refs.withColumn("key", F.lower(F.trim("ref")))
    plain = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").cast("int"))
    by_label = labels.select("world_id", F.col("ref_label").alias("key"), F.col("story_position").alias("by_label"))
    out = r.join(by_label, ["world_id", "key"], "left").join(dotted.withColumnRenamed("dot", "key"), ["world_id", "key"], "left").join(first.withColumnRenamed("ref_work", "key"), ["world_id", "key"], "left")
    return out.select("world_id", "ref", F.coalesce(plain, "by_label", "by_dot", "by_work").alias("position"))


def world_summary(g: Graph) -> DataFrame:
    """(world_id, dimension, value, n): entities by kind, provisional entities, assertions by status and predicate, sizes."""
    count = lambda df, dim, value: df.groupBy("world_id", F.lit(dim).alias("dimension"), F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"))
    size = lambda df, dim: df.groupBy("world_id").agg(F.count("*").alias("n")).select("world_id", F.lit("size").alias("dimension"), F.lit(dim).alias("value"), "n")
    parts = [count(g.entities, "kind", "kind"), count(g.entities.filter("provisional"), "provisional", "kind"), count(g.assertions, "status", "status"), count(g.assertions, "predicate", "predicate"), size(g.scenes, "scenes"), size(g.works, "works"), size(g.presence, "presence")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def world_list(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """Sizes of each world's tables, with ``found`` its unsealed findings too."""
    count = lambda df, n: df.groupBy("world_id").agg(F.count("*").alias(n))
    out = count(g.works, "works")
    for df, n in ((g.scenes, "scenes"), (g.entities, "entities"), (g.assertions, "assertions")):
        out = out.join(count(df, n), "world_id", "left")
    if found is not None:
        out = out.join(count(found.filter("not sealed"), "findings"), "world_id", "left")
    return out.fillna(0)


def scene_density(g: Graph) -> DataFrame:
    count = lambda df, n: df.groupBy("world_id", "scene_id").agg(F.count("*").alias(n))
    return g.scenes.select("world_id", "scene_id", "story_position").join(count(g.presence, "present"), ["world_id", "scene_id"], "left").join(count(g.assertions, "asserted"), ["world_id", "scene_id"], "left").fillna(0, ["present", "asserted"])


def load_bearing(g: Graph, k: int = 10) -> DataFrame:
    """The entities of each world with most assertions at either end, with their distinct scenes."""
    ends = g.assertions.select("world_id", F.col("subject_id").alias("entity_id"), "scene_id").unionByName(g.assertions.filter("object_id is not null").select("world_id", F.col("object_id").alias("entity_id"), "scene_id"))
    sums = ends.groupBy("world_id", "entity_id").agg(F.count("*").alias("degree"), F.countDistinct("scene_id").alias("scenes")).join(g.entities.select("world_id", "entity_id", "name"), ["world_id", "entity_id"])
    place = F.row_number().over(Window.partitionBy("world_id").orderBy(F.desc("degree"), "name", "entity_id"))
    return sums.withColumn("place", place).filter(F.col("place") <= k)


def corpus_stats(g: Graph) -> DataFrame:
    at = scene_labels(g)
    span = at.groupBy("world_id").agg(F.min("story_position").alias("first_position"), F.max("story_position").alias("last_position"), F.min_by("label", "story_position").alias("first_label"), F.max_by("label", "story_position").alias("last_label"), F.count("*").alias("scenes"))
    return span.join(world_list(g).drop("scenes"), "world_id")


def alias_array(g: Graph) -> DataFrame:
    own = g.aliases.groupBy("world_id", "entity_id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    return g.entities.join(own, ["world_id", "entity_id"], "left").select("world_id", "entity_id", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "|").alias("aliases"))


def singletons(g: Graph) -> DataFrame:
    """Facts that nothing else in the world repeats."""
    same = Window.partitionBy("world_id", "subject_id", "predicate", "object_id", "fact_key")
    return g.assertions.withColumn("n", F.count("*").over(same)).filter("n = 1").select("world_id", "assertion_id", "subject_id", "predicate")


def age_threshold(g: Graph, least: int = 15) -> DataFrame:
    per = g.scenes.join(g.works, ["world_id", "work_id"]).groupBy("world_id", "title").count()
    return per.groupBy("world_id").agg(F.greatest(F.lit(least), F.max("count").cast("int")).alias("threshold"))


def interval_close(g: Graph) -> DataFrame:
    """Open locations end where the subject's next one begins."""
    here = g.assertions.filter("predicate = 'located_at' and lo is not null and status not in ('rejected', 'retconned')")
    w = Window.partitionBy("world_id", "subject_id").orderBy("lo", "assertion_id")
    after = F.min("lo").over(Window.partitionBy("world_id", "subject_id").orderBy("lo").rangeBetween(1, Window.unboundedFollowing))
    return here.withColumn("closed_hi", F.coalesce("hi", after)).withColumn("ordinal", F.row_number().over(w)).select("world_id", "subject_id", "assertion_id", "object_id", "lo", "hi", "closed_hi", "ordinal")


def first_last_appearance(g: Graph) -> DataFrame:
    """Each entity's first and last scene by presence, else by assertions about it."""
    at = g.scenes.select("world_id", "scene_id", "story_position")
    edge = lambda df, p: df.join(at, ["world_id", "scene_id"]).groupBy("world_id", "entity_id").agg(F.min_by("scene_id", "story_position").alias(f"{p}_first"), F.max_by("scene_id", "story_position").alias(f"{p}_last"))
    seen, said = edge(g.presence, "p"), edge(g.assertions.select("world_id", F.col("subject_id").alias("entity_id"), "scene_id"), "a")
    both = g.entities.select("world_id", "entity_id").join(seen, ["world_id", "entity_id"], "left").join(said, ["world_id", "entity_id"], "left")
    return both.select("world_id", "entity_id", F.coalesce("p_first", "a_first").alias("first_scene"), F.coalesce("p_last", "a_last").alias("last_scene"))


def rolling_synopsis(g: Graph, facts: int = 12, back: int | None = None) -> DataFrame:
    """For each scene the digests (``facts`` at most each) of all scenes before it, or of the last ``back``."""
    place = F.row_number().over(Window.partitionBy("world_id", "scene_id").orderBy("assertion_id"))
    few = g.assertions.withColumn("place", place).filter(F.col("place") <= facts)
    line = F.concat_ws(" ", F.col("subject_id").cast("string"), "predicate", F.coalesce("object_value", F.col("object_id").cast("string"), F.lit("")))
    digest = few.groupBy("world_id", "scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "; ").alias("digest"))
    w = Window.partitionBy("world_id").orderBy("story_position").rowsBetween(Window.unboundedPreceding if back is None else -back, -1)
    return g.scenes.join(digest, ["world_id", "scene_id"], "left").withColumn("synopsis", F.array_join(F.collect_list(F.coalesce("digest", F.lit(""))).over(w), " / ")).select("world_id", "scene_id", "story_position", "synopsis")


def entity_profile(g: Graph) -> DataFrame:
    """One row an entity: aliases, and its assertions as subject and as object in order."""
    as_subject = g.assertions.groupBy("world_id", F.col("subject_id").alias("entity_id")).agg(F.sort_array(F.collect_list("assertion_id")).alias("s"))
    as_object = g.assertions.filter("object_id is not null").groupBy("world_id", F.col("object_id").alias("entity_id")).agg(F.sort_array(F.collect_list("assertion_id")).alias("o"))
    out = alias_array(g).join(as_subject, ["world_id", "entity_id"], "left").join(as_object, ["world_id", "entity_id"], "left")
    many = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("world_id", "entity_id", "name", "aliases", many("s").alias("as_subject"), many("o").alias("as_object"))


def scene_page(g: Graph) -> DataFrame:
    """One row a scene: its label, who is present, how many assertions it establishes and their predicates."""
    there = g.presence.join(g.entities.select("world_id", "entity_id", "name"), ["world_id", "entity_id"]).groupBy("world_id", "scene_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("present"))
    said = g.assertions.groupBy("world_id", "scene_id").agg(F.count("*").alias("established"), F.array_join(F.sort_array(F.collect_set("predicate")), ", ").alias("predicates"))
    out = scene_labels(g).select("world_id", "scene_id", "label", "slug", "story_position").join(there, ["world_id", "scene_id"], "left").join(said, ["world_id", "scene_id"], "left")
    return out.fillna("", ["present", "predicates"]).fillna(0, ["established"])


def assertion_page(g: Graph, found: DataFrame) -> DataFrame:
    """One row an assertion: its sentence, range and label, and the checks whose findings cite it, sealed ones apart."""
    cited = found.select("world_id", "check_name", "sealed", F.explode(F.array_distinct(F.array_compact(F.array("assertion_a", "assertion_b")))).alias("assertion_id"))
    sums = cited.groupBy("world_id", "assertion_id").agg(
        F.count_if(~F.col("sealed")).alias("live"), F.count_if("sealed").alias("sealed"), F.array_join(F.sort_array(F.collect_set("check_name")), ", ").alias("checks"),
    )
    rows = enrich(g).select("world_id", "assertion_id", phrase().alias("sentence"), "range", "label", "status")
    return rows.join(sums, ["world_id", "assertion_id"], "left").fillna(0, ["live", "sealed"]).fillna("", ["checks"])


def finding_page(g: Graph, found: DataFrame) -> DataFrame:
    """One row a finding: the sentences and labels of both its assertions, the label of its scene, and its seal."""
    said = enrich(g).select("world_id", "assertion_id", phrase().alias("sentence"), "label")
    side = lambda x: said.select("world_id", F.col("assertion_id").alias(f"assertion_{x}"), F.col("sentence").alias(f"sentence_{x}"), F.col("label").alias(f"label_{x}"))
    at = scene_labels(g).select("world_id", "scene_id", "label")
    out = found.join(side("a"), ["world_id", "assertion_a"], "left").join(side("b"), ["world_id", "assertion_b"], "left").join(at, ["world_id", "scene_id"], "left")
    return out.select("world_id", "check_name", "severity", "scene_id", "label", "assertion_a", "sentence_a", "label_a", "assertion_b", "sentence_b", "label_b", "sealed")


def draft_queue(g: Graph, size: int = 20) -> DataFrame:
    return page(g.assertions.filter("status = 'draft'"), ["world_id"], [F.desc("confidence"), F.asc("assertion_id")], size).select("world_id", "assertion_id", "confidence", "place", "total", "truncated")


def family_list(g: Graph, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(world_id, family, kind, enabled): every family in every world; what no world switched off is on."""
    each = g.works.select("world_id").distinct().select("world_id", F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    off_ = checks.switched_off(g.family_config).withColumn("off", F.lit(True))
    kind = F.when(F.col("family").isin(*text.NOTE_FAMILIES), "note").otherwise("check")
    return each.join(off_, ["world_id", "family"], "left").select("world_id", "family", kind.alias("kind"), F.col("off").isNull().alias("enabled"))


def family_on(g: Graph, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(world_id, family) of what is on."""
    return family_list(g, families).filter("enabled").select("world_id", "family")


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that came (``added``) and went (``removed``) between two runs, by check and explanation."""
    key = ["world_id", "check_name", "explanation"]
    gone = before.select(*key).distinct().join(after.select(*key), key, "left_anti").withColumn("change", F.lit("removed"))
    return after.select(*key).distinct().join(before.select(*key), key, "left_anti").withColumn("change", F.lit("added")).unionByName(gone)



def distinct_values(g: Graph) -> DataFrame:
    """(world_id, field, value): the kinds, predicates, traits and positions that a world has."""
    part = lambda df, field, c: df.select("world_id", F.lit(field).alias("field"), F.col(c).cast("string").alias("value"))
    out = part(g.entities, "kind", "kind").unionByName(part(g.assertions, "predicate", "predicate"))
    out = out.unionByName(part(g.assertions.filter("predicate = 'trait'"), "trait", "object_value")).unionByName(part(g.scenes, "position", "story_position"))
    return out.filter("value is not null").distinct()


def assertion_lookup(g: Graph, refs: DataFrame) -> DataFrame:
    """(ref_id, world_id, assertion_id or subject_id, predicate and maybe at) -> found with the assertion, ambiguous, or missing."""
    a = g.assertions.select("world_id", F.col("assertion_id").alias("hit"), "subject_id", "predicate", "lo", "hi")
    by_id = refs.filter("assertion_id is not null").select("ref_id", "world_id", F.col("assertion_id").alias("hit")).join(a.select("world_id", "hit"), ["world_id", "hit"])
    by_name = refs.filter("assertion_id is null").select("ref_id", "world_id", "subject_id", "predicate", "at").join(a, ["world_id", "subject_id", "predicate"])
    by_name = by_name.filter(F.col("at").isNull() | (ranges.contains(F.col("lo"), F.col("hi"), F.col("at")) & ~ranges.is_empty(F.col("lo"), F.col("hi"))))
    hits = by_id.select("ref_id", "hit").unionByName(by_name.select("ref_id", "hit")).groupBy("ref_id").agg(F.count("*").alias("n"), F.min("hit").alias("hit"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous")
    return refs.select("ref_id", "world_id").join(hits, "ref_id", "left").select("ref_id", "world_id", status.alias("status"), F.when(n == 1, F.col("hit")).alias("assertion_id"))
