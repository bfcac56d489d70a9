"""Templated questions, answered only with citations: (question_id, world_id, question), many at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import ranges, text
from storyloom.operators.checks import presence_scenes
from storyloom.operators.holes import scene_labels
from storyloom.operators.needles import containing
from storyloom.sources.graph import Graph

MUTED = ("rejected", "retconned")
LIMIT = 50
# The forms in which questions are asked; {who} and {what} are slots, words in brackets may stand or not.
FORMS = (
    ("knows", "what does {who} know"), ("believes", "what does {who} believe"), ("who_knows", "who knows {what}"), ("dies", "when does {who} die"),
    ("located_at", "where is {who} hidden"), ("located_at", "where is {who} located"), ("located_at", "where is {who} kept"), ("cannot", "what cannot {who} do"),
    ("open_promised", "what open promises does {who} have"), ("occupation", "what is {who}s job"), ("event", "what happened to {who}"),
    ("after_death", "where does {who} appear after [his|her|their] death"),
)
# Forms behind which anything may follow: what the question is about, and when.
OPEN_ENDED = ("knows", "believes")
EVENTS = ("dies", "destroyed", "created", "fact")


def plain(c: str) -> Column:
    """A question in single-spaced words; the possessive stays with its word, and what cannot be is one word."""
    joined = F.regexp_replace(F.regexp_replace(c, "(?i)can['’]t", "cannot"), "(?i)['’]s", "s")
    return text.norm_collapse(joined)


def pattern(intent: str, form: str) -> str:
    """A form as a regular expression: its slot is group 1, what follows an open end group 2."""
    filled = re.sub(r"\[([^]]*)\] ", r"(?:(?:\1) )?", form).replace("{who}", "(.+?)").replace("{what}", "(.+?)")
    return f"^{filled}" + (r"s?\b(.*)$" if intent in OPEN_ENDED else "$")


def phrase(c: Column) -> Column:
    """A slot's words without an article in front; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), "^(the|a|an) ", "")), F.lit(""))


def handle(c: Column) -> Column:
    """What somebody may know, without the order in which it was learned, and with a place named as facts name it."""
    bare = phrase(F.regexp_replace(c, " in the order\\b.*$", ""))
    return F.regexp_replace(F.regexp_replace(bare, "s location", " location"), " location of", " location")


def route(questions: DataFrame) -> DataFrame:
    """The first form that fits decides the intent, the subject, the object and the position; none leaves the intent null."""
    fits = [pattern(intent, form) for intent, form in FORMS]
    kept = ["question_id", "world_id", "question"]
    # Each of these is computed once: the optimiser doesn't copy an expression over a generator into all its uses.
    once = lambda df, c, name: df.select(*df.columns, F.inline(F.array(F.struct(c.alias(name)))))
    q = once(questions.select(*kept), plain("question"), "q")
    q = once(q, F.coalesce(*[F.when(F.col("q").rlike(p), k) for k, p in enumerate(fits)]), "form")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("form"))
    q = q.withColumn("intent", of([intent for intent, _ in FORMS])).withColumn("fits", of(fits))
    q = once(q, F.expr("regexp_extract(q, fits, 1)"), "slot").withColumn("rest", F.expr(f"CASE WHEN intent IN {OPEN_ENDED} THEN regexp_extract(q, fits, 2) END"))
    about = F.regexp_extract("rest", r"\babout (.+?)(?: and when\b.*| at (?:scene|pos|position)\b.*)?$", 1)
    at = F.regexp_extract("rest", r"\b(?:scene|pos|position) ([0-9]+)\b", 1)
    who = F.col("intent") == "who_knows"
    return q.select(
        "question_id", "world_id", "question", "intent", F.when(~who, phrase(F.col("slot"))).alias("subject"), F.when(who, handle(F.col("slot"))).otherwise(phrase(about)).alias("thing"),
        F.when(at != "", at.try_cast("int")).alias("at"),
    )


def answers(g: Graph, routed: DataFrame) -> DataFrame:
    """Rows of every answer: question_id, world_id, assertion_id, scene_id, lo, place, truncated."""
    keys = g.entities.select("world_id", "entity_id", text.norm_collapse("name").alias("subject")).union(g.aliases.select("world_id", "entity_id", text.norm_collapse("alias").alias("subject"))).distinct()
    about = routed.filter("subject is not null").join(keys, ["world_id", "subject"]).select("question_id", "world_id", "intent", "thing", "at", F.col("entity_id").alias("subject_id"))
    at = g.scenes.select("world_id", "scene_id", "story_position")
    a = g.assertions.filter(~F.col("status").isin(*MUTED)).join(at, ["world_id", "scene_id"])
    fits = (
        F.when(F.col("intent") == "event", F.col("predicate").isin(*EVENTS)).when(F.col("intent") == "open_promised", (F.col("predicate") == "promised") & F.col("hi").isNull())
        .when(F.col("intent") == "located_at", (F.col("predicate") == "located_at") & F.col("object_id").isNotNull()).otherwise(F.col("predicate") == F.col("intent"))
    )
    said = F.col("thing").isNull() | text.norm_collapse("object_value").contains(F.col("thing"))
    when = F.col("at").isNull() | ranges.contains(F.col("lo"), F.col("hi"), F.col("at"))
    one = about.filter("intent <> 'after_death'").join(a, ["world_id", "subject_id"]).filter(fits & said & when)
    # Who knows: what was asked is looked up among the distinct facts that anyone knows.
    known = a.filter("predicate = 'knows'").withColumn("hay", text.norm_collapse("object_value"))
    asked = routed.filter("intent = 'who_knows'").select("question_id", "world_id", F.col("thing").alias("needle"))
    told = containing(known.select("world_id", "hay").distinct(), asked)
    two = told.join(known, ["world_id", "hay"])
    deaths = a.filter("predicate = 'dies' and lo is not null").select("world_id", "subject_id", F.col("lo").alias("died"), "assertion_id")
    seen = presence_scenes(g).withColumnRenamed("at", "seen_at")
    three = about.filter("intent = 'after_death'").join(deaths, ["world_id", "subject_id"]).join(seen, ["world_id", "subject_id"]).filter("seen_at > died")
    rows = lambda df, lo, pos: df.select("question_id", "world_id", "assertion_id", "scene_id", F.col(lo).alias("lo"), F.col(pos).alias("pos"))
    out = rows(one, "lo", "story_position").unionByName(rows(two, "lo", "story_position")).unionByName(rows(three, "seen_at", "seen_at"))
    w = Window.partitionBy("question_id")
    ranked = out.withColumn("place", F.row_number().over(w.orderBy(F.asc_nulls_last("lo"), "pos", "assertion_id", "scene_id"))).withColumn("truncated", F.count("*").over(w) > LIMIT)
    return ranked.filter(F.col("place") <= LIMIT).drop("pos")


def cited(g: Graph, questions: DataFrame) -> DataFrame:
    """One row a question: status refused | no_support | uncited | answered, with rows and citations; one row without a label refuses the whole answer."""
    routed = route(questions)
    labels = scene_labels(g).select("world_id", "scene_id", "label")
    rows = answers(g, routed).join(labels, ["world_id", "scene_id"], "left").groupBy("question_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("label").isNotNull()).alias("all_cited"), F.bool_or("truncated").alias("truncated"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("label", F.lit("?")).alias("label")))), lambda x: x["label"]), ",").alias("citations"),
    )
    out = routed.join(rows, "question_id", "left")
    status = F.when(F.col("intent").isNull(), "refused").when(F.col("n").isNull(), "no_support").when(~F.col("all_cited"), "uncited").otherwise("answered")
    return out.select("question_id", "world_id", "intent", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.when(status == "answered", F.col("citations")).alias("citations"))


TABLES = ("assertions", "scenes", "entities", "aliases", "presence", "works")


def cited_sql(g: Graph, sql: str, worlds: list[int]) -> DataFrame:
    """A user's query over {assertions}, {scenes}, {entities}, {aliases}, {presence} and {works} of the given worlds, with labels.

    It stands inside a SELECT of ours, so anything but one query is refused by the parser, and it only sees those
    worlds.  It must return world_id and scene_id; one row without a label refuses the whole answer of its world.
    """
    spark = g.assertions.sparkSession
    tables = {name: getattr(g, name).filter(F.col("world_id").isin(worlds)) for name in TABLES}
    out = spark.sql("SELECT * FROM (\n" + sql + "\n) AS asked", **{k: v for k, v in tables.items() if "{" + k + "}" in sql})
    missing = {"world_id", "scene_id"} - set(out.columns)
    if missing:
        raise ValueError(f"the query must return {sorted(missing)}")
    both = out.join(scene_labels(g).select("world_id", "scene_id", "label"), ["world_id", "scene_id"], "left")
    whole = F.bool_and(F.col("label").isNotNull()).over(Window.partitionBy("world_id"))
    return both.withColumn("__whole", whole).filter("__whole").drop("__whole")
