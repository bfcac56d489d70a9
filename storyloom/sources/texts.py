"""Text corpora: segmentation, evidence, policy and leak scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.sources.graph import PREDICATES

HEADING = r"^(INT|EXT|EST|INT\./EXT|I/E)[. ]"


def segment(docs: DataFrame, heading: str = HEADING, blank_before: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, scene, heading, is_flashback, n_lines, body): scenes begin at headings behind an empty line; what comes before the first is dropped."""
    line = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = docs.select("doc_id", line.alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.trim("line").rlike(heading)
    if blank_before:
        head = head & F.coalesce(F.trim(F.lag("line").over(w)) == "", F.lit(True))
    lines = lines.withColumn("head", head).withColumn("scene", F.sum(F.col("head").cast("int")).over(w)).filter("scene > 0")
    mark = F.when(F.upper("line").contains("END FLASHBACK"), False).when(F.upper("line").contains("FLASHBACK"), True)
    lines = lines.withColumn("flash", F.coalesce(F.last(mark, True).over(w), F.lit(False)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id", "scene").agg(F.max(F.when(F.col("head"), F.trim("line"))).alias("heading"), F.bool_or("flash").alias("is_flashback"), F.count("*").alias("n_lines"), text.clean_block(body).alias("body"))


def title_page(docs: DataFrame) -> DataFrame:
    """Key: value lines above the first empty line."""
    top = F.split(F.coalesce("text", F.lit("")), r"\n\s*\n").getItem(0)
    pairs = docs.select("doc_id", F.explode(F.split(top, "\n")).alias("line")).filter(F.col("line").rlike(r"^[A-Za-z ]+:\s*\S"))
    return pairs.select("doc_id", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def story_positions(works: DataFrame, scenes: DataFrame) -> DataFrame:
    """(world, work, title), (work, scene) -> one position per world: works by the number in their title, else by name; prefix sums of counts, no global sort."""
    number = F.regexp_extract("title", r"(\d+)", 1)
    order = Window.partitionBy("world_id").orderBy(F.asc_nulls_last(F.when(number != "", number.cast("int"))), "title", "work_id")
    n = scenes.groupBy("work_id").agg(F.count("*").alias("n"))
    before = works.join(n, "work_id").withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("work_id").orderBy("scene"))
    return scenes.withColumn("inside", inside).join(before.select("world_id", "work_id", "before"), "work_id").select("world_id", "work_id", "scene", (F.col("before") + F.col("inside")).alias("position"))


def evidence_gate(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, doc_id, quote, predicate) against texts -> keep or the first reason to drop."""
    both = claims.join(sources.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    reason = F.when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no_quote").when(F.col("source").isNull(), "no_source").when(~text.quote_norm("source").contains(text.quote_norm("quote")), "quote_not_found").otherwise("keep")
    return both.select("claim_id", "doc_id", reason.alias("verdict"))


# Predicates that need no object.
INTRANSITIVE = ("alive", "dies", "destroyed")


def gated_rows(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Extracted rows (claim_id, doc_id, predicate, object_entity, object_value, object_fact_ref, quote, confidence, polarity, starts_here, ends_here) with a verdict.

    The first of no_quote, bad_predicate, no_object, quote_not_found; else keep.  Missing flags get their defaults (true,
    true, false), confidence is a number from 0 to 1.
    """
    both = rows.join(sources.select("doc_id", F.col("text").alias("source")), "doc_id", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bare = F.coalesce(F.nullif("object_entity", F.lit("")), F.nullif("object_value", F.lit("")), F.nullif("object_fact_ref", F.lit(""))).isNull()
    found = F.coalesce(text.quote_norm("source").contains(text.quote_norm("quote")), F.lit(False))
    verdict = (
        F.when(blank("quote"), "no_quote").when(~F.coalesce(F.col("predicate").isin(*PREDICATES), F.lit(False)), "bad_predicate")
        .when(bare & ~F.col("predicate").isin(*INTRANSITIVE), "no_object").when(~found, "quote_not_found").otherwise("keep")
    )
    flag = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return both.select("claim_id", "doc_id", verdict.alias("verdict"), text.clamp_confidence("confidence").alias("confidence"), flag("polarity", True), flag("starts_here", True), flag("ends_here", False))


def policy_scan(docs: DataFrame, secret: str, heading: str, most: int = 3) -> DataFrame:
    """Documents with many heading lines or something like a secret key."""
    heads = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(heading)))
    return docs.select("doc_id", heads.cast("long").alias("headings"), F.coalesce(F.col("text").rlike(secret), F.lit(False)).alias("has_secret")).withColumn("flagged", (F.col("headings") >= most) | F.col("has_secret"))


def leak_check(docs: DataFrame, marker: str) -> DataFrame:
    return docs.select("doc_id", F.regexp_count("text", F.lit(marker)).cast("long").alias("n")).filter("n > 0")


def role_references(docs: DataFrame) -> DataFrame:
    """(surface): the distinct words of all texts, between anything but letters and dots, that name a role.

    Words are many and distinct ones few, so each is judged once: the test reads the count, or Spark would move it before the grouping.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z.]+"))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    judged = F.when((F.col("n") > 0) & (F.col("surface") != ""), F.col("surface"))
    return words.filter(judged.isNotNull() & text.is_role_reference(judged)).select("surface")
