"""Scripts into works and scenes: title pages, headings behind an empty line, annotations, flashbacks that span scenes.

All by windows over the lines of a script: (doc_id, text) in, any number of scripts at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text

# How lines of a script are told apart.
HEADING = r"(?i)^(?:(INT|EXT|EST|INT\.?/EXT|EXT\.?/INT|I/E|E/I)\b|\.(?!\.))"
SCENE_NUMBER = r"\s*#[^#]+#\s*$"
TITLE_KEY = r"^([A-Za-z][A-Za-z0-9 _-]*):\s?(.*)$"
FLASHBACK, FLASHBACK_OVER = r"^(BEGIN\s+FLASHBACK|FLASHBACK)\b", r"^(END\s+(OF\s+)?FLASHBACK|BACK\s+TO\s+PRESENT)\b"
ANNOTATION = "PLANTED"


def strip(x: Column | str) -> Column:
    return F.regexp_replace(text.col(x), r"^\s+|\s+$", "")


def slug(heading: Column) -> Column:
    """A heading without the mark that forces it and without its scene number."""
    return strip(F.regexp_replace(F.regexp_replace(heading, r"^\.(?!\.)\s*", ""), SCENE_NUMBER, ""))


def lines(scripts: DataFrame, annotation: str = ANNOTATION, titled: bool = True) -> DataFrame:
    """(doc_id, pos, raw, line, part title|body, n_stripped): a title page is a run of keys on top, up to the first empty line, if scripts are ``titled``.

    ``[annotation: ...]`` is taken out of body lines wherever it stands; a line with one that isn't closed goes whole.
    """
    each = scripts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")).alias("pos", "raw")).withColumn("line", strip("raw"))
    whole = Window.partitionBy("doc_id")
    each = each.withColumn("top", F.min(F.when(F.col("line") != "", F.col("pos"))).over(whole))
    each = each.withColumn("keyed", F.coalesce(F.bool_or((F.col("pos") == F.col("top")) & F.col("line").rlike(TITLE_KEY)).over(whole), F.lit(False)))
    each = each.withColumn("end", F.min(F.when((F.col("pos") > F.col("top")) & (F.col("line") == ""), F.col("pos"))).over(whole))
    part = F.when(F.lit(not titled) | ~F.col("keyed") | (F.col("pos") > F.col("end")), "body").when(F.col("line") != "", "title")
    each = each.withColumn("part", part).filter("part is not null").drop("top", "keyed", "end")
    tag = rf"(?i)\[{annotation}:[^\]]*\]"
    body = F.col("part") == "body"
    n = F.when(body, F.regexp_count("raw", F.lit(tag))).otherwise(0)
    bare = F.regexp_replace("raw", tag, "")
    broken = body & F.upper(bare).contains(f"[{annotation.upper()}:")
    raw = F.when(~body | ((n == 0) & ~broken), F.col("raw")).when(broken, "").otherwise(strip(bare))
    return each.select("doc_id", "pos", raw.alias("raw"), "part", (n + broken.cast("int")).alias("n_stripped")).withColumn("line", strip("raw"))


def scenes(scripts: DataFrame, annotation: str = ANNOTATION, printed: bool = False) -> DataFrame:
    """(doc_id, scene, slug, is_flashback, raw_text): a scene from each heading behind an empty line (or on top) to the next; what comes before the first is dropped.

    Text taken from ``printed`` pages has lost its empty lines and has no title page: there any heading in capitals
    begins a scene, and page numbers and the like are left out.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    capital = (F.col("line") == F.upper("line")) & (F.col("line") != F.lower("line"))
    body = lines(scripts, annotation, titled=not printed).filter("part = 'body'")
    if printed:
        body = body.filter(~text.is_furniture("line"))
    looks = F.col("line").rlike(HEADING)
    body = body.withColumn("looks", looks & ~F.startswith("line", F.lit(".")) & (F.col("line") == F.upper("line")) if printed else looks)
    over = capital & F.col("line").rlike(FLASHBACK_OVER)
    back = capital & F.col("line").rlike(FLASHBACK) & ~F.col("looks")
    body = body.withColumn("mark", F.when(over, False).when(back, True)).withColumn("before", F.lag("line", 1, "").over(w))
    body = body.withColumn("head", F.col("mark").isNull() & F.col("looks") & (F.lit(printed) | (F.col("before") == "")))
    body = body.withColumn("flash", F.coalesce(F.last("mark", True).over(w), F.lit(False))).withColumn("scene", F.sum(F.col("head").cast("int")).over(w))
    kept = body.filter("mark is null and scene > 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    named = kept.groupBy("doc_id", F.col("scene").cast("int").alias("scene")).agg(
        slug(F.max(F.when(F.col("head"), F.col("line")))).alias("slug"), F.bool_or(F.col("head") & F.col("flash")).alias("within"), text.clean_block(joined).alias("raw_text")
    )
    return named.select("doc_id", "scene", "slug", (F.col("within") | F.upper("slug").contains("FLASHBACK")).alias("is_flashback"), "raw_text")


def works(scripts: DataFrame, annotation: str = ANNOTATION) -> DataFrame:
    """(doc_id, title, show_title, episode, n_stripped): the episode is the number that its field begins with, the title the episode's number and quoted name, else the show's, else the document's."""
    each = lines(scripts, annotation)
    top = each.filter("part = 'title'").withColumn("is_key", F.col("line").rlike(TITLE_KEY))
    top = top.withColumn("nth", F.sum(F.col("is_key").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    said = F.when(F.col("is_key"), strip(F.regexp_extract("line", TITLE_KEY, 2))).otherwise(F.col("line"))
    value = strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"]), " "))
    pairs = top.groupBy("doc_id", "nth").agg(F.max(F.when(F.col("is_key"), F.lower(strip(F.regexp_extract("line", TITLE_KEY, 1))))).alias("key"), value.alias("value"))
    newest = lambda key: F.max_by("value", F.when(F.col("key") == key, F.col("nth")))
    page = pairs.groupBy("doc_id").agg(newest("title").alias("show_title"), newest("episode").alias("field"))
    counts = each.groupBy("doc_id").agg(F.sum("n_stripped").alias("n_stripped"))
    both = scripts.select("doc_id").join(counts, "doc_id").join(page, "doc_id", "left")
    number, name = F.regexp_extract("field", r"^\s*(\d+)", 1), F.regexp_extract("field", '"([^"]+)"', 1)
    episode = F.when(number != "", number.try_cast("int"))
    title = F.when(episode.isNotNull() & (name != ""), F.concat(F.lit("E"), episode, F.lit(" — "), name)).when(episode.isNotNull(), F.concat(F.lit("E"), episode))
    return both.select("doc_id", F.coalesce(title, F.nullif("show_title", F.lit("")), F.col("doc_id").cast("string")).alias("title"), "show_title", episode.alias("episode"), "n_stripped")
