"""Text helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no subject matter in a fact.
STOP_WORDS = (
    "a", "an", "and", "as", "at", "by", "for", "from", "he", "her", "his", "in", "is", "it", "of", "on", "or", "she", "that", "the", "their", "there", "they", "this", "to", "was",
    "with", "you",
)
# Verbs of threads that carry no subject matter either.
THREAD_VERBS = ("find", "discover", "locate", "learn", "get", "make")
# Words that name a role rather than a person, and pronouns.
ROLE_WORDS = (
    "uncle", "aunt", "brother", "sister", "father", "mother", "mom", "dad", "son", "daughter", "cousin", "nephew", "niece", "husband", "wife", "widow", "deputy", "sheriff",
    "captain", "cook", "boss", "stranger", "man", "woman", "boy", "girl", "kid", "the man", "the woman",
)
PRONOUNS = ("he", "she", "they", "him", "her", "them", "it", "his", "hers", "its", "their", "we", "us")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_strip(x: Column | str) -> Column:
    """Lower case with everything but letters, digits and blanks deleted: the join key of facts."""
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9 ]", "")


def norm_collapse(x: Column | str) -> Column:
    """Lower case with other characters turned to single blanks."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def tokens(x: Column | str) -> Column:
    """Distinct words of the collapsed form, without stop words."""
    words = F.array_distinct(F.split(norm_collapse(x), " "))
    return F.array_except(words, F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def thread_terms(*columns: Column | str) -> Column:
    """Words of what a thread is about: those of its values and names, without stop words and thread verbs."""
    return F.array_except(tokens(F.concat_ws(" ", *[col(c) for c in columns])), F.array(*[F.lit(w) for w in THREAD_VERBS]))


def is_initials(x: Column | str) -> Column:
    return F.coalesce(F.trim(col(x)).rlike(r"^([A-Za-z]\.){2,}$"), F.lit(False))


def is_role_reference(x: Column | str) -> Column:
    """Initials, a role or a pronoun: a name for somebody else, not an entity of its own. Articles in front don't count."""
    bare = F.trim(norm_strip(F.regexp_replace(F.trim(F.coalesce(col(x), F.lit(""))), r"(?i)^((the|a|an)(\s+|$))+", "")))
    return is_initials(x) | (bare == "") | bare.isin(*ROLE_WORDS) | bare.isin(*PRONOUNS)


def object_placeholder(value: Column, object_id: Column, predicate: Column) -> Column:
    """A value for predicates without an object: the predicate itself."""
    return F.when(object_id.isNotNull() | (F.coalesce(value, F.lit("")) != ""), value).otherwise(predicate)


def without_placeholder(value: Column, predicate: Column) -> Column:
    """The inverse of ``object_placeholder``: a value that only repeats its predicate is none."""
    return F.when(value != predicate, value)


def quote_offset(source: Column | str, quote: Column | str) -> Column:
    """Where the quote stands in the source (from 1; 0: nowhere), blanks, dashes and quotation marks as in ``quote_norm``."""
    return F.when(F.coalesce(F.trim(col(quote)), F.lit("")) == "", 0).otherwise(F.coalesce(F.instr(quote_norm(source), quote_norm(quote)), F.lit(0)))


def quote_norm(x: Column | str) -> Column:
    """Straight quotes and dashes, single blanks, lower case."""
    plain = F.translate(col(x), "‘’“”–—", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def quote_pattern(quote: Column | str) -> Column:
    """A regular expression for all texts that are alike to the quote under ``quote_norm``."""
    q = F.replace(quote_norm(quote), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    for plain, any_ in ((" ", r"\s+"), ("'", "['‘’]"), ('"', "[\"“”]"), ("-", "[-–—]")):
        q = F.replace(q, F.lit(plain), F.lit(f"\\E{any_}\\Q"))
    return F.concat(F.lit(r"(?iu)\Q"), q, F.lit(r"\E"))


def has_quote(quote: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(col(quote), r"\s+", ""), F.lit("")) != ""


def quote_span(source: Column | str, quote: Column | str) -> Column:
    """(start, end) of the first place in the source, as it stands, that is the quote under ``quote_norm``; from 1, end exclusive; null if there is none."""
    found = F.regexp_substr(col(source), quote_pattern(quote))
    start = F.regexp_instr(col(source), quote_pattern(quote))
    return F.when(has_quote(quote) & (start > 0), F.struct(start.alias("start"), (start + F.length(found)).alias("end")))


def html_escape(x: Column | str) -> Column:
    x = col(x)
    # Characters with a meaning in HTML, the ampersand first.
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


OPENS, CLOSES = "\ue000", "\ue001"


def highlight(source: Column | str, quote: Column | str) -> Column:
    """The source in HTML with every place marked that is the quote under ``quote_norm``: as it stands there, not as it is quoted.

    Two characters of Unicode's private area serve as marks on the way; those of the source itself are left out.
    """
    bare = F.translate(F.coalesce(col(source), F.lit("")), OPENS + CLOSES, "")
    marked = F.when(has_quote(quote), F.regexp_replace(bare, quote_pattern(quote), F.lit(f"{OPENS}$0{CLOSES}"))).otherwise(bare)
    return F.replace(F.replace(html_escape(marked), F.lit(OPENS), F.lit("<mark>")), F.lit(CLOSES), F.lit("</mark>"))


def display_name(x: Column | str) -> Column:
    """Names in capitals in title case; others as they are."""
    x = col(x)
    return F.when((F.upper(x) == x) & x.rlike("[A-Z]"), F.initcap(F.lower(x))).otherwise(x)


def first_quote(x: Column | str, shortest: int = 8, most: int = 240) -> Column:
    """The first line of at least ``shortest`` characters, cut."""
    lines = F.filter(F.transform(F.split(col(x), "\n"), lambda line: F.trim(line)), lambda line: F.length(line) >= shortest)
    return F.left(F.get(lines, F.lit(0)), F.lit(most))


def slug_place(x: Column | str) -> Column:
    """A scene heading without its inside/outside prefix and time of day."""
    bare = F.regexp_replace(F.upper(col(x)), r"^(INT\.?/EXT|EXT\.?/INT|INT|EXT|I/E)\.?\s+", "")
    return F.trim(F.regexp_replace(bare, r"\s+-\s+[^-]*$", ""))


def clamp_confidence(x: Column | str) -> Column:
    value = F.expr(f"try_cast({x} AS double)") if isinstance(x, str) else x.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def clean_block(x: Column | str) -> Column:
    """Lines stripped on the right, runs of empty lines as one, none at the ends."""
    lines = F.transform(F.split(col(x), "\n"), lambda line: F.regexp_replace(line, r"\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def slugify(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_stem(x: Column | str) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_replace(col(x), "^.*/", ""), r"^(.+)\.[^.]+$", "$1")


def safe_slug(x: Column | str) -> Column:
    """A name fit for files: other characters as one underline, none at the ends; ``world`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("world"))


def world_slug(x: Column | str) -> Column:
    """A world's name from the name of its file: 60 lower letters, digits and underlines at most; ``script`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(file_stem(F.coalesce(col(x), F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.left(F.coalesce(F.nullif(bare, F.lit("")), F.lit("script")), F.lit(60))


def work_key(episode: Column, source: Column, title: Column) -> Column:
    """``E`` and the episode's number, else the file's name, else the title, with other characters as dashes; ``work`` where nothing is left."""
    stem = F.coalesce(F.nullif(file_stem(source), F.lit("")), F.nullif(title, F.lit("")), F.lit("work"))
    bare = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(episode.isNotNull(), F.concat(F.lit("E"), episode)).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.lit("work")))


# Lines of a printed page that are no text (its number, a scene that goes on, "page 3 of 9").
FURNITURE = (r"^\s*\d+\.?\s*$", r"(?i)^\s*\(?\s*(CONTINUED|MORE)\s*:?\s*\)?\s*(\(\d+\))?\s*$", r"(?i)^\s*page\s+\d+(\s+of\s+\d+)?\s*$")


def is_furniture(x: Column | str) -> Column:
    return reduce(Column.__or__, (F.coalesce(col(x).rlike(p), F.lit(False)) for p in FURNITURE))


# Families of notes.
NOTE_FAMILIES = ("F1", "F2", "F3", "F4")


def family_name(x: Column | str) -> Column:
    """The one spelling of a family: notes in capitals, checks in lower case with underlines."""
    bare = F.trim(F.coalesce(col(x), F.lit("")))
    return F.when(F.upper(bare).isin(*NOTE_FAMILIES), F.upper(bare)).otherwise(F.replace(F.lower(bare), F.lit("-"), F.lit("_")))
