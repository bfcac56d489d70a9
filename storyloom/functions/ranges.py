"""Half-open integer ranges [lo, hi) as two nullable columns; null is unbounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(lo: Column, hi: Column) -> Column:
    return F.coalesce(lo >= hi, F.lit(False))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    before = lambda x, y: F.coalesce(x < y, F.lit(True))
    return before(a_lo, b_hi) & before(b_lo, a_hi) & ~is_empty(a_lo, a_hi) & ~is_empty(b_lo, b_hi)


def contains(lo: Column, hi: Column, at: Column) -> Column:
    return F.coalesce(lo <= at, F.lit(True)) & F.coalesce(at < hi, F.lit(True))


def text(lo: Column, hi: Column) -> Column:
    left = F.when(lo.isNull(), "(").otherwise(F.concat(F.lit("["), lo.cast("string")))
    return F.when(is_empty(lo, hi), "empty").otherwise(F.concat(left, F.lit(","), F.coalesce(hi.cast("string"), F.lit("")), F.lit(")")))


def gloss(lo: Column, hi: Column) -> Column:
    last = hi - 1
    return (
        F.when(lo.isNull() & hi.isNull(), "all positions").when(is_empty(lo, hi), "no position")
        .when(hi.isNull(), F.format_string("pos %d onward", lo)).when(lo.isNull(), F.format_string("through pos %d", last))
        .when(lo == last, F.format_string("pos %d", lo)).otherwise(F.format_string("pos %d–%d", lo, last))
    )
