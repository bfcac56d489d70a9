"""Joins on overlapping ranges, for any keys, that hold where one key has most of the rows.

Two half-open ranges overlap exactly if the later of their beginnings lies in the other, so an
overlap join is two joins of points with ranges, and every pair is found once, where its overlap
begins; ranges without a beginning meet in a third arm, where every pair counts.

A *hot* key, one with more than ``hot_rows`` points, is cut into bins of about equally many points
by its quantiles.  Points stand in one bin, ranges in all bins that they touch, so an open end
is a range to the last bin.  Points that no cut can part (many at one position) are dealt over
salts by the count of their bin.  A range that covers a bin pairs with all of its points, so
the copies of ranges are at most two more a range than pairs / ``hot_rows``.  Other keys join plainly, and where no key is
hot, which one count tells, all do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import ranges
from storyloom.operators.lineage import cut

HOT_ROWS = 50_000
LIST_ROWS = 500  # rows of one key and range that are kept together
TASK_PAIRS = 10_000_000  # pairs for which a task of its own is worth while
CHUNK_ROWS = 2_000  # rows of a key that stay together, so what they meet is copied once for so many
TASK_LISTS = 100  # the same for lists
MOST_TASKS = 1_000
FAN = 32  # cuts are looked up in two steps of so many
PLACE = ("__bin", "__salt")


def hot_keys(df: DataFrame, on: list[str], hot_rows: int) -> DataFrame | None:
    """The keys with more rows than that, and their number of rows; None if there are none."""
    found = df.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    return None if found.isEmpty() else cut(found)


def _bin(cuts: Column, at: Column) -> Column:
    """How many of the sorted cuts aren't above a position: first among every 32nd, then among those behind it."""
    coarse = F.filter(cuts, lambda c, i: (i % FAN) == FAN - 1)
    full = F.size(F.filter(coarse, lambda c: c <= at))
    return full * FAN + F.size(F.filter(F.slice(cuts, full * FAN + 1, F.lit(FAN)), lambda c: c <= at))


def _salt(df: DataFrame, n: Column) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.greatest(n, F.lit(1)))


def deal(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points and ranges with the bins and salts at which they meet."""
    hot = hot_keys(points, on, hot_rows)
    if hot is None:
        place = [F.lit(0).alias("__bin"), F.lit(0).cast("long").alias("__salt")]
        return points.select("*", *place), spans.select("*", *place)
    share = F.array(*[F.lit((k + 1) / FAN**2) for k in range(FAN**2 - 1)])
    ends = points.join(hot, on, "left_semi").groupBy(*on).agg(F.percentile_approx(at, share, F.lit(20 * FAN**2)).alias("__cuts"))
    # Of ``n`` points no more cuts than make bins of some hot_rows.
    ends = ends.join(hot, on)
    step = F.greatest(F.lit(1), F.floor(F.lit(FAN**2) * hot_rows / F.col("__n"))).cast("int")
    cuts = cut(ends.select(*on, F.array_distinct(F.filter("__cuts", lambda c, i: ((i + 1) % step) == 0)).alias("__cuts")))
    p = points.join(cuts, on, "left")
    p = p.withColumn("__bin", F.when(F.col("__cuts").isNull(), 0).otherwise(_bin(F.col("__cuts"), F.col(at)))).drop("__cuts")
    salts = cut(p.join(hot, on, "left_semi").groupBy(*on, "__bin").agg(F.ceil(F.count("*") / hot_rows).alias("__salts")))
    p = p.join(salts, [*on, "__bin"], "left")
    p = p.withColumn("__salt", F.coalesce(_salt(points, F.col("__salts")), F.lit(0).cast("long"))).drop("__salts")
    r = spans.join(cuts, on, "left")
    first = F.when(F.col(lo).isNull(), 0).otherwise(_bin(F.col("__cuts"), F.col(lo)))
    last = F.when(F.col(hi).isNull(), F.size("__cuts")).otherwise(_bin(F.col("__cuts"), F.col(hi) - 1))
    bins = F.when(F.col("__cuts").isNull(), F.array(F.lit(0))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    r = r.withColumn("__bin", F.explode(bins)).join(salts, [*on, "__bin"], "left")
    # Of a hot key only bins with points matter; there is a row of salts for each.
    r = r.filter(F.col("__cuts").isNull() | F.col("__salts").isNotNull())
    return p, r.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__cuts", "__salts")


def point_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str, hot_rows: int = HOT_ROWS, inside: bool = False) -> DataFrame:
    """Pairs of a point and a range [lo, hi) that holds it, a null point none; with ``inside`` only ranges that begin before it. Columns but the keys must differ."""
    p, r = deal(points.filter(F.col(at).isNotNull()), spans, on, at, lo, hi, hot_rows)
    holds = ranges.contains(F.col(lo), F.col(hi), F.col(at))
    if inside:
        holds = holds & F.coalesce(F.col(lo) < F.col(at), F.lit(True))
    return p.join(r, [*on, *PLACE]).filter(holds).drop(*PLACE)


def salted_join(a: DataFrame, b: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """An equi join for keys all of whose pairs count: rows of a hot key of ``a`` are dealt over salts, to which those of ``b`` go."""
    hot = hot_keys(a, on, hot_rows)
    if hot is None:
        return a.join(b, on)
    n = F.ceil(F.col("__n") / hot_rows)
    one = a.join(hot, on, "left").withColumn("__salt", F.coalesce(_salt(a, n), F.lit(0).cast("long"))).drop("__n")
    two = b.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))).drop("__n")
    return one.join(two, [*on, "__salt"]).drop("__salt")


def spread_join(a: DataFrame, b: DataFrame, on: list[str], sizes: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """An equi join with few rows and many pairs, which go to as many tasks as they need; Spark would deal them by the bytes of the rows, that is to one or two.

    ``sizes`` has for each key the rows ``__n`` of ``a`` and what these meet each, ``__each``.  Rows of ``a`` with more pairs
    than a task's are dealt over salts, to which those of ``b`` are copied.
    """
    pairs = F.col("__n").cast("double") * F.col("__each")
    kept = cut(sizes.withColumn("__pairs", pairs), grows=True)
    n = min(MOST_TASKS, int((kept.agg(F.sum("__pairs")).first()[0] or 0) / TASK_PAIRS) + 1)
    if n == 1:
        return a.join(b, on)
    salts = F.least(F.ceil(F.col("__pairs") / TASK_PAIRS), F.ceil(F.col("__n") / (chunk_rows or CHUNK_ROWS)))
    hot = cut(kept.select(*on, salts.alias("__salts")).filter("__salts > 1"))  # few, as each has a task's pairs
    one = a.join(hot, on, "left").withColumn("__salt", F.coalesce(_salt(a, F.col("__salts")), F.lit(0).cast("long"))).drop("__salts")
    two = b.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    # A number that is named is not made smaller again.
    return one.repartition(n, *on, "__salt").join(two.repartition(n, *on, "__salt"), [*on, "__salt"]).drop("__salt")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_range: tuple[str, str], b_range: tuple[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of rows with equal keys and overlapping ranges; null ends are open, empty ranges overlap nothing. Columns but the keys must differ.

    Pairs of one table with itself come in both orders and with themselves, as in any join.
    """
    (a_lo, a_hi), (b_lo, b_hi) = a_range, b_range
    sizes = a.select(*on).unionByName(b.select(*on))
    if hot_keys(sizes, on, hot_rows) is None:
        return a.join(b, on).filter(ranges.overlaps(F.col(a_lo), F.col(a_hi), F.col(b_lo), F.col(b_hi)))
    a, b = (df.filter(~ranges.is_empty(F.col(lo), F.col(hi))) for df, (lo, hi) in ((a, a_range), (b, b_range)))
    columns = [*on, *(c for c in a.columns if c not in on), *(c for c in b.columns if c not in on)]
    arms = [
        point_join(b.filter(F.col(b_lo).isNotNull()), a, on, b_lo, a_lo, a_hi, hot_rows),
        point_join(a.filter(F.col(a_lo).isNotNull()), b, on, a_lo, b_lo, b_hi, hot_rows, inside=True),
        salted_join(a.filter(F.col(a_lo).isNull()), b.filter(F.col(b_lo).isNull()), on, hot_rows),
    ]
    return reduce(DataFrame.unionByName, [arm.select(*columns) for arm in arms])


def lists(df: DataFrame, on: list[str], columns: list[str], order: str, most: int = LIST_ROWS) -> DataFrame:
    """The rows of each key as lists ``__rows`` of at most ``most``: what meets a key then meets a list, and ``unlisted`` makes its rows."""
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    part = F.floor((nth - 1) / most)
    return df.select(*on, order, F.struct(*columns).alias("__row")).withColumn("__part", part).groupBy(*on, "__part").agg(F.collect_list("__row").alias("__rows")).drop("__part")


def unlisted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and those of the rows in the lists."""
    return df.select(*columns, F.explode("__rows").alias("__row")).select(*columns, "__row.*")


def listed_join(a: DataFrame, b: DataFrame, on: list[str], a_range: tuple[str, str], b_range: tuple[str, str], columns: list[str], order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As ``overlap_join``, with all columns of ``a`` and the given ones of ``b``, for many rows of one key and range: these are compared once a list, so a pair costs no more than its row.

    Pairs are dealt over tasks by their number where no key is hot.
    """
    held = lists(b, [*on, *b_range], columns, order)
    sizes = a.groupBy(*on).agg(F.count("*").alias("__n")).join(b.groupBy(*on).agg(F.count("*").alias("__each")), on)
    if hot_keys(a.select(*on).unionByName(held.select(*on)), on, hot_rows) is None:
        (a_lo, a_hi), (b_lo, b_hi) = a_range, b_range
        return unlisted(spread_join(a, held, on, sizes).filter(ranges.overlaps(F.col(a_lo), F.col(a_hi), F.col(b_lo), F.col(b_hi))), a.columns)
    return unlisted(overlap_join(a, held, on, a_range, b_range, hot_rows), a.columns)


def overlap_counts(a: DataFrame, b: DataFrame, on: list[str], a_range: tuple[str, str], b_range: tuple[str, str], n: str = "n") -> DataFrame:
    """Rows of ``a`` with the number ``n`` of rows of ``b`` with equal keys whose ranges overlap theirs, without the pairs.

    All rows of a key overlap a range but those that end by its start and those that begin at its end or later; both
    numbers are running sums over the positions of the key, so only its distinct positions are sorted.
    """
    (a_lo, a_hi), (b_lo, b_hi) = a_range, b_range
    b = b.filter(~ranges.is_empty(F.col(b_lo), F.col(b_hi)))
    spans = a.filter(~ranges.is_empty(F.col(a_lo), F.col(a_hi))).select(*on, F.col(a_lo).alias("__lo"), F.col(a_hi).alias("__hi")).distinct()
    mark = lambda df, c, ended, begun: df.filter(F.col(c).isNotNull()).select(*on, F.col(c).alias("__at"), F.lit(ended).alias("__ended"), F.lit(begun).alias("__begun"))
    marks = reduce(DataFrame.unionByName, [mark(b, b_hi, 1, 0), mark(b, b_lo, 0, 1), mark(spans, "__lo", 0, 0), mark(spans, "__hi", 0, 0)])
    sums = marks.groupBy(*on, "__at").agg(F.sum("__ended").alias("__ended"), F.sum("__begun").alias("__begun"))
    so_far = Window.partitionBy(*on).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*on, "__at", F.sum("__ended").over(so_far).alias("__gone"), (F.sum("__begun").over(so_far) - F.col("__begun")).alias("__come"))
    all_ = b.groupBy(*on).agg(F.count("*").alias("__all"), F.count(b_lo).alias("__begin"))
    out = spans.join(all_, on)
    out = out.join(sums.select(*on, F.col("__at").alias("__lo"), "__gone"), [*on, "__lo"], "left").join(sums.select(*on, F.col("__at").alias("__hi"), "__come"), [*on, "__hi"], "left")
    met = F.col("__all") - F.coalesce("__gone", F.lit(0)) - F.when(F.col("__hi").isNull(), 0).otherwise(F.col("__begin") - F.col("__come"))
    out = out.select(*[F.col(c).alias(f"__{c}") for c in on], "__lo", "__hi", met.alias(n))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in on]) & F.col(a_lo).eqNullSafe(F.col("__lo")) & F.col(a_hi).eqNullSafe(F.col("__hi"))
    return a.join(out, same, "left").select(*[F.col(c) for c in a.columns], F.coalesce(n, F.lit(0)).alias(n))
