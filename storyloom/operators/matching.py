"""Who takes what: expectations in their order, each the first offer that it fits and no earlier one took."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.lineage import components, cut

HOT_LINKS = 200_000
TAKEN = pa.schema([("group", pa.int64()), ("wanted", pa.int64()), ("offered", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, part, kind, id, pool, offered) in order -> what each takes.

    A set's pools come first (kind 0: id is the pool), then who wants (kind 1), each with its own offers in order and
    the pools it may take from.  A pool's offers are passed once: what is taken stays so.  Kept are a set's pools and
    what is taken.
    """
    now, who, own, of = None, None, None, []
    pools: dict[int, array] = defaultdict(lambda: array("q"))
    head: dict[int, int] = {}
    taken: set[int] = set()

    def settle() -> tuple[int, int, int] | None:
        best = own
        for p in of:
            offers, i = pools.get(p, ()), head.get(p, 0)
            while i < len(offers) and offers[i] in taken:
                i += 1
            head[p] = i
            if i < len(offers) and (best is None or offers[i] < best):
                best = offers[i]
        if best is None:
            return None
        taken.add(best)
        return now[0], who, best

    for batch in batches:
        rows = []
        for g, part, kind, key, p, o in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "kind", "id", "pool", "offered"))):
            if (g, part) != now or (kind and key != who):
                if who is not None:
                    rows.append(settle())
                who, own, of = None, None, []
                if (g, part) != now:
                    now = (g, part)
                    pools.clear(), head.clear(), taken.clear()
            if not kind:
                pools[key].append(o)
                continue
            who = key
            if p is not None:
                of.append(p)
            elif own is None and o not in taken:
                own = o
        yield _batch(rows)
    if who is not None:
        yield _batch([settle()])


def _batch(rows: list) -> pa.RecordBatch:
    rows = [r for r in rows if r]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], schema=TAKEN)


def first_free(links: DataFrame | None, pools: DataFrame | None = None, members: DataFrame | None = None, hot: int = HOT_LINKS) -> DataFrame:
    """Links (group, wanted, offered), all long, if any -> those that hold.

    In order of ``wanted`` each takes its smallest ``offered`` that no smaller one of its group took.  Offers that many
    want alike are given once, as pools (group, pool, offered) with members (group, wanted, pool).  Groups of more than
    ``hot`` rows are parted into their connected sets first, which take nothing from each other.
    """
    none = F.lit(None).cast("long")
    parts = []
    if links is not None:
        parts.append(links.select("group", F.lit(1).alias("kind"), F.col("wanted").alias("id"), none.alias("pool"), "offered"))
    if pools is not None:
        parts.append(pools.select("group", F.lit(0).alias("kind"), F.col("pool").alias("id"), none.alias("pool"), "offered"))
        parts.append(members.select("group", F.lit(1).alias("kind"), F.col("wanted").alias("id"), "pool", none.alias("offered")))
    rows = reduce(DataFrame.unionByName, parts)
    rows = cut(rows.distinct(), grows=True)
    large = rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("group")
    each = rows.withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        node = lambda kind, c: F.struct(F.col("group"), kind.alias("kind"), F.col(c).alias("id"))
        other = F.struct(F.col("group"), F.when(F.col("pool").isNull(), 2).otherwise(0).alias("kind"), F.coalesce("offered", "pool").alias("id"))
        sets = components(rows.join(F.broadcast(large), "group", "left_semi").select(node(F.col("kind"), "id").alias("a"), other.alias("b")))
        label = F.xxhash64("component.kind", "component.id").alias("part")
        own = sets.select(F.col("node.group").alias("group"), F.col("node.kind").alias("kind"), F.col("node.id").alias("id"), label)
        each = rows.join(own, ["group", "kind", "id"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    order = ["group", "part", "kind", "id", "pool", "offered"]
    ordered = each.repartition("group", "part").sortWithinPartitions(*order).select(*order)
    return ordered.mapInArrow(_fold, "group long, wanted long, offered long")
