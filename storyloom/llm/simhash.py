"""Near duplicates by SimHash, found with a Gray-order hierarchical index.

Fingerprints that differ in at most ``most`` bits agree on whole chunks of bits.  The 64 bits
are cut into ``most + k`` chunks; k of them agree whole in every linked pair, so each choice
of k chunks makes one *view*: the fingerprint with those bits in front.  k is 2 up to some
billion fingerprints and then grows with their number, so that the groups of equal front
bits don't grow with the corpus.  In a view
the distinct fingerprints are sorted by Gray rank, which keeps equal leading bits together and
puts neighbours that differ in one bit side by side, and cut into *cells* of a bounded number
of fingerprints.  A cell is a small tree: its nodes factor out the bits that all fingerprints
below them share, and a search adds up the differing shared bits from the root down and leaves
a whole group as soon as they exceed ``most``.  A group of equal front bits that is longer
than one cell continues in later ones; its fingerprints visit those too, unless the cell's
own root pattern rules that out.  So no group of near copies, however large, meets in one task.

A cell returns at most one link for each fingerprint it holds or is visited by; connected
components of the links are found by label rounds with hooking and pointer jumping over
distinct fingerprints, until nothing moves, each round written to the shared folder.  Exact
copies share a fingerprint and never meet in a pair.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; texts
of fewer words than a shingle have one shingle; a null id counts as larger than any and
never names a component unless alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

BITS = 64
CELL = 1024
NODE = 32


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    if len(parts) > words:
        start, end = start[: len(parts) - words + 1], end[words - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(start), 65536):
        h = np.array([digest(view[a:b], seed) for a, b in zip(start[at : at + 65536].tolist(), end[at : at + 65536].tolist())], np.uint64)
        count += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(start)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text) -> doc_id, bits (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                found = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found)], names=["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


def chunks(most: int, spare: int = 2) -> list[tuple[int, int]]:
    cuts = [round(i * BITS / (most + spare)) for i in range(most + spare + 1)]
    return list(zip(cuts, cuts[1:]))


def views(most: int, spare: int = 2) -> list[tuple[list[tuple[int, int]], int]]:
    """Of each view the order of chunks, and the number of front bits."""
    parts = chunks(most, spare)
    found = []
    for chosen in combinations(range(len(parts)), spare):
        order = [parts[i] for i in chosen] + [p for i, p in enumerate(parts) if i not in chosen]
        found.append((order, sum(b - a for a, b in order[:spare])))
    return found


def spare_chunks(n: int, most: int) -> int:
    """As many agreeing chunks as it takes for groups of about one cell among ``n`` fingerprints."""
    spare = 2
    while n >> min(front for _, front in views(most, spare)) > CELL and spare < 4:
        spare += 1
    return spare


def turned(bits: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their chunks (ranges of bits from the top) in this order."""
    out, at = np.zeros_like(bits), BITS
    for a, b in order:
        at -= b - a
        out |= ((bits >> np.uint64(BITS - b)) & np.uint64((1 << (b - a)) - 1)) << np.uint64(at)
    return out


def gray_rank(bits: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits ^ (bits >> np.uint64(s))
    return bits


def in_views(found: DataFrame, most: int, spare: int = 2) -> DataFrame:
    """``bits`` -> a row for each view: view, front, rank (ordered as a signed long), bits."""
    shapes = views(most, spare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column(0))
            for k, (order, front) in enumerate(shapes):
                own = turned(bits.view(np.uint64), order)
                rank = (gray_rank(own) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(np.full(len(bits), k, np.int32)), pa.array((own >> np.uint64(BITS - front)).view(np.int64)), pa.array(rank)], names=["bits", "view", "front", "rank"])

    return found.select("bits").mapInArrow(run, "bits long, view int, front long, rank long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared(rows: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Mask of the bits that all rows share, and their values."""
    mask = ~(np.bitwise_or.reduce(rows) ^ np.bitwise_and.reduce(rows))
    return mask, rows[0] & mask


def links_in_cell(rows: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of at most ``most`` differing bits, with whole nodes pruned; as index arrays."""
    found_q, found_r = [], []
    stack = [(0, len(rows), np.uint64(0), np.arange(len(queries)), np.zeros(len(queries), np.uint8))]
    while stack:
        a, b, above, q, diff = stack.pop()
        mask, value = _shared(rows[a:b])
        own = mask & ~above
        diff = diff + _popcount((queries[q] ^ value) & own)
        stay = diff <= most
        q, diff = q[stay], diff[stay]
        if not len(q):
            continue
        if b - a > NODE:
            half = (a + b) // 2
            stack += [(a, half, mask, q, diff), (half, b, mask, q, diff)]
            continue
        for at in range(0, len(q), 8192):
            part = q[at : at + 8192]
            near = _popcount(queries[part][:, None] ^ rows[None, a:b]) <= most
            i, j = np.nonzero(near)
            found_q.append(part[i])
            found_r.append(j + a)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_r)


def components_of(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each, by label rounds."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cells(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Number the cells of sorted rows: one ends with its view, when full, or between groups once half full.

    ``edge`` marks the first and last group of a cell, which alone can go on in another.
    """
    cell, view, held, size = first, None, [], 0

    def close():
        bits, front = (np.concatenate([x[i] for x in held]) for i in range(2))
        edge = (front == front[0]) | (front == front[-1])
        n = len(bits)
        return pa.RecordBatch.from_arrays([pa.array(bits), pa.array(np.full(n, view, np.int32)), pa.array(front), pa.array(np.full(n, cell)), pa.array(edge)], names=["bits", "view", "front", "cell", "edge"])

    for batch in batches:
        bits, views_, front = (np.asarray(batch.column(i)) for i in (0, 1, 2))
        if not len(bits):
            continue
        cut = np.flatnonzero((front[1:] != front[:-1]) | (views_[1:] != views_[:-1])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bits)]):
            same = view == views_[a] and held and held[-1][1][-1] == front[a]
            if size and (view != views_[a] or (size >= CELL // 2 and not same)):
                yield close()
                cell, held, size = cell + 1, [], 0
            view = int(views_[a])
            while a < b:
                if size >= CELL:
                    yield close()
                    cell, held, size = cell + 1, [], 0
                take = min(b - a, CELL - size)
                held.append((bits[a : a + take], front[a : a + take]))
                a, size = a + take, size + take
    if size:
        yield close()


def _search(table: pa.Table, most: int) -> pa.Table:
    """Links of a cell: each row to the smallest of its component here, and each visitor to every component that it meets."""
    bits = np.asarray(table.column("bits").combine_chunks()).view(np.uint64)
    visitor = np.asarray(table.column("visitor").combine_chunks().cast(pa.int8())).astype(bool)
    own = np.unique(bits[~visitor])
    own = own[np.argsort(gray_rank(own))]
    signed = own.view(np.int64)
    label = components_of(len(own), *links_in_cell(own, own, most))
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    least = least[label]
    a, b = [least[least < signed]], [signed[least < signed]]
    guests = bits[visitor]
    for at in range(0, len(guests), 4096):
        part = guests[at : at + 4096]
        q, r = links_in_cell(own, part, most)
        if len(q):
            both = np.unique(np.stack([part[q].view(np.int64), least[r]], axis=1), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            a.append(both.min(axis=1))
            b.append(both.max(axis=1))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def similar(found: DataFrame, most: int = 4) -> DataFrame:
    """Distinct ``bits`` -> links (a, b), a < b, whose components are those of all pairs of at most ``most`` differing bits."""
    dealt = in_views(found, most, spare_chunks(found.count(), most)).repartitionByRange("view", "rank").sortWithinPartitions("view", "rank")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _cells(batches, TaskContext.get().partitionId() << 32)

    cells = B.stored(dealt.mapInArrow(cut, "bits long, view int, front long, cell long, edge boolean"), "simhash-cells")
    # Groups that go on in later cells, and the bits that a group's part of such a cell shares.
    edge = cells.filter("edge")
    root = edge.groupBy("view", "front", F.col("cell").alias("to")).agg(F.bit_and("bits").alias("all_ones"), F.bit_or("bits").alias("any_ones"))
    later = (F.col("to") > F.col("cell")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("all_ones")).bitwiseAND(F.bitwise_not(F.col("all_ones").bitwiseXOR(F.col("any_ones"))))) <= most)
    visits = edge.join(root, ["view", "front"]).filter(later)
    both = cells.select("cell", "bits", F.lit(False).alias("visitor")).unionByName(visits.select(F.col("to").alias("cell"), "bits", F.lit(True).alias("visitor")))
    return both.groupBy("cell").applyInArrow(lambda t: _search(t, most), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, component): the smallest node reachable; nodes without a link are left out.

    Each round gives the smallest grandparent label beside a node to the node and also to its parent
    (whole trees hook at once), then every node takes its grandparent; so the rounds grow with the
    logarithm of a component's size, not its diameter, and they go on until nothing moves.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = B.stored(edges.distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = B.stored(labels.withColumn("far", F.col("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        step = labels.join(near, "node").select("node", "label", "far", F.least("far", "near").alias("low"))
        own = step.select("node", F.least("label", "low").alias("low"), F.col("label").alias("was"), F.col("far").alias("was_far"))
        hooks = step.filter(F.col("low") < F.col("label")).select(F.col("label").alias("node"), "low", F.lit(None).cast("long").alias("was"), F.lit(None).cast("long").alias("was_far"))
        held = B.stored(own.unionByName(hooks).groupBy("node").agg(F.min("low").alias("label"), F.max("was").alias("was"), F.max("was_far").alias("was_far")), "hooked")
        jump = held.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = B.stored(held.join(jump, "label").select("node", "label", "far", ((F.col("label") < F.col("was")) | (F.col("far") < F.col("was_far"))).alias("moved")), "labels")
        labels = new.select("node", "label", "far")
        if new.filter("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


SALTS = 16


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, text) -> doc_id, bits, component_id: the smallest id reachable over fingerprints of at most ``most`` differing bits."""
    found = B.stored(fingerprints(docs, words), "fingerprints")
    classes = B.stored(found.groupBy("bits").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    labels = components(similar(classes.select("bits"), most)).withColumnRenamed("node", "bits")
    linked = classes.join(labels, "bits")
    # A component may hold a third of all fingerprints: its name goes to several salts, and its members look it up under theirs.
    least = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("bits"), F.lit(SALTS)).cast("int")
    named = linked.withColumn("salt", salt).join(least, ["component", "salt"]).select("bits", "component_id")
    alone = classes.join(labels, "bits", "left_anti").select("bits", F.col("least").alias("component_id"))
    where = named.unionByName(alone)
    return found.join(where, "bits").select("doc_id", "bits", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, most: int = 6) -> DataFrame:
    """The documents with the smallest id of their component, all columns; of rows with one id, all stay; a null id stays only where its component has no other."""
    found = near_duplicates(docs, words, most).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__kept"]), "left_semi")
