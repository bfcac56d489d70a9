"""Ranked lexical search over an index whose posting lists are cut into blocks of similar documents.

``index`` writes one row for each *shard*, some tens of thousands of documents: the shard's
vocabulary and for each term its documents and counts.  ``search`` takes items in parts of a
bounded size and answers them shard by shard.  In a shard, an item's terms come in falling order
of weight, and a document is judged in the list of its first term:

* no further list is opened once the lists' largest impacts together can't reach the item's
  fiftieth score;
* a long list is clustered by the similarity of its documents (``blocks_of``).  Each block keeps, for
  every term that some item asks along with the list's own, the largest impact among its
  documents.  Their sum under the item's weights bounds every score in the block, so a block is
  skipped only if this exact bound fails; the others are scored whole, the best bound first.

Scores are whole numbers, as are the bounds, so results are exact and ties go to the smaller
doc_id.  A task keeps each item's best over all its shards and returns no more; before the full
pass, about the square root of all shards is searched for a score that fifty documents reach: this
only saves work.  The texts are read once and never exchanged; what is broadcast is a part of the
items (``PART_BYTES`` of text).  Terms are known by 64-bit hashes.

Defined cases: null texts have no terms; items without terms, empty tables and terms in all
documents (weight 0) give no rows; every row is a document, or an item, of its own, repeated or
not; a null doc_id comes after all others; texts may be of any length; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm import blocks as B
from storyloom.llm.hard_negatives import NONE, Best

PART_BYTES = 1_000_000
SHARD_TERMS, SHARD_DOCS = 3_000_000, 32_768
BLOCK = 128  # documents of a block, about
SKETCH = 16
STOP = np.zeros(256, bool)
STOP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

INDEX = "shard long, n_docs long, n_terms long, ids binary, sizes binary, terms binary, dfs binary, docs binary, tfs binary"


def index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> shards of postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                held.append(postings(B.ids(part), texts))
                if sum(len(h[2]) for h in held) >= SHARD_TERMS or sum(len(h[0]) for h in held) >= SHARD_DOCS:
                    yield packed(shard, held)
                    shard, held = shard + 1, []
        if held:
            yield packed(shard, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def postings(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Ids and sizes of documents; terms, documents and counts of their postings by rising term."""
    w = B.Words(texts, STOP, lower=True)
    sizes = np.diff(w.first)
    doc = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(w.hash, kind="stable")
    term, doc = w.hash[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return ids, sizes.astype(np.int64), term[at], doc[at], np.diff(np.append(at, len(term)))


def packed(shard: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, sizes, term, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4))
    base = np.cumsum([0, *(len(h[0]) for h in held)])
    doc = np.concatenate([h[3] + b for h, b in zip(held, base)])
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    terms, first = np.unique(term, return_index=True)
    dfs = np.diff(np.append(first, len(term)))
    fields = [shard, int((sizes > 0).sum()), int(sizes.sum()), B.planes(ids), B.planes(sizes), B.pack_names(terms), B.planes(dfs.astype(np.int32)), B.planes(doc.astype(np.int32)), B.planes(tf.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in fields], names=[c.split()[0] for c in INDEX.split(", ")])


class Items:
    """Items of a part: their names, and the terms that they ask."""

    def __init__(self, names: list, texts: list[bytes]):
        w = B.Words(pa.array(texts, pa.large_binary()), STOP, lower=True)
        self.names = names
        self.terms = np.unique(w.hash)
        own = B.look_up(self.terms, w.hash)
        self.asked = [np.unique(own[a:b]) for a, b in zip(w.first, w.first[1:])]

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        """Sets the weights of all terms; each item's terms of any weight come heaviest first."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.place = np.empty(len(df), np.int64)
        order = np.lexsort((np.arange(len(df)), -self.weight))
        self.place[order] = np.arange(len(df))
        self.asked = [t[np.argsort(self.place[t])] for t in self.asked]
        self.asked = [t[self.weight[t] > 0] for t in self.asked]
        # For each term the terms that items ask along with it, from its own place on.
        along: dict[int, set[int]] = {}
        for terms in self.asked:
            own = terms.tolist()
            for i, t in enumerate(own):
                along.setdefault(t, set()).update(own[i:])
        self.along = {t: np.array(sorted(v), np.int64) for t, v in along.items()}


class Shard:
    """The part of a shard that a part of the items asks about."""

    def __init__(self, row: dict, items: Items):
        ids, sizes = B.unplanes(row["ids"], np.int64), B.unplanes(row["sizes"], np.int64)
        terms, dfs = B.unpack_names(row["terms"]), B.unplanes(row["dfs"], np.int32).astype(np.int64)
        at = B.look_up(terms, items.terms)
        asked = np.flatnonzero(at >= 0)
        first = np.cumsum(dfs) - dfs
        length = dfs[at[asked]]
        ends = np.cumsum(length)
        take = np.repeat(first[at[asked]] - (ends - length), length) + np.arange(int(length.sum()))
        doc = B.unplanes(row["docs"], np.int32)[take].astype(np.int64)
        tf = B.unplanes(row["tfs"], np.int32)[take].astype(np.int64)
        size_part = 50 + (50 * sizes * items.n_docs) // max(1, items.n_terms)
        self.ids, self.items = ids, items
        self.doc, self.term = doc, np.repeat(asked, length)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * size_part[doc])
        n = len(items.terms)
        self.start, self.stop = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[asked], self.stop[asked] = ends - length, ends
        self.largest = np.zeros(n, np.int64)
        if len(asked):
            self.largest[asked] = np.maximum.reduceat(self.impact, ends - length)
        order = np.argsort(doc, kind="stable")
        self.row_term, self.row_impact = self.term[order], self.impact[order]
        self.row = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))])
        self.sketches: np.ndarray | None = None
        self.cut: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seen = np.full(len(ids), -1, np.int64)
        self.scored = self.skipped = 0

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents: which of them, and where."""
        a, size = self.row[docs], self.row[docs + 1] - self.row[docs]
        ends = np.cumsum(size)
        return np.repeat(np.arange(len(docs)), size), np.repeat(a - (ends - size), size) + np.arange(int(size.sum()))

    def sketch(self) -> np.ndarray:
        """Every document's impacts, weighed, thrown into a few random directions."""
        if self.sketches is None:
            side = np.random.default_rng(1).choice([-1.0, 1.0], (len(self.items.terms), SKETCH)).astype(np.float32)
            out = np.zeros((len(self.ids), SKETCH), np.float32)
            value = (self.row_impact * self.items.weight[self.row_term]).astype(np.float32)
            full = np.flatnonzero(np.diff(self.row))
            for some in np.array_split(full, max(1, len(self.row_term) // 200_000)):
                if len(some):
                    a, b = self.row[some[0]], self.row[some[-1] + 1]
                    out[some] = np.add.reduceat(value[a:b, None] * side[self.row_term[a:b]], self.row[some] - a, axis=0)
            size = np.sqrt((out * out).sum(axis=1, keepdims=True))
            self.sketches = out / np.where(size > 0, size, 1)
        return self.sketches

    def blocks_of(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A long list by blocks of similar documents: documents, where blocks begin and end, column terms, coordinatewise maxima."""
        if t not in self.cut:
            docs = self.doc[self.start[t] : self.stop[t]]
            own = self.sketch()[docs]
            n = -(-len(docs) // BLOCK)
            centres = own[np.linspace(0, len(docs) - 1, n).astype(int)]
            block = np.argmax(own @ centres.T, axis=1)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            bounds = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(docs))
            number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            columns = self.items.along[t]
            where = np.full(len(self.items.terms), -1, np.int64)
            where[columns] = np.arange(len(columns))
            most = np.zeros((len(bounds) - 1, len(columns)), np.int64)
            which, at = self.rows(docs)
            column = where[self.row_term[at]]
            good = column >= 0
            np.maximum.at(most, (number[which[good]], column[good]), self.row_impact[at[good]])
            self.cut[t] = docs, bounds, columns, most
        return self.cut[t]

    def search(self, item: int, best: Best, floor: int) -> None:
        items = self.items
        terms = items.asked[item]
        terms = terms[self.stop[terms] > self.start[terms]]
        if not len(terms):
            return
        weight = np.zeros(len(items.terms), np.int64)
        weight[terms] = items.weight[terms]
        ahead = np.cumsum((self.largest[terms] * weight[terms])[::-1])[::-1]
        least = max(floor, 1, int(best.scores[item, -1]))

        def score(docs: np.ndarray) -> int:
            docs = np.unique(docs[self.seen[docs] != item])
            if not len(docs):
                return least
            self.seen[docs] = item
            self.scored += len(docs)
            which, at = self.rows(docs)
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, which, self.row_impact[at] * weight[self.row_term[at]])
            good = total >= least
            best.add(np.full(int(good.sum()), item), total[good], self.ids[docs[good]])
            return max(least, int(best.scores[item, -1]))

        k = 0
        while k < len(terms) and ahead[k] >= least:
            # Short lists are taken together.
            to, held = k, 0
            while to < len(terms) and self.stop[terms[to]] - self.start[terms[to]] <= BLOCK and held <= BLOCK:
                held += int(self.stop[terms[to]] - self.start[terms[to]])
                to += 1
            if to > k:
                least = score(np.concatenate([self.doc[self.start[t] : self.stop[t]] for t in terms[k:to]]))
                k = to
                continue
            docs, bounds, columns, most = self.blocks_of(int(terms[k]))
            own = np.searchsorted(columns, terms[k:])
            bound = most[:, own] @ weight[terms[k:]]
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] >= least]
            self.skipped += len(bound)
            at, step = 0, 1
            while at < len(order) and bound[order[at]] >= least:
                some = order[at : at + step]
                some = some[bound[some] >= least]
                self.skipped -= len(some)
                least = score(np.concatenate([docs[bounds[b] : bounds[b + 1]] for b in some]))
                at, step = at + step, 2 * step
            k += 1


def _parts(items: DataFrame, part_bytes: int) -> Iterator[tuple[pa.Table, int]]:
    """Items in parts of about ``part_bytes`` of text, each fetched when its turn comes, and the number of parts."""
    plain = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-int(plain.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // part_bytes))
    for k in range(parts):
        yield (plain if parts == 1 else plain.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)).toArrow(), parts


def _frequencies(shards: DataFrame, sent, n: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value.terms
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, dfs in zip(batch.column(0), batch.column(1)):
                at = B.look_up(B.unpack_names(terms.as_py()), asked)
                total[at >= 0] += B.unplanes(dfs.as_py(), np.int32)[at[at >= 0]]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["term", "df"])

    found = shards.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n, np.int64)
    out[np.asarray(found["term"])] = np.asarray(found["df"])
    return out


def _answers(shards: DataFrame, sent, floors: np.ndarray, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = Best(len(items.names), top)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(i)[row].as_py() for i, c in enumerate(batch.schema.names)}, items)
                for k in range(len(items.names)):
                    shard.search(k, best, int(floors[k]))
        who, scores, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64())], names=["who", "score", "id"])

    found = shards.select("ids", "sizes", "terms", "dfs", "docs", "tfs").mapInArrow(run, "who long, score long, id long")
    order = Window.partitionBy("who").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(shards: DataFrame, items: DataFrame, top: int = 50, part_bytes: int = PART_BYTES) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score. ``shards`` is an index that has been stored."""
    spark = shards.sparkSession
    n_docs, n_terms, n_shards = (int(v or 0) for v in shards.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first())
    out = None
    for part, parts in _parts(items, part_bytes):
        own = Items(part["item_id"].to_pylist(), [t.encode() for t in part["text"].to_pylist()])
        own.weigh(n_docs, n_terms, _frequencies(shards, spark.sparkContext.broadcast(own), len(own.terms)))
        sent = spark.sparkContext.broadcast(own)
        floors = np.zeros(len(own.names), np.int64)
        every = math.isqrt(n_shards)
        if every > 2:
            sample = _answers(shards.filter(F.pmod(F.xxhash64("shard"), F.lit(every)) == 0), sent, floors, top).filter(F.col("rank") == top).toArrow()
            floors[np.asarray(sample["who"])] = np.asarray(sample["score"])
        names = spark.createDataFrame(pa.table({"who": pa.array(range(part.num_rows), pa.int64()), "item_id": part["item_id"]}))
        found = _answers(shards, sent, floors, top).join(names, "who")
        found = found.select("item_id", "rank", F.when(F.col("id") < int(B.NO_ID), F.col("id")).alias("doc_id"), "score")
        found = found if parts == 1 else B.stored(found, "answers")
        out = found if out is None else out.unionByName(found)
    return out
