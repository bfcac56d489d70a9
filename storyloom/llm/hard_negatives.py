"""Hard negatives by exact inner products, with lists that all anchors of a cluster share.

Anchors are clustered by direction.  For a cluster with centre c, whose members lie within the
angle t of c, no member u can score more against a row v than

    |u| * |v| * cos(max(0, angle(v, c) - t)),

so the rows of a shard are sorted by the second and third factors once for each cluster, and
every member walks down this one list until the bound of the next row is below what the member
still needs: then nothing further down can matter, which certifies its result.  Members that
are done leave the walk; what a task has found so far is what its next shard must beat.

Two passes over the rows are made for each *part* of the anchors (``PART_BYTES`` of vectors, the only
thing that is broadcast): one for the positives, one for the negatives, whose ranges the
positives give.  A task returns at most ``positives`` rows an anchor, or ``negatives`` rows an
anchor and positive, however many rows it reads; the best of all tasks are a window's ranks.
Rows are never exchanged.

Defined cases: rows with a null id, label, vector, component or a component that isn't finite
take no part; an empty vector and a shorter one count as if padded by zeros; rows that repeat
an id are rows of their own, but no row is a positive of an anchor with its id, and an anchor
row that is repeated is answered as often; ties go to the smaller id; empty tables and anchors
without positives give no rows; other columns are not read.  Vectors whose squared length
exceeds 2^56 are refused, as scores would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

PART_BYTES = 32_000_000
SHARD_BYTES = 16_000_000
FIRST_STEP, LAST_STEP = 64, 2048
MOST_CLUSTERS = 256
NONE = -np.iinfo(np.int64).max
LAST_ID = np.iinfo(np.int64).max
EXACT = 2.0**53
WIDEST = 2.0**56
SLACK = 1e-6  # of the product of lengths: far above the error of the bound


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one width, cut or padded by zeros."""
    bounds = np.asarray(vectors.offsets).astype(np.int64)
    flat = np.asarray(vectors.values)[bounds[0] : bounds[-1]].astype(np.float64)
    size = np.diff(bounds)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], size)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    found = np.sqrt((x * x).sum(axis=1))
    if len(found) and found.max() ** 2 > WIDEST:
        raise ValueError("vectors are too long for scores of 64 bits")
    return found


def directions(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    return x / np.where(length > 0, length, 1.0)[:, None]


class Anchors:
    """The anchors of a part, clustered by direction."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rounds: int = 6):
        length = lengths(x)
        unit = directions(x, length)
        n = max(1, min(MOST_CLUSTERS, len(ids) // 8))
        centres = unit[np.linspace(0, len(ids) - 1, n).astype(int)] if len(ids) else unit
        own = np.zeros(len(ids), np.int64)
        for _ in range(rounds if len(ids) else 0):
            own = np.argmax(unit @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, unit)
            size = np.sqrt((sums * sums).sum(axis=1))
            centres = np.where((size > 0)[:, None], sums / np.where(size > 0, size, 1.0)[:, None], centres)
        order = np.argsort(own, kind="stable")
        self.ids, self.labels, self.x, self.length = ids[order], labels[order], x[order], length[order]
        cut = np.searchsorted(own[order], np.arange(n + 1))
        self.clusters = [(int(a), int(b)) for a, b in zip(cut, cut[1:]) if b > a]
        self.centres = centres[[own[order][a] for a, _ in self.clusters]]
        angle = np.arccos(np.clip((unit[order] * centres[own[order]]).sum(axis=1), -1, 1))
        angle[self.length == 0] = 0.0  # scores nothing, whatever its bound
        self.spread = np.array([angle[a:b].max() for a, b in self.clusters])


class Best:
    """The best k (score, id) of each of n seekers; equal scores by smaller id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), NONE)
        self.ids = np.full((n, k), LAST_ID)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        k = self.scores.shape[1]
        seekers = np.unique(who)
        who = np.concatenate([who, np.repeat(seekers, k)])
        scores = np.concatenate([scores, self.scores[seekers].ravel()])
        ids = np.concatenate([ids, self.ids[seekers].ravel()])
        order = np.lexsort((ids, -scores, who))
        who = who[order]
        first = np.searchsorted(who, seekers)
        take = order[first[:, None] + np.arange(k)]
        self.scores[seekers], self.ids[seekers] = scores[take], ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, place = np.nonzero(self.scores != NONE)
        return who, self.scores[who, place], self.ids[who, place]


def walks(a: Anchors, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every cluster: its members' numbers, the rows by falling bound, and that bound."""
    length = lengths(x)
    angle = np.arccos(np.clip(directions(x, length) @ a.centres.T, -1, 1))
    for k, (i, j) in enumerate(a.clusters):
        bound = length * (np.cos(np.maximum(0.0, angle[:, k] - a.spread[k])) + SLACK)
        order = np.argsort(-bound, kind="stable")
        yield np.arange(i, j), order, bound[order]


def products(u: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    if most < EXACT:
        return np.rint(u @ v.T).astype(np.int64)
    return u.astype(np.int64) @ v.astype(np.int64).T


def walk(a: Anchors, x: np.ndarray, need, look) -> int:
    """Every cluster's walk: ``need(members)`` is the least score that still matters to each, ``look(members, rows, scores)`` takes some rows' scores.

    Returns how many scores were computed.
    """
    seen = 0
    widest = float(lengths(x).max(initial=0.0)) * float(a.length.max(initial=0.0))
    for members, order, bound in walks(a, x):
        at, step = 0, FIRST_STEP
        while at < len(order):
            members = members[a.length[members] * bound[at] >= need(members)]
            if not len(members):
                break
            rows = order[at : at + step]
            look(members, rows, products(a.x[members], x[rows], widest))
            seen += len(members) * len(rows)
            at, step = at + step, min(2 * step, LAST_STEP)
    return seen


class Positives:
    """Rows of an anchor's own label, but for rows with its id."""

    def __init__(self, a: Anchors, k: int):
        self.a, self.best = a, Best(len(a.ids), k)

    def shard(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
        a, best = self.a, self.best

        def need(members):
            return best.scores[members, -1].astype(np.float64)

        def look(members, rows, scores):
            good = (labels[rows] == a.labels[members][:, None]) & (ids[rows] != a.ids[members][:, None]) & (scores >= best.scores[members, -1:])
            m, r = np.nonzero(good)
            best.add(members[m], scores[m, r], ids[rows][r])

        return walk(a, x, need, look)


class Negatives:
    """Rows of other labels with low * p <= 100 * score <= high * p, for each positive score p of an anchor."""

    def __init__(self, a: Anchors, scores: np.ndarray, k: int, low: int, high: int):
        self.a, self.low, self.high, self.p = a, low, high, scores
        self.floor = np.where(scores == NONE, np.inf, -(-low * np.where(scores == NONE, 0, scores) // 100).astype(np.float64))
        self.floor[(scores != NONE) & (low * np.where(scores == NONE, 0, scores) > high * np.where(scores == NONE, 0, scores))] = np.inf
        self.best = Best(scores.size, k)

    def shard(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> int:
        a, best, p, places = self.a, self.best, self.p, self.p.shape[1]

        def needs(members):
            held = best.scores[:, -1].reshape(-1, places)[members]
            return np.maximum(self.floor[members], held)

        def look(members, rows, scores):
            other = labels[rows] != a.labels[members][:, None]
            least = needs(members)
            for i in range(places):
                m, r = np.nonzero(other & (scores >= least[:, i : i + 1]) & (100 * scores <= self.high * p[members, i][:, None]))
                best.add(members[m] * places + i, scores[m, r], ids[rows][r])

        return walk(a, x, lambda members: needs(members).min(axis=1, initial=np.inf), look)


def _pass(rows: DataFrame, state, schema: str, names: list[str]) -> DataFrame:
    """One pass of walks: what the state of each task has found at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = state()
        width = found.a.x.shape[1]
        most = max(256, SHARD_BYTES // (8 * max(1, width)))
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                found.shard(np.asarray(part.column(0)), np.asarray(part.column(1)), matrix(part.column(2), width))
        who, scores, ids = found.best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("who").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _sorted_rows(found: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids by seeker and place."""
    t = found.select("who", "place", "score", "id").toArrow()
    scores, ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)
    who, place = np.asarray(t["who"]), np.asarray(t["place"]) - 1
    scores[who, place], ids[who, place] = np.asarray(t["score"]), np.asarray(t["id"])
    return scores, ids


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, label, vector of whole numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    plain = rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), "is_anchor")
    plain = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(sound)
    anchors, plain = plain.filter("is_anchor").drop("is_anchor"), plain.drop("is_anchor")
    total = int(anchors.agg(F.sum(F.size("vector") * 8 + 32)).first()[0] or 0)
    parts = max(1, -(-total // part_bytes))
    results = []
    for k in range(parts):
        own = (anchors if parts == 1 else anchors.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)).orderBy("id").toArrow().combine_chunks()  # about part_bytes
        vectors = own["vector"].combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.float64()))
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        width = int(np.diff(np.asarray(vectors.offsets)).max(initial=0)) if len(vectors) else 0
        a = Anchors(np.asarray(own["id"]), np.asarray(own["label"]), matrix(vectors, width) if len(vectors) else np.zeros((0, 0)))
        sent = spark.sparkContext.broadcast(a)
        found = _pass(plain, lambda sent=sent: Positives(sent.value, positives), "who long, score long, id long", ["who", "score", "id"])
        scores, ids = _sorted_rows(_top(found, positives), len(a.ids), positives)
        known = spark.sparkContext.broadcast(scores)
        found = _pass(plain, lambda sent=sent, known=known: Negatives(sent.value, known.value, negatives, low, high), "who long, score long, id long", ["who", "score", "id"])
        who, place = np.nonzero(scores != NONE)
        named = spark.createDataFrame(pa.table({"who": pa.array(who * positives + place, pa.int64()), "anchor_id": pa.array(a.ids[who], pa.int64()), "positive_id": pa.array(ids[who, place], pa.int64()), "positive_score": pa.array(scores[who, place], pa.int64())}))
        best = _top(found, negatives).join(named, "who").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results.append(best if parts == 1 else B.stored(best, f"negatives-{k}"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
