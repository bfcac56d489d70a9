"""Documents that hold passages of a benchmark, found with suffix arrays of the training text.

Each task cuts its documents into shards of bounded size and builds a shard's suffix array:
the word positions sorted by the words that follow, up to the window's width.  Positions
whose next words are not all words of the benchmark can't begin a match and are left out of
the array.  Every suffix of every test item is then searched in it by bisection; a run of
adjacent hits along one diagonal is a longest verbatim match.  Texts are never exchanged.

The benchmark comes to the tasks in parts of at most ``part_bytes``: one part where it is
small, else one narrow pass after another over the same rows, each adding its hits.

Defined cases: a null text has no words; an item without words or without an id has no
windows; an item shorter than the window is one window; repeated items count once per id;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

STOP = np.ones(256, bool)
STOP[0x30:0x3A] = False
STOP[0x61:0x7B] = False
STOP[0x80:] = False
PART_BYTES = 32_000_000


class Tests:
    """Windows of test items: word codes in rows, by window length."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        w = B.Words(pa.array([t for _, t in items], pa.large_binary()), STOP, lower=True)
        self.names = [n for n, _ in items]
        self.vocab = np.unique(w.hash)
        codes = np.searchsorted(self.vocab, w.hash)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            m = min(width, b - a)
            if m:
                by.setdefault(m, []).extend((i, a + k, k) for k in range(b - a - m + 1))
        self.windows = {}
        for m, found in by.items():
            item, at, k = (np.array(x) for x in zip(*found))
            self.windows[m] = (_keys(codes[at[:, None] + np.arange(m)]), item, k)
        self.shortest = min(by, default=0)


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of word codes as byte strings that sort alike."""
    m = codes.shape[1]
    return np.ascontiguousarray((codes + 2).astype(">u4")).view(f"S{4 * m}").reshape(-1)


def suffix_array(codes: np.ndarray, run: np.ndarray, width: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``width`` word codes, and those codes; a code of -1 ends a suffix."""
    at = np.flatnonzero(run >= shortest)
    ahead = np.arange(width)
    inside = ahead < np.minimum(run[at], width)[:, None]
    rows = np.where(inside, codes[np.minimum(at[:, None] + ahead, len(codes) - 1)], -1)
    order = np.argsort(_keys(rows), kind="stable")
    return at[order], rows[order]


def matches(w: B.Words, tests: Tests, width: int) -> np.ndarray:
    """Rows (document, position, item, position in the item, length) of windows that occur."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    codes = B.look_up(tests.vocab, w.hash)
    n = len(codes)
    found = []
    if n and tests.windows:
        stops = np.flatnonzero((codes < 0) | np.append(text[1:] != text[:-1], True))
        end = np.append(stops, n)[np.searchsorted(stops, np.arange(n))]
        run = np.where(codes < 0, 0, end - np.arange(n) + (codes[np.minimum(end, n - 1)] >= 0))
        at, rows = suffix_array(codes, run, width, tests.shortest)
        for m, (keys, item, k) in tests.windows.items():
            own = _keys(rows[:, :m])
            a, b = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            q = np.repeat(np.arange(len(keys)), b - a)
            if len(q):
                hit = at[np.arange(len(q)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[q]]
                found.append(np.stack([text[hit], hit, item[q], k[q], np.full(len(q), m)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 5), np.int64)


def longest(found: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """Of each document its longest verbatim match: words, position, item, position in the item."""
    if not len(found):
        return {}
    order = np.lexsort((found[:, 1], found[:, 1] - found[:, 3], found[:, 2], found[:, 0]))
    f = found[order]
    diagonal = f[:, 1] - f[:, 3]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:, 0] != f[:-1, 0]) | (f[1:, 2] != f[:-1, 2]) | (diagonal[1:] != diagonal[:-1]) | (f[1:, 1] > f[:-1, 1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(f)) - 1
    size = f[b, 1] + f[b, 4] - f[a, 1]
    best: dict[int, tuple[int, int, int, int]] = {}
    for k in np.lexsort((f[a, 1], -size)).tolist():
        best.setdefault(int(f[a[k], 0]), (int(size[k]), int(f[a[k], 1]), int(f[a[k], 2]), int(f[a[k], 3])))
    return best


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of the documents in ``row``, with n_words, n_hit, n_items, item_ids, items_sha256, contaminated and the longest match.

    A document is contaminated if its hit words are at least a twentieth of its words.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("item is not null")
    parts = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.lit(None).cast("binary").alias("hits"), F.lit("[]").alias("items"), F.lit(0).cast("long").alias("longest_match"), F.lit(None).cast("string").alias("longest_item"), F.lit(None).cast("long").alias("longest_at"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()  # at most about part_bytes
        tests = spark.sparkContext.broadcast(Tests(sorted((r["item"], r["text"].encode()) for r in own), width))

        def run(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            t = tests.value
            for batch in batches:
                for part, texts in B.slices(pa.Table.from_batches([batch])):
                    w = B.Words(texts, STOP, lower=True)
                    found = matches(w, t, width)
                    step = np.zeros(len(w.hash) + 1, np.int64)
                    np.add.at(step, found[:, 1], 1)
                    np.add.at(step, found[:, 1] + found[:, 4], -1)
                    hit = np.cumsum(step)[:-1] > 0
                    best = longest(found)
                    named: dict[int, set[str]] = {}
                    for doc, item in np.unique(found[:, [0, 2]], axis=0).tolist():
                        named.setdefault(doc, set()).add(t.names[item])
                    bits, ids, size, whose, where, words, hits = [], [], [], [], [], [], []
                    rows = zip(*(part.column(i).to_pylist() for i in range(2, 7)))
                    for i, (before, got, most, item, at) in enumerate(rows):
                        a, b = int(w.first[i]), int(w.first[i + 1])
                        mine = hit[a:b]
                        if before is not None and len(mine):
                            mine = mine | np.unpackbits(np.frombuffer(before, np.uint8), count=b - a).astype(bool)
                        if i in best and best[i][0] > most:
                            most, at, item = best[i][0], best[i][1] - a, t.names[best[i][2]]
                        bits.append(np.packbits(mine).tobytes() if mine.any() else None)
                        ids.append(json.dumps(sorted({*json.loads(got), *named.get(i, ())})) if i in named else got)
                        size.append(most)
                        whose.append(item)
                        where.append(at)
                        words.append(b - a)
                        hits.append(int(mine.sum()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary()), pa.array(ids, pa.string()), pa.array(size, pa.int64()), pa.array(whose, pa.string()), pa.array(where, pa.int64()), pa.array(words, pa.int64()), pa.array(hits, pa.int64())], names=batch.schema.names)

        marked = marked.mapInArrow(run, marked.schema)
    item_ids = F.from_json("items", "array<string>")
    return marked.select(
        "row", "n_words", "n_hit", F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), F.sha2(F.array_join(item_ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_match", "longest_item", "longest_at",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    found = contamination(docs, benchmark, width).filter(~F.col("contaminated"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
