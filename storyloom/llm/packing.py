"""Best-fit packing of tokenized documents into sequences of bounded length.

Only lengths decide where a piece goes, and there are at most as many lengths as a sequence
has tokens.  So Spark counts the lengths, the driver plans on that histogram (bounded by the
capacity, whatever the corpus), and Spark ranks the pieces of each length and looks their
ranks up in the plan.

The plan is vector best-fit decreasing.  A bin has residual tokens, documents and attention
cost (the sum of squared lengths); bins that were opened or filled together are one group, and groups that
come to the same state later stay apart.  A class of equal
pieces goes to the feasible group with the best score: ``norm`` takes the smallest weighted
norm of what is left, ``dot`` the largest weighted product of the piece with what is left.
Where no group can take a piece under every capacity, new bins are opened.

Defined cases: a null or empty text is its end id alone; rows with one id are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

CAPACITY = 1024
END_ID = 2
RANKED_TOGETHER = 20_000
_encoders: dict = {}


def encoder(path: str, ranks_path: str | None):
    """Texts -> ids.  The same vocabulary as ranks, where given, serves plain Latin text, on which both libraries agree, at a quarter of the time."""
    if (path, ranks_path) in _encoders:
        return _encoders[path, ranks_path]
    import base64
    import os
    import re

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact = Tokenizer.from_file(path)
    encode = lambda text: exact.encode(text, add_special_tokens=False).ids
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = re.compile("|".join(map(re.escape, [t.content for t in exact.get_added_tokens_decoder().values()])) + "|[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")
        slow = encode
        encode = lambda text: slow(text) if special.search(text) else fast.encode_ordinary(text)
    _encoders[path, ranks_path] = encode
    return encode


def pieces(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32; only documents of more than ``capacity`` ids are cut, the first piece takes the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path)
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), texts):
                    ids = np.array([*encode(text.as_py().decode()), END_ID], "<u4")
                    n = len(ids)
                    first = n if n <= capacity else n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, rank from, rank to, pieces per bin, first bin, offset): rank r lies in bin first + (r - from) // per, behind (r - from) % per others."""
    most = np.array(capacities, float)
    weight = np.array(weights) / most**2
    groups: list[list] = []  # residual tokens, documents, attention; first bin, bins
    placed, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > most).any():
            raise ValueError(f"a piece of {length} exceeds the capacities {capacities}")
        while left:
            state = np.array([g[0] for g in groups]) if groups else np.zeros((0, 3))
            fits = (state >= need).all(axis=1)
            if fits.any():
                rest = state - need
                value = (weight * rest * rest).sum(axis=1) if rule == "norm" else -(weight * need * state).sum(axis=1)
                k = int(np.where(fits, value, np.inf).argmin())
                residual, first, n = groups[k]
                take = min(n, left)
                placed.append((length, rank, rank + take, 1, first, int(capacities[0] - residual[0])))
                if take < n:
                    groups[k] = [residual, first + take, n - take]
                else:
                    groups.pop(k)
                groups.append([residual - need, first, take])
                rank, left = rank + take, left - take
                continue
            per = int(min(most // need))
            new = max(1, left // per)
            per = min(per, left)
            placed.append((length, rank, rank + new * per, per, bins, 0))
            groups.append([most - per * need, bins, new])
            bins, rank, left = bins + new, rank + new * per, left - new * per
        least = min(counts)
        groups = [g for g in groups if g[0][0] >= least and g[0][1] >= 1 and g[0][2] >= least * least]
    return placed


def pack(found: DataFrame, capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None, rule: str = "norm") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) -> with sequence_id, offset.  ``documents`` and ``attention`` bind only where given."""
    found = B.stored(found, "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    capacities = (capacity, documents or capacity, attention or capacity * capacity)
    placed = plan(counts, capacities, rule=rule)
    schema = "length long, r_from long, r_to long, per long, bin long, at long"
    where = F.broadcast(found.sparkSession.createDataFrame(placed, schema))  # a few rows for each length
    parts = max(16, max(counts.values(), default=0) // RANKED_TOGETHER)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sums = salted.groupBy("length", "salt").count()
    before = sums.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    step = F.col("rank") - F.col("r_from")
    return (
        ranked.join(where, "length").filter((F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(step, F.col("per")) * F.col("length")).cast("long").alias("offset"))
    )
