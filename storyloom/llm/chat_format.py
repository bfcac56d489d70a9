"""Roles of transcript turns by a hidden Markov model, and canonical rendering.

A transcript is a sequence of turns without roles.  Hidden states are the roles; a turn shows
a speaker marker (``User:``, ``AI>`` ... or none), the size of its text, its number of lines
and how its last line ends.  Transition and emission tables are counted by Spark on
conversations whose roles are known (three roles times some forty symbols, whatever the
input), and Viterbi finds the most likely roles of the others.

A conversation may be of any length: it is cut by turn number into segments.  A segment's
best scores from each role before it to each role at its end form a 3 x 3 matrix; Viterbi over
a conversation's matrices fixes the roles at the cuts, and every segment is then decoded
between its cuts, which gives exactly the path of the whole.  Rows are streamed through
sorted partitions; only the matrices of one conversation, nine numbers per ``segment``
turns, meet in one task.

Defined cases: a null text is an empty turn; a null turn number comes first; rows with one
turn number are ordered by text; a null conversation id is a conversation of its own; a role
outside the three is not learned from; with no known roles all tables are uniform; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

ROLES = ("system", "user", "assistant")
# Speaker markers of common transcript formats, by role.
MARKERS = {"system": "system|instructions?|context", "user": "user|human|you|q|question|customer|prompter", "assistant": "assistant|ai|bot|a|answer|agent|gpt|model|response"}
SEGMENT = 512
MARKED = 50  # turns that speak for a role's own marker before any is seen


def blocks_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, text) raw transcripts -> (conv_id, turn, text): a turn begins at a line with a marker or behind an empty line."""
    any_marker = "|".join(MARKERS.values())
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?im)^(?=[ \t#*<\[|]*(?:{any_marker})[ \t*>\]|]*[:>])", "\u0001")
    parts = F.filter(F.split(F.regexp_replace(marked, r"\n[ \t]*\n+", "\u0001"), "\u0001"), lambda x: F.trim(x) != "")
    return transcripts.select("conv_id", F.posexplode(parts).alias("turn", "text")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.regexp_replace("text", r"\s+$", "").alias("text"))


def marked(role: str) -> str:
    """A role's speaker marker at the beginning of a turn."""
    return rf"(?i)^[ \t#*<\[|]*(?:{MARKERS[role]})[ \t*>\]|]*[:>]+[ \t]*"


def body(text: Column, role: Column) -> Column:
    """A turn without its speaker marker: only that of the role that was found, and only once."""
    out = text
    for r in ROLES:
        out = F.when(role == r, F.regexp_replace(text, marked(r), "")).otherwise(out)
    return out


def observed(turns: DataFrame) -> DataFrame:
    """Adds ``symbols``, one small number for each feature."""
    text = F.coalesce("text", F.lit(""))
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(text.rlike(marked(role)), k + 1).otherwise(marker)
    lines = F.size(F.split(text, "\n"))
    tail = F.substring(F.rtrim(text), -1, 1)
    end = F.when(tail == "?", 1).when(tail == ".", 2).when(tail == ":", 3).otherwise(0)
    size = F.least(F.floor(F.log2(F.length(text) + 1)), F.lit(15))
    return turns.withColumn("symbols", F.array(*[x.cast("int") for x in (marker, size, F.least(lines, F.lit(8)), end)]))


SIZES = (4, 16, 9, 4)


def learn(turns: DataFrame, train: Column) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log start, transition (from, to) and emission tables from turns with a known ``role``."""
    known = turns.filter(train & F.col("role").isin(*ROLES) & F.col("turn").isNotNull())
    after = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    moves = known.join(after, ["conv_id", "turn"], "left").groupBy("before", "role").count().collect()  # at most 12 rows
    shown = known.select("role", F.posexplode("symbols").alias("feature", "symbol")).groupBy("role", "feature", "symbol").count().collect()  # at most 99 rows
    k = {r: i for i, r in enumerate(ROLES)}
    start, step = np.ones(3), np.ones((3, 3))
    for r in moves:
        if r["before"] is None:
            start[k[r["role"]]] += r["count"]
        else:
            step[k[r["before"]], k[r["role"]]] += r["count"]
    emit = [np.ones((3, n)) for n in SIZES]
    emit[0][range(3), range(1, 4)] = MARKED
    for r in shown:
        emit[r["feature"]][k[r["role"]], r["symbol"]] += r["count"]
    return np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit]


def _emission(symbols: list[list[int]], emit: list[np.ndarray]) -> np.ndarray:
    s = np.array(symbols).reshape(len(symbols), len(emit))
    return sum(e[:, s[:, i]].T for i, e in enumerate(emit))


def matrix(score: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best score from each role before the segment to each at its end."""
    m = step + score[0]
    for row in score[1:]:
        m = (m[:, :, None] + step[None]).max(axis=1) + row
    return m


def viterbi(first: np.ndarray, score: np.ndarray, step: np.ndarray, last: int | None = None) -> list[int]:
    """The best path; ``first`` holds the scores of entering each role at the first turn, ``last`` fixes the end."""
    best, back = first + score[0], []
    for row in score[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    path = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of equal keys, streamed."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def recover(turns: DataFrame, train: Column, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, turn, role or null, text) -> conv_id, turn, role, found_role, body, rendered."""
    seen = observed(turns.select("conv_id", "turn", "role", "text"))
    start, step, emit = learn(seen, train)
    cut = seen.withColumn("seg", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-1)).cast("long"))
    order = ["conv_id", "seg", F.asc_nulls_first("turn"), "text"]
    dealt = cut.repartition("conv_id", "seg").sortWithinPartitions(*order)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (conv, seg), held in _runs(batches, ("conv_id", "seg")):
            score = _emission([r["symbols"] for r in held], emit)
            rows.append((conv, seg, matrix(score, step).ravel().tolist(), viterbi_end(start, score, step)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["conv_id", "seg", "m", "s"])

    long = cut.groupBy("conv_id").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a < b").select(F.col("conv_id").alias("of"))
    parts = dealt.select("conv_id", "seg", "symbols", "turn", "text").join(long, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").repartition("conv_id", "seg").sortWithinPartitions(*order)
    found = parts.drop("turn", "text").mapInArrow(matrices, "conv_id long, seg long, m array<double>, s array<double>")

    def cuts(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        best, back = np.array(rows[0]["s"]), []
        for r in rows[1:]:
            ways = best[:, None] + np.array(r["m"]).reshape(3, 3)
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "seg": pa.array([r["seg"] for r in rows], pa.int64()), "before": pa.array([None, *path[:-1]], pa.int32()), "last": pa.array(path, pa.int32())})

    bounds = found.groupBy("conv_id").applyInArrow(cuts, "conv_id long, seg long, before int, last int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), held in _runs(batches, ("conv_id", "seg")):
            score = _emission([r["symbols"] for r in held], emit)
            before, last = held[0]["before"], held[0]["last"]
            path = viterbi(start if before is None else step[before], score, step, last)
            yield pa.RecordBatch.from_arrays([
                pa.array([conv] * len(held), pa.int64()), pa.array([r["turn"] for r in held], pa.int64()), pa.array([r["role"] for r in held], pa.string()),
                pa.array([ROLES[p] for p in path], pa.string()), pa.array([r["text"] or "" for r in held], pa.string()),
            ], names=["conv_id", "turn", "role", "found_role", "text"])

    bounds = bounds.withColumnRenamed("conv_id", "of").withColumnRenamed("seg", "part")
    both = cut.join(bounds, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seg") == F.col("part")), "left").drop("of", "part").repartition("conv_id", "seg").sortWithinPartitions(*order)
    out = both.mapInArrow(decode, "conv_id long, turn long, role string, found_role string, text string").withColumn("body", body(F.col("text"), F.col("found_role"))).drop("text")
    return out.withColumn("rendered", F.concat(F.lit("<|"), F.col("found_role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")))


def viterbi_end(first: np.ndarray, score: np.ndarray, step: np.ndarray) -> list[float]:
    """Best score of each role at the end of a segment that begins its conversation."""
    best = first + score[0]
    for row in score[1:]:
        best = (best[:, None] + step).max(axis=0) + row
    return best.tolist()
