"""Removal of lines that many documents share.

A line's key is the line with blanks stripped at both ends and A-Z lower-cased.  Every line
that counts becomes one row: the hash of its key, its document and its position.  Spark deals
the rows by range and sorts them by hash, falling document and position, and each range is
streamed: the first document of a hash keeps its lines, those of all later ones go as soon as
enough documents have passed.  So a stream holds only the lines of the few documents before
that, however frequent the key.  Ranges are cut by hash, document and position, so that even
one key of a third of all lines is dealt over many tasks; of a hash at a cut the undecided
rows are settled by a count over all its parts (at most two hashes a range).

What comes back is a compressed bitmap of kept lines for each document that loses some;
texts are joined to the bitmaps only where a text is asked for.

Defined cases: a null or empty text is one empty line; keys shorter than ``shortest`` code
points always stay; the largest id keeps all its copies of a line; a null id counts as
larger than any; rows with one id count as one document; an empty table gives no rows; other
columns, whatever their names, come back as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import blocks as B

LINES = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
FOUND = "name long, doc long, version long, pos int, n_lines int"
MARK = -1


def _length(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode(errors="replace"))


def line_names(text: bytes, shortest: int) -> list[tuple[int, int]]:
    """(position, hash of the key) of the lines that are long enough to count."""
    names = []
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(b" \t\n\r\v\f")
        if len(key) >= shortest and _length(key) >= shortest:
            names.append((i, xxhash.xxh3_64_intdigest(key.lower())))
    return names


def _who(docs: DataFrame) -> list[Column]:
    """Of a row its document, null as the largest id, and its version: rows with one id can hold several texts."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(int(B.NO_ID))).alias("doc"), F.xxhash64("text").alias("version")]


def line_rows(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, text) -> a row for each line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                found, counts, sizes = [], [], []
                for text in texts.to_pylist():
                    names = line_names(text, shortest)
                    found += names
                    counts.append(len(names))
                    sizes.append(text.count(b"\n") + 1)
                at = np.array([i for i, _ in found], np.int32)
                names = np.array([h for _, h in found], np.uint64).view(np.int64)
                each = lambda x: np.repeat(np.asarray(x), counts)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(each(part.column(0))), pa.array(each(part.column(1))), pa.array(at), pa.array(each(np.array(sizes, np.int32)))], schema=LINES)

    return docs.select(*_who(docs), "text").mapInArrow(run, FOUND)


def later_occurrences(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name and falling doc -> those that go, and as ``edge`` those that only the neighbouring ranges can settle.

    The range's first hash may have begun before it, so all its rows are edges.  Its last hash may go on behind it:
    its undecided rows are edges, and of its first documents one row each marks (position -1) that they were here.
    """
    first, tail = None, None

    def rows(cols: list[np.ndarray], edge: bool, mark: np.ndarray | None = None):
        pos = cols[3] if mark is None else np.where(mark, np.int32(MARK), cols[3])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (cols[0], cols[1], cols[2], pos, cols[4])), pa.array(np.full(len(pos), edge))], schema=LINES.append(pa.field("edge", pa.bool_())))

    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(5)]
        if not len(cols[0]):
            continue
        if first is None:
            first = cols[0][0]
        begun = int(np.searchsorted(cols[0], first, "right"))
        if begun:
            yield rows([c[:begun] for c in cols], True)
            cols = [c[begun:] for c in cols]
        done = np.zeros(len(cols[0]), bool)
        if tail:
            cols, done = [np.concatenate(x) for x in zip(tail[0], cols)], np.append(tail[1], done)
        if not len(done):
            continue
        name, doc = cols[0], cols[1]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        new_doc = new.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        nth = np.cumsum(new_doc)
        nth = nth - nth[at][group]  # 0 for the document that keeps its lines
        shared = (np.maximum.reduceat(nth, at) + 1 >= most)[group]
        gone = shared & (nth > 0) & ~done
        if gone.any():
            yield rows([c[gone] for c in cols], False)
        last = group == group[-1]
        if shared[-1]:
            last &= new_doc & (nth < most)
        tail = ([c[last] for c in cols], np.full(int(last.sum()), bool(shared[-1])))
    if tail:
        yield rows(tail[0], True, tail[1])


def keep_bitmaps(docs: DataFrame, shortest: int = 20, most: int = 3) -> DataFrame:
    """(doc_id, text) -> doc (null as the largest id), version (hash of the text), n_lines, n_dropped, keep_bitmap (zlib, first line in the top bit).

    One row for each document that loses lines: those whose keys have at least ``shortest`` code points and are found
    in ``most`` or more documents, but in the largest id.
    """
    lines = B.stored(line_rows(docs, shortest), "lines")
    order = ["name", F.desc("doc"), "version", "pos"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = B.stored(dealt.mapInArrow(lambda batches: later_occurrences(batches, most), f"{FOUND}, edge boolean"), "later-lines")
    edge = found.filter("edge")
    parts = edge.select("name", "doc").distinct().groupBy("name").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper")).filter(F.col("docs") >= most)
    settled = edge.filter(F.col("pos") != MARK).join(F.broadcast(parts), "name").filter("doc <> keeper")  # at most two hashes a range
    gone = found.filter("not edge").select("doc", "version", "pos", "n_lines").unionByName(settled.select("doc", "version", "pos", "n_lines"))
    sets = gone.groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, sizes = [], []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3)):
                keep = np.ones(n, np.uint8)
                keep[np.asarray(gone.values)] = 0
                sizes.append(n - int(keep.sum()))
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "version", "n_lines", "n_dropped", "keep_bitmap"])

    return sets.select("doc", "version", "n_lines", "gone").mapInArrow(pack, "doc long, version long, n_lines long, n_dropped long, keep_bitmap binary")


def shared_lines(docs: DataFrame, shortest: int = 20, most: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_lines, n_dropped, keep_bitmap (null where all lines stay), kept_text, kept_sha256, rest.

    ``rest`` is a struct of the input's other columns.
    """
    other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*other) if other else F.struct(F.lit(None).cast("string").alias("none"))
    maps = keep_bitmaps(docs.select("doc_id", "text"), shortest, most).select("doc", "version", "keep_bitmap")
    both = docs.select("doc_id", "text", rest.alias("rest"), *_who(docs)).join(maps, ["doc", "version"], "left").select("doc_id", "text", "rest", "keep_bitmap")
    kind = both.schema["rest"].dataType
    plain = [("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("keep_bitmap", T.BinaryType()), ("kept_text", T.StringType()), ("kept_sha256", T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                counts, dropped, kept, sha = [], [], [], []
                for text, packed in zip(texts.to_pylist(), part.column(3).to_pylist()):
                    n = text.count(b"\n") + 1
                    gone = 0
                    if packed is not None:
                        keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).tolist()
                        text = b"\n".join([line for line, stay in zip(text.split(b"\n"), keep) if stay])
                        gone = keep.count(0)
                    counts.append(n)
                    dropped.append(gone)
                    kept.append(text.decode())
                    sha.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), part.column(3).cast(pa.binary()), pa.array(kept, pa.string()), pa.array(sha, pa.string()), part.column(2)], names=[*(c for c, _ in plain), "rest"])

    return both.mapInArrow(cut, T.StructType([*(T.StructField(c, t) for c, t in plain), T.StructField("rest", kind)]))


def without_shared_lines(docs: DataFrame, shortest: int = 20, most: int = 3) -> DataFrame:
    """The documents, all columns, with their kept text (and its length in ``n_chars``, where there is one)."""
    found = shared_lines(docs, shortest, most)
    value = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[value.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])
