"""Shared machinery of the corpus operators: word arrays, and the block exchange.

Documents are cut into *blocks* of a bounded number of bytes as their partitions are read,
and packed (compressed) for the exchange.  What a block knows (names of symbols, n-grams) leaves it once per distinct name, goes to the
*bucket* that owns this range of hashes, and the bucket sends back to every block only
what that block asked for.  So no name, however frequent, has more rows than there are
blocks, no table of names is ever broadcast, and the texts are exchanged once: every
later pass reuses the same exchange.  A bucket answers for many blocks (``BUCKET_BYTES`` of
text against ``BLOCK_BYTES``) and works through its range in parts, so the number of buckets
grows slower than that of the blocks; both grow with the bytes, and so do rows of an exchange with
the square of the bytes, until a row holds one name: there are never more rows than names.  All steps
are Spark exchanges and can be recomputed when an executor is lost; for that the rows of the
documents must come in the same order again, as they do from files.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 128_000_000
MIN_BLOCKS, MIN_BUCKETS = 24, 32
SLICE_BYTES = 1_000_000
PACK_LEVEL = 9  # of zstd
NO_ID = np.iinfo(np.int64).max

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
PLACES = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def pair_name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(a + _U(salt * 2 + 1)) * _U(0xD6E8FEB86659FD93) + b)


def _at_place(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for every byte and place within its word."""
    return mix(mix(place.astype(_U) + _U(0x632BE59BD9B4E019)) + byte.astype(_U) * _U(0x9E3779B97F4A7C15))


_TABLE = _at_place(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256))


class Words:
    """Words of several texts as arrays: hash, start and end byte, first word of each text."""

    def __init__(self, texts: pa.Array, stop: np.ndarray = SPACE, lower: bool = False):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        base = int(bounds[0])
        data = texts.buffers()[2]
        size = int(bounds[-1]) - base
        raw = np.frombuffer(data, np.uint8, size, base) if size else np.zeros(0, np.uint8)
        self.raw, self.bounds = raw, bounds - base
        if lower:
            raw = LOWER[raw]
        self.bytes = raw
        gap = np.ones(size + 1, bool)
        gap[1:] = stop[raw]
        ends_of_texts = np.zeros(size + 1, bool)
        ends_of_texts[self.bounds] = True
        inside = ~gap[1:]
        begins = inside & (gap[:-1] | ends_of_texts[:-1]) if size else inside
        after = np.ones(size, bool)
        after[:-1] = gap[2:] if size else False
        finish = inside & (after | ends_of_texts[1:]) if size else inside
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        if len(self.start):
            # The sum of a random number for each byte at its place: unlike a polynomial, no pattern of letters makes two words meet.
            size_of = self.end - self.start
            within = np.flatnonzero(inside)
            place = np.arange(len(within)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
            byte = raw[within]
            if int(size_of.max()) <= PLACES:
                value = _TABLE[place * 256 + byte]
            else:
                value = _TABLE[np.minimum(place, PLACES - 1) * 256 + byte]
                far = place >= PLACES
                value[far] = _at_place(byte[far], place[far])
            self.hash = mix(np.add.reduceat(value, np.cumsum(size_of) - size_of) + size_of.astype(_U))
        else:
            self.hash = np.zeros(0, _U)


def slices(table: pa.Table, column: str = "text", most: int = SLICE_BYTES):
    """Row ranges of bounded bytes (a single longer text is a range of its own); nulls as empty texts."""
    for batch in table.to_batches():
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def ids(batch, column: str = "doc_id") -> np.ndarray:
    """Ids as int64; null counts as larger than any."""
    return np.asarray(batch.column(batch.schema.get_field_index(column)).fill_null(int(NO_ID)).cast(pa.int64()))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def block_bytes(total: int) -> int:
    """Bytes of a block; small inputs still make some blocks."""
    return max(1, min(BLOCK_BYTES, total // MIN_BLOCKS))


def bucket_count(total: int) -> int:
    return max(MIN_BUCKETS, -(-total // BUCKET_BYTES))


def blocked(docs: DataFrame, most: int, *columns) -> DataFrame:
    """(doc_id, text, columns) -> block, packed: the rows in slices, some of which make a block of about ``most`` bytes.

    A plan that uses this more than once exchanges the texts once.
    """

    def pack(batches):
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for part, texts in slices(pa.Table.from_batches([batch]), most=min(SLICE_BYTES, most)):
                size = sum(b.size for b in texts.buffers() if b) if len(texts) == 1 else int(pc.sum(pc.binary_length(texts)).as_py() or 0)
                if held and held + size > most:
                    block, held = block + 1, 0
                held += size
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK_LEVEL))) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])

    return docs.select("doc_id", "text", *columns).mapInArrow(pack, "block long, packed binary").repartition("block")


def unpacked(table: pa.Table):
    """The slices of a block: rows and their texts."""
    for x in table.column("packed"):
        yield from slices(pa.ipc.open_stream(x.as_py()).read_all(), most=2**62)


ASK = "bucket int, block long, kind int, names binary, vals binary"
TELL = "block long, kind int, names binary, vals binary"
ASK_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("names", pa.binary()), ("vals", pa.binary())])
TELL_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("names", pa.binary()), ("vals", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high bytes are mostly alike, which an exchange compresses away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not b:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_names(names: np.ndarray) -> bytes:
    """Sorted names as steps from one to the next."""
    return planes(np.diff(names, prepend=_U(0)))


def unpack_names(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, _U), dtype=_U)


def asked(block: int, kind: int, names: np.ndarray, vals: np.ndarray, buckets: int) -> list[tuple]:
    """Rows for the buckets; names: sorted distinct uint64, vals: one row of numbers each. A bucket owns a range of names."""
    width = -(-(2**64) // buckets)
    cuts = np.searchsorted(names, np.array([k * width for k in range(1, buckets)], _U))
    at = [0, *cuts.tolist(), len(names)]
    return [(k, block, kind, pack_names(names[i:j]), planes(np.ascontiguousarray(vals[i:j]))) for k, (i, j) in enumerate(zip(at, at[1:])) if j > i]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def rows_of(table: pa.Table, kind: int, dtype) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of each row of a kind the names, the value rows and the block."""
    found = []
    for b, k, n, v in zip(*(table.column(c) for c in ("block", "kind", "names", "vals"))):
        if k.as_py() == kind:
            names = unpack_names(n.as_py())
            vals = unplanes(v.as_py(), dtype)
            found.append((names, vals.reshape(len(names), len(vals) // len(names)), b.as_py()))
    return found


def parts_of(table: pa.Table, kind: int, dtype=np.int64, most: int = 2_000_000):
    """A bucket's names by rising ranges of at most some ``most`` names: (names, value rows, blocks) of each range, block after block."""
    rows = rows_of(table, kind, dtype)
    total = sum(len(n) for n, _, _ in rows)
    if not total:
        return
    parts = -(-total // most)
    least, last = min(int(n[0]) for n, _, _ in rows), max(int(n[-1]) for n, _, _ in rows)
    step = -(-(last - least + 1) // parts)
    at = [0] * len(rows)
    for p in range(parts):
        end = min(least + (p + 1) * step, 2**64 - 1)
        to = [len(n) if p == parts - 1 else int(np.searchsorted(n, _U(end))) for n, _, _ in rows]
        cut = [(n[a:b], v[a:b], k) for (n, v, k), a, b in zip(rows, at, to) if b > a]
        at = to
        if cut:
            yield np.concatenate([n for n, _, _ in cut]), np.concatenate([v for _, v, _ in cut]), np.repeat(np.array([k for _, _, k in cut], np.int64), [len(n) for n, _, _ in cut])


def told(kind: int, names: np.ndarray, vals: np.ndarray, blocks: np.ndarray) -> list[tuple]:
    """Rows for the blocks; within a block the names are in order, as ``parts_of`` gives them."""
    cut = np.flatnonzero(np.diff(blocks)) + 1
    at = [0, *cut.tolist(), len(blocks)]
    return [(int(blocks[i]), kind, pack_names(names[i:j]), planes(np.ascontiguousarray(vals[i:j]))) for i, j in zip(at, at[1:]) if j > i]


def learned(table: pa.Table, kind: int, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """What the buckets told a block under a kind, by name."""
    rows = sorted(rows_of(table, kind, dtype), key=lambda r: int(r[0][0]))
    if not rows:
        return np.zeros(0, _U), np.zeros((0, 1), dtype)
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


def grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by name, the group of each in that order, and where each group begins."""
    order = np.argsort(names)
    new = np.ones(len(names), bool)
    ranked = names[order]
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def look_up(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted name in the sorted names, or -1."""
    if not len(names):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, at, -1)


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
