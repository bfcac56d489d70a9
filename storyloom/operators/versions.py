"""Tables of worlds in versions: replaced world by world, switched at once, read without a lock.

    path/data/version=<id>/world_id=<w>/...   rows, written once and never changed
    path/manifest/n=<k>/...                   the k-th list of (world_id, version): which version of each world holds

A replacement writes its rows under a new version, then the next list beside the ones before; one
rename makes it the newest.  A reader takes the newest list when it begins and so sees
all worlds before a replacement or after it, never between; a writer that another overtook is
refused.  A world that is replaced by no rows has none: worlds are named apart from the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "world_id long, version string"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest list; 0 if there is none."""
    fs, place = _files(spark, path)
    folder = place(f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max([int(n[2:]) for n in names if n.startswith("n=")], default=0)


def entries(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(world_id, version) of a list, the newest if none is named."""
    n = newest(spark, path) if n is None else n
    return spark.read.schema(ENTRY).parquet(f"{path}/manifest/n={n}") if n else spark.createDataFrame([], ENTRY)


def replace(rows: DataFrame, worlds: DataFrame, path: str) -> int:
    """Puts the rows in place of all rows of the named worlds (world_id); the number of the new list."""
    spark = rows.sparkSession
    before = newest(spark, path)
    version = uuid.uuid4().hex
    own = worlds.select(F.col("world_id").cast("long").alias("world_id")).distinct()
    kept = rows.withColumn("world_id", F.col("world_id").cast("long"))
    kept.join(own, "world_id", "left_semi").repartition("world_id").write.partitionBy("world_id").parquet(f"{path}/data/version={version}")
    after = entries(spark, path, before).join(own, "world_id", "left_anti").unionByName(own.withColumn("version", F.lit(version)))
    draft, final = f"{path}/drafts/{version}", f"{path}/manifest/n={before + 1}"
    after.coalesce(1).write.parquet(draft)
    fs, place = _files(spark, path)
    fs.mkdirs(place(f"{path}/manifest"))
    if fs.exists(place(final)) or not fs.rename(place(draft), place(final)):
        raise RuntimeError("another replacement came first")
    return before + 1


def read(spark: SparkSession, path: str, schema: str, n: int | None = None) -> DataFrame:
    """The rows of all worlds as a list has them, the newest if none is named; ``schema`` is that of the rows."""
    held = entries(spark, path, n)
    fs, place = _files(spark, path)
    if not fs.exists(place(f"{path}/data")):
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([], schema)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "world_id"]
    found = spark.read.schema(", ".join([*columns, "version string", "world_id long"])).parquet(f"{path}/data")
    return found.join(F.broadcast(held) if held.count() < 100_000 else held, ["world_id", "version"], "left_semi").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])


def clean(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the rows of versions that none of the newest ``keep`` lists names, and older lists; their names. Readers of these must be done."""
    last = newest(spark, path)
    named = {r.version for n in range(max(1, last - keep + 1), last + 1) for r in entries(spark, path, n).select("version").distinct().collect()}
    fs, place = _files(spark, path)
    gone = [s.getPath().getName() for s in fs.listStatus(place(f"{path}/data")) if s.getPath().getName().removeprefix("version=") not in named]
    for name in gone:
        fs.delete(place(f"{path}/data/{name}"), True)
    for n in range(1, last - keep + 1):
        fs.delete(place(f"{path}/manifest/n={n}"), True)
    return gone
