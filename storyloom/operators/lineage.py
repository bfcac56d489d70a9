"""Iterations over links: components and chains, each round cut off in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; on this machine only where none is named and all runs here."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, grows: bool = False) -> DataFrame:
    """The rows, written once in the shared folder and read again: what follows doesn't compute them anew, also when executors are lost.

    Files are far smaller than their rows where these repeat, so Spark would broadcast tables that the driver can't
    hold.  One that ``grows`` with the input is joined by merging.
    """
    spark = df.sparkSession
    path = folder(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if grows else out


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any ordered type -> (node, component), the smallest node reachable.

    Each round a node and its parent take the smallest label beside the node, then labels are followed once more, so
    rounds grow with the logarithm of a component; they go on until nothing moves.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), grows=True)
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), grows=True)
    while True:
        beside = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(beside, "node").withColumn("low", F.least("label", "low"))
        hooked = step.select("node", "low").unionByName(step.select(F.col("label").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = cut(labels.join(hooked, "node").join(jump, "low").select("node", F.col("label").alias("was"), F.least("low", "far").alias("label")), grows=True)
        labels = new.select("node", "label")
        if new.filter("label < was").isEmpty():
            return labels.withColumnRenamed("label", "component")


def chains(steps: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Steps (keys, old, new), one for each old -> each old with the end of its chain. Every round doubles the way that is followed."""
    out, way, rounds = cut(steps.select(*keys, old, new)), 1, steps.count()
    while True:
        further = out.select(*keys, F.col(old).alias(new), F.col(new).alias("__further"))
        both = cut(out.join(further, [*keys, new], "left"))
        if both.filter("__further is not null").isEmpty():
            return out
        if way > rounds:
            raise ValueError("the steps run in a circle")
        out, way = both.select(*keys, old, F.coalesce("__further", new).alias(new)), 2 * way
