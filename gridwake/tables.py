"""Scratch tables and connected components for the spatial operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
BROADCAST_BYTES = 64 << 20
FEW_ROWS = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def materialize(df: DataFrame) -> DataFrame:
    """df as a written table: it is computed once and a lost executor doesn't cost it."""
    path = f"{scratch_dir(df.sparkSession)}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df as a broadcast side if its rows take at most BROADCAST_BYTES, else as it is, for a shuffled join; df should be a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def met(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join of which it is known that it has `rows` rows at most: broadcast if they are few, else shuffled.

    Not left to the planner, which rates written tables by their compressed bytes and exploded rows like those before, and so broadcasts more than a driver holds.
    """
    return F.broadcast(df) if rows <= FEW_ROWS else df.hint("merge")


def connected(pairs: DataFrame) -> DataFrame:
    """(id, root) for the undirected graph of pairs (a, b), root being the smallest id; labels jump along their own labels."""
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    n = both.count()
    label = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id")
    while True:
        label = materialize(label)
        low = both.join(met(label.withColumnsRenamed({"id": "b", "root": "r"}), n), "b").groupBy("a").agg(F.min("r").alias("low"))
        step = materialize(label.join(met(low, n), label["id"] == low["a"]).select("id", F.col("root").alias("old"), F.least("root", "low").alias("root")))
        far = step.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        nxt = materialize(step.join(met(far, n), "root", "left").select("id", "old", F.least("root", F.coalesce("beyond", "root")).alias("root")))
        if nxt.where("root < old").isEmpty():
            return nxt.select("id", "root")
        label = nxt.select("id", "root")
