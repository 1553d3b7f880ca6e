"""What the operators of this subpackage share: scratch tables, row numbers, connected components and a worker's tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_HELD: dict[Hashable, Any] = {}
_IN_PART = 33  # monotonically_increasing_id keeps the partition above this bit


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset (local tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[app]


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gave, kept by this worker between tasks until it makes something under another name.

    Workers are used again by later stages: each is to hold the tables of the operator it runs, not of all that it ever ran.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[name] = make()
    return _HELD[name]


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep for this process."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc lack it
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that its lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, value: Column) -> tuple[DataFrame, object]:
    """materialize(df) and the value of an aggregate over its rows, which the same job computes; the aggregate must not mind rows met twice."""
    seen = Observation()
    table = materialize(df.observe(seen, value.alias("value")))
    return table, seen.get.get("value")  # None where a table without rows was planned away


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Add the gapless row number from 0 in the given order, without a one-task window.

    The rows are range-partitioned and sorted; what meets in one task is one count per partition.
    df should be narrow: it is shuffled once and written once. Rows that tie on the whole order are numbered arbitrarily.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _IN_PART)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    in_part = F.col("_at").bitwiseAND(F.lit((1 << _IN_PART) - 1))
    # One row for each shuffle partition: its size is bounded by that setting, not by the data.
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + in_part).drop("_part", "_before", "_at")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected graph as (node, root), root being the smallest node; nodes without edges don't appear.

    Smallest-neighbour hooking with pointer jumping: each round joins labels to the edges, lowers them and then
    replaces each label by its label's label, so that chains shorten geometrically; no label lowered means that labels agree along every
    edge. Every round is written to the shared folder. Only whether a label was lowered comes to the driver.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    both = F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))).alias("edge")
    e = materialize(edges.where(a != b).select(both).select("edge.u", "edge.v").distinct())
    labels = materialize(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = e.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("low"))
        lowered = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        lowered, changed = measured(lowered, F.max(F.col("root") < F.col("old")))
        if not changed:
            return labels
        jumped = lowered.join(lowered.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left")
        labels = materialize(jumped.select("node", F.least("root", F.coalesce("r2", "root")).alias("root")))
