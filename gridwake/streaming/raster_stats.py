"""Raster statistics that grow as tiles arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.operators.raster import HISTOGRAM
from gridwake.operators.tiles import partial_statistics


def running_statistics(tiles: DataFrame, nodata: int | None) -> DataFrame:
    """One state row for each category: counts, range, sums of values and squares, and histogram bins. There is no event time."""
    sums = ["valid", "zeros", "nonzeros", "total", "squares", *[f"bin{i}" for i in range(len(HISTOGRAM))]]
    return partial_statistics(tiles, nodata).groupBy("category").agg(*[F.sum(c).alias(c) for c in sums], F.min("min").alias("min"), F.max("max").alias("max"))


def with_moments(state: DataFrame) -> DataFrame:
    mean = F.col("total") / F.col("valid")
    return state.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("valid") - mean * mean)))


def run(spark: SparkSession, tile_folder: str, checkpoint: str, out: str, nodata: int | None, files_at_once: int = 64) -> DataFrame:
    """Take in the tiles that have arrived since the last run with this checkpoint, in batches, and return the statistics of all so far.

    Each batch writes the categories that it changed; the newest row of each is returned. A batch that is done anew after a failure overwrites what it had written.
    """
    schema = spark.read.parquet(tile_folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(tile_folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    running_statistics(stream, nodata).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    changed = spark.read.parquet(out)
    columns = [c for c in changed.columns if c not in ("category", "batch")]
    newest = changed.groupBy("category").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("category", "s.*")
    return with_moments(newest)
