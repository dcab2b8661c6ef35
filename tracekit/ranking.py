"""Written scratch tables and global row positions, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import scratch_path

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in 33 bits


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the cluster's shared checkpoint
    folder and read it back: lineage ends there, every reader sees the same
    rows, and Spark knows the table's real size when it picks a join."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the global ``order``.

    A range-partitioned sort gives each row its partition and its place in
    it; the rows of every partition are counted and the counts of earlier
    partitions are added (one row per partition, never the data). ``order``
    should end in something unique where one value may be frequent, so that
    a frequent value is split over partitions. Runs jobs.
    """
    at, part, offset = f"__{name}_at", f"__{name}_part", f"__{name}_offset"
    placed = written(df.sort(*order).withColumn(at, F.monotonically_increasing_id())
                     .withColumn(part, F.shiftright(at, ROW_BITS).cast("int")), "ranked")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    place = F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (placed.join(F.broadcast(offsets), part)  # one row per partition of the sort
            .withColumn(name, F.col(offset) + place).drop(at, part, offset))
