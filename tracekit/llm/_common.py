"""Helpers shared by the corpus operators: connected components, groups of
sorted tasks, literal tables; written tables and ranks are the library's."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.ranking import ranked, written

__all__ = ["ascii_lower", "components", "literal_rows", "local_components", "partitions", "ranked", "small_table", "union_all",
           "whole_groups", "written"]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals (rule lists and the like), as SQL literals."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1] for part in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds)]) for row in rows]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*structs)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (id, root)
    per id that occurs, root being the smallest id of its component.

    Alternates the large-star and small-star steps; both only link a node's
    neighbours to the smallest of them, so a table never holds more rows than
    there are links. A node with very many neighbours is no hot group: its
    smallest neighbour is a partial aggregate and the join back on it is an
    ordinary join that Spark may split. Tables are written each round, and
    the loop ends when all links are stars: no node has two links to smaller
    ones, or a link to a smaller and one to a larger one.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written(pair, name)
    while True:
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                              F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        # large star: each larger neighbour goes to the smallest of the node and its neighbours
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the node and its smaller neighbours go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        links = written(small.where("u <> v").distinct(), name)
    # now every link ends in its component's smallest id
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a task that is sorted by the long column ``key``, in
    tables that hold each key's rows together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 of one task, the smallest node reachable over the
    links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def small_table(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has
    at most ``max_rows`` rows; beyond, Spark's shuffle joins take it."""
    return F.broadcast(df) if df.count() <= max_rows else df
