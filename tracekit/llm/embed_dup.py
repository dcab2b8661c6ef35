"""Embedding near-duplicates by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, and the two make a
product grid: a vector lives in the cell of its two nearest centroids. It
also visits the cells that are next nearest, in the order of the two
distances' sum (the multi-sequence order), as many as calibration says the
target recall needs, and is compared with those who live there.

Codebooks and calibration use a bounded sample; every vector is indexed. The
members of a cell, residents and visitors, are dealt into blocks, and every
two blocks of a cell are a task of bounded size, so a frequent vector or
label is split. A task yields no pairs: for each member that it linked, how
many links it counted, and one link that spans the linked part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import components, local_components, partitions, whole_groups, written

THRESHOLD = 0.93
TARGET_RECALL = 0.99
SAMPLE = 20_000  # vectors that codebooks are fitted on at most
TRIALS = 2_000  # vectors that the number of visits is calibrated with
PER_CELL = 32  # vectors aimed at per cell and label
MOST_CENTROIDS = 256
BLOCK = 512
SEED = 13


def _usable(vector: list | None) -> np.ndarray | None:
    """The unit vector in double precision; None for null, empty and zero
    vectors and such with null or non-finite components."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0 or np.isnan(x).any():
        return None
    x = x / top
    return x / math.sqrt(float((x * x).sum()))


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; a centroid without points starts again at one."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], x[rng.choice(len(x), k)])
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


@dataclass
class Index:
    """Codebooks of both halves for vectors of one length."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first.

        Of the cells that are a-th in the first half and b-th in the second,
        (a+1)(b+1) are as near, so only those with a product up to n count.
        """
        k, half = len(self.first), self.first.shape[1]
        n = min(n, k * k)
        d1, d2 = _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)
        o1, o2 = np.argsort(d1, 1, "stable"), np.argsort(d2, 1, "stable")
        a, b = np.array([(a, b) for a in range(k) for b in range(k) if (a + 1) * (b + 1) <= n]).T
        both = np.take_along_axis(d1, o1[:, a], 1) + np.take_along_axis(d2, o2[:, b], 1)
        best = np.argsort(both, 1, "stable")[:, :n]
        return np.take_along_axis(o1[:, a] * k + o2[:, b], best, 1)


def fit(sample: np.ndarray, n: int, groups: int, threshold: float, target: float, seed: int = SEED) -> Index:
    """Codebooks from unit vectors, for ``n`` vectors in ``groups`` labels.

    The number of visits is the least that finds the target share of trials,
    where a trial is a sampled vector and one in a random direction from it
    just at the threshold, found if either visits the other's cell.
    """
    rng = np.random.default_rng(seed)
    k = int(min(MOST_CENTROIDS, max(2, math.sqrt(n / (PER_CELL * max(1, groups))))))
    half = sample.shape[1] // 2
    index = Index(_centroids(sample[:, :half], k, rng), _centroids(sample[:, half:], k, rng), 0)
    x = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.maximum(1e-12, np.linalg.norm(away, axis=1))[:, None]
    y = threshold * x + math.sqrt(1 - threshold * threshold) * away
    cells_x, cells_y = index.nearest(x, k * k), index.nearest(y, k * k)
    rank = np.minimum((cells_x == cells_y[:, :1]).argmax(1), (cells_y == cells_x[:, :1]).argmax(1))
    index.visits = int(np.quantile(rank, target, method="higher"))
    return index


def _indexed(vectors: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """Each usable vector with its own cell and those that it visits."""
    sent = vectors.sparkSession.sparkContext.broadcast(indexes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(x, np.float64) for x in batch.column(2).to_pylist()]
            cells: list[list[int]] = [[0]] * len(units)
            for dim in {len(u) for u in units}:
                index, at = sent.value.get(dim), [i for i, u in enumerate(units) if len(u) == dim]
                for start in range(0, len(at) if index else 0, 1024):
                    own = at[start:start + 1024]
                    for i, found in zip(own, index.nearest(np.stack([units[i] for i in own]), 1 + index.visits).tolist()):
                        cells[i] = found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(u) for u in units], pa.int32()), pa.array([c[0] for c in cells], pa.int32()),
                 pa.array([c[1:] for c in cells], pa.list_(pa.int32()))], names=["row", "label", "unit", "dim", "own", "visits"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(rows, f"row long, label {label}, unit binary, dim int, own int, visits array<int>")


def _members(indexed: DataFrame) -> DataFrame:
    """A row per task and member: task, grp (the cell of a label), blk, same
    (the task is of one block), row, unit, own, cell, visits."""
    here = indexed.select("*", F.explode(F.concat(F.array("own"), F.col("visits"))).alias("cell"))
    count = written(here.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"), F.count(F.when(F.col("own") == F.col("cell"), 1)).alias("residents"))
                    .where("m > 1 and residents > 0").withColumn("grp", F.monotonically_increasing_id()), "embed-cells")
    placed = here.join(count, ["label", "dim", "cell"])
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = placed.select("grp", "row", "unit", "own", "cell", "visits", n_blocks.alias("b"),
                           F.pmod(F.xxhash64("row"), n_blocks).cast("int").alias("blk"))
    other = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("o"))
    return other.select(F.xxhash64("grp", F.least("blk", "o"), F.greatest("blk", "o")).alias("task"),
                        "grp", "blk", (F.col("blk") == F.col("o")).alias("same"), "row", "unit", "own", "cell", "visits")


def _links_in(table: pa.Table, threshold: float) -> list[tuple[int, int, int]]:
    """(row, links, spanning row) of a task's linked members."""
    grp, blk, row, own, cell = (table.column(c).to_numpy() for c in ("grp", "blk", "row", "own", "cell"))
    unit = np.stack([np.frombuffer(x, np.float64) for x in table.column("unit").to_pylist()])
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
    near = np.flatnonzero(np.abs((unit[a] * unit[b]).sum(1) - threshold) <= 2e-9) if len(a) else []
    sure = np.ones(len(a), bool)
    sure[near] = [math.fsum((unit[i] * unit[j]).tolist()) >= threshold for i, j in zip(a[near], b[near])]
    # members of one block meet in their own task; two visitors elsewhere
    alone, resident = table.column("same").to_numpy(), own == cell
    sure &= (grp[a] == grp[b]) & (resident[a] | resident[b]) & ((blk[a] != blk[b]) | alone[a])
    a, b = a[sure], b[sure]
    if not len(a):
        return []
    # a resident and a visitor who visit each other count in the smaller cell
    width = table.column("visits").combine_chunks()
    longest = max((len(v) for v in width), default=0)
    visits = np.full((len(row), max(1, longest)), -1)
    for i, v in enumerate(width.to_pylist()):
        visits[i, :len(v)] = v
    host, guest = np.where(resident[a], a, b), np.where(resident[a], b, a)
    mutual = (visits[host] == own[guest][:, None]).any(1)
    counted = (resident[a] & resident[b]) | ~mutual | (own[host] < own[guest])
    n = np.bincount(np.r_[a[counted], b[counted]], minlength=len(row))
    label = local_components(len(row), a, b)
    linked = np.unique(np.r_[a, b])
    return list(zip(row[linked].tolist(), n[linked].tolist(), row[label[linked]].tolist()))


def _compare(members: DataFrame, threshold: float) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            task = table.column("task").to_numpy()
            bounds = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            for start, end in zip(bounds[:-1], bounds[1:]):
                own = table.slice(start, end - start)
                if out := _links_in(own, threshold) if end - start > 1 else []:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "n", "root"])

    dealt = members.repartition(partitions(members.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(rows, "row long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, sample: int = SAMPLE,
                 seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id,
    embedding, label).

    Two rows are linked if their labels are equal and not null and the cosine
    of their vectors, in double precision, is at least ``threshold``; vectors
    of different lengths aren't compared, and null, empty, zero or non-finite
    ones link with nothing. Links are found with about ``target_recall`` at
    the threshold, more above; none below it is reported. n_links counts the
    other rows linked directly, component_id is the smallest vec_id that
    links reach, kept whether it is the row's own. Null ids take part but are
    nobody's smallest one; a row that reaches no other id has a null
    component_id and isn't kept. Repeated rows are rows of their own; empty
    tables and other columns do no harm.

    Codebooks are fitted on at most about ``sample`` vectors of a length,
    chosen by a hash; lengths that the sample lacks have one cell. Runs jobs.
    """
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_usable(v) for v in batch.column(3).to_pylist()]
            blobs = [None if u is None else u.tobytes() for u in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["row", "vec_id", "label", "unit"])

    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    rows = written(rows.mapInArrow(units, f"row long, vec_id long, label {label}, unit binary"), "embed-units")
    usable = rows.where("unit is not null and label is not null").select("row", "label", "unit")

    total, groups = usable.agg(F.count("*"), F.approx_count_distinct("label")).first()
    unit_interval = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = usable.where(unit_interval < min(1.0, sample / max(1, total))).orderBy("row").select("unit").toPandas()["unit"]
    by_length: dict[int, list[np.ndarray]] = {}
    for x in picked:
        by_length.setdefault(len(x) // 8, []).append(np.frombuffer(x, np.float64))
    indexes = {dim: fit(np.stack(xs), total, groups, threshold, target_recall, seed) for dim, xs in by_length.items() if dim > 1}

    members = _members(written(_indexed(usable, indexes), "embed-index"))
    found = written(_compare(members, threshold), "embed-links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")), "embed-components")
    smallest = (roots.join(rows.select(F.col("row").alias("id"), "vec_id"), "id").groupBy("root").agg(F.min("vec_id").alias("smallest")))
    linked = roots.join(smallest, "root").select(F.col("id").alias("row"), "smallest", F.lit(True).alias("linked"))
    out = rows.select("row", "vec_id").join(counts, "row", "left").join(linked, "row", "left")
    component = F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by the contract: cosine 0.93 within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
