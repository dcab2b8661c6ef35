"""Centroid clustering of integer vectors behind n-simplex bounds.

The distances of a vector to a few pivots, worked out once and kept, make it
the apex of a simplex whose base is the pivots: coordinates along the base and
an altitude above it. Between two apexes the Euclidean distance is a lower
bound of that of the vectors, and the distance with one altitude turned to
the other side an upper bound. In each round a centroid that is by its lower
bound farther than another is by its upper one is out; the rest are compared
in exact integers, so the bounds only save work.

Rounds are Spark jobs: tasks send one row of exact sums for each cluster and
dimension, and the driver gets as many numbers as the centroids have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import literal_rows, written

SCALE = 1024
LIMIT = 1 << 27  # components from here on have distances beyond 64 bits
PIVOTS = 12
FLAT = 0.05  # a pivot adds a base coordinate if it stands out by this share of the largest one
ROWS = 4096  # vectors compared at a time


class Simplex:
    """The base that pivots span, from their distances alone."""

    def __init__(self, pivots: np.ndarray):
        """Pivots that hardly stand out of the span of those before are left
        out: they'd add nothing but rounding."""
        chosen, base = [0], np.zeros((0, 0))
        squared = ((pivots[:, None] - pivots[None]) ** 2).sum(2)
        floor = FLAT * float(np.sqrt(squared.max(initial=0)))
        for i in range(1, len(pivots)):
            at, up = self._apexes(base, squared[i:i + 1, chosen])
            if up[0] > max(floor, 0.0):
                grown = np.zeros((len(base) + 1, len(base) + 1))
                grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = base, at[0], up[0]
                base = grown
                chosen.append(i)
        self.base, self.pivots = base, pivots[chosen]
        # rounding in a squared altitude, by the base's condition; its root is that of the altitude
        inverse = np.linalg.inv(base) if len(base) else base
        condition = 1 + float((abs(inverse) @ abs(base)).sum(1).max(initial=0))
        self.slack = 16 * np.sqrt(np.finfo(float).eps * (len(base) + 2)) * condition

    @staticmethod
    def _apexes(base: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the base, and altitudes, by squared distances to its corners."""
        along = np.zeros((len(squared), len(base)))
        for i in range(len(base)):
            right = (squared[:, 0] - squared[:, i + 1] + (base[i] ** 2).sum()) / 2
            along[:, i] = (right - along[:, :i] @ base[i, :i]) / base[i, i]
        return along, np.sqrt(np.maximum(squared[:, 0] - (along ** 2).sum(1), 0))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """A row of coordinates for each vector: along the base, the altitude
        and the distance to the first pivot, by which rounding is bounded."""
        along, up = self._apexes(self.base, distances(vectors, self.pivots).astype(float))
        return np.column_stack([along, up, np.sqrt((along ** 2).sum(1) + up ** 2)])

    def bounds(self, apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower and upper bounds of every vector's distance to each
        of the others, both moved outwards by what rounding may have done."""
        base = ((apexes[:, None, :-2] - others[None, :, :-2]) ** 2).sum(2)
        mine, theirs = apexes[:, None, -2], others[None, :, -2]
        wide = self.slack * (apexes[:, None, -1] + others[None, :, -1]) ** 2
        return base + (mine - theirs) ** 2 - wide, base + (mine + theirs) ** 2 + wide


def distances(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    out = np.empty((len(vectors), len(others)), np.int64)
    for i, other in enumerate(others):
        apart = vectors - other
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(vectors: np.ndarray, apexes: np.ndarray, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (the smaller number of equals), its
    exact squared distance, and how many exact distances that took."""
    low, high = simplex.bounds(apexes, simplex.apexes(centroids))
    open_ = low <= high.min(1)[:, None]
    best, where = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int64)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, number])
        apart = vectors[rows] - centroid
        found = np.einsum("ij,ij->i", apart, apart)
        closer = rows[found < best[rows]]
        best[closer] = found[found < best[rows]]
        where[closer] = number
    return where, best, int(open_.sum())


def integer_vectors(table: DataFrame, vector: str, dims: int, scale: int = SCALE) -> DataFrame:
    """The rows of ``table`` whose ``vector`` has ``dims`` components, none of
    them null, infinite or not a number, with ``ints``: floor(scale * x).
    A component of an absolute value from ``LIMIT`` / scale on, with which
    squared distances would not fit 64 bits, leaves its row out too."""
    def fits(x: Column) -> Column:
        # comparisons with a NaN: it is larger than all numbers in Spark
        return x.isNotNull() & (F.abs(x.cast("double")) < F.lit(LIMIT / scale))

    whole = (F.size(F.col(vector)) == dims) & F.forall(F.col(vector), fits)
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.where(whole).withColumn("ints", ints)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def start_rows(vectors: DataFrame, id_col: str, n: int, salt: str) -> list[list[int]]:
    """The vectors of the ``n`` rows with the smallest lowercase-hex SHA-256
    of ``salt:id``, in that order, then of the vectors; a null id counts as
    an empty one. Fewer where there are fewer rows."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "ints").orderBy("key", "ints").limit(n).collect()
    return [r["ints"] for r in rows]


def cluster(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10,
            salt: str = "3", scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance), final centroids): k centroids start as the
    rows by ``start_rows``; in each of ``rounds`` rounds every vector goes to
    the nearest (ties: the smaller number) and a centroid with vectors becomes
    their componentwise floor(sum / count); then vectors are assigned once more.

    ``integer_vectors`` says which rows count; others are not in the result.
    Repeated rows and null ids each count as a row, a column of any other name
    is ignored, an empty table gives no rows and no centroids, and fewer rows
    than k as many centroids. The vectors are written once with their apex
    coordinates; each round is one pass over that table. Runs jobs.
    """
    spark = table.sparkSession
    ints = integer_vectors(table.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")), "vector", dims, scale).select("id", "ints")
    first = np.array(start_rows(ints, "id", max(k, pivots), salt), np.int64).reshape(-1, dims)
    if not len(first):
        return ints.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).withColumnRenamed("id", id_col), []
    centroids, simplex = first[:k], Simplex(first[:pivots])

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(_matrix(batch.column(1), dims))
            found = pa.FixedSizeListArray.from_arrays(pa.array(apexes.ravel()), apexes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["id", "ints", "apex"])

    id_type = dict(ints.dtypes)["id"]
    kept = written(ints.mapInArrow(cached, f"id {id_type}, ints array<long>, apex array<double>"), "cluster-vectors")

    def assigned(now: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = _matrix(part.column("ints"), dims)
                where, best, _ = nearest(vectors, _matrix(part.column("apex"), simplex.base.shape[0] + 2), simplex, now)
                yield part, vectors, where, best

    def summed(now: np.ndarray):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a task's sums stay below 2**27 * 2**33 rows
            sums, n = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64)
            for _, vectors, where, _ in assigned(now, batches):
                n += np.bincount(where, minlength=len(now))
                for c in np.unique(where):
                    sums[c] += vectors[where == c].sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(now)), dims)), pa.array(np.tile(np.arange(dims), len(now))),
                 pa.array(sums.ravel()), pa.array(np.repeat(n, dims))], names=["cluster", "dim", "total", "n"])
        return rows

    for _ in range(rounds):
        parts = kept.select("ints", "apex").mapInArrow(summed(centroids), "cluster long, dim long, total long, n long")
        totals = parts.groupBy("cluster", "dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]).where("n > 0")
        centroids = centroids.copy()
        for r in totals.collect():  # k * dims rows
            centroids[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, where, best in assigned(centroids, batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(where.astype(np.int32)), pa.array(best)],
                                             names=["id", "cluster", "distance"])

    out = kept.mapInArrow(labelled, f"id {id_type}, cluster int, distance long")
    return out.withColumnRenamed("id", id_col), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows of ``cluster`` with the distances summed by cluster and over
    all, and the digest of the own centroid. Runs a job."""
    rows = written(assigned, "cluster-rows")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(total.alias("s")).collect()}  # k rows
    facts = [(c, int(by_cluster.get(c, 0)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    own = literal_rows(assigned.sparkSession, [(c, s, sum(f[1] for f in facts), h) for c, s, h in facts],
                       "cluster int,cluster_inertia long,inertia long,centroid_sha256 string")
    return rows.join(F.broadcast(own), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by the contract: 64 components, 8 centroids, 10 rounds."""
    return with_inertia(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def oracle_sql(dims: int = 64, k: int = 8, rounds: int = 10, salt: str = "3", scale: int = SCALE) -> str:
    """The same in DuckDB, by plain distances to all centroids."""
    kept = f"""
kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * {scale})::bigint) as v
  from embeddings
  where len(embedding) = {dims}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(x::double) < {LIMIT / scale})) = {dims}),
c0 as materialized (
  select row_number() over (order by sha256('{salt}:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v as m from kept
  qualify c < {k})"""

    def step(i: int) -> str:
        return f"""
a{i} as materialized (
  select vec_id, v, best.c as c, best.d as d from (
    select vec_id, any_value(v) as v, min({{'d': d, 'c': c}}) as best from (
      select vec_id, rid, v, c, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint as d
      from (select *, row_number() over () as rid from kept), c{i})
    group by vec_id, rid))"""

    def move(i: int) -> str:
        return f"""
s{i} as (select c, i, sum(x)::hugeint as t, count(*)::hugeint as n
  from (select c, unnest(v) as x, unnest(range(1, {dims} + 1)) as i from a{i}) group by c, i),
c{i + 1} as materialized (
  select c{i}.c as c, coalesce(moved.m, c{i}.m) as m from c{i} left join (
    select c, list(((t - (((t % n) + n) % n)) // n)::bigint order by i) as m from s{i} group by c) moved on moved.c = c{i}.c)"""

    steps = reduce(lambda out, i: [*out, step(i), move(i)], range(rounds), [kept]) + [step(rounds)]
    return f"""with {",".join(steps)}
select vec_id, a.c::integer as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} a join c{rounds} m on m.c = a.c"""


ORACLE_SQL = oracle_sql()
