"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a hash and from it a score, ``-weight / ln(u)``
with u in (0, 1); a record goes to the shard with the best score. The scores
of the other shards don't change when a shard is added, so a new shard takes
records only into itself, its share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import ranked, written

SEED = 20_240_607


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, shard.cast("int"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -weight / F.ln(unit)


def rendezvous(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """The shard (0-based int) of ``key`` over ``weights``; a weight of zero
    or less takes nothing. Equal scores go to the smaller shard."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    live = F.array(*[F.lit(i) for i, w in enumerate(weights) if w > 0])
    scored = F.transform(live, lambda s: F.struct(_score(key, s, F.get(table, s), seed).alias("score"), (-s).alias("s")))
    return (-F.array_max(scored)["s"]).cast("int")


def assign_shards(docs: DataFrame, n_shards: int = 24, weights: list[float] | None = None,
                  added_weight: float = 1.0, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row each.

    The key is doc_id; rows without one are keyed by their text's CRC-32, so
    that they spread. size is the text's UTF-8 bytes plus 8; a null text has
    none and the CRC-32 of the empty text. slot numbers a shard's rows from 0
    without gaps, in the order of a hash of the key. Repeated rows stay and
    get slots of their own; other columns are not used. grown_shard is the
    shard after one more of ``added_weight``.

    Only narrow rows are sorted, never the text: a global rank less the rank
    of the shard's first row, so neither a shard nor a frequent key has to fit
    one task. Runs jobs.
    """
    weights = weights or [1.0] * n_shards
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text_crc32").cast("string")))
    rows = (docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                        crc.alias("text_crc32"))
            .withColumn("key", F.xxhash64(key)))
    shard = F.col("shard")
    new = F.lit(len(weights))
    own = _score(F.col("key"), shard, F.get(F.array(*[F.lit(float(w)) for w in weights]), shard), seed)
    grown = F.when(_score(F.col("key"), new, F.lit(float(added_weight)), seed) > own, new).otherwise(shard)
    rows = written(rows.withColumn("shard", rendezvous(F.col("key"), weights, seed))
                   .withColumn("grown_shard", grown.cast("int"))
                   .withColumn("row", F.monotonically_increasing_id()), "shards")

    placed = ranked(rows, ["shard", "key", "doc_id", "text_crc32", "row"], "place")
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}  # one row per shard
    first, firsts = 0, []
    for s in range(len(weights)):
        firsts.append(F.lit(first).cast("long"))
        first += counts.get(s, 0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("place") - F.get(F.array(*firsts), shard)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, weights: list[float] | None = None,
                 seed: int = SEED, files_per_shard: int = 1) -> None:
    """Write the records themselves, one folder ``shard=N`` per shard;
    ``files_per_shard`` writers share each, so a shard need not fit a task."""
    weights = weights or [1.0] * n_shards
    text_key = F.concat(F.lit("text:"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("string"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text_key))
    placed = docs.drop("shard").withColumn("shard", rendezvous(key, weights, seed))
    part = F.pmod(F.xxhash64(*[c for c in docs.columns if c != "shard"]), F.lit(files_per_shard))
    placed.repartition(len(weights) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards, and over 25."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
