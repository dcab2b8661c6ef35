"""Session construction and a few session-level helpers.

Nothing here tunes Spark internals; it only sets the public knobs a user of
this toolkit would set for text-heavy jobs, and reads cluster settings
(``spark.checkpoint.dir``) instead of inventing machine-local paths.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tracekit") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    ``master`` and ``shuffle_partitions`` are only applied when given, so a
    cluster submission keeps whatever the cluster manager configured.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session without one (as in tests) gets a folder under the system
    temp folder, which its driver and executor threads share; on a cluster
    that folder would be another one on every machine, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "tracekit-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def filter_here(df: DataFrame, cond: Column) -> DataFrame:
    """Rows where an expensive row-local ``cond`` holds, evaluated at this
    point of the plan.

    Catalyst moves deterministic filters below repartitions, which is right
    for cheap predicates but would run a heavy text predicate inside the
    scan task of a table that ``spread`` re-partitioned. Computing the
    condition as a generated column keeps it where it is written; cheap
    predicates on stored columns are still pushed to the scan.
    """
    flag = "__keep"
    flagged = df.select("*", F.inline(F.array(F.struct(cond.alias(flag)))))
    return flagged.where(F.col(flag)).drop(flag)


SPREAD_KEY = "spark.tracekit.spread"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned on ``key``, if the session asks for it by
    setting ``spark.tracekit.spread`` to a number of partitions.

    For a small table stored as one row group, which arrives as one task and
    would run every regex alone; off by default, as the texts are shuffled.
    Hash partitioning is deterministic, so a lost task recomputes the same
    rows.
    """
    n = int(df.sparkSession.conf.get(SPREAD_KEY, "0"))
    return df.repartition(n, key) if n > 0 else df
