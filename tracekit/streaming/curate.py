"""Incremental curation with Structured Streaming.

Trace files keep arriving while generation runs. Every curation step is
row-local (parse, correctness, truncation, repetition), so the batch plan
runs unchanged on a file stream: each micro-batch parses only new lines.
The running report is a streaming aggregation whose state is four
counters, kept in the checkpoint, so a restarted query continues counting
where it stopped. Checkpoints go under the cluster's shared
``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.repeat import is_repeating
from ..session import checkpoint_root
from ..sources.jsonl import CORRUPT, TRACE_SCHEMA, parse_lines


def trace_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None,
                 schema: T.StructType = TRACE_SCHEMA) -> DataFrame:
    """Streaming trace records from JSONL files landing in ``source_dir``;
    the raw line stays in ``value``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(source_dir).select("value")
    return parse_lines(lines, schema, keep_line_col=True).where(~F.col("_blank"))


def flag_stream(records: DataFrame, threshold: int = 2, min_len: int = 100) -> DataFrame:
    """Add the curation decision: kept = parsed, correct, untruncated and
    not repetitive."""
    ok = F.col(CORRUPT).isNull()
    rep = is_repeating(F.col("model_response"), threshold, min_len)
    return (records.withColumn("is_repeating", ok & rep)
                   .withColumn("kept", ok & F.coalesce(F.col("is_correct"), F.lit(False))
                               & ~F.coalesce(F.col("truncated"), F.lit(False)) & ~rep))


def _checkpoint(spark: SparkSession, name: str, location: str | None, *settings) -> str:
    """A checkpoint of its own for each source, sink and setting."""
    own = hashlib.md5(repr(settings).encode()).hexdigest()[:16]
    return location or os.path.join(checkpoint_root(spark), "streams", f"{name}-{own}")


def start_curation(spark: SparkSession, source_dir: str, sink_dir: str, threshold: int = 2,
                   min_len: int = 100, checkpoint: str | None = None,
                   available_now: bool = True, name: str = "curation") -> StreamingQuery:
    """Append kept records to ``sink_dir`` as JSON lines, each written back
    as it arrived (every field kept). With ``available_now`` the query
    processes what has arrived and stops (incremental batch); otherwise it
    keeps running."""
    flagged = flag_stream(trace_stream(spark, source_dir), threshold, min_len)
    kept = flagged.where("kept").select("value")
    writer = (kept.writeStream.format("text").outputMode("append")
              .option("path", sink_dir)
              .option("checkpointLocation", _checkpoint(spark, name, checkpoint, source_dir, sink_dir, threshold, min_len)))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def report_stream(flagged: DataFrame) -> DataFrame:
    """Running processed / filtered / saved / corrupt counts (four counters
    of state, whatever the stream's size)."""
    return flagged.agg(F.count(F.lit(1)).alias("processed"),
                       F.count_if("is_repeating").alias("filtered"),
                       F.count_if("kept").alias("saved"),
                       F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt"))


def start_report(spark: SparkSession, source: str | DataFrame, threshold: int = 2, min_len: int = 100,
                 checkpoint: str | None = None, query_name: str = "curation_report",
                 available_now: bool = True) -> StreamingQuery:
    """Maintain the running report in an in-memory table ``query_name``.
    ``source`` is a folder of JSONL files, or a stream of trace records,
    which then needs a ``checkpoint``."""
    if isinstance(source, str):
        records = trace_stream(spark, source, schema=TRACE_SCHEMA)
    else:
        records = source.withColumn(CORRUPT, F.lit(None).cast("string"))
    rep = report_stream(flag_stream(records, threshold, min_len))
    writer = (rep.writeStream.format("memory").queryName(query_name).outputMode("complete")
              .option("checkpointLocation", _checkpoint(spark, query_name, checkpoint, source, threshold, min_len)))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
