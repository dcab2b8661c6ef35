"""Budget-forced rounds over generation steps as they arrive.

State is kept by sample: the text and tokens so far, the step that comes next,
and steps that arrived before their turn. Whatever the order and the batches in
which a sample's steps arrive, they are taken in step order, and the rules are those of
``operators.budget``: after a batch a sample that went on gives the prompt of its
next round, and one that stopped its trace, once. State lives in the query's
checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.budget import ALTERNATIVELY, MODES, WAIT
from .curate import _checkpoint

# transformWithState keeps its state in RocksDB
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["step", "gen_text", "gen_tokens", "finish_reason", "prompt_tokens"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


class Rounds(StatefulProcessor):
    """The rules for one sample's steps. A step of a sample counts once: one
    that was taken already, or comes after the stop, is ignored."""

    def __init__(self, mode: str, num_waits: int, max_model_len: int, margin: int, marker_tokens: tuple[int, int]):
        self.mode, self.num_waits, self.max_model_len = mode, num_waits, max_model_len
        self.margin, self.marker_tokens = margin, marker_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", _struct(next_step=T.IntegerType(), tokens=T.LongType(), generation=T.StringType(), stopped=T.BooleanType()))
        # at most num_waits + 1 steps
        self.waiting = handle.getMapState("waiting", _struct(step=T.IntegerType()), _struct(
            gen_text=T.StringType(), gen_tokens=T.LongType(), finish_reason=T.StringType(), prompt_tokens=T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_step, tokens, text, stopped = self.so_far.get() if self.so_far.exists() else (0, 0, "", False)
        for part in rows:
            for step, gen_text, gen_tokens, reason, base in part[COLUMNS].itertuples(index=False):
                if not stopped and next_step <= step <= self.num_waits and not self.waiting.containsKey((int(step),)):
                    self.waiting.updateValue((int(step),), (gen_text or "", int(gen_tokens or 0), reason, int(base or 0)))
        taken = None
        while not stopped and self.waiting.containsKey((next_step,)):
            gen_text, gen_tokens, reason, base = self.waiting.getValue((next_step,))
            self.waiting.removeKey((next_step,))
            tokens += gen_tokens + (base if next_step == 0 else 0)
            truncated = reason == "length" or tokens >= self.max_model_len
            stopped = truncated or tokens > self.max_model_len - self.margin or next_step == self.num_waits or self.mode == "none"
            taken = (next_step, truncated, stopped, tokens)
            text += gen_text
            if not stopped:
                alternates = self.mode == "alternating" and next_step % 2 == 1
                text += f"\n{ALTERNATIVELY if alternates else WAIT}\n"
                tokens += self.marker_tokens[1 if alternates else 0]
            next_step += 1
        if stopped and taken:
            for step in range(next_step, self.num_waits + 1):
                if self.waiting.containsKey((step,)):
                    self.waiting.removeKey((step,))
        self.so_far.update((next_step, tokens, "" if stopped else text, stopped))
        if taken:
            yield pd.DataFrame([(key[0], *taken, text)], columns=["sample_id", "steps", "truncated", "stopped", "tokens", "generation"])

    def close(self) -> None:
        pass


def rounds(steps: DataFrame, mode: str = "budget", num_waits: int = 5, max_model_len: int = 4096, margin: int = 400,
           marker_tokens: tuple[int, int] = (0, 0)) -> DataFrame:
    """(sample_id, steps, truncated, stopped, tokens, generation) from a
    stream of steps: whenever a sample got on, the state of its assembly.
    ``stopped`` rows are final traces; for others the generation, marker included,
    is what the next round (step ``steps`` + 1) continues. A column
    ``prompt_tokens`` of the steps counts the question prompt."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    base = F.col("prompt_tokens") if "prompt_tokens" in steps.columns else F.lit(0)
    given = steps.select("sample_id", F.col("step").cast("int"), "gen_text", F.col("gen_tokens").cast("long"), "finish_reason",
                         base.cast("long").alias("prompt_tokens"))
    out = _struct(steps=T.IntegerType(), truncated=T.BooleanType(), stopped=T.BooleanType(), tokens=T.LongType(), generation=T.StringType())
    schema = T.StructType([steps.schema["sample_id"], *out.fields])
    return given.groupBy("sample_id").transformWithStateInPandas(
        Rounds(mode, num_waits, max_model_len, margin, marker_tokens), schema, "Append", "None")


def start_rounds(spark: SparkSession, source_dir: str, sink_dir: str, schema: T.StructType, mode: str = "budget", num_waits: int = 5,
                 max_model_len: int = 4096, margin: int = 400, marker_tokens: tuple[int, int] = (0, 0), checkpoint: str | None = None,
                 files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Follow Parquet files of steps that arrive in ``source_dir`` and append
    prompts and traces to ``sink_dir`` as Parquet. Each file sink commit and the
    state belong to one batch, so a restart neither repeats nor loses a row."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    out = rounds(reader.parquet(source_dir), mode, num_waits, max_model_len, margin, marker_tokens)
    settings = (source_dir, sink_dir, mode, num_waits, max_model_len, margin, marker_tokens)
    location = _checkpoint(spark, "rounds", checkpoint, *settings)
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", location).outputMode("append")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        # a query keeps the settings that it started with
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The last state of every sample in the sink: its trace, or the prompt
    of its next round. One row per sample leaves the partial aggregates."""
    rows = spark.read.parquet(sink_dir)
    return rows.groupBy("sample_id").agg(F.max_by(F.struct(*rows.columns[1:]), "steps").alias("r")).select("sample_id", "r.*")


__all__ = ["Rounds", "rounds", "start_rounds", "latest"]
