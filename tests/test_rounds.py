"""Steps that arrive in any split give what the batch operator gives."""

import random

import pytest
from pyspark.sql import functions as F

from tracekit.operators import budget as B
from tracekit.sources import fixtures as X
from tracekit.streaming import rounds as R

from .conftest import SF_SMALL


def arrive(df, rows, folder, schema):
    df.sparkSession.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed, mode, waits, max_len", [(1, "budget", 3, 1500), (2, "alternating", 5, 2500)])
def test_any_split_equals_the_batch_operator(spark, tmp_path, seed, mode, waits, max_len):
    steps = X.gen_steps(spark, SF_SMALL)
    rows = [tuple(r) for r in steps.collect()]
    random.Random(seed).shuffle(rows)  # steps of a sample come in any order
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for wave in range(3):  # a restart between waves
        arrive(steps, rows[wave::3] + rows[:3], src, steps.schema)  # some steps come again
        q = R.start_rounds(spark, src, sink, steps.schema, mode, waits, max_len, marker_tokens=(2, 3), checkpoint=ck)
        q.awaitTermination(120)
        assert q.exception() is None
    batch = B.assemble_budget(steps, mode, waits, max_len, marker_tokens=(2, 3)).select("sample_id", "steps", "truncated", "stopped", "tokens", "generation")
    assert sorted(map(tuple, R.latest(spark, sink).collect())) == sorted(map(tuple, batch.collect()))
    every = spark.read.parquet(sink)
    assert every.where("stopped").groupBy("sample_id").count().where("count > 1").count() == 0
    assert every.groupBy("sample_id", "steps").count().where(F.col("count") > 1).count() == 0


def test_prompts_come_as_steps_arrive(spark, tmp_path):
    schema = "sample_id long, step int, gen_text string, gen_tokens int, finish_reason string, prompt_tokens long"
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    waves = [[(1, 1, "b", 5, "stop", 7), (2, 0, "x", 5, "length", 7)],
             [(1, 0, "a", 5, "stop", 7), (2, 1, "y", 5, "stop", 7)],
             [(1, 2, "c", 5, "stop", 7)]]
    frame = spark.createDataFrame([], schema)
    found = []
    for wave in waves:
        arrive(frame, wave, src, schema)
        R.start_rounds(spark, src, sink, frame.schema, "budget", 2, 4000, checkpoint=ck).awaitTermination(120)
        found.append(sorted(map(tuple, R.latest(spark, sink).collect())))
    x = (2, 0, True, True, 12, "x")
    assert found[0] == [x]
    assert found[1] == [(1, 1, False, False, 17, "a\nWait\nb\nWait\n"), x]
    assert found[2] == [(1, 2, False, True, 22, "a\nWait\nb\nWait\nc"), x]
