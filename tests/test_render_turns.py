import random

import pytest
from pyspark.sql import functions as F

from tracekit.operators.render import render_turns


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(conv, []).append(f"<|im_start|>{role}\n{text}<|im_end|>\n")
    return {c: (len(x), "".join(x)) for c, x in out.items()}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_a_conversation_with_most_turns(spark, parts):
    rng = random.Random(2)
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t} " + "w " * rng.randint(0, 5)) for t in range(3000)]
    rows += [(c, t, "user", f"c{c} {t}") for c in range(2, 400) for t in range(rng.randint(1, 6))] + [(None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in render_turns(df, parts=parts).collect()}
    assert got == plain(rows)
    if parts == 16:
        ranged = df.repartitionByRange(16, "conv_id", "turn").where("conv_id = 1").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(ranged) > 8  # the large conversation lies in many ranges


def test_equal_turns_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, None, None), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    one, two = (render_turns(df.repartition(n), parts=3).orderBy("conv_id").collect() for n in (1, 4))
    assert one == two and one[0]["n_turns"] == 3
    assert one[0]["text"] == "<|im_start|>\n<|im_end|>\n" + "<|im_start|>user\nb<|im_end|>\n" * 2
    assert render_turns(df.limit(0)).collect() == []
