import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracekit import cli
from tracekit.functions.records import require_columns
from tracekit.operators import percentiles as Q
from tracekit.sources import jsonl as J

SCHEMA = "index long, model_response string, is_correct boolean, truncated boolean"


def rows(spark, n, shift=0):
    data = [(i + shift, f"r{i}", [True, False, None][i % 3], [False, True, None, False][i % 4]) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def test_split_is_published_as_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "split")
    got = J.commit_split(rows(spark, 60), path)
    whole, correct = J.read_split(spark, path)
    want = [r for r in rows(spark, 60).collect() if r["is_correct"] and r["truncated"] is False]
    assert (got["total"], got["saved"]) == (60, len(want)) and sorted(map(tuple, correct.collect())) == sorted(map(tuple, want))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, rows(spark, 60).collect()))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(J, "_publish", crash)
        with pytest.raises(RuntimeError):
            J.commit_split(rows(spark, 10, 1000), path)
    assert J.read_manifest(spark, path)["total"] == 60 and J.read_split(spark, path)[0].count() == 60
    J.commit_split(rows(spark, 7, 2000), path)
    assert sorted(r["index"] for r in J.read_split(spark, path)[0].collect()) == list(range(2000, 2007))


def test_nothing_is_visible_before_the_first_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "split")
    monkeypatch.setattr(J, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        J.commit_split(rows(spark, 10), path)
    with pytest.raises(Exception, match="(?i)path"):
        J.read_split(spark, path)


def test_an_empty_split(spark, tmp_path):
    path = str(tmp_path / "split")
    assert tuple(J.commit_split(rows(spark, 3).limit(0), path)) == (0, 0)
    assert J.read_manifest(spark, path)["total"] == 0


SHARES = [0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]


def same(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    want = df.agg(F.percentile("v", SHARES)).first()[0]
    assert Q.exact_percentiles(df, "v", SHARES) == want


@pytest.mark.parametrize("values", [[5], [1, 2], [7] * 50, list(range(20000)), [i * i * 1_000_003 for i in range(3000)],
                                    [-2 ** 63, 2 ** 63 - 1, 0, 1, -1], [None, 3, None, 4], [2 ** 62 + i for i in range(500)]])
def test_longs_equal_percentile(spark, values):
    same(spark, values, "long")


def test_doubles_equal_percentile(spark):
    rng = random.Random(4)
    same(spark, [rng.gauss(0, 1) for _ in range(5000)], "double")
    same(spark, [rng.choice((1e-300, 1.5, -1e300, 1e300, 0.0)) * rng.random() for _ in range(3000)], "double")
    same(spark, [0.1 + 1e-16 * rng.random() for _ in range(500)], "double")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-10 ** 12, 10 ** 12), min_size=1, max_size=60))
def test_any_longs(spark, values):
    same(spark, values, "long")


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v long")
    assert Q.exact_percentiles(df, "v", SHARES) is None
    assert tuple(Q.refined_length_stats(df, "v").first()) == (0, None, None, None, None, None, None, None)


def test_train_rows_come_in_their_order(spark, tmp_path):
    data = tmp_path / "t.jsonl"
    data.write_text("".join(json.dumps({"problem": f"p{i}", "model_response": f"r{i}"}) + "\n" for i in range(300)))
    outs = []
    for name in ("a", "b"):
        cli.main(["train-rows", str(data), str(tmp_path / name), "--max_train_samples", "50", "--shuffle_seed", "9"])
        outs.append([json.loads(line)["problem"] for f in sorted((tmp_path / name).glob("part-*")) for line in f.read_text().splitlines()])
    assert outs[0] == outs[1] and len(set(outs[0])) == 50
    assert outs[0] != sorted(outs[0], key=lambda p: int(p[1:]))


def test_required_columns(spark):
    df = spark.range(1).withColumn("text", F.lit("t"))
    assert require_columns(df, ["id"]) is df and require_columns(df, ["no"], unless="text") is df
    with pytest.raises(ValueError, match=r"missing required columns \['no'\]; found columns \['id', 'text'\]"):
        require_columns(df, ["id", "no"])
