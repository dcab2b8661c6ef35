"""JSONL round trips, malformed and blank lines, split writing."""

import os

from pyspark.sql import functions as F

from tracekit.sources import jsonl as J
from tracekit.sources import fixtures as X

from .conftest import SF_SMALL


def test_read_traces_marks_bad_and_blank_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"index": 1, "model_response": "a", "is_correct": true, "truncated": false, "steps": 0}\n'
                 "\n"
                 "{broken\n"
                 '{"index": 2, "problem": null}\n')
    df = J.read_traces(spark, str(p)).orderBy(F.col("index").asc_nulls_last(), "_blank").collect()
    assert len(df) == 4
    assert df[0]["index"] == 1 and df[0]["is_correct"] is True and df[0]["_corrupt_record"] is None
    assert df[1]["index"] == 2 and df[1]["problem"] is None
    assert sum(r["_blank"] for r in df) == 1
    assert sum(r["_corrupt_record"] is not None and not r["_blank"] for r in df) == 1
    assert all(r["_file"].endswith("t.jsonl") for r in df)


def test_read_samples_skips_blank_and_bad(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"doc_id": 1, "resp": "x"}\n\n   \n{oops\n{"doc_id": 2}\n')
    df = J.read_samples(spark, str(p), "doc_id long, resp string")
    assert sorted(r.doc_id for r in df.collect()) == [1, 2]


def test_write_split_round_trip(spark, tmp_path):
    traces = X.traces(spark, SF_SMALL)
    all_path, ok_path = str(tmp_path / "all"), str(tmp_path / "correct")
    summary = J.write_split(traces, all_path, ok_path)
    back = J.read_traces(spark, os.path.join(all_path, "*.json"))
    assert back.where(F.col("_corrupt_record").isNull()).count() == traces.count() == summary.total
    ok = spark.read.json(ok_path)
    assert ok.count() == summary.saved == traces.where("is_correct and not truncated").count()
    # correct file is a subset of the all file
    assert ok.join(back, "index", "left_anti").count() == 0


def test_derived_name():
    assert J.derived_name("a/x.jsonl", "filtered") == "a/x_filtered.jsonl"
    assert J.derived_name("a/x.txt", "filtered") == "a/x.txt.filtered"


def test_read_dataset_by_suffix(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"problem": "p", "model_response": "r"}\n')
    assert J.read_dataset(spark, str(p)).count() == 1
    assert J.read_dataset(spark, f"{SF_SMALL}/labels.parquet").count() > 0
