"""Incremental curation over files arriving in two waves equals the batch
result over all of them."""

import os

from pyspark.sql import functions as F

from tracekit.operators import repeat as R
from tracekit.operators import sampling as S
from tracekit.sources import fixtures as X
from tracekit.sources import jsonl as J
from tracekit.streaming import curate as C

from .conftest import SF_SMALL


def test_stream_curation_matches_batch(spark, tmp_path):
    traces = X.traces(spark, SF_SMALL)
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    src.mkdir()
    # two waves of files, the second with a malformed line
    J.write_jsonl(traces.where(F.col("index") % 2 == 0).coalesce(1), str(tmp_path / "w1"))
    J.write_jsonl(traces.where(F.col("index") % 2 == 1).coalesce(1), str(tmp_path / "w2"))
    w1 = [f for f in os.listdir(tmp_path / "w1") if f.endswith(".json")][0]
    w2 = [f for f in os.listdir(tmp_path / "w2") if f.endswith(".json")][0]
    (src / "a.jsonl").write_text((tmp_path / "w1" / w1).read_text())
    q = C.start_curation(spark, str(src), out, checkpoint=str(ck / "c"))
    q.awaitTermination(120)
    (src / "b.jsonl").write_text((tmp_path / "w2" / w2).read_text() + "{not json\n")
    q = C.start_curation(spark, str(src), out, checkpoint=str(ck / "c"))
    q.awaitTermination(120)

    want = {r["index"] for r in R.drop_repeating(S.correct_untruncated(traces), "model_response", 2, 100)
            .select("index").collect()}
    got = [r["index"] for r in spark.read.schema(J.TRACE_SCHEMA).json(out).collect()]
    assert sorted(got) == sorted(want)

    # another sink starts from the first file, also under the default checkpoint
    for name in ("other", "third"):
        C.start_curation(spark, str(src), str(tmp_path / name)).awaitTermination(120)
        assert spark.read.text(str(tmp_path / name)).count() == len(want)

    rq = C.start_report(spark, str(src), checkpoint=str(ck / "r"), query_name="rep_test")
    rq.awaitTermination(120)
    rep = spark.table("rep_test").first()
    assert rep.processed == traces.count() + 1 and rep.corrupt == 1 and rep.saved == len(want)
