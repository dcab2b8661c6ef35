"""Repetition filter, capped filtering and seeded sampling against brute
force over collected rows (test-only plain Python)."""

import itertools

from pyspark.sql import functions as F

from tracekit.operators import repeat as R
from tracekit.operators import sampling as S
from tracekit.sources import fixtures as X

from . import plain
from .conftest import SF_SMALL

def _traces(spark):
    return X.traces(spark, SF_SMALL).select("index", "model_response", "is_correct", "truncated")


def test_is_repeating_matches_brute_force(spark):
    t = _traces(spark)
    rows = {r["index"]: r.model_response for r in t.collect()}
    settings = [(2, 100), (3, 50), (3, 20), (1, 10), (4, 5), (2, 1)]
    cols = [R.is_repeating(F.col("model_response"), th, ml).alias(f"f{i}") for i, (th, ml) in enumerate(settings)]
    got = {r["index"]: r for r in t.select("index", *cols).collect()}
    flagged_any = 0
    for idx, text in rows.items():
        for i, (th, ml) in enumerate(settings):
            want = plain.most_repeats(text, ml) >= th
            assert got[idx][f"f{i}"] == want, (idx, th, ml)
            flagged_any += want
    assert flagged_any > 0


def test_drop_keeps_and_drops(spark):
    t = _traces(spark)
    kept = R.drop_repeating(t, "model_response", 2, 100).count()
    dropped = t.where(R.is_repeating(F.col("model_response"), 2, 100)).count()
    assert kept + dropped == t.count()
    assert kept > 0 and dropped > 0


def test_repeated_sentences_matches_brute_force(spark):
    t = _traces(spark)
    want = set()
    for r in t.collect():
        for s, g in itertools.groupby(sorted(plain.sentences(r.model_response, 20))):
            n = len(list(g))
            if n >= 2:
                want.add((r["index"], s, n))
    got = {(r["index"], r.sentence, r.n) for r in R.repeated_sentences(t, "index", "model_response", 2, 20).collect()}
    assert got == want and want


def test_first_n_report_matches_loop(spark):
    t = _traces(spark)
    flags = {r["index"]: r.rep for r in t.select(
        "index", R.is_repeating(F.col("model_response"), 3, 20).alias("rep")).collect()}
    keep = ~R.is_repeating(F.col("model_response"), 3, 20)
    for n in [None, 0, 1, 7, 1000]:
        processed = filtered = saved = 0
        for idx in sorted(flags):
            if n is not None and saved >= n:
                break
            processed += 1
            if flags[idx]:
                filtered += 1
            else:
                saved += 1
        got = S.first_n_report(t, keep, "index", n).first()
        assert (got.processed, got.filtered, got.saved) == (processed, filtered, saved), n
        rows = S.first_n_kept(t, keep, "index", n).count()
        assert rows == saved


def test_seeded_sample_independent_of_partitioning(spark):
    t = _traces(spark)
    a = sorted(r["index"] for r in S.seeded_sample(t.repartition(1), 50, 7, "index").collect())
    b = sorted(r["index"] for r in S.seeded_sample(t.repartition(13), 50, 7, "index").collect())
    c = sorted(r["index"] for r in S.seeded_sample(t, 50, 8, "index").collect())
    assert a == b and len(a) == 50 and a != c


def test_repeated_and_null_keys(spark):
    rows = [(i % 7 if i % 5 else None, f"t{i % 11}", i % 3 != 0) for i in range(200)] + [(3, "same", True)] * 40
    df = spark.createDataFrame(rows, "index long, t string, ok boolean").repartition(7)
    keep = F.col("ok")
    kept_keys = sorted((k is None, k or 0) for k, _, ok in rows if ok)
    for n in (0, 1, 13, 60, 100, len(kept_keys), 1000):
        kept, report = S.first_n(df, keep, "index", n)
        got, rep = kept.collect(), report.first()
        assert len(got) == rep.saved == min(n, len(kept_keys))
        assert sorted((r["index"] is None, r["index"] or 0) for r in got) == kept_keys[:n]
        assert rep.processed == rep.saved + rep.filtered and rep.processed <= len(rows)
        assert all(r.ok for r in got)
        sample = S.seeded_sample(df, n, 5, "index").collect()
        assert len(sample) == min(n, len(rows))
    assert S.seeded_sample(df, None, 5, "index").count() == len(rows)
    nulls = spark.createDataFrame([(None, "a", True)] * 20, df.schema)
    assert S.first_n_kept(nulls, keep, "index", 3).count() == 3
