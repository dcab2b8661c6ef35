"""Invariants between the reports."""

from tracekit.operators import stats as ST
from tracekit.plans.pipelines import stats_rows
from tracekit.sources import fixtures as X

from .conftest import SF_SMALL


def test_bucket_report_adds_up(spark):
    rows = stats_rows(X.traces(spark, SF_SMALL))
    total = ST.length_stats(rows).first()
    acc = ST.accuracy(rows).first()
    buckets = ST.length_buckets(rows).collect()
    assert sum(b.n for b in buckets) == total.n == acc.n
    assert abs(sum(b.share for b in buckets) - 1.0) < 1e-12
    assert abs(sum(b.accuracy * b.n for b in buckets) - acc.n_correct) < 1e-9
    assert all(b.n > 0 for b in buckets)  # empty ranges are omitted
    assert total.min_len <= total.p50 <= total.p90 <= total.p95 <= total.p99 <= total.max_len
