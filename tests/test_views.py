"""The record views give every flag and branch something to do."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tracekit.functions import answers as A
from tracekit.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def _values(df, name):
    return {r[0] for r in df.select(name).distinct().collect()}


def test_flags_and_counts_take_both_values(spark):
    q = E.queries()
    for name in ("thinking_stats", "thinking_stats_steps", "flag_counts"):
        row = q[name](spark, SF).first().asDict()
        total = row.get("samples", row.get("n"))
        counts = {k: v for k, v in row.items() if k.startswith("n_")}
        assert counts and all(0 < v < total for v in counts.values()), (name, counts)
    for name, columns in (("generated_records", ["is_correct", "truncated"]), ("as_correct", ["correct"]), ("score_answers", ["exact_match"]),
                          ("parse_trace_lines", ["corrupt", "blank", "is_correct"]), ("repeat_flags", ["is_repeating"])):
        df = q[name](spark, SF)
        for c in columns:
            assert len(_values(df, c) - {None}) == 2, (name, c)


def test_answers_come_in_all_forms(spark):
    t = X.traces(spark, SF)
    box = t.select(A.last_boxed(F.col("model_response")).alias("b"), A.raw_answer(F.col("model_response")).alias("r"))
    forms = ["b is null and r <> '[invalidanswer]'", "b is null and r = '[invalidanswer]'", "contains(b, 'frac')", "contains(b, 'text')",
             "startswith(b, '\\\\fbox')", "startswith(b, '\\\\boxed ')"]
    for form in forms:
        assert box.where(form).count() > 50, form
    scored = E.queries()["score_answers"](spark, SF)
    assert scored.where("exact_match = 1 and pred <> gold").count() > 50
