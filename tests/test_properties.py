"""Property tests: random texts built from sentence pieces, whitespace of all
kinds and brace soup, checked against plain-Python statements of the rules.
Each property collects all its examples into one DataFrame, so Spark runs
once per property."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracekit.functions import answers as A
from tracekit.functions import text as T
from tracekit.operators.repeat import is_repeating, sentence_counts

from . import plain

WS = ["\n", " ", "\t", " ", " ", "\u001c", "\r", "\n\n", "  "]
PIECES = st.lists(st.one_of(st.sampled_from(["Alpha beta", "Gamma", "alpha beta", "Delta epsilon zeta",
                                             "x" * 12, "ÉÜ ß"]),
                            st.sampled_from([".", "!", "?", ",", ""]),
                            st.sampled_from(WS)), min_size=0, max_size=40).map("".join)
SETTINGS = dict(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**SETTINGS)
@given(st.lists(PIECES, min_size=60, max_size=60))
def test_repetition_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cases = [(2, 3), (3, 1), (2, 12), (4, 2)]
    cols = [is_repeating(F.col("t"), th, ml).alias(f"r{k}") for k, (th, ml) in enumerate(cases)]
    got = {r.i: r for r in df.select("i", *cols, sentence_counts(F.col("t"), 3).alias("c")).collect()}
    for i, t in enumerate(texts):
        for k, (th, ml) in enumerate(cases):
            assert got[i][f"r{k}"] == (plain.most_repeats(t, ml) >= th), (t, th, ml)
        segs = plain.sentences(t, 3)
        assert {(c.sentence, c.n) for c in got[i]["c"]} == {(s, segs.count(s)) for s in set(segs)}


BOX_SOUP = st.lists(st.sampled_from(["{", "}", "\\boxed", "\\fbox", "\\boxed ", "a", "1", "$", " ", "é"]),
                    min_size=0, max_size=25).map("".join)


@settings(**SETTINGS)
@given(st.lists(BOX_SOUP, min_size=80, max_size=80))
def test_last_boxed_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", A.last_boxed(F.col("t")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain.last_box(t), t


def test_strip_matches_python_on_all_whitespace(spark):
    texts = [w + "a b" + w for w in WS + [T.WHITESPACE]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(T.py_strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(-10**6, 10**6), st.integers(1, 999)), min_size=40, max_size=40))
def test_answers_equal_rules(spark, pairs):
    from fractions import Fraction
    rows = []
    for n, d in pairs:
        rows += [(f"{n}", f"{n}.0", True), (f"\\frac{{{n * d}}}{{{d}}}", f"{n}", True),
                 (f"{n}", f"{n + 1}", False), (f"\\frac{{{n}}}{{{d}}}", f"{n}", Fraction(n, d) == n)]
    long = "1234567890" * 4
    rows += [(long, long + ".0", True), ("00" + long, long, True), ("0.12345678901234567890", "0.123456789012345678900", True),
             ("-" + long, long, False), (long + ".5", long, False), ("-0.0", "0", True), (".50", "0.5", True), ("", "", False)]
    rows += [(b, a, want) for a, b, want in rows]  # symmetric
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = {r.i: r.e for r in df.select("i", A.answers_equal(F.col("a"), F.col("b")).alias("e")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, _, w in rows]
