import re
import sys

from pyspark.sql import functions as F

from tracekit.functions import text as T


def _all_chars() -> str:
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)


def test_java_whitespace_class_equals_python_isspace(spark):
    df = spark.createDataFrame([(_all_chars(),)], "s string")
    kept = df.select(F.regexp_replace("s", f"(?U)[^{T.JAVA_WS[1:-1]}]", "")).first()[0]
    assert kept == T.WHITESPACE == "".join(c for c in _all_chars() if c.isspace())


def test_digit_class_equals_python_isdigit(spark):
    df = spark.createDataFrame([(_all_chars(),)], "s string")
    kept = df.select(F.regexp_replace("s", "[^" + T.DIGIT_CLASS[1:], "")).first()[0]
    assert kept == "".join(c for c in _all_chars() if c.isdigit())


def test_word_count_and_strip(spark):
    rows = [("  a b c d \n",), ("",), (None,), ("\u001cx\u001d",), ("one",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(T.word_count(F.col("s"))).collect()]
    want = [len((s or "").split()) for (s,) in rows]
    assert got == want
    got = [r[0] for r in df.select(T.py_strip(F.col("s"))).collect()]
    assert got == [s.strip() if s is not None else None for (s,) in rows]


def test_split_sentences_matches_python(spark):
    texts = ["A b.  C d!\nE f? G\n\n\nH. ", "x. y", "no punct\u001cfoo", "", "a...b. c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [list(r[0]) for r in df.select(T.split_sentences(F.col("t"))).collect()]
    want = [re.split(r"(?<=[.!?])\s+|\n+", t) for t in texts]
    # Java drops nothing with limit -1 except a leading empty string from a zero-width match
    assert got == want
