"""Golden cases for answer extraction and path parsing (hand-checkable)."""

import pytest
from pyspark.sql import functions as F

from tracekit.functions import answers as A
from tracekit.functions.records import budget_from_path
from tracekit.operators.repeat import is_repeating

BS = "\\"

NORMALIZE_CASES = [
    ("x = 5", "5"), ("100,000", "100000"), ("1,2", "12"), ("$12$ dollars", "12"),
    (BS + "text{(B)}", "(B)"), (BS + "frac12", BS + "frac{1}{2}"),
    (BS + "frac{1}{2}", BS + "frac{1}{2}"), (BS + "dfrac{3}{4}", BS + "dfrac{3}{4}"),
    (BS + "sqrt3", BS + "sqrt{3}"), ("90^" + BS + "circ", "90"),
    (BS + "left(3,4" + BS + "right)", BS + "le(3,4" + BS + "right)"),
    ("3" + BS + "text{ cm}", "3"), ("5" + BS + "text{ cm}^2", "5"), (BS + "mbox{even}", "even"),
    ("a cat", "cat"), (BS + "textbf{7}", "7"), (BS + "overline{12}", "12"), ("1{,}000", "1000"),
    ("{1," + BS + "!000}", "{1000}"), (BS + "$5.00", "5.00"), ("12,345.5", "12,345.5"),
    ("x" + BS + "in[1,2]", "x" + BS + "in[1,2]"), ("[invalidanswer]", "[invalidanswer]"),
    ("", ""), (None, ""), ("2\n=3", "3"),
]

LAST_BOXED_CASES = [
    ("a \\boxed{\\frac{1}{2}} b \\boxed{x^{2}} c}", "\\boxed{x^{2}}"),
    ("none", None), ("", None), ("\\boxed{open", None), ("\\boxed{a}\\boxed", None),
    ("x \\boxed 5$ y \\boxed{3}", "\\boxed 5"),
    ("\\fbox{7} q", "\\fbox{7}"),
    ("\\boxed{é{ü}}z", "\\boxed{é{ü}}"),
    ("\\boxed{} tail", "\\boxed{}"),
    ("\\boxed5 then {z}", "\\boxed5 then {z}"),
    ("\\boxed}{x}}", None),
]

PATH_CASES = [
    ("results/bf-step32forcing/x.jsonl", (32, None)), ("a/step7/b.jsonl", (7, None)),
    ("qwen-32steps_32kctxt/a.jsonl", (None, None)), ("run-2048tokens/a.jsonl", (None, 2048)),
    ("a/stepX_512tokens/c", (None, 512)), ("plain/a.jsonl", (None, None)),
]


def _one_col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_normalize_golden(spark):
    got = _one_col(spark, [c[0] for c in NORMALIZE_CASES], A.normalize_answer)
    assert got == [c[1] for c in NORMALIZE_CASES]


def test_last_boxed_golden(spark):
    got = _one_col(spark, [c[0] for c in LAST_BOXED_CASES], A.last_boxed)
    assert got == [c[1] for c in LAST_BOXED_CASES]


def test_unbox_and_raw_answer(spark):
    texts = ["\\boxed{12}", "\\boxed 7", "\\fbox{7}", "Final Answer: The final answer is 5. ",
             "Final Answer: The final answer is 5.", "nothing here", "x \\boxed{3} y", None,
             "Final Answer: The final answer is  $\\frac{1}{2}$ . I hope it is correct."]
    got = _one_col(spark, texts, A.raw_answer)
    assert got == ["12", "7", "[invalidanswer]", "5", "[invalidanswer]", "[invalidanswer]", "3",
                   "[invalidanswer]", "$\\frac{1}{2}$"]
    assert _one_col(spark, ["\\boxed{12}"], A.final_answer) == ["12"]


def test_answers_equal(spark):
    pairs = [("12", "12"), ("0.5", "\\frac{1}{2}"), ("2", "2.0"), ("-\\frac{2}{4}", "-0.5"),
             ("", ""), ("[invalidanswer]", "[invalidanswer]"), ("x", "y"), ("3", "4"),
             ("\\sqrt{4}", "2"), ("1", "\\frac{1}{0}")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(A.answers_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, True, True, False, False, False, False, False, False]


def test_budget_from_path_golden(spark):
    got = _one_col(spark, [c[0] for c in PATH_CASES], budget_from_path)
    assert [(r["steps"], r["tokens"]) for r in got] == [c[1] for c in PATH_CASES]


def test_is_repeating_null_and_empty(spark):
    got = _one_col(spark, [None, "", "   "], lambda c: is_repeating(c, 2, 0 + 1))
    assert got == [False, False, False]


def test_java_replacement():
    assert A.java_replacement("$\\3$") == "\\$$3\\$"
    assert A.java_replacement("frac{\\2}{\\3}") == "frac{$2}{$3}"


def test_typed_records_on_empty_and_nested(spark):
    from tracekit.functions.records import as_correct_typed, first_response
    df = spark.createDataFrame(
        [(1, [], [[]], [1], ["Yes"], True), (2, ["a"], [["b", "c"]], [0], [], None)],
        "id int, r array<string>, rr array<array<string>>, n array<int>, s array<string>, b boolean")
    got = df.orderBy("id").select(
        first_response(F.col("r"), df.schema["r"].dataType).alias("r"),
        first_response(F.col("rr"), df.schema["rr"].dataType).alias("rr"),
        as_correct_typed(df, "n").alias("n"), as_correct_typed(df, "s").alias("s"),
        as_correct_typed(df, "b").alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, None, True, True, True), ("a", "b", False, False, False)]


def test_score_validates_gold_keys(spark):
    import pytest

    from tracekit.operators.scoring import score
    out = spark.createDataFrame([(1, "so \\boxed{2}"), (2, "\\boxed{0.5}")], "k int, model_response string")
    gold = spark.createDataFrame([(1, "2"), (2, "\\frac{1}{2}")], "k int, answer string")
    got = {r.k: (r.pred, r.exact_match) for r in score(out, gold, "k", validate=True).collect()}
    assert got == {1: ("2", 1), 2: ("0.5", 1)}
    with pytest.raises(ValueError, match="not unique"):
        score(out, gold.unionByName(gold), "k", validate=True)


def test_unmatched_outputs_stay_and_no_text_is_shuffled(spark):
    from tracekit.operators.scoring import score
    outputs = spark.createDataFrame([(1, "so $\\boxed{4}$"), (2, "so $\\boxed{5}$"), (3, "none")], "k long, model_response string")
    gold = spark.createDataFrame([(1, "4.0"), (9, "1")], "k long, answer string")
    got = {r.k: (r.pred, r.gold, r.exact_match) for r in score(outputs, gold, "k").collect()}
    assert got[1] == ("4", "4.0", 1) and got[2] == ("5", None, 0) and got[3][1:] == (None, 0)
    twice = gold.union(spark.createDataFrame([(1, "7")], gold.schema))
    with pytest.raises(ValueError):
        score(outputs, twice, "k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id k", "text model_response")
        node = score(docs, gold, "k").select("k", "exact_match")._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    while node.nodeName() != "Join":
        node = node.children().head()
    left = node.children().head().output()
    assert [left.apply(i).name() for i in range(left.size())] == ["k", "pred"]
