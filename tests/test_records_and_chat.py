"""Hand-worked cases for response parsing, JSON path access and chat
rendering."""

from pyspark.sql import functions as F

from tracekit.functions import chat as C
from tracekit.functions.records import path_value
from tracekit.functions.thinking import step_parts, thinking_parts

TH, AN, IS = "<|im_start|>think", "<|im_start|>answer", "<|im_start|>"


def _rows(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return df.orderBy("i").select(*[e(F.col("s")).alias(f"c{k}") for k, e in enumerate(exprs)]).collect()


def test_thinking_parts(spark):
    texts = [f"{TH}\nline1\nline2\n{AN}\nAnswer: 5", "no tags here", f"{TH}\na\n{AN}",
             f"x\ny\n{AN}\nA\n{AN}\nB\nC"]
    got = [tuple(r.c0[k] for k in ("thinking", "n_steps", "answer")) + (list(r.c0["lines"]),)
           for r in _rows(spark, texts, thinking_parts)]
    assert got == [("line1\nline2", 2, "Answer: 5", ["line1", "line2"]),
                   ("", -1, "", []),
                   ("a", 1, "", ["a"]),
                   ("y", 1, "B\nC", ["y"])]


def test_step_parts(spark):
    texts = [f"{IS}3 steps left\nfoo\n{IS}2 steps left\nbar{AN}\nAnswer: 7", "plain",
             f"{IS}1 steps left\nonly{AN}\nx{AN}\ny"]
    got = [(list(r.c0["steps"]), r.c0["n_markers"], r.c0["answer"]) for r in _rows(spark, texts, step_parts)]
    assert got == [(["foo\n", "bar"], 2, "\nAnswer: 7"), ([], 0, ""), (["only", "x"], 1, "\nx")]


def test_path_value(spark):
    docs = ['{"a": {"b": [1, 2]}, "r": [["x", "y"]], "s": "str"}', None]
    paths = ["a.b", "a.b[1]", "a.c", "r[0]", "s", "a.b[5]"]
    got = _rows(spark, docs, *[lambda c, p=p: path_value(c, p) for p in paths])
    assert tuple(got[0]) == ("1", "2", "", "x", "str", "")
    assert tuple(got[1]) == ("",) * len(paths)


def test_assistant_segment_and_rendering(spark):
    texts = [f"{IS}system\nS<|im_end|>\n{IS}assistant\n  hello <|im_end|>\nrest",
             "no chat", f"{IS}assistant without newline",
             f"{IS}assistant\nfirst<|im_end|>\n{IS}assistant\nsecond"]
    got = [r.c0 for r in _rows(spark, texts, C.assistant_segment)]
    assert got == ["hello", "no chat", f"{IS}assistant without newline", "second"]
    rendered = _rows(spark, ["P"], lambda c: C.training_text(c, F.lit("R"), "SYS"))[0].c0
    assert rendered == ("<|im_start|>system\nSYS<|im_end|>\n"
                        "<|im_start|>user\nProblem:\nP\n\nSolution:<|im_end|>\n"
                        "<|im_start|>assistant\nR<|im_end|>\n")
    prompt = _rows(spark, ["Q"], C.start_prompt)[0].c0
    assert prompt.startswith("<|im_start|>system\nReason step by step") and prompt.endswith(
        "<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n<|im_start|>think\n")


def test_path_values_of_lists_and_nulls(spark):
    from tracekit.functions.records import as_correct_json, path_value
    texts = ['{"a": []}', '{"a": [null]}', '{"a": null}', "{}", '{"a": ["x", "y"]}', '{"a": "[1]"}', '{"a": {"b": 1}}', '{"a": [[1, 2]]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(path_value(F.col("t"), "a").alias("v")).collect()]
    assert got == ["", "", "", "", "x", "[1]", '{"b":1}', "[1,2]"]
    lines = ['{"m": null, "e": 1}', '{"m": null, "e": 0}', '{"m": 0, "e": 1}', '{"m": [null], "e": 1}', '{"m": null}', '{"m": null, "e": "Yes"}', "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(as_correct_json(F.col("t"), ["m", "e"]).alias("v")).collect()]
    assert got == [True, False, False, False, False, True, False]
