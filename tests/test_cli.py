"""The command-line workflows run end to end on small inputs."""

import json

from pyspark.sql import functions as F

from tracekit import cli
from tracekit.sources import fixtures as X
from tracekit.sources import jsonl as J

from .conftest import SF_SMALL


def test_filter_stats_train_rows(spark, tmp_path, capsys):
    traces = X.traces(spark, SF_SMALL)
    src = str(tmp_path / "traces.jsonl")
    J.write_jsonl(traces.withColumn("extra_field", F.lit("kept")), src)
    out = str(tmp_path / "traces_filtered.jsonl")
    cli.main(["filter", src, out, "--threshold", "3", "--min_len", "21", "--max_samples", "50"])
    filtered = spark.read.json(out)
    assert filtered.count() == 50 and filtered.where("extra_field = 'kept'").count() == 50
    cli.main(["stats", src])
    cli.main(["train-rows", out, str(tmp_path / "rows.jsonl"), "--max_train_samples", "10"])
    rows = spark.read.json(str(tmp_path / "rows.jsonl"))
    assert rows.count() == 10 and rows.where(F.col("text").startswith("<|im_start|>user")).count() == 10
    text = capsys.readouterr().out
    assert "filter report" in text and "length ranges" in text


def test_thinking_and_assemble(spark, tmp_path, capsys):
    s = X.samples(spark, SF_SMALL)
    harness = s.select(F.to_json(F.struct(
        F.struct(F.col("prompt").alias("problem")).alias("doc"),
        F.struct(F.struct(F.col("prompt").alias("arg_0")).alias("gen_args_0")).alias("arguments"),
        F.array(F.array("resp")).alias("filtered_resps"), "exact_match")).alias("value"))
    d = tmp_path / "run-512tokens"
    harness.write.text(str(d))
    cli.main(["thinking", str(d)])
    steps = str(tmp_path / "steps.parquet")
    X.gen_steps(spark, SF_SMALL).write.parquet(steps)
    questions = str(tmp_path / "q.parquet")
    (X.table(spark, SF_SMALL, "conversations").where("turn = 0")
      .select(F.col("conv_id").alias("sample_id"), F.col("text").alias("problem"),
              (F.col("conv_id") % 97).cast("string").alias("answer")).write.parquet(questions))
    out = str(tmp_path / "gen.jsonl")
    cli.main(["assemble", steps, questions, out, "--num_waits", "3", "--max_model_len", "1500"])
    text = capsys.readouterr().out
    assert '"samples": 20' in text or '"samples"' in text
    assert spark.read.json(out).count() > 0
    lines = [json.loads(x) for x in text.splitlines() if x.startswith("{")]
    assert any("total" in x for x in lines)


def test_compare_runs(spark, tmp_path, capsys):
    r = X.runs(spark, SF_SMALL)
    for run in ["base", "tuned"]:
        r.where(F.col("run") == run).select(F.to_json(F.struct("doc_id", "exact_match")).alias("value")) \
         .write.text(str(tmp_path / run))
    cli.main(["compare", f"base={tmp_path / 'base'}", str(tmp_path / "tuned")])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    want = {row.run: row for row in spark.createDataFrame(r.toPandas()).groupBy("run")
            .agg(F.avg("exact_match").alias("acc")).collect()}
    got = {x["run"]: x for x in out}
    assert set(got) == {"base", "tuned"}
    assert abs(got["tuned"]["accuracy"] - want["tuned"].acc) < 1e-12
    assert abs(got["tuned"]["delta"] - (want["tuned"].acc - want["base"].acc)) < 1e-12
    assert got["base"]["delta"] == 0.0


def test_thinking_uses_step_form_from_path(spark, tmp_path, capsys):
    import __spark_entry__ as E
    s = X.step_samples(spark, SF_SMALL)
    args = F.struct(F.struct(F.lit("").alias("arg_0")).alias("gen_args_0")).alias("arguments")
    harness = s.select(F.to_json(F.struct(args, F.array("resp").alias("filtered_resps"),
                                          F.lit(1).alias("exact_match"))).alias("value"))
    d = tmp_path / "bf-step3forcing"
    harness.write.text(str(d))
    cli.main(["thinking", str(d)])
    line = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")][-1]
    want = E.queries()["thinking_stats_steps"](spark, SF_SMALL).first().asDict()
    for k in ["samples", "n_over_budget", "n_no_thinking", "n_no_answer", "min_thinking_tokens",
              "max_thinking_tokens"]:
        assert line[k] == want[k], k
    assert abs(line["avg_steps"] - round(want["avg_steps"], 1)) < 1e-9


def test_stream_filter(spark, tmp_path):
    traces = X.traces(spark, SF_SMALL)
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    J.write_jsonl(traces.coalesce(1), str(tmp_path / "w"))
    part = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".json")][0]
    (src / "a.jsonl").write_text(part.read_text())
    cli.main(["stream-filter", str(src), sink, "--checkpoint", str(tmp_path / "ck")])
    from tracekit.operators import repeat as R
    want = R.drop_repeating(traces.where("is_correct and not truncated"), "model_response", 2, 100).count()
    got = spark.read.json(sink).count()
    assert got == want > 0


def test_filter_keeps_every_valid_record(spark, tmp_path, capsys):
    lines = ['{"index": "q-2", "model_response": "a"}', '{"index": 3, "is_correct": 1, "model_response": "b"}', '{"index": 4, "steps": 1.0}',
             '{"index": 5, "model_response": null}', "\t", "", "{broken", "[1]", '{"index": 5, "model_response": "%s"}' % ("Same again and again. " * 3)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n")
    for cap, saved in ((None, 4), (3, 3), (0, 0)):
        out = str(tmp_path / f"out{cap}")
        cli.main(["filter", str(tmp_path / "in.jsonl"), out, "--min_len", "10", *([] if cap is None else ["--max_samples", str(cap)])])
        report = json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][0])
        got = [r.value for r in spark.read.text(out).collect()]
        assert len(got) == report["saved"] == saved and set(got) <= set(lines[:4])
        assert report["processed"] == report["saved"] + report["filtered"] + report["malformed"]
    assert cli.main(["filter", str(tmp_path / "in.jsonl"), out, "--min_len", "10"]) == 0
    report = json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][0])
    assert report == {"processed": 7, "filtered": 1, "saved": 4, "malformed": 2}


def test_stats_reads_past_json_nulls(tmp_path, capsys):
    (tmp_path / "s.jsonl").write_text("".join('{"problem": "p", "model_response": "r", "math_verify": null, "exact_match": 1}\n' for _ in range(4)))
    cli.main(["stats", str(tmp_path / "s.jsonl")])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert any(x.get("accuracy") == 1.0 and x.get("n_correct") == 4 for x in out)


def test_thinking_totals_only_and_lengths(spark, tmp_path, capsys):
    line = json.dumps({"filtered_resps": [["one two three \\\\boxed{4}"]], "arguments": {"gen_args_0": {"arg_0": "p"}}, "exact_match": 1})
    (tmp_path / "qwq-run").mkdir()
    (tmp_path / "qwq-run" / "s.jsonl").write_text((line + "\n") * 3)
    out = str(tmp_path / "lengths")
    cli.main(["thinking", str(tmp_path / "qwq-run"), "--lengths", out])
    row = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")][0]
    assert row["samples"] == 3 and row["avg_total_tokens"] == 4 and row["n_no_answer"] == 0
    assert row["avg_thinking_tokens"] is None and row["n_no_thinking"] == 0
    assert spark.read.json(out).count() == 3


def test_next_round_from_the_command_line(spark, tmp_path):
    q = str(tmp_path / "q.parquet")
    spark.createDataFrame([(1, "p1", "so $\\boxed{3}$"), (2, "p2", "none")], "sample_id long, problem string, solution string").write.parquet(q)
    cli.main(["next-round", q, str(tmp_path / "r0")])
    first = spark.read.json(str(tmp_path / "r0")).collect()
    assert sorted(r.sample_id for r in first) == [1, 2] and all(r.next_step == 0 and r.prompt.endswith("think\n") for r in first)
    s = str(tmp_path / "s.parquet")
    spark.createDataFrame([(1, 0, "a", 5, "stop"), (2, 0, "b", 5, "length")],
                          "sample_id long, step int, gen_text string, gen_tokens int, finish_reason string").write.parquet(s)
    cli.main(["next-round", q, str(tmp_path / "r1"), "--steps", s])
    (row,) = spark.read.json(str(tmp_path / "r1")).collect()
    assert row.sample_id == 1 and row.next_step == 1 and row.prompt.endswith("think\na\nWait\n")


def test_whole_prompts_count_towards_the_limit(spark):
    from tracekit.plans.pipelines import generate_records
    steps = spark.createDataFrame([(1, 0, "a", 5, "stop"), (1, 1, "b \\boxed{3}", 5, "stop")],
                                  "sample_id long, step int, gen_text string, gen_tokens int, finish_reason string")
    q = spark.createDataFrame([(1, "word " * 30, "so $\\boxed{3}$")], "sample_id long, problem string, solution string")
    rows = {n: generate_records(steps, q, num_waits=1, max_model_len=n).first() for n in (41, 10_000)}
    assert rows[41].truncated and rows[41].steps == 0 and not rows[41].is_correct
    assert not rows[10_000].truncated and rows[10_000].steps == 1 and rows[10_000].is_correct and rows[10_000].ground_truth == "3"
