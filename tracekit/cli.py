"""Command-line front end: the curation workflows as Spark jobs.

    python -m tracekit.cli filter   IN OUT [--threshold 2 --min_len 100 --max_samples N]
    python -m tracekit.cli stream-filter SRC_DIR SINK_DIR [--continuous]
    python -m tracekit.cli stats    IN [--prompt_column problem --response_column model_response ...]
    python -m tracekit.cli thinking IN
    python -m tracekit.cli compare base=RUN_DIR tuned=RUN_DIR [--baseline base]
    python -m tracekit.cli train-rows IN OUT [--max_train_samples N --shuffle_seed 42 ...]
    python -m tracekit.cli assemble STEPS QUESTIONS OUT [--mode budget --num_waits 5 ...]
    python -m tracekit.cli next-round QUESTIONS OUT [--steps STEPS ...]

Inputs may be files, directories or globs. Only one-row summaries and the
bucket table (at most seven rows) are brought to the driver for printing.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import chat as C
from .functions.records import as_correct_json, budget_from_path, first_response, with_fallback
from .functions.text import py_strip, token_len
from .operators import budget as B
from .operators import repeat as R
from .operators import ordering as D
from .operators import sampling as S
from .operators import stats as ST
from .operators.scoring import check_unique_key
from .plans import pipelines as P
from .ranking import written
from .session import get_spark
from .sources import jsonl as J
from .sources import lines as L


# Fixed value: runs with this in their path have no thinking format.
TOTALS_ONLY_PATH = "qwq"


def _show(title: str, df: DataFrame) -> None:
    print(f"== {title}")
    for row in df.collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


def cmd_filter(spark, a) -> None:
    """Kept records are written back as they were read, every field included.
    Lines that are no record count as processed, not as filtered; a cap
    takes the first records in the order of the files' lines."""
    out = a.output or J.derived_name(a.input, "filtered")
    lines = J.read_traces(spark, a.input, keep_line=True, ordered=True).where(~F.col("_blank"))
    lines = lines.select("value", *L.ORDER, "model_response", J.CORRUPT)
    valid = F.col(J.CORRUPT).isNull()
    repeats = valid & R.is_repeating(F.coalesce(F.col("model_response"), F.lit("")), a.threshold, a.min_len)
    kept, report = S.first_n(lines, valid & ~repeats, L.ORDER, a.max_samples, filtered=repeats)
    kept.select("value").write.mode("overwrite").text(out)
    _show("filter report", report.select("*", (F.col("processed") - F.col("filtered") - F.col("saved")).alias("malformed")))
    print(f"written to {out}")


def cmd_stream_filter(spark, a) -> None:
    """Incremental filter: process the trace files that arrived since the
    last run (or keep running with --continuous)."""
    from .streaming.curate import start_curation
    q = start_curation(spark, a.source, a.sink, a.threshold, a.min_len, checkpoint=a.checkpoint,
                       available_now=not a.continuous)
    q.awaitTermination()
    print(f"appended to {a.sink}")


def _harness_fields(lines: DataFrame, prompt_path: str, response_path: str) -> DataFrame:
    prompt, response = with_fallback(F.col("value"), prompt_path, response_path)
    return lines.select("value", prompt.alias("prompt"), response.alias("response"))


def _json_lines(spark, path: str) -> DataFrame:
    """Non-blank lines that parse as JSON; others are skipped, as the line
    loop skips lines it cannot process."""
    lines = spark.read.text(path).where(py_strip(F.col("value")) != "")
    return lines.where(F.try_parse_json("value").isNotNull())


def cmd_stats(spark, a) -> None:
    lines = _json_lines(spark, a.input)
    rows = _harness_fields(lines, a.prompt_column, a.response_column)
    rows = rows.withColumn("correct", as_correct_json(F.col("value"), [a.correctness_column, "exact_match", "is_correct"]))
    per = P.stats_rows(rows.withColumn("index", F.monotonically_increasing_id()), prompt_col="prompt",
                       response_col="response", correct=F.col("correct"), system=a.system_prompt or None,
                       threshold=a.repetition_threshold, min_len=a.min_sentence_len, with_prompt=False,
                       tokenizer_file=a.tokenizer_file)
    # the text work runs once; the reports read its narrow rows
    per = written(per.select("len", "correct", "is_repeating"), "stats-rows")
    _show("lengths", ST.length_stats(per))
    _show("accuracy", ST.accuracy(per))
    _show("repetition", ST.repetition_rate(per))
    _show("length ranges", ST.length_buckets(per).orderBy("low"))


def cmd_thinking(spark, a) -> None:
    lines = _json_lines(spark, a.input)
    line = F.col("value")
    budget = budget_from_path(F.col("_metadata.file_path"))
    samples = lines.select(
        first_response(F.get_json_object(line, "$.filtered_resps")).alias("resp"),
        F.coalesce(F.get_json_object(line, "$.arguments.gen_args_0.arg_0"), F.lit("")).alias("prompt"),
        F.get_json_object(line, "$.exact_match").alias("exact_match"),
        budget["steps"].alias("step_limit"), budget["tokens"].alias("token_limit"),
        F.col("_metadata.file_path").contains(TOTALS_ONLY_PATH).alias("totals_only"))
    # the run's path decides the format: a step limit means step-limited responses
    rows = ST.thinking_rows(samples.withColumn("resp", F.coalesce("resp", F.lit(""))),
                            tokenizer_file=a.tokenizer_file, step_limit=F.col("step_limit"), totals_only=F.col("totals_only"))
    rows = rows.withColumn("over_budget", F.when(F.col("step_limit").isNull() & ~F.col("totals_only"), F.coalesce(
        F.col("thinking_tokens") > F.col("token_limit"), F.lit(False))).otherwise(F.col("over_budget")))
    rows = written(rows.drop("resp", "prompt"), "thinking-rows")
    _show("thinking", ST.thinking_stats(rows))
    if a.lengths:
        ST.by_thinking_length(rows.withColumn("doc_id", F.monotonically_increasing_id())).write.mode("overwrite").json(a.lengths)
        print(f"lengths written to {a.lengths}")


def _run_spec(spec: str) -> tuple[str, str]:
    """``name=path`` or ``path`` (named by its last folder)."""
    if "=" in spec:
        name, path = spec.split("=", 1)
        return name, path
    return spec.rstrip("/").split("/")[-1], spec


def cmd_compare(spark, a) -> None:
    """Accuracy per run (from harness sample files) and delta to the baseline."""
    specs = [_run_spec(x) for x in a.runs]
    frames = [_json_lines(spark, path).select(
        F.lit(name).alias("run"),
        as_correct_json(F.col("value"), [a.correctness_column]).cast("int").alias("exact_match"))
        for name, path in specs]
    runs = frames[0]
    for f in frames[1:]:
        runs = runs.unionByName(f)
    _show("runs", ST.compare_runs(runs, a.baseline or specs[0][0]).orderBy("run"))


def cmd_train_rows(spark, a) -> None:
    """Rows are written in their training order: the seeded order of the
    files' rows, or with a key of the rows in the key's order."""
    data = J.read_dataset(spark, a.input, fmt=a.format)
    if a.key:
        check_unique_key(data, a.key)
        sampled = D.ordered_sample(data, a.key, a.max_train_samples, a.shuffle_seed, "_place")
    else:
        numbered = L.with_line_numbers(L.with_order(data), "_line")
        sampled = D.in_seeded_order(numbered, "_line", a.shuffle_seed, a.max_train_samples, "_place").drop("_line", *L.ORDER)
    rows = P.training_rows(sampled, None, a.shuffle_seed, "_place", a.prompt_column,
                           a.response_column, a.system_prompt or None, a.text_column)
    J.write_jsonl(rows.orderBy("_place").drop("_place"), a.output)
    print(f"written to {a.output}")


def cmd_assemble(spark, a) -> None:
    steps = J.read_dataset(spark, a.steps, fmt=a.format)
    questions = J.read_dataset(spark, a.questions, fmt=a.format)
    records = P.generate_records(steps, questions, a.mode, a.num_waits, a.max_model_len,
                                 tokenizer_file=a.tokenizer_file, score_full_prompt=a.score_full_prompt,
                                 symbolic=not a.strings_only)
    summary = J.write_split(records.drop("tokens"), a.output, J.derived_name(a.output, "correct"))
    print("== written")
    print(json.dumps(summary.asDict()))
    written = spark.read.schema(J.TRACE_SCHEMA).json(a.output)
    _show("summary", ST.generation_summary(
        written.withColumn("tokens", token_len(F.col("model_response"), a.tokenizer_file))))


def cmd_next_round(spark, a) -> None:
    """Prompts of the next generation step: of all (sampled) questions when
    there are no steps yet, else of the samples that haven't stopped."""
    questions = J.read_dataset(spark, a.questions, fmt=a.format)
    if a.steps is None:
        rounds = B.first_round(questions, a.num_samples, a.seed)
    else:
        steps, q = J.read_dataset(spark, a.steps, fmt=a.format), P.question_set(questions)
        lengths = q.select("sample_id", token_len(F.col("_prompt"), a.tokenizer_file).alias("prompt_tokens"))
        rounds = B.next_round(B.assemble_budget(
            steps, a.mode, a.num_waits, a.max_model_len, prompts=q.withColumnRenamed("_prompt", "prompt"),
            prompt_tokens=lengths, marker_tokens=P.marker_lengths(a.tokenizer_file)))
    J.write_jsonl(rounds, a.output)
    print(f"written to {a.output}")


def build_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tracekit")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)

    f = sub.add_parser("filter")
    f.add_argument("input")
    f.add_argument("output", nargs="?")
    f.add_argument("--threshold", type=int, default=2)
    f.add_argument("--min_len", type=int, default=100)
    f.add_argument("--max_samples", type=int, default=None)

    sf = sub.add_parser("stream-filter")
    sf.add_argument("source")
    sf.add_argument("sink")
    sf.add_argument("--threshold", type=int, default=2)
    sf.add_argument("--min_len", type=int, default=100)
    sf.add_argument("--checkpoint", default=None, help="default: under spark.checkpoint.dir")
    sf.add_argument("--continuous", action="store_true")

    s = sub.add_parser("stats")
    s.add_argument("input")
    s.add_argument("--prompt_column", default="problem")
    s.add_argument("--response_column", default="model_response")
    s.add_argument("--system_prompt", default=C.STATS_SYSTEM_PROMPT)
    s.add_argument("--repetition_threshold", type=int, default=3)
    s.add_argument("--min_sentence_len", type=int, default=50)
    s.add_argument("--correctness_column", default="math_verify")
    s.add_argument("--tokenizer_file", default=None)

    t = sub.add_parser("thinking")
    t.add_argument("input")
    t.add_argument("--tokenizer_file", default=None)
    t.add_argument("--lengths", default=None, help="write (thinking length, correctness) sorted by length here")

    c = sub.add_parser("compare")
    c.add_argument("runs", nargs="+", help="name=path or path (run named by its last folder)")
    c.add_argument("--baseline", default=None, help="run to compare against (default: the first)")
    c.add_argument("--correctness_column", default="exact_match")

    r = sub.add_parser("train-rows")
    r.add_argument("input")
    r.add_argument("output")
    r.add_argument("--prompt_column", default="problem")
    r.add_argument("--response_column", default="model_response")
    r.add_argument("--text_column", default="text")
    r.add_argument("--system_prompt", default=None)
    r.add_argument("--max_train_samples", type=int, default=None)
    r.add_argument("--shuffle_seed", type=int, default=42)
    r.add_argument("--key", default=None, help="a unique column whose order numbers the rows, instead of the files' order")
    r.add_argument("--format", default=None, choices=["json", "parquet"])

    g = sub.add_parser("assemble")
    g.add_argument("steps")
    g.add_argument("questions")
    g.add_argument("output")
    g.add_argument("--mode", default="budget", choices=["budget", "alternating", "none"])
    g.add_argument("--num_waits", type=int, default=5)
    g.add_argument("--max_model_len", type=int, default=4096)
    g.add_argument("--tokenizer_file", default=None)
    g.add_argument("--format", default=None, choices=["json", "parquet"])
    g.add_argument("--score_full_prompt", action="store_true")
    g.add_argument("--strings_only", action="store_true", help="compare answers as strings and numbers, not as expressions")

    n = sub.add_parser("next-round")
    n.add_argument("questions")
    n.add_argument("output")
    n.add_argument("--steps", default=None, help="recorded steps; without them the first round's prompts")
    n.add_argument("--num_samples", type=int, default=0, help="questions of the first round, 0 for all")
    n.add_argument("--seed", type=int, default=42)
    n.add_argument("--mode", default="budget", choices=["budget", "alternating", "none"])
    n.add_argument("--num_waits", type=int, default=5)
    n.add_argument("--max_model_len", type=int, default=4096)
    n.add_argument("--tokenizer_file", default=None)
    n.add_argument("--format", default=None, choices=["json", "parquet"])
    return ap


COMMANDS = {"filter": cmd_filter, "stream-filter": cmd_stream_filter, "stats": cmd_stats, "thinking": cmd_thinking, "compare": cmd_compare,
            "train-rows": cmd_train_rows, "assemble": cmd_assemble, "next-round": cmd_next_round}


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = get_spark(a.master)
    COMMANDS[a.cmd](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
