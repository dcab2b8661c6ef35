"""Registered queries that go through files: the record views are written as
files by Spark, in an order of their own, and read back by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions.records import missing_columns, with_fallback
from ..operators import ordering as D
from ..operators import percentiles as Q
from ..operators import render as E
from ..operators import repeat as R
from ..operators import sampling as S
from ..operators.scoring import score_columns
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import jsonl as J
from ..sources import lines as L
from ..streaming import rounds as W
from . import oracle as O
from .catalog import _BUDGET_SELECT, _budget_out, _budget_sql, _flagged_sql, _value, register

# the order of the lines in the files, which is not that of the index
_FILE_ORDER = "md5(cast(index as varchar)), index"


def _file_order() -> list:
    return [F.md5(F.col("index").cast("string")), F.col("index")]


def _written_lines(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


@register("first_lines_kept", X.with_views(
    f"""select line, index from (
          select index, row_number() over (order by {_FILE_ORDER}) - 1 as line from traces)
        where index not in {_flagged_sql('traces', 'model_response', 3, 20)} order by line limit 150""", "traces"))
def q_first_lines_kept(spark, sf):
    path = _written_lines(spark, X.traces(spark, sf).orderBy(*_file_order()), "trace-lines")
    lines = J.read_traces(spark, path, ordered=True)
    kept, _ = S.first_n(lines, ~R.is_repeating(F.col("model_response"), 3, 20), L.ORDER, 150)
    return L.with_line_numbers(lines.select("index", *L.ORDER)).join(kept.select("index"), "index").select("line", "index")


@register("positional_scores", X.with_views(
    f"""select coalesce(o.line, g.line) as line, cast(o.pred is not null and g.line is not null
              and {_value('o.pred')} = {_value('g.gold')} and o.pred not in ('', '[invalidanswer]') as int) as exact_match,
            case when g.line is null then 'left' when o.line is null then 'right' end as only_in
        from (select row_number() over (order by {_FILE_ORDER}) - 1 as line, {O.normalize(O.raw_answer('model_response'))} as pred
              from traces where md5(cast(index as varchar)) < 'f8') o
        full join (select row_number() over (order by {_FILE_ORDER}) - 1 as line, {O.normalize('ground_truth')} as gold
                   from traces where index % 50 <> 49 or md5(cast(index as varchar)) < '80') g on o.line = g.line""", "traces"))
def q_positional_scores(spark, sf):
    t, digest = X.traces(spark, sf), F.md5(F.col("index").cast("string"))
    outputs = t.where(digest < "f8").orderBy(*_file_order()).select("model_response")
    gold = t.where((F.col("index") % 50 != 49) | (digest < "80")).orderBy(*_file_order()).select("ground_truth")
    numbered = [L.with_line_numbers(J.read_traces(spark, _written_lines(spark, df, "lines"), ordered=True).select(*df.columns, *L.ORDER)).drop(*L.ORDER)
                for df in (outputs, gold)]
    both = L.align(*numbered)
    scored = score_columns(both, "model_response", "ground_truth")
    return scored.select("line", "exact_match", F.col("_only").alias("only_in"))


def _place_sql(rows: str, seed: int) -> str:
    """The places of (row, position) pairs by the same moves, walked on by recursion."""
    def half(step: int, other: str, side: str) -> str:
        return f"('0x' || substr(md5('{seed}:{step}:' || {other}), 1, {D.HEX}))::bigint % {side}"

    def moved(source: str) -> str:
        sql = f"select key, a, b, rows, place // b as l, place % b as r from ({source})"
        for step in range(0, 2 * D.ROUNDS, 2):
            sql = f"select key, a, b, rows, (l + {half(step, 'r', 'a')}) % a as l, r from ({sql})"
            sql = f"select key, a, b, rows, l, (r + {half(step + 1, 'l', 'b')}) % b as r from ({sql})"
        return f"select key, a, b, rows, l * b + r as place from ({sql})"

    return f"""sides as (select n as rows, a, greatest(1, ceil(n / a)::bigint) as b
  from (select count(*) as n, greatest(1, ceil(sqrt(count(*)))::bigint) as a from ({rows}))),
walk as ({moved(f'select key, a, b, rows, position as place from ({rows}), sides')}
  union all {moved('select * from walk where place >= rows')})"""


@register("ordered_sample", "with recursive " + _place_sql("select doc_id as key, row_number() over (order by doc_id) - 1 as position from documents", 42)
          + " select key as index, place from walk where place < least(rows, 250)")
def q_ordered_sample(spark, sf):
    return D.ordered_sample(X.traces(spark, sf).select("index"), "index", 250, 42).select("index", "place")


@register("seeded_line_order", "with recursive " + X.with_views("", "traces").removeprefix("with ").strip() + ", " + _place_sql(
    f"select index as key, row_number() over (order by {_FILE_ORDER}) - 1 as position from traces", 7)
          + " select key as index, place from walk where place < rows")
def q_seeded_line_order(spark, sf):
    path = _written_lines(spark, X.traces(spark, sf).orderBy(*_file_order()).select("index", "problem"), "trace-lines")
    lines = L.with_line_numbers(J.read_traces(spark, path, ordered=True).select("index", *L.ORDER))
    return D.in_seeded_order(lines, "line", 7).select("index", "place")


# --------------------------------------------------------------------------- readers and writers

@register("read_samples_lines", X.with_views(
    "select doc_id, exact_match, md5(resp) as resp_md5 from samples where doc_id % 9 <> 4", "samples"))
def q_read_samples_lines(spark, sf):
    """Blank lines, broken lines and lines of another kind between the samples are skipped."""
    s = X.samples(spark, sf)
    line = (F.when(s.doc_id % 9 == 4, F.concat(F.lit('{"doc_id": '), s.doc_id.cast("string"), F.lit(', "resp": "cut off')))
            .otherwise(F.to_json(F.struct("doc_id", "exact_match", "prompt", "resp"))))
    path = scratch_path(spark, "sample-lines")
    s.select(F.explode(F.array(line, F.when(s.doc_id % 5 == 0, F.lit(" \t")).otherwise(F.lit("[1, 2]")))).alias("value")).write.text(path)
    got = J.read_samples(spark, path, "doc_id long, exact_match int, resp string")
    return got.select("doc_id", "exact_match", F.md5("resp").alias("resp_md5"))


@register("dataset_roundtrip", X.with_views(
    """select index, problem, ground_truth, md5(model_response) as response_md5, case when index % 4 <> 1 then is_correct end as is_correct, truncated, steps
       from traces where index % 3 <> 2""", "traces"))
def q_dataset_roundtrip(spark, sf):
    """Written as JSON lines over an earlier version, and read by suffix; null fields stay."""
    t = X.traces(spark, sf)
    path = scratch_path(spark, "traces") + ".jsonl"
    J.write_jsonl(t.select("index"), path)
    J.write_jsonl(t.where("index % 3 <> 2").withColumn("is_correct", F.when(F.col("index") % 4 != 1, F.col("is_correct"))), path)
    got = J.read_dataset(spark, path, J.TRACE_SCHEMA)
    return got.select("index", "problem", "ground_truth", F.md5("model_response").alias("response_md5"), "is_correct", "truncated", "steps")


@register("committed_split", X.with_views(
    """select index, md5(model_response) as response_md5, cast(is_correct and not truncated as int) as in_correct,
         (select count(*) from traces) as total, (select count(*) from traces where is_correct and not truncated) as saved from traces""", "traces"))
def q_committed_split(spark, sf):
    path = scratch_path(spark, "split")
    J.commit_split(X.traces(spark, sf), path)
    found = J.read_manifest(spark, path)
    whole, correct = J.read_split(spark, path)
    both = whole.select("index", F.md5("model_response").alias("response_md5")).join(
        correct.select(F.col("index").alias("i"), F.lit(1).alias("one")), F.col("index") == F.col("i"), "left")
    return both.select("index", "response_md5", F.coalesce("one", F.lit(0)).alias("in_correct"),
                       F.lit(found["total"]).cast("long").alias("total"), F.lit(found["saved"]).cast("long").alias("saved"))


@register("derived_names", X.with_views(
    """select doc_id, case when path like '%.jsonl%' then replace(path, '.jsonl', '_filtered.jsonl') else path || '.filtered' end as name
       from run_paths""", "run_paths"))
def q_derived_names(spark, sf):
    return X.run_paths(spark, sf).select("doc_id", J.derived_name_column(F.col("path"), "filtered").alias("name"))


@register("prompt_fallback", X.with_views(
    """select doc_id, case when doc_id % 3 = 1 then prompt when doc_id % 3 = 2 then prompt else '' end as prompt,
         md5(case when doc_id % 4 = 3 and doc_id % 3 = 2 then '' else resp end) as resp_md5 from samples""", "samples"))
def q_prompt_fallback(spark, sf):
    """Records with their own fields, in the harness's layout, and with neither."""
    s = X.samples(spark, sf)
    own = F.to_json(F.struct(F.struct(s.prompt.alias("text")).alias("q"), F.array(s.resp).alias("answers")))
    harness = F.to_json(F.struct(F.struct(s.prompt.alias("problem")).alias("doc"), F.when(s.doc_id % 4 != 3, F.array(F.array(s.resp))).alias("filtered_resps")))
    answer_only = F.to_json(F.struct(F.array(s.resp).alias("answers")))
    line = F.when(s.doc_id % 3 == 1, own).when(s.doc_id % 3 == 2, harness).otherwise(answer_only)
    path = scratch_path(spark, "records")
    s.select(F.to_json(F.struct("doc_id", line.alias("line"))).alias("value")).write.text(path)
    read = spark.read.schema("doc_id long, line string").json(path)
    prompt, response = with_fallback(F.col("line"), "q.text", "answers[0]")
    return read.select("doc_id", prompt.alias("prompt"), F.md5(response).alias("resp_md5"))


@register("required_columns", X.with_views(
    """select 'traces' as name, count(*) as n, '' as missing from traces
       union all select 'questions', count(*), 'model_response' from questions
       union all select 'samples', count(*), 'problem,model_response' from samples""", "traces", "questions", "samples"))
def q_required_columns(spark, sf):
    """The record views against the columns that training rows need."""
    views = {"traces": X.traces(spark, sf), "questions": X.questions(spark, sf), "samples": X.samples(spark, sf)}
    found = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", F.lit(
        ",".join(missing_columns(df, ["problem", "model_response"]))).alias("missing")) for name, df in views.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --------------------------------------------------------------------------- percentiles

@register("length_stats_refined", """
select count(v) as n, avg(v) as mean_len, min(v) as min_len, max(v) as max_len, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.9), 6) as p90,
  round(quantile_cont(v, 0.95), 6) as p95, round(quantile_cont(v, 0.99), 6) as p99
from (select length(text) * 100003 + doc_id as v from documents)""")
def q_length_stats_refined(spark, sf):
    """A column in which every value is its own."""
    d = X.table(spark, sf, "documents")
    return Q.refined_length_stats(d.select((F.length("text").cast("long") * 100003 + F.col("doc_id")).alias("v")), "v")


# --------------------------------------------------------------------------- conversations and rounds

@register("render_turns",
          f"""select conv_id, n_turns, cast(length(t) as bigint) as text_len, md5(t) as text_md5
              from (select conv_id, count(*) as n_turns, string_agg({O.nl(C.IM_START)} || role || chr(10) || text || {O.nl(C.IM_END)} || chr(10), ''
                                                                    order by turn) as t
                    from conversations group by conv_id)""")
def q_render_turns(spark, sf):
    """Conversations as training texts, rendered in ranges of turns."""
    t = E.render_turns(X.table(spark, sf, "conversations"))
    return t.select("conv_id", "n_turns", F.length("text").cast("bigint").alias("text_len"), F.md5("text").alias("text_md5"))


@register("stream_rounds", _budget_sql("alternating", 4, 2000, _BUDGET_SELECT))
def q_stream_rounds(spark, sf):
    """Recorded steps arrive as files in no order of their own; the stream's last rows are the assembled traces and open prompts."""
    steps = X.gen_steps(spark, sf)
    source, sink = scratch_path(spark, "arriving-steps"), scratch_path(spark, "rounds")
    steps.repartition(4, F.md5(F.concat_ws(":", "sample_id", "step"))).write.parquet(source)
    query = W.start_rounds(spark, source, sink, steps.schema, "alternating", 4, 2000, files_per_batch=2, checkpoint=scratch_path(spark, "rounds-state"))
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    prompts = X.questions(spark, sf).select("sample_id", C.start_prompt(F.col("problem")).alias("prompt"))
    rows = W.latest(spark, sink).join(prompts, "sample_id", "left")
    return _budget_out(rows.withColumn("response", F.concat(F.coalesce("prompt", F.lit("")), "generation")))
