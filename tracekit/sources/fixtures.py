"""Input tables and the derived record views the operators run on.

The driver's tables carry no boxed answers, chat markers or generation
steps, so four deterministic views add them (``traces``, ``gen_steps``,
``samples``, ``runs``). Each is built here with the DataFrame API for Spark,
and kept as SQL text for the DuckDB oracle; both read the whole base tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]
# tables whose rows carry long texts: spread them before regex work
_TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id",
              "benchmark": "item_id"}


OVERLONG_WORDS = 33_000  # more than a sample's context of 32760 tokens


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if name in _TEXT_KEYS:
        df = spread(df, _TEXT_KEYS[name])
    return df


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated-trace records (index, problem, ground_truth, model_response,
    is_correct, truncated, steps), one per document."""
    return traces_of(table(spark, sf_dir, "documents"))


def traces_of(d: DataFrame) -> DataFrame:
    """``traces`` of a (static or streaming) documents table: every tenth
    text says its first paragraph twice more."""
    head = F.substring_index(d.text, "\n", 1)
    body = F.when(d.doc_id % 10 == 3, F.concat(d.text, F.lit(" "), head, F.lit(". "), head, F.lit(". "))
                  ).otherwise(d.text)
    n = (d.doc_id % 97 + F.when(d.doc_id % 3 == 0, 1).otherwise(0)).cast("string")
    k = F.floor(d.doc_id / 3) % 7
    final = (F.when(k == 0, F.concat(F.lit(" Final: $\\boxed{"), n, F.lit("}$")))
             .when(k == 1, F.concat(F.lit(" Final: $\\boxed{\\frac{"), n, F.lit("}{1}}$")))
             .when(k == 2, F.concat(F.lit(" Final: $\\boxed "), n, F.lit("$ here")))
             .when(k == 3, F.concat(F.lit(" Final: $\\fbox{x = "), n, F.lit(".0}$")))
             .when(k == 4, F.concat(F.lit(" Final Answer: The final answer is $"), n, F.lit("$. I hope it is correct.")))
             .when(k == 5, F.concat(F.lit(" Final: $\\boxed{\\text{"), n, F.lit("}}$")))
             .otherwise(F.lit(" No final answer.")))
    return d.select(
        d.doc_id.alias("index"),
        F.concat(F.lit("Q"), d.doc_id.cast("string")).alias("problem"),
        (d.doc_id % 97).cast("string").alias("ground_truth"),
        F.concat(body, final).alias("model_response"),
        (d.doc_id % 3 != 0).alias("is_correct"),
        (d.n_chars > 8000).alias("truncated"),
        (d.doc_id % 4).cast("int").alias("steps"),
    )


def _stated(sample: Column) -> Column:
    """The answer that a sample's steps state: of six samples two the right
    one, one of these in value only, one a wrong one, one a sentence without
    a box, one a fraction, one none."""
    n = (sample % 97).cast("string")
    return (F.when(sample % 6 == 0, F.concat(F.lit(" So $\\boxed{"), n, F.lit("}$.")))
            .when(sample % 6 == 1, F.concat(F.lit(" So $\\boxed{"), n, F.lit(".0}$.")))
            .when(sample % 6 == 2, F.concat(F.lit(" So $\\boxed{x = "), (sample % 97 + 1).cast("string"), F.lit("}$.")))
            .when(sample % 6 == 3, F.concat(F.lit(" Final Answer: The final answer is "), n, F.lit(". I hope it is correct.")))
            .when(sample % 6 == 4, F.concat(F.lit(" So $\\fbox{\\frac{"), n, F.lit("}{1}}$.")))
            .otherwise(F.lit("")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, problem, answer): the first user turn of a conversation."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.groupBy(F.col("conv_id").alias("sample_id")).agg(F.min_by("text", "turn").alias("problem")).select(
        "sample_id", "problem", (F.col("sample_id") % 97).cast("string").alias("answer"))


def gen_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation-step records (sample_id, step, gen_text, gen_tokens,
    finish_reason) from the assistant turns of each conversation.

    The key is renamed before the window, so the window's partitioning is on
    ``sample_id`` and every later per-sample step reuses it."""
    c = (table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
         .select(F.col("conv_id").alias("sample_id"), "turn",
                 F.concat("text", _stated(F.col("conv_id"))).alias("gen_text")))
    w = Window.partitionBy("sample_id").orderBy("turn")
    return c.select(
        "sample_id",
        (F.row_number().over(w) - 1).cast("int").alias("step"),
        "gen_text",
        F.length("gen_text").cast("int").alias("gen_tokens"),
        F.when(F.length("gen_text") > 2000, "length").otherwise("stop").alias("finish_reason"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation-harness samples (doc_id, exact_match, prompt, resp) in the
    free thinking format, one per conversation."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.when(c.role == "assistant", F.struct("turn", "text"))))
    g = c.groupBy("conv_id").agg(
        F.coalesce(F.min_by(F.when(c.role == "user", c.text), F.when(c.role == "user", c.turn)), F.lit("")).alias("prompt"),
        F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("said"))
    opener = F.when(g.conv_id % 11 == 4, F.lit("")).otherwise(F.lit("<|im_start|>think\n"))
    filler = F.when(g.conv_id % 50 == 17, F.repeat(F.lit(" word"), OVERLONG_WORDS)).otherwise(F.lit(""))
    tail = F.when(g.conv_id % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("\n<|im_start|>answer\nAnswer: "), g.conv_id.cast("string")))
    return g.select(
        g.conv_id.alias("doc_id"),
        (g.conv_id % 2).cast("int").alias("exact_match"),
        g.prompt,
        F.concat(opener, g.said, filler, tail).alias("resp"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run, per-item correctness for comparing methods."""
    lab = table(spark, sf_dir, "labels")
    base = lab.select(F.lit("base").alias("run"), "doc_id", F.col("quality").alias("exact_match"))
    tuned = lab.select(F.lit("tuned").alias("run"), "doc_id",
                       F.greatest(lab.quality, 1 - lab.toxic).alias("exact_match"))
    return base.unionByName(tuned)


def step_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the step-limited format: every assistant turn becomes a
    ``<|im_start|>N steps left`` step, followed by an answer section."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    steps = c.select("conv_id", "turn", "text", F.row_number().over(w).alias("rn"),
                     F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("cnt"))
    marker = F.concat(F.lit("<|im_start|>"), (F.col("cnt") - F.col("rn")).cast("string"), F.lit(" steps left\n"))
    piece = F.concat(F.when(F.col("conv_id") % 13 == 5, F.lit("")).otherwise(marker), F.col("text"))
    g = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("ps"))
    return g.select(F.col("conv_id").alias("doc_id"), F.concat(
        F.array_join(F.transform("ps", lambda x: x["p"]), ""),
        F.when(F.col("conv_id") % 50 == 17, F.repeat(F.lit(" word"), OVERLONG_WORDS)).otherwise(F.lit("")),
        F.when(F.col("conv_id") % 7 == 3, F.lit("")).otherwise(
            F.concat(F.lit("<|im_start|>answer\nAnswer: "), F.col("conv_id").cast("string")))).alias("resp"))


def run_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result-file paths in the naming styles runs are stored under."""
    d = table(spark, sf_dir, "documents")
    k = d.doc_id % 5
    path = (F.when(k == 0, F.concat(F.lit("results/bf-step"), (d.doc_id % 64).cast("string"),
                                    F.lit("forcing/samples.jsonl")))
            .when(k == 1, F.concat(F.lit("runs/m-"), (d.doc_id % 50).cast("string"),
                                   F.lit("steps_32kctxt/"), d.source, F.lit(".jsonl")))
            .when(k == 2, F.concat(F.lit("out/"), d.lang, F.lit("-"), (d.doc_id % 4096).cast("string"),
                                   F.lit("tokens/s.jsonl")))
            .when(k == 3, F.concat(F.lit("a/stepX_"), d.doc_id.cast("string"), F.lit("tokens/c")))
            .otherwise(F.concat(F.lit("plain/"), d.source, F.lit("/"), d.doc_id.cast("string"),
                                F.lit(".jsonl"))))
    return d.select("doc_id", path.alias("path"))


# The same views as SQL text (FIXTURES B1–B4) for the DuckDB oracle.
VIEW_SQL = {
    "traces": """
select d.doc_id as index, concat('Q', cast(d.doc_id as string)) as problem,
  cast(d.doc_id % 97 as string) as ground_truth,
  concat(case when d.doc_id % 10 = 3
              then concat(d.text, ' ', split_part(d.text, chr(10), 1), '. ', split_part(d.text, chr(10), 1), '. ')
              else d.text end,
         case (d.doc_id // 3) % 7
           when 0 then ' Final: $' || chr(92) || 'boxed{' || n || '}$'
           when 1 then ' Final: $' || chr(92) || 'boxed{' || chr(92) || 'frac{' || n || '}{1}}$'
           when 2 then ' Final: $' || chr(92) || 'boxed ' || n || '$ here'
           when 3 then ' Final: $' || chr(92) || 'fbox{x = ' || n || '.0}$'
           when 4 then ' Final Answer: The final answer is $' || n || '$. I hope it is correct.'
           when 5 then ' Final: $' || chr(92) || 'boxed{' || chr(92) || 'text{' || n || '}}$'
           else ' No final answer.' end) as model_response,
  (d.doc_id % 3 <> 0) as is_correct, (d.n_chars > 8000) as truncated,
  cast(d.doc_id % 4 as int) as steps
from (select *, cast(doc_id % 97 + case when doc_id % 3 = 0 then 1 else 0 end as string) as n from documents) d""",
    "gen_steps": """
select conv_id as sample_id,
  cast(row_number() over (partition by conv_id order by turn) - 1 as int) as step,
  said as gen_text, cast(length(said) as int) as gen_tokens,
  case when length(said) > 2000 then 'length' else 'stop' end as finish_reason
from (select conv_id, turn, text || case conv_id % 6
        when 0 then ' So $' || chr(92) || 'boxed{' || (conv_id % 97)::varchar || '}$.'
        when 1 then ' So $' || chr(92) || 'boxed{' || (conv_id % 97)::varchar || '.0}$.'
        when 2 then ' So $' || chr(92) || 'boxed{x = ' || (conv_id % 97 + 1)::varchar || '}$.'
        when 3 then ' Final Answer: The final answer is ' || (conv_id % 97)::varchar || '. I hope it is correct.'
        when 4 then ' So $' || chr(92) || 'fbox{' || chr(92) || 'frac{' || (conv_id % 97)::varchar || '}{1}}$.'
        else '' end as said
      from conversations where role = 'assistant')""",
    "questions": """
select conv_id as sample_id, arg_min(text, turn) as problem, cast(conv_id % 97 as varchar) as answer
from conversations where role = 'user' group by conv_id""",
    "samples": """
select conv_id as doc_id, cast(conv_id % 2 as int) as exact_match,
  coalesce(arg_min(text, turn) filter (where role = 'user'), '') as prompt,
  concat(case when conv_id % 11 = 4 then '' else concat('<|im_start|>think', chr(10)) end,
    coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'assistant'), ''),
    case when conv_id % 50 = 17 then repeat(' word', 33000) else '' end,
    case when conv_id % 7 = 0 then ''
         else concat(chr(10), '<|im_start|>answer', chr(10), 'Answer: ', cast(conv_id as string)) end) as resp
from conversations group by conv_id""",
    "runs": """
select 'base' as run, doc_id, quality as exact_match from labels
union all select 'tuned' as run, doc_id, greatest(quality, 1 - toxic) as exact_match from labels""",
    "step_samples": """
select conv_id as doc_id,
  string_agg(case when conv_id % 13 = 5 then '' else '<|im_start|>' || cast(cnt - rn as varchar) || ' steps left' || chr(10) end
             || text, '' order by turn)
    || case when conv_id % 50 = 17 then repeat(' word', 33000) else '' end
    || case when conv_id % 7 = 3 then '' else '<|im_start|>answer' || chr(10) || 'Answer: ' || cast(conv_id as varchar) end as resp
from (select *, row_number() over (partition by conv_id order by turn) as rn,
             count(*) over (partition by conv_id) as cnt
      from conversations where role = 'assistant')
group by conv_id""",
    "run_paths": """
select doc_id, case doc_id % 5
  when 0 then 'results/bf-step' || cast(doc_id % 64 as varchar) || 'forcing/samples.jsonl'
  when 1 then 'runs/m-' || cast(doc_id % 50 as varchar) || 'steps_32kctxt/' || source || '.jsonl'
  when 2 then 'out/' || lang || '-' || cast(doc_id % 4096 as varchar) || 'tokens/s.jsonl'
  when 3 then 'a/stepX_' || cast(doc_id as varchar) || 'tokens/c'
  else 'plain/' || source || '/' || cast(doc_id as varchar) || '.jsonl' end as path
from documents""",
}


def with_views(sql: str, *names: str, extra: tuple[str, ...] = ()) -> str:
    """Prefix ``sql`` with the named views, then ``extra`` CTEs."""
    ctes = [f"{n} as ({VIEW_SQL[n]}\n)" for n in names] + list(extra)
    return "with " + ",\n".join(ctes) + "\n" + sql if ctes else sql
