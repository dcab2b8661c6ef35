"""Registered queries: one Spark plan per operator, each with a DuckDB
oracle that reads the same base tables.

Every query reads whole tables (through the derived record views) and
returns keys, counts, lengths or md5 digests instead of long texts, so the
oracle compare stays cheap without cutting any input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import chat as C
from ..functions.text import token_len
from ..operators import budget as B
from ..operators import repeat as R
from ..operators import sampling as S
from ..operators import stats as ST
from ..operators.scoring import score
from ..sources import fixtures as X
from . import oracle as O
from .pipelines import stats_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _flagged_sql(src: str, text: str, threshold: int, min_len: int, key: str = "index") -> str:
    """Ids whose text repeats a sentence: unnest + GROUP BY in DuckDB."""
    return (f"(select distinct {key} from (select {key}, unnest({O.sentence_list(text, min_len)}) as sentence "
            f"from {src}) group by {key}, sentence having count(*) >= {threshold})")


# --------------------------------------------------------------------------- filters


@register("correct_untruncated", X.with_views(
    "select index, steps from traces where is_correct and not truncated", "traces"))
def q_correct_untruncated(spark, sf):
    return S.correct_untruncated(X.traces(spark, sf)).select("index", "steps")


@register("repeat_filter_t2", X.with_views(
    f"select index, steps from traces where index not in {_flagged_sql('traces', 'model_response', 2, 100)}",
    "traces"))
def q_repeat_filter_t2(spark, sf):
    return R.drop_repeating(X.traces(spark, sf), "model_response", 2, 100).select("index", "steps")


@register("repeat_filter_t3", X.with_views(
    f"select index, steps from traces where index not in {_flagged_sql('traces', 'model_response', 3, 20)}",
    "traces"))
def q_repeat_filter_t3(spark, sf):
    return R.drop_repeating(X.traces(spark, sf), "model_response", 3, 20).select("index", "steps")


@register("repeat_flags", X.with_views(
    f"select index, index in {_flagged_sql('traces', 'model_response', 3, 50)} as is_repeating from traces",
    "traces"))
def q_repeat_flags(spark, sf):
    return R.repetition_flags(X.traces(spark, sf), "model_response", 3, 50).select("index", "is_repeating")


@register("repeated_sentences", X.with_views(
    f"""select index, sentence, count(*) as n from (
          select index, unnest({O.sentence_list('model_response', 20)}) as sentence from traces)
        group by index, sentence having count(*) >= 2""", "traces"))
def q_repeated_sentences(spark, sf):
    return R.repeated_sentences(X.traces(spark, sf), "index", "model_response", 2, 20)


@register("filter_report", X.with_views(
    """select count(*) as processed,
              count(*) filter (where index in (select index from f)) as filtered,
              count(*) filter (where index not in (select index from f)) as saved from c""",
    "traces", extra=("c as (select * from traces where is_correct and not truncated)",
                     f"f as {_flagged_sql('c', 'model_response', 2, 100)}")))
def q_filter_report(spark, sf):
    c = S.correct_untruncated(X.traces(spark, sf))
    return ST.filter_report(R.repetition_flags(c, "model_response", 2, 100))


_KEEP_SQL = ("c as (select * from traces where is_correct and not truncated)",
             f"f as {_flagged_sql('c', 'model_response', 3, 21)}",
             "k as (select index from c where index not in (select index from f))")


@register("first_n_kept", X.with_views(
    "select index from k order by index limit 250", "traces", extra=_KEEP_SQL))
def q_first_n_kept(spark, sf):
    c = S.correct_untruncated(X.traces(spark, sf))
    keep = ~R.is_repeating(F.col("model_response"), 3, 21)
    return S.first_n_kept(c, keep, "index", 250).select("index")


@register("first_n_report", X.with_views(
    """select count(*) as processed,
              count(*) filter (where index in (select index from f)) as filtered,
              count(*) filter (where index not in (select index from f)) as saved
       from c where (select case when count(*) >= 250 then max(index) end
                     from (select index from k order by index limit 250)) is null
                 or index <= (select max(index) from (select index from k order by index limit 250))""",
    "traces", extra=_KEEP_SQL))
def q_first_n_report(spark, sf):
    c = S.correct_untruncated(X.traces(spark, sf))
    keep = ~R.is_repeating(F.col("model_response"), 3, 21)
    return S.first_n_report(c, keep, "index", 250)


@register("seeded_sample", X.with_views(
    "select index from traces order by md5('42:' || cast(index as varchar)), index limit 250", "traces"))
def q_seeded_sample(spark, sf):
    return S.seeded_sample(X.traces(spark, sf), 250, 42, "index").select("index")


# --------------------------------------------------------------------------- statistics

def _stats_rows_cte() -> str:
    resp = f"({O.start_prompt('problem', C.GENERATION_SYSTEM_PROMPT)} || model_response)"
    text = O.render([("system", O.nl(C.STATS_SYSTEM_PROMPT)), ("user", O.question_prompt("problem")),
                     ("assistant", O.assistant_segment(resp))])
    return (f"rows as (select index, {O.word_count(text)} as len, is_correct as correct, "
            f"index in {_flagged_sql('traces', 'model_response', 3, 50)} as is_repeating from traces)")


def _with_rows(sql: str) -> str:
    return X.with_views(sql, "traces", extra=(_stats_rows_cte(),))


@register("length_stats", _with_rows(
    """select count(len) as n, avg(len) as mean_len, cast(min(len) as bigint) as min_len,
              cast(max(len) as bigint) as max_len,
              round(quantile_cont(len, 0.5), 6) as p50, round(quantile_cont(len, 0.9), 6) as p90,
              round(quantile_cont(len, 0.95), 6) as p95, round(quantile_cont(len, 0.99), 6) as p99
       from rows"""))
def q_length_stats(spark, sf):
    return ST.length_stats(stats_rows(X.traces(spark, sf)))


@register("length_buckets", _with_rows(
    """select bucket, cast(min(low) as bigint) as low, count(*) as n,
              count(*) / sum(count(*)) over () as share,
              count(*) filter (where correct) / count(*) as accuracy
       from (select *, case when len < 512 then '0-512' when len < 1024 then '512-1024'
                            when len < 2048 then '1024-2048' when len < 4096 then '2048-4096'
                            when len < 8192 then '4096-8192' when len < 16384 then '8192-16384'
                            else '16384+' end as bucket,
                       case when len < 512 then 0 when len < 1024 then 512 when len < 2048 then 1024
                            when len < 4096 then 2048 when len < 8192 then 4096
                            when len < 16384 then 8192 else 16384 end as low
             from rows) group by bucket"""))
def q_length_buckets(spark, sf):
    return ST.length_buckets(stats_rows(X.traces(spark, sf)))


@register("repetition_rate", _with_rows(
    """select count(*) as n, count(*) filter (where is_repeating) as n_repeating,
              count(*) filter (where is_repeating) / count(*) as share from rows"""))
def q_repetition_rate(spark, sf):
    return ST.repetition_rate(stats_rows(X.traces(spark, sf)))


@register("generation_summary", X.with_views(
    f"""select count(*) as total, count(*) filter (where is_correct) as n_correct,
               count(*) filter (where is_correct) / count(*) as accuracy,
               avg(tokens) as avg_tokens, avg(tokens) filter (where is_correct) as avg_correct_tokens,
               count(*) filter (where is_correct and not truncated) as saved
        from (select *, {O.word_count('model_response')} as tokens from traces)""", "traces"))
def q_generation_summary(spark, sf):
    t = X.traces(spark, sf).withColumn("tokens", token_len(F.col("model_response")))
    return ST.generation_summary(t)


@register("run_comparison", X.with_views(
    """select run, count(*) as n, avg(cast(exact_match as double)) as accuracy,
              avg(cast(exact_match as double)) - max(case when run = 'base' then avg(cast(exact_match as double)) end) over () as delta
       from runs group by run""", "runs"))
def q_run_comparison(spark, sf):
    return ST.compare_runs(X.runs(spark, sf), "base")


# --------------------------------------------------------------------------- answers


@register("last_boxed", X.with_views(
    f"select index, {O.last_boxed('model_response')} as boxed from traces", "traces"))
def q_last_boxed(spark, sf):
    return X.traces(spark, sf).select("index", A.last_boxed(F.col("model_response")).alias("boxed"))


@register("final_answers", X.with_views(
    f"select index, {O.normalize(O.raw_answer('model_response'))} as pred from traces", "traces"))
def q_final_answers(spark, sf):
    return X.traces(spark, sf).select("index", A.final_answer(F.col("model_response")).alias("pred"))


# what follows the last equals sign of a turn, so that the rewrites have something to do
_LATEX = [" = \\frac12$", " = \\sqrt5 \\text{cm}", " = $1,234$", " = \\textbf{x}\\text{ and }y", " = \\frac{3}4 dollars", " = \\overline{AB}", ""]


@register("normalize_answer",
          "select conv_id, cast(turn as bigint) as turn, "
          + O.normalize("(text || case (conv_id + turn) % 7 " + " ".join(f"when {i} then {O.sq(x)}" for i, x in enumerate(_LATEX)) + " end)")
          + " as norm from conversations")
def q_normalize_answer(spark, sf):
    c = X.table(spark, sf, "conversations")
    tail = F.get(F.array(*[F.lit(x) for x in _LATEX]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_LATEX))).cast("int"))
    return c.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                    A.normalize_answer(F.concat("text", tail)).alias("norm"))


def _value(x: str) -> str:
    """A whole number written as one, with ``.0`` or over 1, as itself."""
    over_one = O.sq("^" + chr(92) * 2 + "frac[{]([0-9]+)[}][{]1[}]$")
    return f"regexp_replace(regexp_replace({x}, '[.]0$', ''), {over_one}, {O.sq(chr(92) + '1')})"


@register("score_answers", X.with_views(
    f"""select index, pred, gold, cast({_value('pred')} = {_value('gold')} and pred not in ('', '[invalidanswer]') as int) as exact_match
        from (select index, {O.normalize(O.raw_answer('model_response'))} as pred,
                     {O.normalize('ground_truth')} as gold from traces)""", "traces"))
def q_score_answers(spark, sf):
    t = X.traces(spark, sf)
    out = score(t.select("index", "model_response"), t.select("index", F.col("ground_truth").alias("answer")),
                "index")
    return out.select("index", "pred", "gold", "exact_match")


# Answers as formulas of a number r, and the kind of each: 0 the number, 1 times
# the root of 2, 2 and 3 the polynomials x + r and its square, 4 no formula.
_WRITTEN = [("{r}", 0), ("\\frac{{{r2}}}{{2}}", 0), ("\\sqrt{{{rr}}}", 0), ("{r}.0", 0), ("{r}\\sqrt{{2}}", 1), ("\\sqrt{{{rr2}}}", 1),
            ("\\frac{{{r2}}}{{\\sqrt{{2}}}}", 1), ("x+{r}", 2), ("\\frac{{x^2-{rr}}}{{x-{r}}}", 2), ("(x+{r})^2", 3), ("x^2+{r2}x+{rr}", 3),
            ("{r}\\mapsto x", 4)]
_GOLD_WRITTEN = ["{r}", "{r}\\sqrt{{2}}", "{r}+x", "(x+{r})(x+{r})", "{r}\\mapsto x"]


def _formula(template: str, r: Column) -> Column:
    """The template with the numbers of ``r`` filled in."""
    out = F.lit(template.replace("{{", "{").replace("}}", "}")) if "{r" not in template else None
    if out is None:
        marks = {"{r}": r, "{r2}": r * 2, "{rr}": r * r, "{rr2}": r * r * 2}
        parts, rest = [], template
        while any(m in rest for m in marks):
            at, mark = min((rest.index(m), m) for m in marks if m in rest)
            parts += [F.lit(rest[:at].replace("{{", "{").replace("}}", "}")), marks[mark].cast("string")]
            rest = rest[at + len(mark):]
        out = F.concat(*parts, F.lit(rest.replace("{{", "{").replace("}}", "}")))
    return out


@register("symbolic_answers", """
select index, cast(kind = gold_kind and r = m as int) as exact_match
from (select doc_id as index, doc_id % 89 + 2 as m, doc_id % 89 + 2 + case when doc_id % 7 = 0 then 1 else 0 end as r,
        case when doc_id % 12 < 4 then 0 when doc_id % 12 < 7 then 1 when doc_id % 12 < 9 then 2 when doc_id % 12 < 11 then 3 else 4 end as kind,
        case when doc_id % 2 = 0 then kind else (doc_id // 12) % 5 end as gold_kind
      from documents)""")
def q_symbolic_answers(spark, sf):
    d = X.table(spark, sf, "documents")
    m = F.col("doc_id") % 89 + 2
    r = m + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    written = F.get(F.array(*[_formula(t, r) for t, _ in _WRITTEN]), (F.col("doc_id") % 12).cast("int"))
    kind = F.get(F.array(*[F.lit(k) for _, k in _WRITTEN]), (F.col("doc_id") % 12).cast("int"))
    gold_kind = F.when(F.col("doc_id") % 2 == 0, kind).otherwise(F.floor(F.col("doc_id") / 12) % 5).cast("int")
    traces = d.select(F.col("doc_id").alias("index"),
                      F.concat(F.coalesce("text", F.lit("")), F.lit(" So $\\boxed{"), written, F.lit("}$.")).alias("model_response"))
    gold = d.select(F.col("doc_id").alias("index"), F.get(F.array(*[_formula(t, m) for t in _GOLD_WRITTEN]), gold_kind).alias("answer"))
    return score(traces, gold, "index", symbolic=True).select("index", "exact_match")


# --------------------------------------------------------------------------- budget assembly

def _budget_sql(mode: str, num_waits: int, max_len: int, select: str, whole_prompt: bool = False) -> str:
    """The window formulation in DuckDB; ``select`` reads the assembled ``r``.
    With ``whole_prompt`` a step's length counts its prompt's words and the
    markers in it, one word each."""
    alt = "true" if mode == "alternating" else "false"
    none = "true" if mode == "none" else "false"
    prompt = O.start_prompt("problem", C.GENERATION_SYSTEM_PROMPT)
    more = f"+ step + coalesce({O.word_count('p.prompt')}, 0)" if whole_prompt else ""
    return X.with_views(select, "gen_steps", "questions", extra=(
        f"p as (select sample_id, {prompt} as prompt from questions)",
        f"""w as (
  select g.*, cast(sum(gen_tokens) over (partition by g.sample_id order by step
                   rows between unbounded preceding and current row) {more} as bigint) as tokens
  from gen_steps g left join p on g.sample_id = p.sample_id)""",
        f"""d as (
  select *, (finish_reason = 'length' or tokens >= {max_len}) as truncated,
         (finish_reason = 'length' or tokens >= {max_len} or tokens > {max_len - 400}
          or step = {num_waits} or {none}) as stop
  from w)""",
        """e as (
  select *, coalesce(max(cast(stop as int)) over (partition by sample_id order by step
                 rows between unbounded preceding and 1 preceding), 0) as earlier
  from d)""",
        f"""a as (
  select sample_id, max(step) as steps, bool_or(truncated) as truncated, bool_or(stop) as stopped,
         max(tokens) as tokens,
         string_agg(gen_text || case when stop then ''
                    else chr(10) || case when {alt} and step % 2 = 1 then 'Alternatively' else 'Wait' end || chr(10) end,
                    '' order by step) as generation
  from e where earlier = 0 and step <= {num_waits} group by sample_id)""",
        """r as (select a.sample_id, a.steps, a.truncated, a.stopped, a.tokens,
         coalesce(p.prompt, '') || a.generation as response
  from a left join p on a.sample_id = p.sample_id)"""))


def _budget(spark, sf, mode, num_waits, max_len):
    prompts = X.questions(spark, sf).select("sample_id", C.start_prompt(F.col("problem")).alias("prompt"))
    return B.assemble_budget(X.gen_steps(spark, sf), mode, num_waits, max_len, prompts=prompts)


def _budget_out(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "steps", "truncated", "stopped", "tokens",
                     F.length("response").cast("bigint").alias("response_len"),
                     F.md5("response").alias("response_md5"))


_BUDGET_SELECT = ("select sample_id, steps, truncated, stopped, tokens, "
                  "cast(length(response) as bigint) as response_len, md5(response) as response_md5 from r")


@register("assemble_budget_wait", _budget_sql("budget", 3, 1500, _BUDGET_SELECT))
def q_assemble_budget_wait(spark, sf):
    return _budget_out(_budget(spark, sf, "budget", 3, 1500))


@register("assemble_budget_alternating", _budget_sql("alternating", 5, 2500, _BUDGET_SELECT))
def q_assemble_budget_alternating(spark, sf):
    return _budget_out(_budget(spark, sf, "alternating", 5, 2500))


@register("assemble_budget_none", _budget_sql("none", 3, 1500, _BUDGET_SELECT))
def q_assemble_budget_none(spark, sf):
    return _budget_out(_budget(spark, sf, "none", 3, 1500))


@register("next_round", _budget_sql(
    "budget", 5, 4096, "select sample_id, steps + 1 as next_step, cast(length(response) as bigint) as prompt_len, "
                       "md5(response) as prompt_md5 from r where not stopped"))
def q_next_round(spark, sf):
    nr = B.next_round(_budget(spark, sf, "budget", 5, 4096))
    return nr.select("sample_id", "next_step", F.length("prompt").cast("bigint").alias("prompt_len"),
                     F.md5("prompt").alias("prompt_md5"))


# --------------------------------------------------------------------------- thinking traces

_TAG_ANS = "<|im_start|>answer"


def _thinking_cte(token_limit: int = 200) -> str:
    """Per-sample thinking measures of ``samples`` in DuckDB."""
    wc = O.word_count
    return f"""th as (
  select doc_id, exact_match, prompt, resp,
         head, lines, think_lines, array_to_string(think_lines, chr(10)) as thinking,
         (length(head) - length(replace(head, chr(10), ''))) - 1 as n_steps,
         case when not contains(resp, {O.sq(_TAG_ANS)}) then ''
              when contains(after, chr(10)) then substr(after, strpos(after, chr(10)) + 1)
              else after end as answer
  from (select *, case when len(lines) > 2 then lines[2:len(lines) - 1] else [] end as think_lines
        from (select *, string_split(head, chr(10)) as lines
              from (select *, split_part(resp, {O.sq(_TAG_ANS)}, 1) as head,
                           string_split(resp, {O.sq(_TAG_ANS)})[-1] as after from samples)))),
tr as (
  select doc_id, exact_match, cast(n_steps as bigint) as n_steps, cast(len(think_lines) as bigint) as n_lines,
         cast(coalesce(list_sum(list_transform(think_lines, lambda l: {wc('l')})), 0) as bigint) as sum_step_tokens,
         {wc('thinking')} as thinking_tokens, {wc('answer')} as answer_tokens, {wc('resp')} as total_tokens,
         not contains(resp, 'Answer:') and not contains(resp, chr(92) || 'boxed') as no_answer,
         not contains(resp, '<|im_start|>think') as no_thinking,
         {wc('prompt || resp')} > 32760 as over_context,
         coalesce({wc('thinking')} > {token_limit}, false) as over_budget,
         cast(length(thinking) as bigint) as thinking_len, cast(length(answer) as bigint) as answer_len
  from th)"""


def _thinking_rows(spark, sf, token_limit: int = 200):
    return ST.thinking_rows(X.samples(spark, sf), token_limit=token_limit)


@register("thinking_parts", X.with_views(
    "select doc_id, n_steps, n_lines, thinking_len, answer_len from tr", "samples",
    extra=(_thinking_cte(),)))
def q_thinking_parts(spark, sf):
    from ..functions.thinking import thinking_parts
    s = X.samples(spark, sf)
    p = thinking_parts(F.col("resp"))
    return s.select("doc_id", p["n_steps"].cast("bigint").alias("n_steps"),
                    F.size(p["lines"]).cast("bigint").alias("n_lines"),
                    F.length(p["thinking"]).cast("bigint").alias("thinking_len"),
                    F.length(p["answer"]).cast("bigint").alias("answer_len"))


@register("thinking_stats", X.with_views(
    """select count(*) as samples, sum(n_steps) / count(*) as avg_steps,
              sum(sum_step_tokens) / sum(n_lines) as avg_step_tokens,
              min(thinking_tokens) as min_thinking_tokens, max(thinking_tokens) as max_thinking_tokens,
              avg(thinking_tokens) as avg_thinking_tokens, avg(answer_tokens) as avg_answer_tokens,
              avg(total_tokens) as avg_total_tokens,
              count(*) filter (where over_budget) as n_over_budget,
              count(*) filter (where over_context) as n_over_context,
              count(*) filter (where no_answer) as n_no_answer,
              count(*) filter (where no_thinking) as n_no_thinking from tr""", "samples",
    extra=(_thinking_cte(),)))
def q_thinking_stats(spark, sf):
    return ST.thinking_stats(_thinking_rows(spark, sf), digits=None)


@register("by_thinking_length", X.with_views(
    "select doc_id, thinking_tokens, exact_match from tr order by thinking_tokens, doc_id", "samples",
    extra=(_thinking_cte(),)))
def q_by_thinking_length(spark, sf):
    return ST.by_thinking_length(_thinking_rows(spark, sf))


@register("flag_counts", X.with_views(
    """select count(*) as n, count(*) filter (where no_answer) as n_no_answer,
              count(*) filter (where no_thinking) as n_no_thinking,
              count(*) filter (where over_context) as n_over_context,
              count(*) filter (where over_budget) as n_over_budget from tr""", "samples",
    extra=(_thinking_cte(),)))
def q_flag_counts(spark, sf):
    r = _thinking_rows(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("no_answer").alias("n_no_answer"),
                 F.count_if("no_thinking").alias("n_no_thinking"),
                 F.count_if("over_context").alias("n_over_context"),
                 F.count_if("over_budget").alias("n_over_budget"))


@register("step_parts", X.with_views(
    f"""select doc_id,
               cast((length(resp) - length(replace(resp, ' steps left' || chr(10), ''))) / 12 as bigint) as n_markers,
               cast(len(steps) as bigint) as n_steps,
               cast(coalesce(list_sum(list_transform(steps, lambda p: length(p))), 0) as bigint) as step_chars,
               cast(case when contains(resp, {O.sq(_TAG_ANS)}) then length(split_part(resp, {O.sq(_TAG_ANS)}, 2))
                    else 0 end as bigint) as answer_len
        from (select doc_id, resp,
                     list_transform(case when len(pieces) > 2 then pieces[2:len(pieces) - 1] else [] end,
                                    lambda p: case when contains(p, chr(10)) then substr(p, strpos(p, chr(10)) + 1)
                                                   else '' end) as steps
              from (select *, string_split(resp, '<|im_start|>') as pieces from step_samples))""",
    "step_samples"))
def q_step_parts(spark, sf):
    from ..functions.thinking import step_parts
    p = step_parts(F.col("resp"))
    return X.step_samples(spark, sf).select(
        "doc_id", p["n_markers"].alias("n_markers"), F.size(p["steps"]).cast("bigint").alias("n_steps"),
        F.aggregate(p["steps"], F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("step_chars"),
        F.length(p["answer"]).cast("bigint").alias("answer_len"))


def _step_thinking_cte(step_limit: int) -> str:
    """Per-sample measures of ``step_samples`` in the step-limited format."""
    wc = O.word_count
    return f"""ss as (
  select doc_id, resp,
         list_transform(case when len(pieces) > 2 then pieces[2:len(pieces) - 1] else [] end,
                        lambda p: case when contains(p, chr(10)) then substr(p, strpos(p, chr(10)) + 1)
                                       else '' end) as steps,
         case when contains(resp, {O.sq(_TAG_ANS)}) then split_part(resp, {O.sq(_TAG_ANS)}, 2) else '' end as answer,
         cast((length(resp) - length(replace(resp, ' steps left' || chr(10), ''))) / 12 as bigint) as n_markers
  from (select *, string_split(resp, '<|im_start|>') as pieces from step_samples)),
st as (
  select doc_id, n_markers as n_steps, cast(len(steps) as bigint) as n_lines,
         cast(coalesce(list_sum(list_transform(steps, lambda l: {wc('l')})), 0) as bigint) as sum_step_tokens,
         {wc('answer')} as answer_tokens, {wc('resp')} as total_tokens,
         not contains(resp, 'Answer:') and not contains(resp, chr(92) || 'boxed') as no_answer,
         not contains(resp, ' steps left' || chr(10)) as no_thinking,
         {wc('resp')} > 32760 as over_context,
         n_markers > {step_limit} as over_budget
  from ss)"""


@register("thinking_stats_steps", X.with_views(
    """select count(*) as samples, sum(n_steps) / count(*) as avg_steps,
              sum(sum_step_tokens) / sum(n_lines) as avg_step_tokens,
              min(sum_step_tokens) as min_thinking_tokens, max(sum_step_tokens) as max_thinking_tokens,
              avg(sum_step_tokens) as avg_thinking_tokens, avg(answer_tokens) as avg_answer_tokens,
              avg(total_tokens) as avg_total_tokens,
              count(*) filter (where over_budget) as n_over_budget,
              count(*) filter (where over_context) as n_over_context,
              count(*) filter (where no_answer) as n_no_answer,
              count(*) filter (where no_thinking) as n_no_thinking from st""", "step_samples",
    extra=(_step_thinking_cte(3),)))
def q_thinking_stats_steps(spark, sf):
    s = X.step_samples(spark, sf).withColumn("prompt", F.lit(""))
    rows = ST.thinking_rows(s, step_limit=F.lit(3))
    return ST.thinking_stats(rows, digits=None)


# --------------------------------------------------------------------------- chat rendering


@register("training_rows", X.with_views(
    f"""select doc_id, cast(length(t) as bigint) as text_len, md5(t) as text_md5
        from (select doc_id, {O.render([('user', O.question_prompt('prompt')),
                                        ('assistant', O.assistant_segment('resp'))])} as t from samples)""",
    "samples"))
def q_training_rows(spark, sf):
    s = X.samples(spark, sf).withColumn("t", C.training_text(F.col("prompt"), F.col("resp")))
    return s.select("doc_id", F.length("t").cast("bigint").alias("text_len"), F.md5("t").alias("text_md5"))


@register("render_conversations",
          f"""select conv_id, count(*) as n_turns, cast(length(t) as bigint) as text_len, md5(t) as text_md5
              from (select conv_id, count(*) over (partition by conv_id) as c,
                           string_agg({O.nl(C.IM_START)} || role || chr(10) || text || {O.nl(C.IM_END)} || chr(10), ''
                                      order by turn) over (partition by conv_id) as t
                    from conversations) group by conv_id, t""")
def q_render_conversations(spark, sf):
    c = X.table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", C.message(F.col("role"), F.col("text")).alias("m"))))
        .alias("ms"))
    t = C.render_chat(F.transform("ms", lambda x: x["m"]))
    return g.select("conv_id", "n_turns", F.length(t).cast("bigint").alias("text_len"), F.md5(t).alias("text_md5"))


@register("assistant_segment", X.with_views(
    f"""select index, cast(length(seg) as bigint) as seg_len, md5(seg) as seg_md5
        from (select index, {O.assistant_segment('full_text')} as seg
              from (select index, {O.start_prompt('problem', C.GENERATION_SYSTEM_PROMPT)} || model_response
                                  || {O.nl(C.IM_END + chr(10))} as full_text from traces))""", "traces"))
def q_assistant_segment(spark, sf):
    t = X.traces(spark, sf)
    full = F.concat(C.start_prompt(F.col("problem")), F.col("model_response"), F.lit(C.IM_END + "\n"))
    seg = C.assistant_segment(full)
    return t.select("index", F.length(seg).cast("bigint").alias("seg_len"), F.md5(seg).alias("seg_md5"))


# --------------------------------------------------------------------------- records and paths

_JSON_CASE = {
    0: ("'{\"math_verify\": ' || cast(exact_match as varchar) || ', \"exact_match\": 0}'",
        lambda em: F.concat(F.lit('{"math_verify": '), em.cast("string"), F.lit(', "exact_match": 0}'))),
    1: ("'{\"exact_match\": ' || case when exact_match = 1 then 'true' else 'false' end || '}'",
        lambda em: F.concat(F.lit('{"exact_match": '), F.when(em == 1, "true").otherwise("false"), F.lit("}"))),
    2: ("'{\"exact_match\": \"' || case when exact_match = 1 then 'Yes' else 'no' end || '\"}'",
        lambda em: F.concat(F.lit('{"exact_match": "'), F.when(em == 1, "Yes").otherwise("no"), F.lit('"}'))),
    3: ("'{\"exact_match\": [' || cast(exact_match as varchar) || ']}'",
        lambda em: F.concat(F.lit('{"exact_match": ['), em.cast("string"), F.lit("]}"))),
    4: ("'{\"math_verify\": null, \"exact_match\": ' || cast(exact_match as varchar) || '.0}'",
        lambda em: F.concat(F.lit('{"math_verify": null, "exact_match": '), em.cast("string"), F.lit(".0}"))),
    5: ("'{\"other\": 1}'", lambda em: F.lit('{"other": 1}')),
    6: ("'{\"math_verify\": [null], \"exact_match\": ' || cast(exact_match as varchar) || '}'",
        lambda em: F.concat(F.lit('{"math_verify": [null], "exact_match": '), em.cast("string"), F.lit("}"))),
}


def _json_results(spark, sf):
    s = X.samples(spark, sf)
    k = F.floor(s.doc_id / 2) % len(_JSON_CASE)  # each shape meets both outcomes
    line = None
    for i, (_, build) in _JSON_CASE.items():
        line = F.when(k == i, build(F.col("exact_match"))) if line is None else line.when(
            k == i, build(F.col("exact_match")))
    return s.select("doc_id", line.alias("line"))


_JSON_SQL = (f"case (doc_id // 2) % {len(_JSON_CASE)} " + " ".join(f"when {i} then {sql}" for i, (sql, _) in _JSON_CASE.items())
             + " end")


@register("as_correct", X.with_views(
    f"""select doc_id, coalesce(case json_type(f)
              when 'BOOLEAN' then json_extract_string(f, '$') = 'true'
              when 'BIGINT' then cast(json_extract_string(f, '$') as double) > 0
              when 'UBIGINT' then cast(json_extract_string(f, '$') as double) > 0
              when 'DOUBLE' then cast(json_extract_string(f, '$') as double) > 0
              when 'VARCHAR' then lower(json_extract_string(f, '$')) in ('true', '1', 'yes', 'correct')
              else false end, false) as correct
        from (select doc_id, case when json_type(v) = 'ARRAY' then json_extract(v, '$[0]') else v end as f
              from (select doc_id, case when coalesce(json_type(line, '$.math_verify'), 'NULL') <> 'NULL'
                                        then json_extract(line, '$.math_verify')
                                        else json_extract(line, '$.exact_match') end as v
                    from (select doc_id, {_JSON_SQL} as line from samples)))""", "samples"))
def q_as_correct(spark, sf):
    from ..functions.records import as_correct_json
    return _json_results(spark, sf).select(
        "doc_id", as_correct_json(F.col("line"), ["math_verify", "exact_match"]).alias("correct"))


@register("budget_from_path", X.with_views(
    """select doc_id, steps, case when steps is null then tokens end as tokens
       from (select doc_id,
               try_cast(split_part(split_part(string_split(path, 'step')[-1], '/', 1), 'forcing', 1) as integer) as steps,
               try_cast(string_split(string_split(split_part(path, 'tokens', 1), '-')[-1], '_')[-1] as integer) as tokens
             from run_paths)""", "run_paths"))
def q_budget_from_path(spark, sf):
    from ..functions.records import budget_from_path
    b = budget_from_path(F.col("path"))
    return X.run_paths(spark, sf).select("doc_id", b["steps"].alias("steps"), b["tokens"].alias("tokens"))


@register("path_values", X.with_views(
    """select doc_id, md5(coalesce(json_extract_string(j, '$.doc.problem'), '')) as problem_md5,
              md5(coalesce(json_extract_string(j, '$.filtered_resps[0][0]'),
                           json_extract_string(j, '$.filtered_resps[0]'), '')) as resp_md5,
              coalesce(json_extract_string(j, '$.arguments.gen_args_0.arg_0'), '') = prompt as has_prompt
       from (select doc_id, prompt, '{"doc": ' || json_object('problem', prompt)::varchar
                    || ', "arguments": {"gen_args_0": {"arg_0": ' || to_json(prompt)::varchar || '}}'
                    || ', "filtered_resps": ' || case when doc_id % 2 = 0 then to_json([[resp]])::varchar
                                                      else to_json([resp])::varchar end || '}' as j
             from samples)""", "samples"))
def q_path_values(spark, sf):
    from ..functions.records import path_value
    s = X.samples(spark, sf)
    resps = F.when(s.doc_id % 2 == 0, F.to_json(F.array(F.array("resp")))).otherwise(F.to_json(F.array("resp")))
    j = F.concat(F.lit('{"doc": '), F.to_json(F.struct(F.col("prompt").alias("problem"))),
                 F.lit(', "arguments": {"gen_args_0": '), F.to_json(F.struct(F.col("prompt").alias("arg_0"))),
                 F.lit('}, "filtered_resps": '), resps, F.lit("}"))
    s = s.select("doc_id", "prompt", j.alias("j"))
    return s.select("doc_id", F.md5(path_value(F.col("j"), "doc.problem")).alias("problem_md5"),
                    F.md5(path_value(F.col("j"), "filtered_resps[0]")).alias("resp_md5"),
                    (path_value(F.col("j"), "arguments.gen_args_0.arg_0") == F.col("prompt")).alias("has_prompt"))


# lines of a trace file: broken, other types than the schema's, a tab, blank, and records
_LINE_SQL = """case index % 50 when 0 then '{"index": ' || cast(index as varchar) || ', "steps": '
  when 1 then '{"index": "q-' || cast(index as varchar) || '", "steps": 1.0, "is_correct": 1, "model_response": "t"}'
  when 2 then chr(9) when 3 then '' when 4 then '[1]' else to_json(traces)::varchar end"""


def _trace_lines(spark, sf):
    t = X.traces(spark, sf)
    k, i = t["index"] % 50, t["index"].cast("string")
    line = (F.when(k == 0, F.concat(F.lit('{"index": '), i, F.lit(', "steps": ')))
            .when(k == 1, F.concat(F.lit('{"index": "q-'), i, F.lit('", "steps": 1.0, "is_correct": 1, "model_response": "t"}')))
            .when(k == 2, F.lit("\t")).when(k == 3, F.lit("")).when(k == 4, F.lit("[1]"))
            .otherwise(F.to_json(F.struct(*t.columns))))
    return t.select(line.alias("value"))


@register("parse_trace_lines", X.with_views(
    """select case when ok then try_cast(json_extract_string(line, '$.index') as bigint) end as index,
              case when ok then cast(json_extract(line, '$.steps') as integer) end as steps,
              case when ok then json_extract_string(line, '$.is_correct') in ('true', '1') end as is_correct,
              case when ok then md5(json_extract_string(line, '$.model_response')) end as response_md5,
              not ok as corrupt, trim(line, chr(9) || ' ') = '' as blank
       from (select line, case when json_valid(line) then json_type(line) = 'OBJECT' else false end as ok from l)""",
    "traces", extra=(f"l as (select {_LINE_SQL} as line from traces)",)))
def q_parse_trace_lines(spark, sf):
    from ..sources.jsonl import TRACE_SCHEMA, parse_lines
    p = parse_lines(_trace_lines(spark, sf), TRACE_SCHEMA)
    return p.select("index", "steps", "is_correct", F.md5("model_response").alias("response_md5"),
                    F.col("_corrupt_record").isNotNull().alias("corrupt"), F.col("_blank").alias("blank"))


@register("filter_lines_report", X.with_views(
    f"""select count(*) as processed, count(*) filter (where not ok) as malformed, count(*) filter (where ok and repeats) as filtered,
              count(*) filter (where ok and not repeats) as saved
       from (select line, index, index in {_flagged_sql('r', 'model_response', 2, 100)} as repeats,
                    case when json_valid(line) then json_type(line) = 'OBJECT' else false end as ok from l where trim(line, chr(9) || ' ') <> '')""",
    "traces", extra=(f"l as (select {_LINE_SQL} as line, index, case when index % 50 > 4 then model_response else 't' end as model_response from traces)",
                     "r as (select index, model_response from l)")))
def q_filter_lines_report(spark, sf):
    from ..sources.jsonl import CORRUPT, TRACE_SCHEMA, parse_lines
    p = parse_lines(_trace_lines(spark, sf), TRACE_SCHEMA, keep_line_col=True).where(~F.col("_blank"))
    valid = F.col(CORRUPT).isNull()
    repeats = valid & R.is_repeating(F.coalesce(F.col("model_response"), F.lit("")), 2, 100)
    report = S.first_n(p.select("index", "value", "model_response", CORRUPT), valid & ~repeats, "index", None, filtered=repeats)[1]
    return report.select("*", (F.col("processed") - F.col("filtered") - F.col("saved")).alias("malformed"))


# --------------------------------------------------------------------------- more reports


@register("accuracy", X.with_views(
    """select count(*) as n, count(*) filter (where is_correct) as n_correct,
              count(*) filter (where is_correct) / count(*) as accuracy from traces""", "traces"))
def q_accuracy(spark, sf):
    return ST.accuracy(X.traces(spark, sf), "is_correct")


@register("repeated_sentences_top", X.with_views(
    f"""select index, sentence, count(*) as n from (
          select index, unnest({O.sentence_list('model_response', 20)}) as sentence from traces)
        group by index, sentence having count(*) >= 2
        order by n desc, index, sentence limit 20""", "traces"))
def q_repeated_sentences_top(spark, sf):
    r = R.repeated_sentences(X.traces(spark, sf), "index", "model_response", 2, 20)
    return r.orderBy(F.col("n").desc(), "index", "sentence").limit(20)


@register("render_chat", X.with_views(
    f"""select index, cast(length(t) as bigint) as text_len, md5(t) as text_md5
        from (select index, {O.render([('system', O.nl(C.STATS_SYSTEM_PROMPT)),
                                       ('user', O.question_prompt('problem')),
                                       ('assistant', O.assistant_segment(
                                           f"({O.start_prompt('problem', C.GENERATION_SYSTEM_PROMPT)} || model_response)"))])}
                     as t from traces)""", "traces"))
def q_render_chat(spark, sf):
    t = X.traces(spark, sf)
    resp = F.concat(C.start_prompt(F.col("problem")), F.col("model_response"))
    text = C.training_text(F.col("problem"), resp, C.STATS_SYSTEM_PROMPT)
    return t.select("index", F.length(text).cast("bigint").alias("text_len"), F.md5(text).alias("text_md5"))


# a worked solution quotes the trace's answer and goes on to one of its own
_SOLUTION = "(model_response || ' Hence $' || chr(92) || 'boxed{' || chr(92) || 'sqrt' || ground_truth || ', ' || problem || '}$')"


@register("gold_answers", X.with_views(
    f"select index, {O.normalize(O.bind(O.last_boxed(_SOLUTION), O.unbox))} as answer from traces",
    "traces"))
def q_gold_answers(spark, sf):
    from ..operators.scoring import gold_answers
    own = F.concat(F.col("model_response"), F.lit(" Hence $\\boxed{\\sqrt"), "ground_truth", F.lit(", "), "problem", F.lit("}$"))
    t = X.traces(spark, sf).select("index", own.alias("solution"))
    return gold_answers(t).select("index", "answer")


_GENERATED = O.normalize(O.raw_answer("a.generation"))
_VALUE = _value(_GENERATED)


@register("generated_records", _budget_sql("alternating", 3, 2500, f"""
select r.sample_id as index, r.steps, r.truncated, q.sample_id is not null as has_question,
       coalesce({_VALUE} = q.answer, false) as is_correct,
       {O.word_count('r.response')} as tokens, md5(r.response) as response_md5
from r join a on r.sample_id = a.sample_id left join questions q on q.sample_id = r.sample_id""", whole_prompt=True))
def q_generated_records(spark, sf):
    from .pipelines import generate_records
    recs = generate_records(X.gen_steps(spark, sf), X.questions(spark, sf), mode="alternating", num_waits=3, max_model_len=2500)
    return recs.select("index", "steps", "truncated", F.col("problem").isNotNull().alias("has_question"), "is_correct",
                       "tokens", F.md5("model_response").alias("response_md5"))


@register("first_round", X.with_views(
    f"""select sample_id, 0 as next_step, md5({O.start_prompt('problem', C.GENERATION_SYSTEM_PROMPT)}) as prompt_md5
        from questions""", "questions"))
def q_first_round(spark, sf):
    return B.first_round(X.questions(spark, sf)).select("sample_id", "next_step", F.md5("prompt").alias("prompt_md5"))


# --------------------------------------------------------------------------- streaming


@register("stream_curation_report", X.with_views(
    f"""select count(*) as processed,
              count(*) filter (where index in (select index from f)) as filtered,
              count(*) filter (where is_correct and not truncated
                                     and index not in (select index from f)) as saved,
              cast(0 as bigint) as corrupt
       from traces""", "traces", extra=(f"f as {_flagged_sql('traces', 'model_response', 2, 100)}",)))
def q_stream_curation_report(spark, sf):
    """The running curation report, computed by a Structured Streaming query
    over the trace records of the documents table's files."""
    import uuid

    from ..session import scratch_path
    from ..streaming.curate import start_report
    path = X.table_path(sf, "documents")
    # as a pattern, since a table may be one file or a folder of them
    documents = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    name = f"curation_report_{uuid.uuid4().hex[:8]}"
    q = start_report(spark, X.traces_of(documents), 2, 100, checkpoint=scratch_path(spark, "stream-ck"), query_name=name)
    q.awaitTermination()
    return spark.table(name)
