"""Summary statistics (A1–A7, A9, L3) as aggregations.

Global summaries are single ``agg`` calls: each partition pre-aggregates and
only partial buffers cross the network. Exact percentiles keep one
(value → count) map whose size is bounded by the number of distinct lengths,
not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, token_len
from ..functions.thinking import no_answer, no_thinking, over_context, step_parts, thinking_parts

QUANTILES = [0.5, 0.9, 0.95, 0.99]

# Fixed value: length ranges of the bucket report, [low, high).
LENGTH_RANGES = [(0, 512), (512, 1024), (1024, 2048), (2048, 4096), (4096, 8192),
                 (8192, 16384), (16384, 1000000)]


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def length_stats(df: DataFrame, len_col: str = "len", digits: int | None = 6) -> DataFrame:
    """count, mean, min, max and P50/P90/P95/P99 (linear interpolation).

    Percentiles are rounded to ``digits`` places: engines interpolate with
    different float expressions and differ in the last bit otherwise."""
    c = F.col(len_col)
    pct = F.percentile(c, QUANTILES)

    def r(x: Column) -> Column:
        return x if digits is None else F.round(x, digits)

    return df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean_len"),
        F.min(c).cast("bigint").alias("min_len"),
        F.max(c).cast("bigint").alias("max_len"),
        pct.alias("_p"),
    ).select("n", "mean_len", "min_len", "max_len",
             *[r(F.col("_p")[i]).alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def accuracy(df: DataFrame, correct_col: str = "correct") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(F.col(correct_col)).alias("n_correct"),
                  ratio(F.count_if(F.col(correct_col)), F.count(F.lit(1))).alias("accuracy"))


def repetition_rate(df: DataFrame, flag_col: str = "is_repeating") -> DataFrame:
    n = F.count(F.lit(1))
    rep = F.count_if(F.col(flag_col))
    return df.agg(n.alias("n"), rep.alias("n_repeating"), ratio(rep, n).alias("share"))


# (low, label) of each range; the last one is open
BUCKETS = [(low, f"{low}+" if i == len(LENGTH_RANGES) - 1 else f"{low}-{high}")
           for i, (low, high) in enumerate(LENGTH_RANGES)]


def length_bucket(length: Column) -> Column:
    """struct(bucket, low) of the range a length falls in; null below 0."""
    table = F.array(*[F.struct(F.lit(label).alias("bucket"), F.lit(low).cast("bigint").alias("low")) for low, label in BUCKETS])
    reached = F.filter(table, lambda b: b["low"] <= length)
    return F.try_element_at(reached, F.lit(-1))


def length_buckets(df: DataFrame, len_col: str = "len", correct_col: str = "correct") -> DataFrame:
    """Per non-empty length range: rows, share of all rows, accuracy."""
    # The length is read once per row, into one struct key. (No filter on it:
    # a filter on a derived column is pushed below its projection and would
    # compute the length twice.)
    g = (df.groupBy(bind(F.col(len_col), length_bucket).alias("b"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct_col)).alias("n_correct")))
    # the grouped frame has at most seven rows, so a whole-frame window is free
    total = F.sum("n").over(Window.partitionBy())
    return g.select(F.col("b.bucket").alias("bucket"), F.col("b.low").alias("low"), "n",
                    ratio(F.col("n"), total).alias("share"),
                    ratio(F.col("n_correct"), F.col("n")).alias("accuracy"))


def generation_summary(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """total, correct (truncated included), accuracy, mean tokens, mean tokens
    of correct rows (null if none), rows saved to the correct file."""
    correct = F.col("is_correct")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"),
        F.count_if(correct).alias("n_correct"),
        ratio(F.count_if(correct), n).alias("accuracy"),
        F.avg(tokens_col).alias("avg_tokens"),
        F.avg(F.when(correct, F.col(tokens_col))).alias("avg_correct_tokens"),
        F.count_if(correct & ~F.col("truncated")).alias("saved"))


def filter_report(df: DataFrame, flag_col: str = "is_repeating") -> DataFrame:
    """processed / filtered / saved of one filter pass."""
    return df.agg(F.count(F.lit(1)).alias("processed"),
                  F.count_if(F.col(flag_col)).alias("filtered"),
                  F.count_if(~F.col(flag_col)).alias("saved"))


def compare_runs(df: DataFrame, baseline: str, run_col: str = "run",
                 correct_col: str = "exact_match") -> DataFrame:
    """Accuracy per run and its difference to the baseline run."""
    g = df.groupBy(run_col).agg(F.count(F.lit(1)).alias("n"),
                                F.avg(F.col(correct_col).cast("double")).alias("accuracy"))
    # one row per run: tiny, so a whole-frame window is free
    base = F.max(F.when(F.col(run_col) == baseline, F.col("accuracy"))).over(Window.partitionBy())
    return g.withColumn("delta", F.col("accuracy") - base)


def thinking_rows(df: DataFrame, resp_col: str = "resp", prompt_col: str = "prompt",
                  tokenizer_file: str | None = None, token_limit: int | None = None,
                  step_limit: Column | None = None, totals_only: Column | None = None) -> DataFrame:
    """Per-sample thinking measures.

    Rows with a step limit (``step_limit`` not null) are read in the
    step-limited format: steps are the sections between ``<|im_start|>``
    tags, their count is the number of "N steps left" markers, the thinking
    length is the sum of the step lengths, and over-budget means more
    markers than the limit. Other rows are read in the free format (thinking
    lines before the answer tag), over budget when the thinking is longer
    than ``token_limit`` tokens. Rows where ``totals_only`` is true have no
    thinking format: only their total length, over_context and no_answer are
    measured, the rest is null.
    """
    resp = F.col(resp_col)
    tl = lambda c: token_len(c, tokenizer_file)
    is_step = F.lit(False) if step_limit is None else step_limit.isNotNull()
    zero = F.lit(0).cast("bigint")

    def bound(frame: DataFrame, **columns: Column) -> DataFrame:
        # a generator computes its columns once, whoever reads them
        return frame.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))

    def pick(step_value: Column, free_value: Column) -> Column:
        return F.when(is_step, step_value).otherwise(free_value)

    free, step = F.col("__free"), F.col("__step")
    parsed = bound(df, __free=F.when(~is_step, thinking_parts(resp)), __step=F.when(is_step, step_parts(resp)))
    measured = bound(parsed, __sizes=F.transform(pick(step["steps"], free["lines"]), tl))
    total = F.aggregate("__sizes", zero, lambda a, x: a + x)
    out = measured.select(
        *df.columns,
        pick(step["n_markers"], free["n_steps"].cast("bigint")).alias("n_steps"),
        F.size("__sizes").cast("bigint").alias("n_lines"),
        total.alias("sum_step_tokens"),
        pick(total, tl(free["thinking"])).alias("thinking_tokens"),
        tl(pick(step["answer"], free["answer"])).alias("answer_tokens"),
        tl(resp).alias("total_tokens"),
        no_answer(resp).alias("no_answer"),
        pick(no_thinking(resp, step_form=True), no_thinking(resp)).alias("no_thinking"),
        over_context(F.col(prompt_col), resp, tokenizer_file=tokenizer_file).alias("over_context"),
    )
    limit = F.lit(token_limit) if token_limit is not None else F.lit(None).cast("bigint")
    over = pick(F.col("n_steps") > step_limit if step_limit is not None else F.lit(False),
                F.col("thinking_tokens") > limit)
    out = out.withColumn("over_budget", F.coalesce(over, F.lit(False)))
    if totals_only is None:
        return out
    parts = ["n_steps", "n_lines", "sum_step_tokens", "thinking_tokens", "answer_tokens", "no_thinking", "over_budget"]
    return out.withColumns({c: F.when(~totals_only, F.col(c)) for c in parts})


def thinking_stats(rows: DataFrame, digits: int | None = 1) -> DataFrame:
    """Global summary of ``thinking_rows``; step tokens average over all
    steps. Averages are rounded to ``digits`` places (None: not rounded)."""
    def r(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("samples"),
        r(ratio(F.sum("n_steps"), n)).alias("avg_steps"),
        r(ratio(F.sum("sum_step_tokens"), F.sum("n_lines"))).alias("avg_step_tokens"),
        F.min("thinking_tokens").alias("min_thinking_tokens"),
        F.max("thinking_tokens").alias("max_thinking_tokens"),
        r(F.avg("thinking_tokens")).alias("avg_thinking_tokens"),
        r(F.avg("answer_tokens")).alias("avg_answer_tokens"),
        r(F.avg("total_tokens")).alias("avg_total_tokens"),
        F.count_if("over_budget").alias("n_over_budget"),
        F.count_if("over_context").alias("n_over_context"),
        F.count_if("no_answer").alias("n_no_answer"),
        F.count_if("no_thinking").alias("n_no_thinking"))


def by_thinking_length(rows: DataFrame, id_col: str = "doc_id",
                       correct_col: str = "exact_match") -> DataFrame:
    """Samples ordered by thinking length, ties by id (a distributed sort)."""
    return (rows.select(id_col, "thinking_tokens", correct_col)
                .orderBy("thinking_tokens", id_col))
