"""Budget-forced trace assembly over recorded generation steps.

The original loop appends each step's text, decides whether to stop, and
otherwise appends a "Wait"/"Alternatively" marker and asks for another step.
Every stop test looks only at values of that step (its finish reason and the
running token count), so the stopping step is simply the first step whose
test fires: one window pass computes the running count and whether any
earlier step already stopped, with no iteration.

Plan: one shuffle on ``sample_id``; both windows and the final group-by
reuse that partitioning. A group holds at most ``num_waits + 1`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chat import start_prompt
from ..functions.thinking import hit_limit, near_limit
from .sampling import seeded_sample

MODES = ("budget", "alternating", "none")
# The budget-forcing markers.
WAIT = "Wait"
ALTERNATIVELY = "Alternatively"


def step_decisions(steps: DataFrame, mode: str = "budget", num_waits: int = 5,
                   max_model_len: int = 4096, margin: int = 400,
                   prompt_tokens: DataFrame | None = None,
                   marker_tokens: tuple[int, int] = (0, 0)) -> DataFrame:
    """Per kept step: running tokens, truncated / stop flags and the marker
    appended after it. Steps after the first stopping one are dropped.

    A step's tokens are those of its prompt, which holds the question prompt
    (``prompt_tokens``: sample_id, prompt_tokens), earlier steps and the
    markers between them (``marker_tokens`` of the two markers), and its own.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # steps past the last allowed one can never be kept; dropping them first
    # bounds every window group to num_waits + 1 rows
    df = steps.where(F.col("step") <= num_waits)
    base = F.lit(0)
    if prompt_tokens is not None:
        df = df.join(prompt_tokens, "sample_id", "left")
        base = F.coalesce(F.col("prompt_tokens"), F.lit(0))
    w = Window.partitionBy("sample_id").orderBy("step")
    alternates = F.lit(mode == "alternating") & (F.col("step") % 2 == 1)
    marker = F.when(alternates, marker_tokens[1]).otherwise(marker_tokens[0])
    tokens = (F.sum(F.col("gen_tokens") + marker).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
              - marker + base).cast("bigint")
    df = df.withColumn("tokens", tokens)
    trunc = hit_limit(F.col("finish_reason"), F.col("tokens"), max_model_len)
    near = near_limit(F.col("tokens"), max_model_len, margin)
    last = (F.col("step") == num_waits) | F.lit(mode == "none")
    df = (df.withColumn("truncated", trunc)
            .withColumn("stop", trunc | near | last))
    earlier = F.max(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    token = F.when(alternates, F.lit(ALTERNATIVELY)).otherwise(F.lit(WAIT))
    return (df.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
              .where(F.col("_earlier") == 0)
              .withColumn("marker", F.when(F.col("stop"), F.lit(""))
                          .otherwise(F.concat(F.lit("\n"), token, F.lit("\n"))))
              .drop("_earlier"))


def assemble_budget(steps: DataFrame, mode: str = "budget", num_waits: int = 5,
                    max_model_len: int = 4096, margin: int = 400,
                    prompts: DataFrame | None = None,
                    prompt_tokens: DataFrame | None = None,
                    marker_tokens: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row per sample: steps (last step index run), truncated, stopped,
    tokens, and ``response`` = prompt (if given) + every kept step's text and
    the markers between them."""
    d = step_decisions(steps, mode, num_waits, max_model_len, margin, prompt_tokens, marker_tokens)
    pieces = F.array_sort(F.collect_list(F.struct("step", F.concat("gen_text", "marker").alias("piece"))))
    out = d.groupBy("sample_id").agg(
        F.max("step").alias("steps"),
        F.max("truncated").alias("truncated"),
        F.max("stop").alias("stopped"),
        F.max("tokens").alias("tokens"),
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("generation"))
    if prompts is not None:
        out = (out.join(prompts.select("sample_id", "prompt"), "sample_id", "left")
                  .withColumn("response", F.concat(F.coalesce("prompt", F.lit("")), "generation"))
                  .drop("prompt"))
    else:
        out = out.withColumn("response", F.col("generation"))
    return out


def first_round(questions: DataFrame, n: int = 0, seed: int = 42, key: str = "sample_id",
                problem_col: str = "problem") -> DataFrame:
    """The prompts that generation starts from: ``n`` questions drawn by the
    seed (all for 0), at step 0."""
    drawn = seeded_sample(questions, n or None, seed, key)
    return drawn.select(F.col(key), F.lit(0).alias("next_step"), start_prompt(F.col(problem_col)).alias("prompt"))


def next_round(assembled: DataFrame) -> DataFrame:
    """Samples still active after the recorded steps, with the step to run
    next and the prompt to run it on (the response so far, marker included)."""
    return (assembled.where(~F.col("stopped"))
                     .select("sample_id", (F.col("steps") + 1).alias("next_step"),
                             F.col("response").alias("prompt")))
