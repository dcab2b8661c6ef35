"""Scoring generated outputs against gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import with_equivalence
from ..functions.answers import answers_equal, final_answer, gold_answer, normalize_answer


def gold_answers(questions: DataFrame, solution_col: str = "solution",
                 answer_col: str = "answer") -> DataFrame:
    """Add the normalized gold answer extracted from each worked solution."""
    return questions.withColumn(answer_col, gold_answer(F.col(solution_col)))


def score_columns(df: DataFrame, response_col: str, gold_col: str, normalize_gold: bool = True,
                  verifier_col: str | None = None, symbolic: bool = False) -> DataFrame:
    """Add ``pred``, ``gold``, ``exact_match`` (int) and ``is_correct`` to a
    frame that already carries the response and its gold answer."""
    return _matched(df.withColumn("pred", final_answer(F.col(response_col))), gold_col, normalize_gold, verifier_col, symbolic)


def _matched(df: DataFrame, gold_col: str, normalize_gold: bool, verifier_col: str | None, symbolic: bool) -> DataFrame:
    gold = F.when(F.col(gold_col).isNotNull(), normalize_answer(F.col(gold_col))) if normalize_gold else F.col(gold_col)
    if symbolic:
        scored = with_equivalence(df.withColumn("gold", gold), F.col("pred"), F.col("gold"), "exact_match")
    else:
        equal = F.coalesce(answers_equal(F.col("pred"), F.col("gold")), F.lit(False))
        scored = df.withColumn("gold", gold).withColumn("exact_match", equal)
    scored = scored.withColumn("exact_match", F.col("exact_match").cast("int"))
    correct = F.col("exact_match") == 1
    if verifier_col:
        correct = correct | (F.coalesce(F.col(verifier_col), F.lit(0)) == 1)
    return scored.withColumn("is_correct", correct)


def check_unique_key(df: DataFrame, key: str) -> None:
    """Raise if ``key`` repeats: one grouped count, only a single offending
    key (if any) reaches the driver."""
    dup = df.groupBy(key).count().where(F.col("count") > 1).select(key).limit(1).collect()
    if dup:
        raise ValueError(f"{key} is not unique in the gold answers, e.g. {dup[0][0]!r}")


def score(outputs: DataFrame, gold: DataFrame, key: str, response_col: str = "model_response",
          gold_col: str = "answer", normalize_gold: bool = True,
          verifier_col: str | None = None, validate: bool = True, symbolic: bool = False) -> DataFrame:
    """Join each output to the gold answer of the same sample and score it.

    The positional lookup of the original loop becomes a left equi-join on
    ``key``; an output without a gold answer stays, with a null ``gold`` and
    exact_match 0. Answers are read from the responses before the join, so a
    shuffle carries a response only if the caller selects it. No broadcast
    hint: Spark broadcasts the gold side only when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks with runtime
    sizes); past that it shuffles both sides on the key. Adds ``pred``,
    ``gold``, ``exact_match`` (int) and ``is_correct``; an optional verifier
    column is OR-ed into ``is_correct``. ``validate`` first checks that each
    key has one gold answer (the lookup is one-to-one). ``symbolic`` also takes
    answers as equal that are the same expression (``functions.algebra``).
    """
    if validate:
        check_unique_key(gold, key)
    g = gold.select(F.col(key), F.col(gold_col).alias("_gold"))
    read = outputs.withColumn("pred", final_answer(F.col(response_col)))
    return _matched(read.join(g, key, "left"), "_gold", normalize_gold, verifier_col, symbolic).drop("_gold")
