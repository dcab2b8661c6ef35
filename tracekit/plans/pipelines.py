"""End-to-end curation plans composed from the operators.

Each stage of the original workflow (generate → score → keep correct → drop
repetitive → train rows / statistics) is a lazy DataFrame transformation
here, so stages chain in one session and Catalyst sees the whole plan:
cheap predicates are evaluated before the repetition check, and only the
columns a stage needs are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions.answers import gold_answer, normalize_answer
from ..functions.records import require_columns
from ..functions.text import py_strip, token_len
from ..operators import budget as B
from ..operators import repeat as R
from ..operators import sampling as S
from ..operators import stats as ST
from ..operators.scoring import check_unique_key, score_columns


def stats_rows(traces: DataFrame, prompt_col: str = "problem", response_col: str = "model_response",
               correct: Column | None = None, system: str | None = C.STATS_SYSTEM_PROMPT,
               threshold: int = 3, min_len: int = 50, with_prompt: bool = True,
               tokenizer_file: str | None = None, id_col: str = "index") -> DataFrame:
    """Per-record (len, correct, is_repeating) for the statistics report.

    ``len`` is the token length of the rendered training text: system
    prompt, the question prompt as user turn and the assistant part of the
    response. With ``with_prompt`` the response is first prefixed with the
    generation prompt, as generated traces are stored.
    """
    resp = F.col(response_col)
    if with_prompt:
        resp = F.concat(C.start_prompt(F.col(prompt_col)), resp)
    text = C.training_text(F.col(prompt_col), resp, system)
    return traces.select(
        F.col(id_col),
        token_len(text, tokenizer_file).alias("len"),
        (F.col("is_correct") if correct is None else correct).alias("correct"),
        R.is_repeating(F.col(response_col), threshold, min_len).alias("is_repeating"))


def curate(traces: DataFrame, threshold: int = 2, min_len: int = 100,
           max_samples: int | None = None, order_col: str = "index") -> DataFrame:
    """Correct, untruncated, non-repetitive traces, optionally the first
    ``max_samples`` of them in ``order_col`` order."""
    correct = S.correct_untruncated(traces)
    keep = ~R.is_repeating(F.col("model_response"), threshold, min_len)
    return S.first_n_kept(correct, keep, order_col, max_samples)


def question_set(questions: DataFrame, question_col: str = "problem", answer_col: str = "answer",
                 solution_col: str = "solution") -> DataFrame:
    """(sample_id, problem, answer, prompt): the gold answer is read from the
    worked solution where there is one, normalized once, and is the
    normalized answer column otherwise."""
    if solution_col in questions.columns:
        answer = gold_answer(F.col(solution_col))
    else:
        answer = normalize_answer(F.col(answer_col).cast("string"))
    shown = F.col(answer_col).cast("string") if answer_col in questions.columns and solution_col not in questions.columns else answer
    return questions.select("sample_id", F.col(question_col).alias("_problem"), answer.alias("_gold"),
                            shown.alias("_answer"), C.start_prompt(F.col(question_col)).alias("_prompt"))


def marker_lengths(tokenizer_file: str | None = None) -> tuple[int, int]:
    """Tokens of the two markers as they are appended: words by default."""
    texts = [f"\n{m}\n" for m in (B.WAIT, B.ALTERNATIVELY)]
    if tokenizer_file is None:
        return tuple(len(t.split()) for t in texts)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file)
    return tuple(len(tok.encode(t, add_special_tokens=False).ids) for t in texts)


def generate_records(steps: DataFrame, questions: DataFrame, mode: str = "budget",
                     num_waits: int = 5, max_model_len: int = 4096,
                     question_col: str = "problem", answer_col: str = "answer",
                     tokenizer_file: str | None = None, score_full_prompt: bool = False,
                     validate: bool = True, symbolic: bool = False) -> DataFrame:
    """Trace records from recorded generation steps and the question set.

    ``questions`` has sample_id, problem and answer, or a worked solution to
    read the answer from; each sample has one question (checked by
    ``validate``). The steps are assembled under the budget rules (one
    shuffle on sample_id), where a step's length counts its whole prompt:
    question prompt, earlier steps and markers. Samples without a question
    stay, with an empty question prompt and no gold answer. The generated
    text is scored against the gold answer. ``score_full_prompt`` scores the
    whole text instead, prompt included — whose system line itself holds an
    empty box, so a response without a box then scores as the empty answer.
    ``symbolic`` compares answers as expressions too.
    """
    if validate:
        check_unique_key(questions, "sample_id")
    q = question_set(questions, question_col, answer_col)
    lengths = q.select("sample_id", token_len(F.col("_prompt"), tokenizer_file).alias("prompt_tokens"))
    assembled = B.assemble_budget(steps, mode, num_waits, max_model_len, prompt_tokens=lengths,
                                  marker_tokens=marker_lengths(tokenizer_file))
    joined = (assembled.join(q, "sample_id", "left")
                       .withColumn("response", F.concat(F.coalesce("_prompt", F.lit("")), F.col("generation"))))
    scored = score_columns(joined, "response" if score_full_prompt else "generation", "_gold", normalize_gold=False,
                           symbolic=symbolic)
    return scored.select(F.col("sample_id").alias("index"),
                         F.col("_problem").alias("problem"),
                         py_strip(F.col("_answer")).alias("ground_truth"),
                         F.col("response").alias("model_response"),
                         "is_correct", "truncated", "steps",
                         token_len(F.col("response"), tokenizer_file).alias("tokens"))


def training_rows(records: DataFrame, n: int | None, seed: int, key: str,
                  prompt_col: str = "problem", response_col: str = "model_response",
                  system: str | None = None, text_col: str = "text") -> DataFrame:
    """Seeded sample of ``n`` records rendered as chat training text. A
    dataset that already has ``text_col`` is passed through unchanged."""
    sampled = S.seeded_sample(records, n, seed, key)
    if text_col in records.columns:
        return sampled
    require_columns(records, [prompt_col, response_col])
    return sampled.withColumn(text_col, C.training_text(F.col(prompt_col), F.col(response_col), system))


def summary(records: DataFrame) -> DataFrame:
    return ST.generation_summary(records)
