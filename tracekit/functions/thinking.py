"""Thinking-trace parsing of evaluation samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chat import ANSWER_TAG, IM_START, THINK_TAG
from .text import bind, token_len

# The marker of the step-limited response format, and the
# prompt+response token count above which a sample counts as over-context.
STEPS_LEFT = " steps left\n"
CONTEXT_LIMIT = 32760


def _count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("bigint")


def thinking_parts(resp: Column) -> Column:
    """Free-form response → struct(thinking, n_steps, answer, lines).

    Head = text before the first answer tag; thinking lines = head lines
    without the first and last; answer = text after the last answer tag
    without its first line ("" without a tag); n_steps = newlines in head − 1.
    """
    def answer(after: Column) -> Column:
        return F.when(~resp.contains(ANSWER_TAG), F.lit("")).when(
            after.contains("\n"), F.substring(after, F.instr(after, "\n") + 1, F.length(after))
        ).otherwise(after)

    def parts(lines: Column) -> Column:
        n = F.size(lines)
        inner = F.when(n > 2, F.slice(lines, 2, n - 2)).otherwise(F.array().cast("array<string>"))
        return bind(inner, lambda kept: F.struct(F.array_join(kept, "\n").alias("thinking"),
                                                 (n - 2).cast("bigint").alias("n_steps"),
                                                 bind(F.substring_index(resp, ANSWER_TAG, -1), answer).alias("answer"),
                                                 kept.alias("lines")))

    return bind(F.split(F.substring_index(resp, ANSWER_TAG, 1), "\n", -1), parts)


def step_parts(resp: Column) -> Column:
    """Step-limited response → struct(steps, n_markers, answer).

    steps = pieces between ``<|im_start|>`` tags except the first and last,
    each without its first line; n_markers = occurrences of " steps left\\n";
    answer = text after the first answer tag up to the next one ("" if none).
    """
    def without_first_line(piece: Column) -> Column:
        return F.when(piece.contains("\n"), F.substring(piece, F.instr(piece, "\n") + 1, F.length(piece))).otherwise(F.lit(""))

    def inner(pieces: Column) -> Column:
        n = F.size(pieces)
        return F.transform(F.when(n > 2, F.slice(pieces, 2, n - 2)).otherwise(F.array().cast("array<string>")), without_first_line)

    steps = bind(F.split(resp, "\\Q" + IM_START + "\\E", -1), inner)
    answer = F.when(resp.contains(ANSWER_TAG),
                    F.substring_index(F.substring_index(resp, ANSWER_TAG, 2), ANSWER_TAG, -1)
                    ).otherwise(F.lit(""))
    return F.struct(steps.alias("steps"), _count(resp, STEPS_LEFT).alias("n_markers"),
                    answer.alias("answer"))


def no_answer(resp: Column) -> Column:
    """Neither ``Answer:`` nor ``\\boxed`` appears."""
    return ~resp.contains("Answer:") & ~resp.contains("\\boxed")


def no_thinking(resp: Column, step_form: bool = False) -> Column:
    """Lacks the thinking opener (free form) or any step marker."""
    return ~resp.contains(STEPS_LEFT if step_form else THINK_TAG)


def over_context(prompt: Column, resp: Column, limit: int = CONTEXT_LIMIT,
                 tokenizer_file: str | None = None) -> Column:
    """Prompt plus response is longer than the context (F8)."""
    return token_len(F.concat(prompt, resp), tokenizer_file) > F.lit(limit)


def hit_limit(finish_reason: Column, tokens: Column, max_model_len: int) -> Column:
    """Generation was cut by the length limit."""
    return (finish_reason == "length") | (tokens >= F.lit(max_model_len))


def near_limit(tokens: Column, max_model_len: int, margin: int = 400) -> Column:
    """Within ``margin`` tokens of the limit (F5); checked after F4."""
    return tokens > F.lit(max_model_len - margin)
