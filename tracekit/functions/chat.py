"""Prompt and chat rendering (P4–P7) as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# ---------------------------------------------------------------------------
# The chat markers and default prompts the traces are written
# with; they must equal the originals byte for byte.
# ---------------------------------------------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
ASSISTANT_TAG = "<|im_start|>assistant"
THINK_TAG = "<|im_start|>think"
ANSWER_TAG = "<|im_start|>answer"
GENERATION_SYSTEM_PROMPT = "Reason step by step, and put your final answer within \\boxed{}."
STATS_SYSTEM_PROMPT = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
# ---------------------------------------------------------------------------


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def question_prompt(problem: Column) -> Column:
    """``"Problem:\\n" + p + "\\n\\nSolution:"``."""
    return F.concat(F.lit("Problem:\n"), problem, F.lit("\n\nSolution:"))


def start_prompt(problem: Column, system: str | Column = GENERATION_SYSTEM_PROMPT) -> Column:
    """System, user and assistant markers followed by the thinking opener."""
    return F.concat(F.lit(f"{IM_START}system\n"), _lit(system),
                    F.lit(f"{IM_END}\n{IM_START}user\n"), problem,
                    F.lit(f"{IM_END}\n{IM_START}assistant\n{THINK_TAG}\n"))


def assistant_segment(text: Column) -> Column:
    """When the text holds a full chat, keep only the last assistant turn
    (up to its end marker, stripped); otherwise the text unchanged."""
    tag = ASSISTANT_TAG + "\n"
    last = F.substring_index(F.substring_index(text, tag, -1), IM_END, 1)
    return F.when(text.contains(tag), py_strip(last)).otherwise(text)


def message(role: str | Column, content: Column) -> Column:
    return F.struct(_lit(role).alias("role"), content.alias("content"))


def chat_messages(user: Column, assistant: Column, system: str | Column | None = None) -> Column:
    """array<struct<role,content>> with an optional leading system message."""
    msgs = [message("user", user), message("assistant", assistant)]
    if system is not None:
        msgs.insert(0, message("system", _lit(system)))
    return F.array(*msgs)


def render_chat(messages: Column) -> Column:
    """ChatML rendering of a message array, no generation prompt."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(f"{IM_END}\n"))), "")


def training_text(prompt: Column, response: Column, system: str | Column | None = None) -> Column:
    """The fine-tuning row: question prompt as user turn, the assistant part
    of the response as assistant turn, rendered as ChatML."""
    return render_chat(chat_messages(question_prompt(prompt), assistant_segment(response), system))
