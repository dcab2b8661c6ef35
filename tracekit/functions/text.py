"""Text helpers shared by every operator.

Python's ``str.strip`` / ``\\s`` / ``str.isdigit`` are Unicode-aware, Java's
defaults are not. Rather than hand-listing characters, the exact sets are
derived at import time from Python's own predicates and turned into
character classes that both Java regex and RE2 accept (``\\x{HHHH}``).
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ranges(pred) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in range(sys.maxunicode + 1):
        if pred(chr(cp)):
            if out and out[-1][1] == cp - 1:
                out[-1] = (out[-1][0], cp)
            else:
                out.append((cp, cp))
    return out


def _char_class(ranges: list[tuple[int, int]]) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
    return "[" + "".join(parts) + "]"


_WS_RANGES = _ranges(str.isspace)
_DIGIT_RANGES = _ranges(str.isdigit)

#: every character Python's ``str.strip()`` removes
WHITESPACE = "".join(chr(c) for lo, hi in _WS_RANGES for c in range(lo, hi + 1))
#: regex class equal to Python's ``\s`` on str patterns, spelled out (RE2)
WS_CLASS = _char_class(_WS_RANGES)
#: the same set for Java regex under the (?U) flag: Unicode White_Space plus
#: U+001C..U+001F (tests check equality over every code point). Java matches
#: this form several times faster than the spelled-out class.
JAVA_WS = "[\\s\\x{1C}-\\x{1F}]"
#: regex class equal to Python's ``str.isdigit`` per character
DIGIT_CLASS = _char_class(_DIGIT_RANGES)
#: regex class of non-whitespace
NON_WS_CLASS = "[^" + WS_CLASS[1:]

#: the sentence splitter of the repetition check: after ., ! or ? a run of
#: whitespace, or a run of newlines
SENTENCE_SPLIT = f"(?U)(?<=[.!?]){JAVA_WS}+|\\n+"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Column builders that use an input several times would otherwise copy the
    whole input expression into each use, and conditional branches are not
    de-duplicated by the optimizer.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(col: Column) -> Column:
    """``str.strip()``: trims every Unicode whitespace character, no regex."""
    return F.trim(col, F.lit(WHITESPACE))


def is_digits(col: Column) -> Column:
    """``str.isdigit()``: non-empty and every character a digit."""
    return col.rlike(f"^{DIGIT_CLASS}+\\z")


def split_sentences(col: Column) -> Column:
    """``re.split(r'(?<=[.!?])\\s+|\\n+', text)`` as an array column."""
    return F.split(col, SENTENCE_SPLIT, -1)


def sentences(col: Column, min_len: int) -> Column:
    """Stripped sentences of at least ``min_len`` characters; null text → []."""
    parts = F.transform(split_sentences(F.coalesce(col, F.lit(""))), py_strip)
    return F.filter(parts, lambda s: F.length(s) >= F.lit(min_len))


def word_count(col: Column) -> Column:
    """Number of maximal non-whitespace runs (the default token proxy);
    null → 0. Splits the stripped text on whitespace runs."""
    return bind(py_strip(F.coalesce(col, F.lit(""))), lambda s: F.when(s == "", F.lit(0)).otherwise(
        F.size(F.split(s, f"(?U){JAVA_WS}+", -1))).cast("bigint"))


def token_len(col: Column, tokenizer_file: str | None = None) -> Column:
    """Token length of a text column (K1).

    Without a tokenizer file this is the whitespace-word proxy, computed in
    the JVM. With a ``tokenizers`` JSON file, an Arrow-batched pandas UDF
    loads the tokenizer once per Python worker and encodes whole batches.
    """
    if tokenizer_file is None:
        return word_count(col)
    return _tokenizer_len_udf(tokenizer_file)(col)


def _tokenizer_len_udf(path: str):
    @F.pandas_udf("bigint")
    def _len(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer
        tok = _TOKENIZERS.get(path)
        if tok is None:
            tok = _TOKENIZERS[path] = Tokenizer.from_file(path)
        vals = texts.fillna("").tolist()
        enc = tok.encode_batch(vals, add_special_tokens=False)
        return pd.Series([len(e.ids) for e in enc], dtype="int64")

    return _len


_TOKENIZERS: dict = {}
