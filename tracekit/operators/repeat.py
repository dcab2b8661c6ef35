"""Repetition detection over whole texts.

Every plan here is row-local: all sentences of a text live in its row, so
counting them needs no shuffle. A document of any size is handled in one
pass of split → sort → compare neighbours; the cluster never moves sentence
text between machines, and no key can be hot because there is no key.

Array values are bound once with ``transform(array(x), v -> …)``: a lambda
that referred to the split expression directly would re-split the text once
per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, sentences
from ..session import filter_here


def _has_run(sorted_arr: Column, threshold: int) -> Column:
    """A sorted array holds a value ``threshold`` times iff some element
    equals the one ``threshold - 1`` places after it."""
    n = F.size(sorted_arr)
    width = n - F.lit(threshold - 1)
    return F.when(n < threshold, F.lit(False)).otherwise(F.exists(
        F.zip_with(F.slice(sorted_arr, 1, width), F.slice(sorted_arr, threshold, width),
                   lambda a, b: a == b),
        lambda eq: eq))


def is_repeating(text: Column, threshold: int = 2, min_len: int = 100) -> Column:
    """True when some stripped sentence of at least ``min_len`` characters
    occurs ``threshold`` or more times. Null or empty text → false."""
    segs = sentences(text, min_len)
    if threshold <= 1:
        return F.size(segs) > 0

    def check(s: Column) -> Column:
        dup = F.size(s) > F.size(F.array_distinct(s))
        if threshold == 2:
            return dup
        return F.when(~dup, F.lit(False)).otherwise(
            bind(F.array_sort(s), lambda so: _has_run(so, threshold)))

    return bind(segs, check)


def drop_repeating(df: DataFrame, text_col: str, threshold: int = 2, min_len: int = 100) -> DataFrame:
    """Rows whose text is not repeating (F2)."""
    return filter_here(df, ~is_repeating(F.col(text_col), threshold, min_len))


_COUNTS_TYPE = "array<struct<sentence:string,n:bigint>>"


def _run_lengths(so: Column) -> Column:
    """(value, occurrences) of each distinct value of a sorted array, read
    off the positions where the value changes."""
    n = F.size(so)
    ends = F.filter(F.sequence(F.lit(1), n),
                    lambda i: (i == n) | (F.element_at(so, i) != F.try_element_at(so, i + 1)))

    def counted(ends_arr: Column) -> Column:
        return F.transform(ends_arr, lambda e, j: F.struct(
            F.element_at(so, e).alias("sentence"),
            (e - F.when(j == 0, F.lit(0)).otherwise(F.element_at(ends_arr, j))).cast("bigint").alias("n")))

    return F.when(n == 0, F.array().cast(_COUNTS_TYPE)).otherwise(bind(ends, counted))


def sentence_counts(text: Column, min_len: int) -> Column:
    """array<struct<sentence:string, n:bigint>>: every distinct qualifying
    sentence of the text with its number of occurrences, from one sort of the
    row's sentences."""
    return bind(F.array_sort(sentences(text, min_len)), _run_lengths)


def repeated_sentences(df: DataFrame, id_col: str, text_col: str, threshold: int = 2,
                       min_len: int = 20) -> DataFrame:
    """(id, sentence, n) for every sentence occurring ``threshold``+ times in
    its text (A8). Each text is split once; texts without any duplicate skip
    the sort."""
    def repeated(s: Column) -> Column:
        runs = F.filter(bind(F.array_sort(s), _run_lengths), lambda r: r["n"] >= threshold)
        if threshold < 2:
            return runs
        return F.when(F.size(s) > F.size(F.array_distinct(s)), runs).otherwise(F.array().cast(_COUNTS_TYPE))

    return df.select(F.col(id_col), F.inline(bind(sentences(F.col(text_col), min_len), repeated)))


def repetition_flags(df: DataFrame, text_col: str, threshold: int, min_len: int,
                     name: str = "is_repeating") -> DataFrame:
    return df.withColumn(name, is_repeating(F.col(text_col), threshold, min_len))
