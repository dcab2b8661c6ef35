"""Seeded sampling and capped filtering.

A cap ``n`` is found on keys alone. Every row has a key in a total order (the
order column with nulls last, then hashes of the whole row), and the narrow
keys are written once and ranked over a range-partitioned sort; the n-th key
is the cutoff, and full rows pass an ordinary ``key <= cutoff`` filter where
they are read. Only rows that are equal in every column tie, so of the rows
at the cutoff any will do. One path serves every size; no text is shuffled
and no task gathers rows in proportion to ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranking import ranked, written
from ..session import filter_here


def correct_untruncated(df: DataFrame) -> DataFrame:
    """Rows that go to the "correct" file: correct and not truncated."""
    return df.where(F.col("is_correct") & ~F.col("truncated"))


def seed_order(seed: int, key: str) -> Column:
    """A pseudo-random but seed-fixed order: md5(seed:key). It depends only
    on the row, never on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _total_order(df: DataFrame, order: list[Column]) -> Column:
    """One struct that orders all rows: ``order`` with nulls last, then two
    hashes of the row, so that only equal rows tie."""
    parts = []
    for i, c in enumerate(order):
        parts += [c.isNull().alias(f"n{i}"), c.alias(f"o{i}")]
    row = [F.col(f"`{c}`") for c in df.columns]
    return F.struct(*parts, F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2"))


def _nth(keys: DataFrame, n: int) -> tuple[Column, int] | None:
    """The n-th smallest ``key`` as a literal and how many of its equals are
    among the first n; None if there are fewer rows. ``keys`` is a written
    table."""
    if keys.count() < n:
        return None
    # the written row breaks ties, so that a frequent key is sorted by many tasks
    row = F.monotonically_increasing_id()
    last = ranked(keys.select("key").withColumn("row", row), ["key", "row"]).where(F.col("rank") == n - 1).first()
    kinds = keys.schema["key"].dataType
    cut = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last["key"], kinds)])
    return cut, n - keys.where(F.col("key") < cut).count()


def _up_to(df: DataFrame, key: Column, cut: Column, ties: int) -> DataFrame:
    """Rows before the cutoff, and ``ties`` of the equal rows at it."""
    marked = df.withColumn("__key", key)
    before = marked.where(F.col("__key") < cut).drop("__key")
    return before.unionByName(marked.where(F.col("__key") == cut).limit(ties).drop("__key"))


def seeded_sample(df: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """``n`` rows chosen by the seed, as a set without order; all rows for
    None or an ``n`` past the row count, none for 0."""
    if n is None:
        return df
    if n == 0:
        return df.limit(0)
    order = _total_order(df, [seed_order(seed, key), F.col(key)])
    found = _nth(written(df.select(order.alias("key")), "sample-keys"), n)
    return df if found is None else _up_to(df, order, *found)


def first_n(df: DataFrame, keep: Column, order_col: str | list[str], n: int | None,
            filtered: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` kept rows in the order of one column or of several
    (nulls last, all kept rows for None) and the processed / filtered / saved report of a pass that
    stops after the n-th saved row, from one decision per row.

    ``filtered`` tells which of the rows that aren't kept count as filtered
    (all of them by default); others are only processed.
    """
    out = ~F.coalesce(keep, F.lit(False)) if filtered is None else F.coalesce(filtered, F.lit(False))
    counts = [F.count(F.lit(1)).alias("processed"), F.count_if("out").alias("filtered"), F.count_if("kept").alias("saved")]
    if n == 0:
        return df.limit(0), df.select(out.alias("out"), keep.alias("kept")).limit(0).agg(*counts)
    order = _total_order(df, [F.col(c) for c in ([order_col] if isinstance(order_col, str) else order_col)])
    rows = written(df.select(order.alias("key"),
                             F.coalesce(keep, F.lit(False)).alias("kept"), out.alias("out")), "keep-decisions")
    found = None if n is None else _nth(rows.where("kept"), n)
    if found is None:
        return filter_here(df, keep), rows.agg(*counts)
    cut, ties = found
    kept = _up_to(df, order, cut, ties)
    before = rows.where(F.col("key") < cut)
    report = before.agg(*counts).select(*[(F.col(c) + extra).cast("bigint").alias(c)
                                          for c, extra in (("processed", ties), ("filtered", 0), ("saved", ties))])
    return filter_here(kept, keep), report


def first_n_kept(df: DataFrame, keep: Column, order_col: str, n: int | None) -> DataFrame:
    """The rows of ``first_n``."""
    return filter_here(df, keep) if n is None else first_n(df, keep, order_col, n)[0]


def first_n_report(df: DataFrame, keep: Column, order_col: str, n: int | None) -> DataFrame:
    """The report of ``first_n``."""
    return first_n(df, keep, order_col, n)[1]
