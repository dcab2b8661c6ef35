"""Exact percentiles by refining histograms.

``percentile`` keeps a map from value to count, which grows with the distinct
values. Here each pass counts the values of the ranges that still hold a wanted
rank in a fixed number of parts, and keeps the part with the rank and its
smallest and largest value; a range that holds one value ends. No task and
not the driver ever holds more than ranks x parts counts, however many distinct
values there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ranking import written

PARTS = 1024


def _kth_values(values: DataFrame, ranks: list[int], low, high, integral: bool) -> dict[int, float | int]:
    """The values at the 0-based ``ranks`` of the written one-column table."""
    found: dict[int, float | int] = {}
    # a range: its smallest and largest value, the number of values below it, its ranks
    ranges = [(low, high, 0, ranks)]
    v = F.col("v")
    while ranges:
        open_ = []
        for lo, hi, below, wanted in ranges:
            if lo == hi:
                found.update(dict.fromkeys(wanted, lo))
            else:
                open_.append((lo, hi, below, wanted))
        if not open_:
            break
        which, part = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (lo, hi, *_) in enumerate(open_):
            inside = v.between(F.lit(lo).cast("long" if integral else "double"), F.lit(hi).cast("long" if integral else "double"))
            if integral:
                width = (hi - lo) // PARTS + 1
                own = F.floor((v.cast("decimal(20,0)") - F.lit(str(lo)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("long")
            else:  # divided first: the difference of two doubles may not be one
                own = F.floor((v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * PARTS).cast("long")
            which, part = F.when(inside, i).otherwise(which), F.when(inside, F.least(own, F.lit(PARTS - 1).cast("long"))).otherwise(part)
        rows = values.select("v", which.alias("which"), part.alias("part")).where("which is not null")
        counts = rows.groupBy("which", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        ranges = []
        for i, (_, _, below, wanted) in enumerate(open_):
            for r in sorted((r for r in counts if r["which"] == i), key=lambda r: r["part"]):
                here = [k for k in wanted if below <= k < below + r["n"]]
                if here:
                    ranges.append((r["lo"], r["hi"], below, here))
                below += r["n"]
    return found


def exact_percentiles(df: DataFrame, col: str, shares: list[float]) -> list[float] | None:
    """The percentiles of a numeric column at ``shares`` (0 to 1), linearly
    interpolated, equal to ``percentile`` to the last bit; None without values.
    Nulls and NaN don't count. The narrow column is written once; a pass reads it
    about once for each three digits of the values' range."""
    kind = df.schema[col].dataType
    integral = isinstance(kind, T.IntegralType)
    v = F.col(col).cast("long" if integral else "double")
    values = written(df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v.cast("double"))), "percentile-values")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    if not integral and (math.isinf(low) or math.isinf(high)):
        raise ValueError(f"{col} has infinite values")
    places = [share * (n - 1) for share in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    at = _kth_values(values, ranks, low, high, integral)
    out = []
    for p in places:
        lower, upper = at[math.floor(p)], at[math.ceil(p)]
        out.append(float(lower) if lower == upper else (math.ceil(p) - p) * float(lower) + (p - math.floor(p)) * float(upper))
    return out


def refined_length_stats(df: DataFrame, len_col: str = "len", shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99),
                         digits: int | None = 6) -> DataFrame:
    """``length_stats`` for columns with any number of distinct values. Runs jobs."""
    found = exact_percentiles(df, len_col, list(shares))
    c = F.col(len_col)
    stats = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean_len"), F.min(c).cast("bigint").alias("min_len"), F.max(c).cast("bigint").alias("max_len"))
    values = [F.lit(None if found is None else found[i]).cast("double") for i in range(len(shares))]
    return stats.select("*", *[(x if digits is None else F.round(x, digits)).alias(f"p{int(q * 100)}") for q, x in zip(shares, values)])
