"""A seeded order of all rows, and samples that come with it.

The order is a bijection on row positions, so each row's place follows from
its own position: no sort by hash, no row sees another. It is a Feistel network
on pairs (l, r) of a grid that just holds the rows: each half is moved by a hash of
the other. Places past the last row walk on through the same bijection until they fall
below it.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..ranking import ranked

ROUNDS = 4
HEX = 15  # hex digits of a hash that are used: 60 bits
MOST_STEPS = 64


def grid(rows: int) -> tuple[int, int]:
    """Sides of the grid, whose product exceeds ``rows`` by less than a side."""
    a = max(1, isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def _hashed(seed: int, step: int, half: Column, side: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("long") % side


def _moved(place: Column, seed: int, a: int, b: int) -> Column:
    """The bijection once, on 0 to a * b - 1."""
    def rounds(l: Column, r: Column, step: int) -> Column:  # noqa: E741
        if step == 2 * ROUNDS:
            return l * b + r
        new_l = (l + _hashed(seed, step, r, a)) % a
        return bind(new_l, lambda x: bind((r + _hashed(seed, step + 1, x, b)) % b, lambda y: rounds(x, y, step + 2)))

    return rounds(F.floor(place / b).cast("long") if b > 1 else place, place % b, 0)


def place_of(position: Column, rows: int, seed: int) -> Column:
    """The place (0 to rows - 1) of the row at ``position`` in the order of
    ``seed``: a bijection. ``rows`` is the number of rows, positions are longs."""
    a, b = grid(rows)
    over = a * b - rows  # a walk meets each place past the last row at most once
    first = _moved(position, seed, a, b)
    if not over:
        return first
    steps = F.sequence(F.lit(1), F.lit(min(over, MOST_STEPS)))
    walked = F.aggregate(steps, first, lambda x, _: F.when(x < rows, x).otherwise(_moved(x, seed, a, b)))
    # beyond MOST_STEPS, which less than one row in 64**64 needs
    return bind(walked, lambda x: F.when(x < rows, x).otherwise(F.raise_error(F.lit("no place found")).cast("long")))


def in_seeded_order(df: DataFrame, position: str, seed: int, n: int | None = None, name: str = "place") -> DataFrame:
    """``df`` with each row's place in the seeded order; with ``n`` only the
    first n. ``position`` numbers the rows from 0 without gaps (line numbers, or
    ``by_key``); the same rows get the same places however they are split. Runs a count."""
    rows = df.select(position).count()
    placed = df.withColumn(name, place_of(F.col(position), rows, seed) if rows else F.lit(0).cast("long"))
    return placed if n is None else placed.where(F.col(name) < n)


def ordered_sample(df: DataFrame, key: str, n: int | None, seed: int, name: str = "place") -> DataFrame:
    """``n`` rows (all for None) with their place in the training order,
    where positions are those of the unique ``key``: the narrow keys are ranked by a
    range-partitioned sort, and the rows come by a join of the chosen keys."""
    keys = ranked(df.select(F.col(key).alias("__key")), ["__key"])
    chosen = in_seeded_order(keys, "rank", seed, n, name).select("__key", name)
    return df.join(chosen, df[key].eqNullSafe(chosen["__key"])).drop("__key")
