"""Lines of text files in their files' own order, and tables aligned by it.

Spark reads a file in blocks, each by one task from its first line to its last.
Every line therefore carries (file, block, at): the path, the byte its block
starts at, and a number that rises within the block, and these three order all lines as
the files have them. Line numbers are prefix sums: one count per block
(never the data) is added up over the blocks before it, so a line gets its number where it is
read, without a sort or a shuffle of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ranking import ROW_BITS, written

ORDER = ["_file", "_block", "_at"]


def with_order(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, with the columns of ``ORDER``."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _file, _block, _at) of all lines; several files follow one
    another in the order of their paths."""
    return with_order(spark.read.text(path))


def _offsets(lines: DataFrame, counted: Column | None = None) -> DataFrame:
    """(_file, _block, first, n, lines_before) for each block: its smallest
    ``_at``, its lines and those before it; with ``counted`` only such lines count."""
    n = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    blocks = written(lines.groupBy("_file", "_block").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"), n.alias("c")), "line-blocks")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_file", "_block", "first", "n", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("lines_before"))


def with_line_numbers(lines: DataFrame, name: str = "line") -> DataFrame:
    """``lines`` of ``with_order`` with their 0-based number in the order of
    all files. Runs one job that counts lines by block.

    The numbers rest on both passes reading the same blocks, which Spark
    cuts from the file sizes and the session's settings; a block that came out otherwise is an error.
    """
    # one row for each block of a file
    found = lines.join(F.broadcast(_offsets(lines)), ["_file", "_block"], "left")
    place = F.col("_at") - F.col("first")
    same = F.shiftright("_at", ROW_BITS) == F.shiftright("first", ROW_BITS)
    ok = F.coalesce(same & (place >= 0) & (place < F.col("n")), F.lit(False))
    number = F.when(ok, F.col("lines_before") + place).otherwise(F.raise_error(F.lit("files changed while their lines were counted")).cast("long"))
    return found.withColumn(name, number).drop("first", "n", "lines_before")


def align(left: DataFrame, right: DataFrame, on: str = "line") -> DataFrame:
    """Two tables row by row at the same position ``on``: a full outer join, so
    that rows beyond the shorter one stay, with ``_only`` = "left" or "right" (null for
    a pair). Neither has other columns of the same name; positions are unique."""
    marked = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    only = F.when(F.col("_r").isNull(), F.lit("left")).when(F.col("_l").isNull(), F.lit("right"))
    return marked.withColumn("_only", only).drop("_l", "_r")


def alignment_report(aligned: DataFrame) -> DataFrame:
    """One row: pairs, and rows that have no partner on either side."""
    return aligned.agg(F.count_if(F.col("_only").isNull()).alias("pairs"), F.count_if(F.col("_only") == "left").alias("only_left"),
                       F.count_if(F.col("_only") == "right").alias("only_right"))
