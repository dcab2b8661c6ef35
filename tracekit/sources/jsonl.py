"""JSON-lines readers and writers.

Lines are scanned as text and parsed to VARIANT rather than with
``spark.read.json``: the text scan keeps blank and malformed lines visible,
so they can be counted as the original line loop counts them, and any JSON
object is a record whatever its fields' types, while the parse itself stays
in the JVM and splits with the files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from .lines import read_lines

TRACE_SCHEMA = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("problem", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("model_response", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("steps", T.IntegerType()),
])
CORRUPT = "_corrupt_record"


def parse_lines(lines: DataFrame, schema: T.StructType | str, line_col: str = "value",
                keep_line_col: bool = False) -> DataFrame:
    """Parse a text column of JSON objects, reading the fields of ``schema``.

    Adds ``_corrupt_record`` (the raw line when it is no JSON object) and
    ``_blank`` (line is empty or whitespace). Each line is parsed once; a
    field that is missing or of another type than the schema's is null, and
    the record stays a valid one.
    """
    if isinstance(schema, str):
        schema = T.DataType.fromDDL(schema)
    line, parsed = F.col(line_col), F.col("_p")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    cols = [F.try_variant_get(parsed, f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    others = [c for c in lines.columns if keep_line_col or c != line_col]
    # the parse is bound by a generator, so that no field parses the line again
    bound = lines.select("*", (py_strip(F.coalesce(line, F.lit(""))) == "").alias("_blank"),
                         F.inline(F.array(F.struct(F.try_parse_json(line).alias("_p")))))
    return bound.select(*others, *cols, F.when(~is_object, line).alias(CORRUPT), "_blank")


def read_traces(spark: SparkSession, path: str, schema: T.StructType = TRACE_SCHEMA,
                keep_line: bool = False, ordered: bool = False) -> DataFrame:
    """Trace records from JSONL files, malformed lines kept and marked.
    ``_file`` carries each line's source path (for budget-from-path); with
    ``keep_line`` the raw line stays in ``value`` (to write records back
    with every field they had); with ``ordered`` the columns ``lines.ORDER``
    order the records as their files do."""
    lines = read_lines(spark, path) if ordered else spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return parse_lines(lines, schema, keep_line_col=keep_line)


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Evaluation samples from JSONL: blank lines skipped, malformed lines
    dropped (S2)."""
    lines = spark.read.text(path).where(py_strip(F.col("value")) != "")
    return parse_lines(lines, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_blank")


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str | None = None) -> DataFrame:
    """A dataset by file suffix: ``.json``/``.jsonl`` as JSON lines, else
    Parquet (S3); ``fmt`` ("json" / "parquet") overrides the suffix."""
    if fmt == "json" or (fmt is None and (path.endswith(".json") or path.endswith(".jsonl"))):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.json(path)
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields are written, not dropped."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def derived_name(path: str, suffix: str) -> str:
    """``x.jsonl`` → ``x_<suffix>.jsonl``; other names get ``.<suffix>``."""
    out = path.replace(".jsonl", f"_{suffix}.jsonl")
    return out if out != path else f"{path}.{suffix}"


def write_split(df: DataFrame, all_path: str, correct_path: str) -> Row:
    """Write every record to ``all_path`` and the correct, untruncated ones
    to ``correct_path`` (S6); returns Row(total, saved).

    The counts are observed while the records are written (no extra pass),
    and the correct subset is read back from the written files, so expensive
    upstream work (assembly, scoring) runs once and a lost executor
    recomputes from files, not from the start of the lineage.
    """
    keep = F.col("is_correct") & ~F.col("truncated")
    obs = Observation("write_split")
    write_jsonl(df.observe(obs, F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("saved")), all_path)
    written = df.sparkSession.read.schema(df.schema).json(all_path)
    write_jsonl(written.where(keep), correct_path)
    return Row(**obs.get)


MANIFEST = "manifest.json"


def commit_split(df: DataFrame, path: str) -> Row:
    """Write all records under ``path`` in one job, parted by whether they go
    to the correct subset, and publish them by one rename (S6).

    The records land in a folder of their own; then a manifest with that
    folder's name and the counts is written beside it and renamed to its final
    name, which replaces the one before. Readers (``read_split``) only follow the
    manifest, so a crash at any point leaves the earlier records visible, or none,
    never a half. Returns Row(total, saved). Folders of earlier versions stay
    for readers that have them open.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    keep = F.coalesce(F.col("is_correct") & ~F.col("truncated"), F.lit(False))
    obs, data = Observation(f"split-{version}"), f"data-{version}"
    marked = df.observe(obs, F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("saved")).withColumn("correct_part", keep)
    marked.write.partitionBy("correct_part").option("ignoreNullFields", "false").json(f"{path}/{data}")
    counts = obs.get
    _publish(spark, path, json.dumps({"data": data, "schema": df.schema.json(), **counts}), version)
    return Row(**counts)


def _publish(spark: SparkSession, path: str, text: str, version: str) -> None:
    """Write the manifest beside its final name and rename it, which replaces
    an earlier one at once."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    root = fs.Path(path)
    context = fs.FileContext.getFileContext(root.toUri(), conf) if root.toUri().getScheme() else fs.FileContext.getFileContext(conf)
    draft = fs.Path(root, f"_{MANIFEST}-{version}")
    stream = fs.FileSystem.get(root.toUri(), conf).create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark._jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getClass(), 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(draft, fs.Path(root, MANIFEST), options)


def read_manifest(spark: SparkSession, path: str) -> Row:
    """Row(data, schema, total, saved) of the published version of a split."""
    row = spark.read.schema("data string, schema string, total long, saved long").json(f"{path}/{MANIFEST}").first()
    if row is None:
        raise ValueError(f"{path} has no published records")
    return row


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all records, the correct and untruncated ones) of the published
    version; the subset is a pruned partition of the same files."""
    found = read_manifest(spark, path)
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    whole = spark.read.schema(T.StructType([*schema.fields, T.StructField("correct_part", T.BooleanType())])).json(f"{path}/{found['data']}")
    return whole.drop("correct_part"), whole.where("correct_part").drop("correct_part")


def derived_name_column(path: Column, suffix: str) -> Column:
    """``derived_name`` for a column of paths."""
    out = F.replace(path, F.lit(".jsonl"), F.lit(f"_{suffix}.jsonl"))
    return F.when(path.contains(".jsonl"), out).otherwise(F.concat(path, F.lit(f".{suffix}")))


__all__ = ["commit_split", "read_split", "read_manifest", "derived_name_column", "TRACE_SCHEMA", "parse_lines", "read_traces", "read_samples", "read_dataset",
           "write_jsonl", "derived_name", "write_split"]
