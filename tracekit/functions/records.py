"""Access to loosely-shaped records.

Records come either as typed struct columns (when the schema is known) or
as raw JSON text (when it varies line by line). Both paths stay in the JVM:
``getField`` / ``element_at`` for structs, ``get_json_object`` for text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(r"^([^\[\]]*)((?:\[\d+\])*)$")


def json_path(path: str) -> str:
    """``a.b[0].c`` → ``$.a.b[0].c`` (validated)."""
    for part in path.split("."):
        if not _PART.match(part):
            raise ValueError(f"bad path part {part!r} in {path!r}")
    return "$." + path


def path_value(json_text: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text column as a string.

    A list result yields its first element; a missing path, a null, an empty
    list and a list that starts with null yield "".
    """
    if not path:
        return F.lit("")
    jp = json_path(path)
    parsed = F.try_parse_json(json_text)
    kind = F.schema_of_variant(F.try_variant_get(parsed, jp, "variant"))
    null_first = F.is_variant_null(F.try_variant_get(parsed, jp + "[0]", "variant"))
    value = (F.when(kind.startswith("ARRAY") & F.coalesce(null_first, F.lit(False)), F.lit(""))
             .when(kind.startswith("ARRAY"), F.get_json_object(json_text, jp + "[0]"))
             .otherwise(F.get_json_object(json_text, jp)))
    return F.coalesce(value, F.lit(""))


def first_response(col: Column, dtype: T.DataType | None = None) -> Column:
    """First response of ``filtered_resps``: ``r[0]``, or ``r[0][0]`` when
    it is a list of lists. For JSON text pass the text column and no dtype."""
    if dtype is None:
        return F.coalesce(F.get_json_object(col, "$[0][0]"), F.get_json_object(col, "$[0]"))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.ArrayType):
        return F.try_element_at(F.try_element_at(col, F.lit(1)), F.lit(1))
    return F.try_element_at(col, F.lit(1))


def with_fallback(json_text: Column, prompt_path: str, response_path: str) -> tuple[Column, Column]:
    """(prompt, response) of a JSON record by path; where both come out
    empty, of the evaluation harness's fields ``doc.problem`` and the first of
    ``filtered_resps`` (P2)."""
    p, r = path_value(json_text, prompt_path), path_value(json_text, response_path)
    both_empty = (p == "") & (r == "")
    prompt = F.when(both_empty, F.coalesce(F.get_json_object(json_text, "$.doc.problem"), p)).otherwise(p)
    response = F.when(both_empty, F.coalesce(first_response(F.get_json_object(json_text, "$.filtered_resps")), r)).otherwise(r)
    return prompt, response


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that ``df`` lacks, as given."""
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: list[str], unless: str | None = None) -> DataFrame:
    """``df`` if it has the columns, or the column ``unless`` that makes them
    needless; otherwise a ValueError that names missing and found ones (P8)."""
    missing = missing_columns(df, columns)
    if missing and (unless is None or unless not in df.columns):
        raise ValueError(f"missing required columns {missing}; found columns {df.columns}")
    return df


_TRUE_WORDS = ["true", "1", "yes", "correct"]


def as_correct_typed(df: DataFrame, name: str) -> Column:
    """Correctness of a typed column, dispatching on its Spark type at plan
    time: numbers → > 0, booleans as is, strings → one of true/1/yes/correct
    (any case), arrays → their first element; null → false."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    return F.coalesce(_correct_of(col, dtype), F.lit(False))


def _correct_of(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col
    if isinstance(dtype, T.NumericType):
        return col > 0
    if isinstance(dtype, T.StringType):
        return F.lower(col).isin(_TRUE_WORDS)
    if isinstance(dtype, T.ArrayType):
        return _correct_of(F.try_element_at(col, F.lit(1)), dtype.elementType)
    return F.lit(False)


def as_correct_json(json_text: Column, fields: list[str]) -> Column:
    """Correctness read from raw JSON, trying ``fields`` in order (the first
    value that is neither missing nor a JSON null wins). Uses VARIANT to tell
    booleans, numbers, strings and lists apart."""
    if not fields:
        return F.lit(False)
    v = F.try_parse_json(json_text)
    found = [F.variant_get(v, f"$.{f}", "variant") for f in fields]
    value = F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])
    first = F.when(F.schema_of_variant(value).startswith("ARRAY"),
                   F.variant_get(value, "$[0]", "variant")).otherwise(value)
    kind = F.schema_of_variant(first)
    num = F.try_variant_get(first, "$", "double")
    text = F.try_variant_get(first, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(first, "$", "boolean"))
        .when(kind.rlike("^(BIGINT|INT|DOUBLE|DECIMAL|FLOAT|SMALLINT|TINYINT)"), num > 0)
        .when(kind == "STRING", F.lower(text).isin(_TRUE_WORDS)),
        F.lit(False))


def budget_from_path(path: Column) -> Column:
    """struct<steps:int, tokens:int> parsed out of a run's file path.

    Step limit: the text after the last ``step``, up to ``/``, up to
    ``forcing``. Failing that, the token limit: the text before the first
    ``tokens``, its last ``-`` part, its last ``_`` part. Else both null.
    """
    steps = F.substring_index(F.substring_index(F.substring_index(path, "step", -1), "/", 1),
                              "forcing", 1).try_cast("int")
    tokens = F.substring_index(F.substring_index(F.substring_index(path, "tokens", 1), "-", -1),
                               "_", -1).try_cast("int")
    return F.struct(steps.alias("steps"),
                    F.when(steps.isNull(), tokens).alias("tokens"))
