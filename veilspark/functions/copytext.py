"""COPY text: tab-separated fields, ``\\N`` for NULL, backslash escapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pgtypes

NULL = "\\N"
# Control characters and their letters.
ESCAPES = [("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\u000b", "v")]


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit("\\" + e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    """Undoes ``escape``. Escaped backslashes are parked as NUL, which such text cannot hold."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    c = reduce(lambda x, e: F.replace(x, F.lit("\\" + e[1]), F.lit(e[0])), ESCAPES, c)
    return F.replace(c, F.lit("\u0000"), F.lit("\\"))


def line(df: DataFrame) -> Column:
    """One COPY line of all columns of ``df``."""
    fields = [F.coalesce(escape(pgtypes.encode(F.col(f"`{f.name}`"), f.dataType)), F.lit(NULL)) for f in df.schema.fields]
    return F.concat_ws("\t", *fields)


def write(df: DataFrame, path: str) -> None:
    df.select(line(df).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def parse(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows from a column ``value`` of COPY lines."""
    parts = F.split("value", "\t", -1)
    columns = []
    for n, f in enumerate(schema.fields):
        raw = F.get(parts, F.lit(n))
        text = F.when(raw != NULL, unescape(raw))
        if isinstance(f.dataType, T.BooleanType):
            value = pgtypes.bool_value(text)
        elif isinstance(f.dataType, T.BinaryType):
            value = pgtypes.decode(text, "bytea")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.from_json(text, f.dataType)
        else:
            value = text.cast(f.dataType)
        columns.append(value.alias(f.name))
    return lines.select(*columns)


def read(spark, path: str, schema: T.StructType) -> DataFrame:
    """The text reader keeps empty strings apart from NULL, which the CSV reader does not."""
    return parse(spark.read.text(path), schema)
