"""The masking projection: one select per table, checked by type, NULLs kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import masks, pgtypes


def bind(columns: list[str], rules: dict[str, str]) -> list[masks.Mask | None]:
    """A mask or None for each column. An unknown mask is an error; rules for other columns are ignored."""
    bound = {c: masks.get(name) for c, name in rules.items()}
    return [bound.get(c) for c in columns]


def check_masks(rules: dict[str, dict[str, str]]) -> None:
    """Up-front check that every configured mask exists."""
    for table, columns in sorted(rules.items()):
        for column, name in sorted(columns.items()):
            try:
                masks.get(name)
            except ValueError as e:
                raise ValueError(f"table {table}, column {column}: {e}") from None


def _failure(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def masked(field: T.StructField, mask: masks.Mask, pg: str | None = None) -> Column:
    """The masked column in the field's own type. A value that the type cannot take raises, NULL never does.

    ``pg`` is the column's declared type where the frame holds its text, as in COPY data.
    """
    c, kind = F.col(f"`{field.name}`"), field.dataType
    pg = pg or field.metadata.get("pg_type") or pgtypes.pg_type(kind)
    codec = pgtypes.family(pg)
    name = kind.simpleString()
    is_text = isinstance(kind, T.StringType)
    if mask.typed == "same":
        out = mask.build(c)
        if is_text and codec == "bool":
            return F.when(pgtypes.valid(c, codec), F.when(pgtypes.bool_value(c), "t").when(~pgtypes.bool_value(c), "f")).otherwise(_failure(f"decode error: column {field.name}", "string"))
        return F.when(pgtypes.valid(c, codec), out).otherwise(_failure(f"decode error: column {field.name}", "string")) if is_text and codec != "text" else out
    if not pgtypes.writes(mask.name, codec):
        return F.when(c.isNotNull(), _failure(f"encode error: column {field.name}: {mask.name} cannot write {pg}", name))
    text = c if is_text else pgtypes.encode(c, kind)
    out = mask.build(text if mask.typed is None else c)
    out = out.cast("string") if is_text or isinstance(kind, T.BinaryType) else out
    if is_text and codec != "text":
        out = F.when(pgtypes.valid(c, codec), out).otherwise(_failure(f"decode error: column {field.name}", "string"))
    return out.cast(kind)


def mask(df: DataFrame, rules: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """All columns in order, those with a rule masked. Works on streams too, as every mask is a row-wise expression."""
    bound = bind(df.columns, rules)
    types = types or {}
    return df.select(*(F.col(f"`{f.name}`") if m is None else masked(f, m, types.get(f.name)).alias(f.name) for f, m in zip(df.schema.fields, bound)))
