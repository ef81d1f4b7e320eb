"""PostgreSQL type names, strict text codecs, and what each mask does with each type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names by codec; anything else is text.
FAMILIES = {
    "int": ["integer", "bigint", "smallint", "int2", "int4", "int8", "serial", "bigserial", "smallserial"],
    "float": ["real", "double precision", "float4", "float8", "numeric", "decimal"],
    "bool": ["boolean", "bool"],
    "timestamp": ["timestamp without time zone", "timestamp with time zone", "timestamptz", "timestamp"],
    "date": ["date"],
    "bytea": ["bytea"],
    "json": ["json", "jsonb"],
}
# Spellings of the two truth values.
TRUE, FALSE = ["t", "true", "1", "yes", "on"], ["f", "false", "0", "no", "off"]
SIMPLE = {"bigint": "bigint", "int": "integer", "smallint": "smallint", "tinyint": "smallint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "date": "date", "binary": "bytea"}


def pg_type(kind: T.DataType) -> str:
    """The PostgreSQL name of a Spark type."""
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return pg_type(kind.elementType) + "[]"
    return SIMPLE.get(kind.simpleString(), "text")


def normalize(name: str) -> str:
    """Lower case, without modifiers in brackets: ``timestamp(3) without time zone`` loses its ``(3)``."""
    name = name.lower().strip()
    head, bracket, tail = name.partition("(")
    return (head + tail.partition(")")[2]).strip() if bracket else name


def family(pg: str) -> str:
    name = normalize(pg)
    return next((f for f, names in FAMILIES.items() if name in names), "text")


def bool_value(c: Column) -> Column:
    """True, false, or NULL where the text is neither."""
    return F.when(F.lower(c).isin(TRUE), True).when(F.lower(c).isin(FALSE), False)


def valid(c: Column, codec: str) -> Column:
    """Does a text pass the codec? NULL passes. Spark's casts alone are laxer: they trim and take 1d or 2024-1-5."""
    if codec == "int":
        ok = c.rlike(r"^[+-]?[0-9]+$") & c.try_cast("bigint").isNotNull()
    elif codec == "float":
        number = c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        named = F.lower(c).rlike(r"^[+-]?(nan|inf|infinity)$")
        value = c.try_cast("double")
        ok = named | (number & value.isNotNull() & (F.abs(value) < F.lit(float("inf"))))
    elif codec == "bool":
        ok = bool_value(c).isNotNull()
    elif codec == "timestamp":
        shape = c.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d{1,9})?([+-]\d{2}(:\d{2})?)?|T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z)$")
        ok = shape & F.substring(c, 1, 19).try_cast("timestamp_ntz").isNotNull()
    elif codec == "date":
        ok = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()
    elif codec == "bytea":
        ok = ~c.startswith("\\x") | c.rlike(r"^\\x([0-9a-fA-F]{2})*$")
    elif codec == "json":
        # wrapped, so that anything after the first value is noticed
        whole = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).cast("array<variant>")
        ok = F.coalesce(F.size(whole) == 1, F.lit(False)) & (F.trim(c) != "")
    else:
        ok = F.lit(True)
    return c.isNull() | F.coalesce(ok, F.lit(False))


def decode(c: Column, codec: str) -> Column:
    """The typed value of a text; NULL where it fails (see ``valid``)."""
    good = lambda x: F.when(valid(c, codec), x)
    if codec == "int":
        return good(c.try_cast("bigint"))
    if codec == "float":
        return good(c.try_cast("double"))
    if codec == "bool":
        return bool_value(c)
    if codec == "timestamp":
        return good(F.translate(F.substring(c, 1, 26), "TZ", " ").try_cast("timestamp_ntz"))
    if codec == "date":
        return good(c.try_cast("date"))
    if codec == "bytea":
        return F.when(c.startswith("\\x"), good(F.unhex(F.substring(c, F.lit(3), F.length(c))))).otherwise(c.cast("binary"))
    return good(c)


def encode(c: Column, kind: T.DataType) -> Column:
    """PostgreSQL text of a typed value: t/f, \\x hex, numbers without exponent, json for nested ones."""
    name = kind.simpleString()
    if name == "boolean":
        return F.when(c, "t").when(~c, "f")
    if name == "binary":
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    if name in ("double", "float"):
        text = c.cast("string")
        plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        whole = F.regexp_replace(text, r"\.0$", "")
        return F.when(text.contains("E"), F.coalesce(plain, text)).otherwise(whole)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


#: Codec families whose values a mask can write: the mask's text, or the number that random-int makes.
ACCEPTS = {
    "preserve": {"int", "float", "bool", "timestamp", "date", "bytea", "json", "text"},
    "redact": {"bytea", "text"},
    "mask-email": {"bytea", "text"},
    "mask-name": {"bytea", "text"},
    "hash-sha256": {"bytea", "text"},
    "random-int": {"int", "float", "json", "text"},
}


def writes(mask: str, codec: str) -> bool:
    """Can the mask's output be stored in such a column? Masks that are not built in are taken to write text."""
    return codec in ACCEPTS.get(mask, {"bytea", "text"})
