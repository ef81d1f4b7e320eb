"""Masking functions as column expressions, and the registry that configuration names refer to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pools of synthetic names, in order.
FIRST_NAMES = ["James", "Maria", "John", "Ana", "Robert", "Linda", "David", "Sarah", "Michael", "Emma", "William", "Olivia", "Richard", "Sophia", "Thomas", "Isabella", "Daniel", "Mia"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez", "Wilson", "Anderson", "Taylor", "Thomas", "Moore", "Jackson", "Martin", "Lee"]
REDACTED = "***REDACTED***"
MASKED_EMAIL = "masked@example.com"
RANDOM_INT_BOUND = 1_000_000
# The column types that each mask declares.
TEXT_TYPES = ["text", "varchar", "character varying"]


@dataclass(frozen=True)
class Mask:
    """build maps a column to the masked column; NULL stays NULL. ``typed`` is the type it returns, None for text,
    "same" for the input's own."""

    name: str
    build: Callable[[Column], Column]
    description: str
    help: str
    types: tuple[str, ...]
    examples: tuple[tuple[str, str], ...] = ()
    typed: str | None = None


def preserve(c: Column) -> Column:
    return c


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(REDACTED))


def hash_sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def mask_email(c: Column) -> Column:
    at = F.instr(c, "@")
    local = F.substring(F.sha2(F.substring(c, F.lit(1), at - 1), 256), 1, 8)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(at == 0, F.lit(MASKED_EMAIL)).otherwise(F.concat(local, F.substring(c, at, F.length(c))))


def mask_name(c: Column) -> Column:
    number = F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")
    pick = lambda pool, n: F.element_at(F.array(*map(F.lit, pool)), (n % len(pool) + 1).cast("int"))
    return F.when(c.isNotNull(), F.concat_ws(" ", pick(FIRST_NAMES, number), pick(LAST_NAMES, F.floor(number / len(FIRST_NAMES)))))


def random_int(c: Column, seed: int | None = None) -> Column:
    draw = F.rand() if seed is None else F.rand(seed)
    return F.when(c.isNotNull(), F.floor(draw * RANDOM_INT_BOUND).cast("long"))


_registry: dict[str, Mask] = {}


def register(mask: Mask) -> None:
    """Adds or replaces a mask; user code may register any function from Column to Column, pandas UDFs included."""
    _registry[mask.name] = mask


def get(name: str) -> Mask:
    try:
        return _registry[name]
    except KeyError:
        raise ValueError(f"unknown transformer: {name}") from None


def names() -> list[str]:
    return sorted(_registry)


def all_masks() -> list[Mask]:
    return [_registry[n] for n in names()]


for _mask in (
    Mask("preserve", preserve, "Leaves values as they are", "The value passes through unchanged, after its type's check.", (*TEXT_TYPES, "integer", "bigint", "smallint", "numeric", "real", "double precision", "boolean", "timestamp", "timestamptz", "date", "json", "jsonb", "uuid", "bytea"), (("keep me", "keep me"),), "same"),
    Mask("redact", redact, "Puts a constant in place of every value", f"Every non-NULL value becomes {REDACTED}.", (*TEXT_TYPES, "integer", "bigint", "numeric", "timestamp", "date", "boolean", "json", "jsonb"), (("sensitive data", REDACTED),)),
    Mask("hash-sha256", hash_sha256, "SHA-256 of the value, in hex", "The full digest of the UTF-8 bytes, 64 lower-case hex digits. Equal values stay equal, so masked keys still join.", (*TEXT_TYPES, "uuid", "bytea"), (("hello", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"),)),
    Mask("mask-email", mask_email, "Hides the local part of an e-mail address, keeps the domain", f"The part before the first @ becomes 8 hex digits of its SHA-256; without an @ the value becomes {MASKED_EMAIL}.", tuple(TEXT_TYPES), (("alice@company.com", "2bd806c9@company.com"), ("bob.smith@gmail.com", "365b77fb@gmail.com"))),
    Mask("mask-name", mask_name, "Puts a synthetic first and last name in place of a name", "The first 32 bits of the SHA-256 choose one of 324 names, the same for equal values.", tuple(TEXT_TYPES), (("Alice Johnson", "Emma Taylor"), ("Bob Smith", "Isabella Johnson"))),
    Mask("random-int", random_int, "A random integer from 0 to 999999", "Uniform and not repeatable, unless the mask is built with a seed.", ("integer", "bigint", "smallint", "numeric"), (("42", "a number below 1000000"),), "bigint"),
):
    register(_mask)


def catalog(spark):
    """name, description, types (comma-joined), n_examples of every registered mask, by name."""
    rows = [(m.name, m.description, ", ".join(m.types), len(m.examples)) for m in all_masks()]
    return spark.createDataFrame(rows, T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("types", T.StringType()), T.StructField("n_examples", T.LongType())])).orderBy("name")


def show(name: str) -> str:
    m = get(name)
    lines = [f"{m.name}: {m.description}", "", m.help, "", f"Types: {', '.join(m.types)}", "Examples:", *(f"  {a} -> {b}" for a, b in m.examples)]
    return "\n".join(lines)
