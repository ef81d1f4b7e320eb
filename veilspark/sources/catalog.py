"""Sources of tables, their columns and foreign keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.pgtypes import pg_type

from .database import Database, ForeignKey, TableInfo, quoted, regrouped


CATALOG = T.StructType([T.StructField("schema", T.StringType()), T.StructField("table", T.StringType()), T.StructField("column", T.StringType()), T.StructField("type", T.StringType()), T.StructField("position", T.LongType()), T.StructField("nullable", T.BooleanType())])


class Source:
    """Tables by full name. Subclasses give ``names`` and ``read``."""

    def __init__(self, spark: SparkSession, foreign_keys: list[ForeignKey] | None = None):
        self.spark, self._keys = spark, list(foreign_keys or [])

    def names(self) -> list[str]:
        raise NotImplementedError

    def read(self, table: str) -> DataFrame:
        raise NotImplementedError

    def foreign_keys(self) -> list[ForeignKey]:
        return sorted(self._keys, key=lambda k: (k.from_table, k.name))

    def version(self) -> str:
        return self.spark.version

    def query(self, table: str, where: str) -> DataFrame:
        """A scan filtered by predicate text, which Catalyst pushes into the source."""
        return self.read(table).where(F.expr(where))

    def schemas(self) -> dict[str, dict[str, str]]:
        """table -> column -> type name, in order."""
        return {t: {f.name: pg_type(f.dataType) for f in self.read(t).schema.fields} for t in self.names()}

    def catalog(self) -> DataFrame:
        rows = []
        for name in self.names():
            schema, _, table = name.rpartition(".")
            rows += [(schema or "public", table, f.name, pg_type(f.dataType), n, f.nullable) for n, f in enumerate(self.read(name).schema.fields, 1)]
        return self.spark.createDataFrame(rows, CATALOG)


class ParquetSource(Source):
    """A folder with one Parquet table ``<name>.parquet`` each; ``tables`` names them."""

    def __init__(self, spark: SparkSession, path: str, tables: list[str] | None = None, foreign_keys: list[ForeignKey] | None = None):
        super().__init__(spark, foreign_keys)
        self.path, self._tables = path.rstrip("/"), tables

    def names(self) -> list[str]:
        if self._tables is None:
            jvm = self.spark._jvm.org.apache.hadoop.fs
            folder = jvm.Path(self.path)
            found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
            self._tables = [n[: -len(".parquet")] for s in found if (n := s.getPath().getName()).endswith(".parquet")]
        return sorted(self._tables)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")


@dataclass
class FrameSource(Source):
    """Tables given as DataFrames."""

    spark: SparkSession
    frames: dict[str, DataFrame]
    keys: list[ForeignKey] = field(default_factory=list)

    def __post_init__(self) -> None:
        Source.__init__(self, self.spark, self.keys)

    def names(self) -> list[str]:
        return sorted(self.frames)

    def read(self, table: str) -> DataFrame:
        return self.frames[table]


#: Columns of a catalog query of foreign keys, a row for each column pair.
KEY_ROWS = "schema string, table string, name string, position int, column string, to_schema string, to_table string, to_column string"


def keys_of(rows: DataFrame) -> list[ForeignKey]:
    """Foreign keys from a table of ``KEY_ROWS``."""
    return regrouped(tuple(r) for r in rows.select("schema", "table", "name", "position", "column", "to_schema", "to_table", "to_column").collect())  # a catalog: a row for each key's column


class JdbcSource(Source):
    """A database behind Spark's JDBC reader; needs the database's driver on the class path.

    A table whose primary key begins with a whole number is read in ``parts`` ranges of it at once, other tables by one
    task; ``partition`` maps a table to its own (column, lower, upper, parts). Ranges are bounds of equal width, and the
    first and last take what lies outside, so no row is lost.
    """

    def __init__(self, spark: SparkSession, options: dict[str, str], partition: dict[str, tuple[str, str, str, int]] | None = None, parts: int | None = None, fetch: int = 10_000, schemas: list[str] | None = None):
        super().__init__(spark)
        self.database = Database(spark, options, schemas)
        self.options, self.partition, self.fetch = self.database.options, partition or {}, fetch
        self.parts = parts or max(2, spark.sparkContext.defaultParallelism)
        self._info: dict[str, TableInfo] | None = None

    def _load(self, **more: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, fetchsize=str(self.fetch), **more).load()

    def describe(self) -> dict[str, TableInfo]:
        if self._info is None:
            self._info = self.database.describe()
        return self._info

    def names(self) -> list[str]:
        return list(self.describe())

    def schemas(self) -> dict[str, dict[str, str]]:
        return {t: {c.name: c.type for c in info.columns} for t, info in self.describe().items()}

    def ranges(self, table: str) -> tuple[str, str, str, int] | None:
        if table in self.partition:
            return self.partition[table]
        info = self.describe()[table]
        column = info.primary_key[0] if info.primary_key else None
        if column is None or {c.name: c.type for c in info.columns}[column].split("(")[0] not in ("bigint", "integer", "int", "int8", "int4", "int2", "smallint", "serial", "bigserial"):
            return None
        q = '"' + column.replace('"', '""') + '"'
        low, high = self._load(query=f"SELECT min({q}) AS low, max({q}) AS high FROM {quoted(table)}").first()
        return None if low is None or low == high else (column, str(low), str(high), min(self.parts, int(high) - int(low)))

    def read(self, table: str) -> DataFrame:
        more, ranges = {"dbtable": quoted(table)}, self.ranges(table)
        if ranges is not None:
            column, low, high, parts = ranges
            more |= {"partitionColumn": f'"{column}"', "lowerBound": low, "upperBound": high, "numPartitions": str(parts)}
        df = self._load(**more)
        types = {c.name: c.type for c in self.describe()[table].columns} if table in self.describe() else {}
        return df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata | {"pg_type": types.get(f.name, pg_type(f.dataType))}) for f in df.schema.fields))

    def foreign_keys(self) -> list[ForeignKey]:
        return self.database.foreign_keys()

    def version(self) -> str:
        return self.database.version()


_drivers: dict[str, Callable[..., Source]] = {}


def register_driver(name: str, make: Callable[..., Source]) -> None:
    _drivers[name] = make


def driver(name: str) -> Callable[..., Source]:
    if name not in _drivers:
        raise ValueError(f"unknown driver: {name}; known: {', '.join(drivers())}")
    return _drivers[name]


def drivers() -> list[str]:
    return sorted(_drivers)


register_driver("parquet", ParquetSource)
register_driver("frames", FrameSource)
register_driver("jdbc", JdbcSource)
