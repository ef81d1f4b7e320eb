"""A live database behind its JDBC driver: catalog, keys, version, statements.

The catalog comes from the driver's own metadata, which is the same for every database; foreign keys are put together by
the table that has them and their name, as names are unique within a table only.

An engine inside the driver's process is not reached by executors elsewhere. Its rows go through the shared folder and the
driver: in by the engine's own import, out some megabytes at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing, contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .config import full_name

#: Driver classes by the beginning of the URL.
DRIVERS = {"jdbc:postgresql:": "org.postgresql.Driver", "jdbc:derby:": "org.apache.derby.jdbc.EmbeddedDriver", "jdbc:h2:": "org.h2.Driver", "jdbc:mysql:": "com.mysql.cj.jdbc.Driver"}
SYSTEM_SCHEMAS = {"pg_catalog", "information_schema", "sys", "sysibm", "syscat", "sysfun", "sysproc", "sysstat", "syscs_diag", "syscs_util", "nullid", "sqlj"}
#: For databases other than PostgreSQL, types of the SQL standard in place of PostgreSQL's own.
PORTABLE = {"text": "varchar(32672)", "bytea": "blob", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "json": "clob", "jsonb": "clob", "uuid": "char(36)", "bool": "boolean"}
#: Types whose length or scale is part of their name.
SIZED, SCALED = {"varchar", "char", "bpchar", "character varying", "character", "varbit"}, {"numeric", "decimal"}
#: What the driver takes out of an engine in its own process at once, and the rows after which it looks.
HELD_BYTES, HELD_ROWS = 32 << 20, 1000


@dataclass(frozen=True)
class ForeignKey:
    name: str
    from_table: str
    from_columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None


@dataclass(frozen=True)
class TableInfo:
    columns: tuple[ColumnInfo, ...]
    primary_key: tuple[str, ...] = ()
    indexes: tuple[tuple[str, bool, tuple[str, ...]], ...] = field(default=())  # name, unique, columns


def regrouped(rows: Iterable[tuple[str, str, str, int, str, str, str, str]]) -> list[ForeignKey]:
    """Foreign keys from rows (schema, table, key's name, position, column, schema, table and column referred to)."""
    parts: dict[tuple[str, str, str], list[tuple]] = {}
    for schema, table, name, position, column, to_schema, to_table, to_column in rows:
        parts.setdefault((schema, table, name), []).append((position, column, to_schema, to_table, to_column))
    keys = []
    for (schema, table, name), found in sorted(parts.items()):
        found.sort()
        keys.append(ForeignKey(name, full_name(schema, table), tuple(c for _, c, *_ in found), full_name(found[0][2], found[0][3]), tuple(c for *_, c in found)))
    return keys


def type_text(name: str, size: int, digits: int) -> str:
    low = name.lower()
    if low in SIZED and 0 < size < 1 << 24:
        return f"{low}({size})"
    if low in SCALED and 0 < size < 1000:
        return f"{low}({size},{digits})"
    return low


def quoted(table: str) -> str:
    """A full name, its parts quoted; a bare name stands in the schema public."""
    schema, _, name = table.rpartition(".")
    return ".".join('"' + p.replace('"', '""') + '"' for p in (schema or "public", name))


def import_line(df: DataFrame, zone: str):
    """A row as the engine's import reads it: values in quotes, nothing for NULL; points in time by the clock of this zone."""
    def text(f: T.StructField):
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"{f.name}: a column of {f.dataType.simpleString()} has no type there")
        if isinstance(f.dataType, T.TimestampType):
            c = F.convert_timezone(None, F.lit(zone), c.cast("timestamp_ntz"))
        c = F.hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
        return F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))

    return F.concat_ws(",", *map(text, df.schema.fields))


class Database:
    """options: url, user, password, driver, as Spark's JDBC reader takes them."""

    def __init__(self, spark: SparkSession, options: dict[str, str], schemas: list[str] | None = None):
        self.spark, self.options, self.schemas = spark, {k: v for k, v in options.items() if v}, schemas
        driver = self.options.get("driver") or next((d for u, d in DRIVERS.items() if self.options["url"].startswith(u)), None)
        if driver is not None:
            self.options["driver"] = driver

    @property
    def is_postgres(self) -> bool:
        return self.options["url"].startswith("jdbc:postgresql:")

    @property
    def in_driver(self) -> bool:
        """Is it an engine inside the driver's process, with executors in others?"""
        url = self.options["url"]
        return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://") and not shared.one_process(self.spark)

    @contextmanager
    def _connected(self) -> Iterator:
        registry = self.spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry
        registry.register(self.options["driver"])
        properties = self.spark._jvm.java.util.Properties()
        for key in ("user", "password"):
            if key in self.options:
                properties.setProperty(key, self.options[key])
        with closing(registry.get(self.options["driver"]).connect(self.options["url"], properties)) as connection:
            yield connection

    @staticmethod
    def _rows(result, *columns: str) -> list[tuple]:
        with closing(result):
            out = []
            while result.next():
                out.append(tuple(result.getObject(c) for c in columns))
            return out

    def execute(self, statements: Iterable[str]) -> None:
        """All in one transaction."""
        with self._connected() as connection:
            connection.setAutoCommit(False)
            with closing(connection.createStatement()) as statement:
                try:
                    for sql in statements:
                        statement.execute(sql)
                    connection.commit()
                except Exception:
                    connection.rollback()
                    raise

    def version(self) -> str:
        """Empty if the server doesn't tell."""
        try:
            with self._connected() as connection:
                return str(connection.getMetaData().getDatabaseProductVersion())
        except Exception:
            return ""

    def tables(self) -> dict[str, tuple[str, str]]:
        """full name -> (schema, name) of the ordinary tables, in order."""
        with self._connected() as connection:
            found = self._rows(connection.getMetaData().getTables(None, None, "%", self._kinds("TABLE")), "TABLE_SCHEM", "TABLE_NAME")
        wanted = [(s or "", t) for s, t in sorted(found, key=lambda r: (r[0] or "", r[1])) if (s or "").lower() not in SYSTEM_SCHEMAS and not (s or "").startswith("pg_toast") and (self.schemas is None or s in self.schemas)]
        return {full_name(s, t): (s, t) for s, t in wanted}

    def schema_names(self) -> set[str]:
        with self._connected() as connection:
            return {s for (s,) in self._rows(connection.getMetaData().getSchemas(), "TABLE_SCHEM")}

    def _kinds(self, *names: str):
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, len(names))
        for n, name in enumerate(names):
            kinds[n] = name
        return kinds

    def describe(self) -> dict[str, TableInfo]:
        """Columns in order, primary key and other indexes of every table."""
        tables, out = self.tables(), {}
        with self._connected() as connection:
            meta = connection.getMetaData()
            escape = lambda name: name.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%") if name and meta.getSearchStringEscape() == "\\" else name
            for full, (schema, name) in tables.items():
                columns = self._rows(meta.getColumns(None, escape(schema) or None, escape(name), "%"), "ORDINAL_POSITION", "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "NULLABLE", "COLUMN_DEF", "TABLE_SCHEM", "TABLE_NAME")
                mine = sorted(c[:7] for c in columns if (c[7] or "", c[8]) == (schema, name))
                key = sorted((k, c) for k, c in self._rows(meta.getPrimaryKeys(None, schema or None, name), "KEY_SEQ", "COLUMN_NAME"))
                primary = tuple(c for _, c in key)
                indexes: dict[tuple[str, bool], list] = {}
                for index, not_unique, place, column in self._rows(meta.getIndexInfo(None, schema or None, name, False, True), "INDEX_NAME", "NON_UNIQUE", "ORDINAL_POSITION", "COLUMN_NAME"):
                    if index and column:
                        indexes.setdefault((index, not not_unique), []).append((place, column))
                others = tuple((i, u, columns) for (i, u), found in sorted(indexes.items()) if (columns := tuple(c for _, c in sorted(found))) != primary or not u)
                out[full] = TableInfo(tuple(ColumnInfo(c, type_text(t, size or 0, digits or 0), nullable != 0, default) for _, c, t, size, digits, nullable, default in mine), primary, others)
        return out

    def foreign_keys(self) -> list[ForeignKey]:
        rows, tables = [], self.tables()
        with self._connected() as connection:
            meta = connection.getMetaData()
            for schema, name in tables.values():
                found = self._rows(meta.getImportedKeys(None, schema or None, name), "FKTABLE_SCHEM", "FKTABLE_NAME", "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_SCHEM", "PKTABLE_NAME", "PKCOLUMN_NAME")
                rows += [(s or "", t, n or f"{t}_{pt}_fkey", k, c, ps or "", pt, pc) for s, t, n, k, c, ps, pt, pc in found]
        return regrouped(rows)

    def count(self, table: str) -> int:
        with self._connected() as connection, closing(connection.createStatement()) as statement:
            return int(self._rows(statement.executeQuery(f"SELECT count(*) AS n FROM {quoted(table)}"), "n")[0][0])

    def _schema(self, table: str) -> T.StructType:
        return self.spark.read.format("jdbc").options(**self.options, dbtable=quoted(table)).load().schema

    def insert(self, df: DataFrame, table: str) -> None:
        """All rows or none into an engine in the driver's process: executors write text, the engine imports it."""
        jvm, place = self.spark._jvm, f"{self.spark.sparkContext._temp_dir}/rows-{uuid.uuid4().hex}.csv"
        conf, names = self.spark._jsc.hadoopConfiguration(), self._schema(table).names
        if sorted(df.columns) == sorted(names):
            df = df.select(*("`" + n.replace("`", "``") + "`" for n in names))
        columns = None if df.columns == names else ",".join(df.columns)  # all in order, or those named
        with shared.scratch(self.spark):
            path = shared.folder(self.spark, "rows")
            df.select(import_line(df, jvm.java.util.TimeZone.getDefault().getID()).alias("value")).write.text(path)
            try:
                with closing(jvm.java.io.FileOutputStream(place)) as out:
                    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
                    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
                        if not status.getPath().getName().startswith(("_", ".")):
                            with closing(fs.open(status.getPath())) as part:
                                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                schema, _, name = table.rpartition(".")
                with self._connected() as connection, closing(connection.prepareStatement("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, ?, NULL, ?, ',', '\"', 'UTF-8', 0)")) as call:
                    for n, value in enumerate((schema or "public", name, columns, place), 1):
                        call.setString(n, value)
                    call.execute()
            finally:
                if os.path.exists(place):
                    os.remove(place)

    def fetch(self, table: str) -> DataFrame:
        """All rows of an engine in the driver's process, from a table in the shared folder."""
        jvm, path = self.spark._jvm, shared.folder(self.spark, "fetched")
        schema = self._schema(table)
        java_schema = self.spark._jsparkSession.parseDataType(schema.json())
        with self._connected() as connection, closing(connection.createStatement()) as statement:
            dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.options["url"])
            rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(statement.executeQuery(f"SELECT * FROM {quoted(table)}"), java_schema, dialect).grouped(HELD_ROWS)
            more = True
            while more:
                held, size = jvm.java.util.ArrayList(), 0
                while size < HELD_BYTES and (more := rows.hasNext()):
                    part = jvm.scala.jdk.javaapi.CollectionConverters.asJava(rows.next())
                    size += jvm.org.apache.spark.util.SizeEstimator.estimate(part)
                    held.addAll(part)
                DataFrame(self.spark._jsparkSession.createDataFrame(held, java_schema), self.spark).coalesce(1).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def end(self) -> None:
        """Ends an engine inside this process and its hold on memory and files."""
        registry, url = self.spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry, self.options["url"].split(";")[0]
        registry.register(self.options["driver"])
        try:
            registry.get(self.options["driver"]).connect(f"{url};shutdown=true", self.spark._jvm.java.util.Properties())
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() not in ("08006", "XJ004"):  # a shutdown that went well, no such database yet
                raise

    def reset(self) -> None:
        """Drops the tables and all that hangs on them."""
        if self.is_postgres:
            schemas = [f'"{s}"' for s in self.schemas or ["public"]]
            self.execute(sql for s in schemas for sql in (f"DROP SCHEMA IF EXISTS {s} CASCADE", f"CREATE SCHEMA {s}"))
            return
        keys, tables = self.foreign_keys(), self.tables()
        self.execute([*(f'ALTER TABLE {quoted(k.from_table)} DROP CONSTRAINT "{k.name}"' for k in keys), *(f"DROP TABLE {quoted(t)}" for t in tables)])

    @contextmanager
    def without_triggers(self, tables: list[str]) -> Iterator[None]:
        """Triggers, and with them checks of foreign keys, are off inside and on again afterwards, whatever happens."""
        if not self.is_postgres:
            raise ValueError("triggers can be switched off in PostgreSQL only")
        off = []
        try:
            for table in tables:
                self.execute([f"ALTER TABLE {quoted(table)} DISABLE TRIGGER ALL"])
                off.append(table)
            yield
        finally:
            for table in off:
                self.execute([f"ALTER TABLE {quoted(table)} ENABLE TRIGGER ALL"])


def portable(info: TableInfo) -> TableInfo:
    """The same table in the SQL standard's types; arrays as text."""
    kind = lambda t: "clob" if t.endswith("[]") else PORTABLE.get(t, t)
    return TableInfo(tuple(ColumnInfo(c.name, kind(c.type), c.nullable, c.default) for c in info.columns), info.primary_key, info.indexes)


def table_ddl(quote, table: str, info: TableInfo) -> list[str]:
    """CREATE TABLE with its primary key, then its indexes."""
    q = lambda c: '"' + c.replace('"', '""') + '"'
    lines = [f"{q(c.name)} {c.type}" + (f" DEFAULT {c.default}" if c.default is not None and "nextval(" not in c.default else "") + ("" if c.nullable else " NOT NULL") for c in info.columns]
    if info.primary_key:
        lines.append(f"PRIMARY KEY ({', '.join(map(q, info.primary_key))})")
    indexes = [f"CREATE {'UNIQUE ' if unique else ''}INDEX {q(name)} ON {quote(table)} ({', '.join(map(q, columns))})" for name, unique, columns in info.indexes]
    return [f"CREATE TABLE {quote(table)} ({', '.join(lines)})", *indexes]


def keys_ddl(quote, tables: dict[str, TableInfo], keys: Iterable[ForeignKey]) -> list[str]:
    """The foreign keys between these tables, after a UNIQUE where what a key names is not known to be so."""
    q = lambda cs: ", ".join('"' + c.replace('"', '""') + '"' for c in cs)
    out, unique = [], {(t, frozenset(cs)) for t, i in tables.items() for cs in (i.primary_key, *(cs for _, u, cs in i.indexes if u))}
    for k in keys:
        if k.from_table in tables and k.to_table in tables:
            if (k.to_table, frozenset(k.to_columns)) not in unique:
                unique.add((k.to_table, frozenset(k.to_columns)))
                out.append(f"ALTER TABLE {quote(k.to_table)} ADD UNIQUE ({q(k.to_columns)})")
            out.append(f'ALTER TABLE {quote(k.from_table)} ADD CONSTRAINT "{k.name}" FOREIGN KEY ({q(k.from_columns)}) REFERENCES {quote(k.to_table)} ({q(k.to_columns)})')
    return out
