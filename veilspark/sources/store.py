"""Dumps: folders with a schema file, a manifest and one dataset for each table."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.pgtypes import pg_type

from .database import ColumnInfo, ForeignKey, TableInfo, keys_ddl, quoted, table_ddl

TABLE = "STRUCT<schema STRING, name STRING, row_count BIGINT, columns ARRAY<STRING>, column_types ARRAY<STRING>, transformers MAP<STRING,STRING>, data_file STRING, compressed_size_bytes BIGINT, dump_duration_ns BIGINT, original_size_bytes BIGINT>"
MANIFEST = f"id STRING, created_at TIMESTAMP, source_db STRING, tables ARRAY<{TABLE}>, schema_file STRING, duration_ns BIGINT, description STRING, version STRING, pg_version STRING, total_rows BIGINT, total_size_bytes BIGINT, tags ARRAY<STRING>, config_snapshot STRING"
SCHEMA_FILE, MANIFEST_FILE = "schema.dump", "metadata.json"


class Store:
    """All files go through Hadoop's file systems, so the folder may lie on any shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.fs.Path(name)

    def folder(self, dump: str) -> str:
        if not dump or dump in (".", "..") or "/" in dump or "\\" in dump:
            raise ValueError(f"not a dump id: {dump!r}")
        return f"{self.path}/{dump}"

    def schema_path(self, dump: str) -> str:
        return f"{self.folder(dump)}/{SCHEMA_FILE}"

    def data_path(self, dump: str, schema: str, table: str) -> str:
        return f"{self.folder(dump)}/{self.data_name(schema, table)}"

    @staticmethod
    def data_name(schema: str, table: str) -> str:
        return f"data/{schema or 'public'}.{table}.csv.gz"

    def create(self, db: str, suffix: str = "", now: datetime | None = None) -> str:
        """A new folder named by time, database and suffix."""
        stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
        dump = "_".join([stamp, db, *([suffix] if suffix else [])])
        if self.fs.exists(self._path(self.folder(dump))):
            raise FileExistsError(dump)
        self.fs.mkdirs(self._path(f"{self.folder(dump)}/data"))
        return dump

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_manifest(self, dump: str, manifest: dict) -> None:
        self.write_text(f"{self.folder(dump)}/{MANIFEST_FILE}", json.dumps({k: v for k, v in manifest.items() if v not in (None, "", [], 0) or k in ("id", "created_at", "source_db", "tables", "schema_file", "duration_ns")}, indent=2))

    def manifest(self, dump: str) -> dict:
        name = f"{self.folder(dump)}/{MANIFEST_FILE}"
        if not self.fs.exists(self._path(name)):
            raise FileNotFoundError(dump)
        return json.loads(self.read_text(name))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.fs.exists(self._path(name)) else 0

    def manifests(self) -> list[dict]:
        """Newest first; folders without a readable manifest are passed over."""
        if not self.fs.exists(self._path(self.path)):
            return []
        found = []
        for status in self.fs.listStatus(self._path(self.path)):
            if status.isDirectory():
                try:
                    found.append(self.manifest(status.getPath().getName()))
                except (FileNotFoundError, ValueError):
                    continue
        return sorted(found, key=lambda m: m.get("created_at", ""), reverse=True)

    def dumps(self) -> DataFrame:
        rows = [json.dumps(m) for m in self.manifests()]
        return self.spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", MANIFEST).alias("m")).select("m.*").orderBy(F.desc("created_at"))

    def tables(self, dump: str) -> DataFrame:
        """One row for each table of a dump."""
        row = self.spark.createDataFrame([(json.dumps(self.manifest(dump)),)], "value string")
        return row.select(F.explode(F.from_json("value", MANIFEST)["tables"]).alias("t")).select("t.*")

    def columns(self, dump: str) -> DataFrame:
        """(table, column, type, transformer) of a dump."""
        t = self.tables(dump)
        each = t.select(F.when(F.col("schema").isin("", "public"), F.col("name")).otherwise(F.concat_ws(".", "schema", "name")).alias("table"), "transformers", F.posexplode("columns").alias("n", "column"), "column_types")
        return each.select("table", "column", F.coalesce(F.get("column_types", F.col("n")), F.lit("")).alias("type"), F.element_at("transformers", F.col("column")).alias("transformer"))

    def delete_data(self, dump: str, schema: str, table: str) -> None:
        self.fs.delete(self._path(self.data_path(dump, schema, table)), True)

    def delete(self, dump: str) -> None:
        folder = self._path(self.folder(dump))
        if not self.fs.exists(folder) or not self.fs.getFileStatus(folder).isDirectory():
            raise FileNotFoundError(dump)
        self.fs.delete(folder, True)


def schema_text(frames: dict[str, DataFrame], keys: list, info: dict | None = None) -> str:
    """Schemas and foreign keys of all tables, as JSON; what a database tells of its tables - declared types, NOT NULL,
    defaults, keys, indexes - or else what the frames tell."""
    tables = {t: (info or {}).get(t) or info_of(df) for t, df in sorted(frames.items())}
    return json.dumps({"tables": {t: df.schema.jsonValue() for t, df in sorted(frames.items())}, "info": {t: asdict(i) for t, i in tables.items()}, "foreign_keys": [asdict(k) for k in keys]}, indent=1)


def info_of(df: DataFrame) -> TableInfo:
    return TableInfo(tuple(ColumnInfo(f.name, f.metadata.get("pg_type") or pg_type(f.dataType), f.nullable) for f in df.schema.fields))


def info_in(text: str) -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    """Tables and foreign keys of a schema file."""
    found = json.loads(text)
    tables = {t: TableInfo(tuple(ColumnInfo(**c) for c in i["columns"]), tuple(i["primary_key"]), tuple((n, u, tuple(cs)) for n, u, cs in i["indexes"])) for t, i in found.get("info", {}).items()}
    return tables, [ForeignKey(k["name"], k["from_table"], tuple(k["from_columns"]), k["to_table"], tuple(k["to_columns"])) for k in found["foreign_keys"]]


def ddl(text: str, quote=quoted) -> list[str]:
    """Statements that make the tables of a schema file, and then their foreign keys."""
    tables, keys = info_in(text)
    return [sql for t, info in tables.items() for sql in table_ddl(quote, t, info)] + keys_ddl(quote, tables, keys)


def schema_of(text: str) -> dict[str, T.StructType]:
    return {t: T.StructType.fromJson(s) for t, s in json.loads(text)["tables"].items()}


def format_bytes(c):
    """1536 -> 1.50 KB; below 1024 plain bytes."""
    size = lambda n, unit: F.format_string(f"%.2f {unit}", c / float(n))
    return F.when(c >= 1 << 30, size(1 << 30, "GB")).when(c >= 1 << 20, size(1 << 20, "MB")).when(c >= 1 << 10, size(1 << 10, "KB")).otherwise(F.concat(c.cast("string"), F.lit(" B")))
