"""Jobs: dump, subset dump, restore, and restore in foreign-key order."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import veilspark
from veilspark.functions import copytext, pgtypes
from veilspark.plans import subset as subsets
from veilspark.plans.graph import Graph
from veilspark.sources import shared
from veilspark.sources import store as stores
from veilspark.sources.catalog import JdbcSource, Source
from veilspark.sources.config import Config
from veilspark.sources.database import Database, ForeignKey, keys_ddl, portable, quoted, table_ddl
from veilspark.sources.store import Store

from .mask import check_masks, mask


class PartlyFailed(RuntimeError):
    """Some tables failed; ``result`` has what went through, ``errors`` the rest."""

    def __init__(self, result, errors: dict[str, str]):
        super().__init__("; ".join(f"{t}: {e}" for t, e in sorted(errors.items())))
        self.result, self.errors = result, errors


def reason(e: Exception) -> str:
    """The first line of what went wrong, of the engine's own error where there is one."""
    inner = getattr(e, "java_exception", None)
    return (str(inner.getMessage() if inner is not None else e).splitlines() or [type(e).__name__])[0][:500]


def split_name(table: str) -> tuple[str, str]:
    schema, _, name = table.rpartition(".")
    return schema or "public", name


def line_stats(df: DataFrame) -> DataFrame:
    """(rows, bytes) of the COPY text of a table, one byte for each line's end."""
    return df.select(copytext.line(df).alias("value")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))


def write_table(store: Store, dump: str, table: str, df: DataFrame, rules: dict[str, str]) -> dict:
    """One masked table as gzipped COPY text; rows and bytes are counted in the same pass. Its entry in the manifest."""
    began = time.time_ns()
    schema, name = split_name(table)
    path = store.data_path(dump, schema, name)
    out = mask(df, rules)
    seen = Observation()
    lines = out.select(copytext.line(out).alias("value")).observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    types = [f.metadata.get("pg_type") or pgtypes.pg_type(f.dataType) for f in df.schema.fields]
    return {"schema": schema, "name": name, "row_count": seen.get["rows"], "columns": df.columns, "column_types": types, "transformers": {c: m for c, m in rules.items() if c in df.columns}, "data_file": store.data_name(schema, name), "compressed_size_bytes": store.size(path), "dump_duration_ns": time.time_ns() - began, "original_size_bytes": seen.get["bytes"]}


def _write_all(store: Store, dump: str, frames: dict[str, DataFrame], config: Config, parallelism: int) -> tuple[list[dict], dict[str, str]]:
    done, errors = {}, {}

    def one(table: str) -> None:
        try:
            done[table] = write_table(store, dump, table, frames[table], config.rules(*split_name(table)))
        except Exception as e:  # reported with the others after all tables have had their turn
            errors[table] = reason(e)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        list(pool.map(one, sorted(frames)))
    return [done[t] for t in sorted(done)], errors


def _info(source: Source) -> dict | None:
    return source.describe() if isinstance(source, JdbcSource) else None


def _manifest(source: Source, dump: str, db: str, began: int, tables: list[dict], config: Config, description: str = "", tags: list[str] | None = None) -> dict:
    return {
        "id": dump, "created_at": datetime.now(timezone.utc).isoformat(), "source_db": db, "tables": tables, "schema_file": stores.SCHEMA_FILE, "duration_ns": time.time_ns() - began,
        "description": description, "version": veilspark.__version__, "pg_version": source.version(), "total_rows": sum(t["row_count"] for t in tables), "total_size_bytes": sum(t["compressed_size_bytes"] for t in tables), "tags": tags or [], "config_snapshot": config.snapshot(),
    }


def dump(spark: SparkSession, source: Source, config: Config, store: Store, db: str = "db", suffix: str = "", description: str = "", tags: list[str] | None = None) -> str:
    """All selected tables, masked. With failed tables the manifest still lists the others, then PartlyFailed is raised."""
    check_masks({t: c.columns for t, c in config.tables.items()})
    began = time.time_ns()
    frames = {t: source.read(t) for t in source.names() if config.includes(*split_name(t))}
    name = store.create(db, suffix)
    store.write_text(store.schema_path(name), stores.schema_text(frames, source.foreign_keys(), _info(source)))
    tables, errors = _write_all(store, name, frames, config, config.parallelism or 4)
    store.write_manifest(name, _manifest(source, name, db, began, tables, config, description, tags))
    if errors:
        raise PartlyFailed(name, errors)
    return name


def subset_dump(spark: SparkSession, source: Source, config: Config, store: Store, db: str = "db", suffix: str = "subset", description: str = "") -> str:
    """Seeds and their closure, masked; the first error ends the job. Empty tables are left out."""
    if config.subset is None or not config.subset.seeds:
        raise ValueError("the configuration has no subset seeds")
    began, s = time.time_ns(), config.subset
    name = store.create(db, suffix)
    with shared.scratch(spark):
        frames = subsets.subset(source, s.seeds, parents=s.resolve_parents, children=s.resolve_children, max_depth=s.max_depth)
        tables = [write_table(store, name, t, df, config.rules(*split_name(t))) for t, df in sorted(frames.items())]
        for t in tables:
            if not t["row_count"]:
                store.delete_data(name, t["schema"], t["name"])
        tables = [t for t in tables if t["row_count"]]
        left = {t: df for t, df in frames.items() if split_name(t) in {(x["schema"], x["name"]) for x in tables}}
        store.write_text(store.schema_path(name), stores.schema_text(left, source.foreign_keys(), _info(source)))
    store.write_manifest(name, _manifest(source, name, db, began, tables, config, description))
    return name


def read_dump(spark: SparkSession, store: Store, dump: str) -> dict[str, DataFrame]:
    """table -> rows of a dump."""
    schemas = stores.schema_of(store.read_text(store.schema_path(dump)))
    out = {}
    for t in store.manifest(dump)["tables"]:
        table = t["name"] if t["schema"] in ("", "public") else f"{t['schema']}.{t['name']}"
        out[table] = copytext.read(spark, f"{store.folder(dump)}/{t['data_file']}", schemas[table])
    return out


@dataclass
class Restored:
    rows: dict[str, int] = field(default_factory=dict)
    order: list[list[list[str]]] = field(default_factory=list)
    orphans: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.rows.values())


class FolderTarget:
    """A folder with one Parquet table ``<name>.parquet`` each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def prepare(self, schema: str, drop: bool) -> None:
        """Nothing to do: a table is made, or replaced, when it is loaded."""

    def load(self, df: DataFrame, table: str) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/{table}.parquet")
        return seen.get["rows"]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")

    def group(self, tables: list[str], triggers_off: bool):
        return nullcontext()

    def finish(self, schema: str) -> None:
        """Nothing to do."""


class DatabaseTarget:
    """Tables of a database, loaded by Spark's JDBC writer, ``parts`` connections at once.

    Tables that are missing are made from the dump's schema; foreign keys between these follow once all rows are in. Rows are
    appended. A part whose task is lost after its commit is written again, so the rows are counted after each table: more
    or fewer than were to come is an error. An engine inside the driver's process, where executors are in others, takes and
    gives its rows through the driver.
    """

    def __init__(self, spark: SparkSession, options: dict[str, str], parts: int = 4, batch: int = 10_000):
        self.database, self.parts, self.batch = Database(spark, options), parts, batch
        self.spark, self.options, self.made = spark, self.database.options, set()

    def prepare(self, schema: str, drop: bool) -> None:
        if drop:
            self.database.reset()
        tables, _ = stores.info_in(schema)
        there = self.database.tables()
        self.made = {t for t in tables if t not in there}
        own = (lambda info: info) if self.database.is_postgres else portable
        schemas = {t.rpartition(".")[0] or "public" for t in self.made} - self.database.schema_names()
        self.database.execute([*(f'CREATE SCHEMA "{s}"' for s in sorted(schemas)), *(sql for t in sorted(self.made) for sql in table_ddl(quoted, t, own(tables[t])))])

    def read(self, table: str) -> DataFrame:
        if self.database.in_driver:
            return self.database.fetch(table)
        return self.spark.read.format("jdbc").options(**self.options, dbtable=quoted(table)).load()

    def kept(self, table: str) -> DataFrame:
        """The rows as they are now, from a table in the shared folder that outlasts the database."""
        return self.read(table) if self.database.in_driver else shared.written(self.read(table), "kept")

    def _count(self, table: str) -> int:
        return self.database.count(table)

    def load(self, df: DataFrame, table: str) -> int:
        before, seen = self._count(table), Observation()
        if self.database.in_driver:
            self.database.insert(df.observe(seen, F.count(F.lit(1)).alias("rows")), table)
        else:
            rows = df.coalesce(self.parts).observe(seen, F.count(F.lit(1)).alias("rows"))
            rows.write.format("jdbc").options(**self.options, dbtable=quoted(table), batchsize=str(self.batch)).mode("append").save()
        came, wanted = self._count(table) - before, seen.get["rows"]
        if came != wanted:
            raise RuntimeError(f"{table}: {came} rows came of {wanted}")
        return came

    def group(self, tables: list[str], triggers_off: bool):
        return self.database.without_triggers(tables) if triggers_off else nullcontext()

    def finish(self, schema: str) -> None:
        tables, keys = stores.info_in(schema)
        self.database.execute(keys_ddl(quoted, {t: i for t, i in tables.items() if t in self.made}, keys))


Target = FolderTarget | DatabaseTarget


def target_of(spark: SparkSession, target: str | Target) -> Target:
    return FolderTarget(spark, target) if isinstance(target, str) else target


def restore(spark: SparkSession, store: Store, dump: str, target: str | Target, parallelism: int = 4, drop: bool = False) -> Restored:
    """Every table into the target, a folder's name or a Target, some at a time and in no order; errors come after all have
    been tried."""
    frames, out, errors, target = read_dump(spark, store, dump), Restored(), {}, target_of(spark, target)
    schema = store.read_text(store.schema_path(dump))
    target.prepare(schema, drop)

    def one(table: str) -> None:
        try:
            out.rows[table] = target.load(frames[table], table)
        except Exception as e:
            errors[table] = reason(e)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        list(pool.map(one, sorted(frames)))
    if errors:
        raise PartlyFailed(out, errors)
    target.finish(schema)
    return out


def restore_in_order(spark: SparkSession, store: Store, dump: str, target: str | Target, keys: list[ForeignKey] | None = None, drop: bool = False, triggers_off: bool = True) -> Restored:
    """Layer by layer along the foreign keys - those given, else the target's own, else the dump's - a cycle as one group,
    with a database's triggers off for its tables; after each layer orphans are counted by key. A table that fails is
    left out of ``rows`` and named in ``errors``; the others go on."""
    frames, out, target = read_dump(spark, store, dump), Restored(), target_of(spark, target)
    schema = store.read_text(store.schema_path(dump))
    target.prepare(schema, drop)
    if keys is None:
        keys = (target.database.foreign_keys() if isinstance(target, DatabaseTarget) else []) or stores.info_in(schema)[1]
    inside = [k for k in keys if k.from_table in frames and k.to_table in frames]
    own = {k.from_table for k in inside if k.from_table == k.to_table}
    out.order = Graph.of(frames, inside).restore_layers()
    for layer in out.order:
        for group in layer:
            off = triggers_off and isinstance(target, DatabaseTarget) and target.database.is_postgres and (len(group) > 1 or group[0] in own)
            with target.group(list(group), off):
                for table in group:
                    try:
                        out.rows[table] = target.load(frames[table], table)
                    except Exception as e:
                        out.errors[table] = reason(e)
        tables = [t for group in layer for t in group]
        for k in inside:
            if k.from_table in tables and not {k.from_table, k.to_table} & set(out.errors):
                with shared.scratch(spark):
                    out.orphans[k.name] = orphans(target.read(k.from_table), target.read(k.to_table), k).count()
    if not out.errors:
        target.finish(schema)
    return out


def orphans(child: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Rows whose key, none of it NULL, names no parent."""
    on = [child[f"`{a}`"] == parent[f"`{b}`"] for a, b in zip(key.from_columns, key.to_columns)]
    return child.dropna(subset=list(key.from_columns)).join(parent, on, "left_anti")
