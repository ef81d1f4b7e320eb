"""Command line: dump, subset, restore, restore-in-order, validate, list-dumps, show-dump, delete, list-transformers,
show-transformer, init."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.functions import masks
from veilspark.operators import jobs, validate
from veilspark.sources import config as configs
from veilspark.sources.catalog import ForeignKey, JdbcSource, ParquetSource, Source
from veilspark.sources.store import Store, format_bytes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Masked, referentially consistent copies of relational data")
    p.add_argument("--config", default="veilspark.yaml")
    p.add_argument("--parquet", help="read tables from this folder instead of the configured database")
    p.add_argument("--foreign-key", action="append", default=[], help="child(col,..)=parent(col,..), for folders")
    sub = p.add_subparsers(dest="command", required=True)
    dsn = argparse.ArgumentParser(add_help=False)
    dsn.add_argument("--dsn", help="database to read in place of the configured one")
    for name in ("dump", "subset"):
        c = sub.add_parser(name, parents=[dsn])
        c.add_argument("--suffix", default="" if name == "dump" else "subset")
        c.add_argument("--description", default="")
        if name == "dump":
            c.add_argument("--tag", action="append", default=[])
    for name in ("restore", "restore-in-order"):
        c = sub.add_parser(name)
        c.add_argument("dump")
        to = c.add_mutually_exclusive_group(required=True)
        to.add_argument("--target", help="folder for Parquet tables")
        to.add_argument("--target-dsn", help="database")
        c.add_argument("--drop-schema", action="store_true", help="empty the target database first")
        if name == "restore-in-order":
            c.add_argument("--disable-triggers", action=argparse.BooleanOptionalAction, default=True, help="for tables in cycles")
    c = sub.add_parser("validate", parents=[dsn])
    c.add_argument("--check", action="append", choices=validate.CHECKS)
    c.add_argument("--dump")
    c.add_argument("--sample-rows", type=int, default=5)
    sub.add_parser("list-dumps")
    c = sub.add_parser("show-dump")
    c.add_argument("dump")
    c.add_argument("--columns", action="store_true")
    c.add_argument("--show-config", action="store_true")
    sub.add_parser("delete").add_argument("dump")
    sub.add_parser("list-transformers")
    sub.add_parser("show-transformer").add_argument("name")
    sub.add_parser("init").add_argument("path", nargs="?", default="veilspark.yaml")
    return p


def foreign_key(text: str) -> ForeignKey:
    (a, ca), (b, cb) = ((side.partition("(")[0].strip(), tuple(c.strip() for c in side.partition("(")[2].rstrip(") ").split(","))) for side in text.split("="))
    return ForeignKey(f"{a}_{'_'.join(ca)}_fkey", a, ca, b, cb)


def source_of(args, config: configs.Config, spark: SparkSession) -> Source | None:
    if args.parquet:
        return ParquetSource(spark, args.parquet, None, [foreign_key(k) for k in args.foreign_key])
    if getattr(args, "dsn", None):
        return JdbcSource(spark, configs.options_of(args.dsn))
    return JdbcSource(spark, config.connection.jdbc()) if config.connection.host else None


def shortened(items: list[str], most: int) -> str:
    """The first ``most``, and how many there are if more."""
    return ", ".join(items[:most]) + (f", ... ({len(items)} in all)" if len(items) > most else "")


def target_of(args, config: configs.Config, spark: SparkSession) -> str | jobs.DatabaseTarget:
    return jobs.DatabaseTarget(spark, configs.options_of(args.target_dsn), max(1, config.parallelism)) if args.target_dsn else args.target


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        configs.init(args.path)
        print(f"wrote {args.path}")
        return 0
    if args.command == "list-transformers":
        for m in masks.all_masks():
            print(f"{m.name:14} {m.description} [{shortened(list(m.types), 3)}]")
        return 0
    if args.command == "show-transformer":
        print(masks.show(args.name))
        return 0
    config = configs.load(args.config)
    spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
    store = Store(spark, config.storage_dir)
    db = config.connection.dbname or "db"
    if args.command in ("dump", "subset", "validate"):
        source = source_of(args, config, spark)
        if source is None and args.command != "validate":
            print("no source: configure a connection or give --parquet", file=sys.stderr)
            return 1
    if args.command == "dump":
        try:
            print(jobs.dump(spark, source, config, store, db, args.suffix, args.description, args.tag))
        except jobs.PartlyFailed as e:
            print(f"{e.result} is incomplete: {e}", file=sys.stderr)
            return 1
    elif args.command == "subset":
        print(jobs.subset_dump(spark, source, config, store, db, args.suffix, args.description))
    elif args.command == "restore":
        try:
            done = jobs.restore(spark, store, args.dump, target_of(args, config, spark), config.parallelism, args.drop_schema)
        except jobs.PartlyFailed as e:
            print(f"{e.result.total} rows in {len(e.result.rows)} tables; {e}", file=sys.stderr)
            return 1
        print(f"{done.total} rows in {len(done.rows)} tables")
    elif args.command == "restore-in-order":
        keys = [foreign_key(k) for k in args.foreign_key] or None
        done = jobs.restore_in_order(spark, store, args.dump, target_of(args, config, spark), keys, args.drop_schema, args.disable_triggers)
        for n, layer in enumerate(done.order):
            print(f"layer {n}: " + "; ".join(", ".join(f"{t} ({done.rows[t]} rows)" if t in done.rows else f"{t} (failed)" for t in group) for group in layer))
        bad = {k: n for k, n in done.orphans.items() if n}
        print(f"{done.total} rows in {len(done.rows)} tables" + (f"; orphans: {bad}" if bad else ""))
        for table, error in sorted(done.errors.items()):
            print(f"{table}: {error}", file=sys.stderr)
    elif args.command == "validate":
        v = validate.Validator(spark, config, source, args.sample_rows)
        if args.dump:
            v.set_dump(store.columns(args.dump))
        found = v.run(args.check or validate.CHECKS).collect()
        for row in found:
            print(validate.render(row))
        errors = sum(r["severity"] == validate.ERROR for r in found)
        print(f"{errors} errors, {len(found) - errors} warnings" if found else "All checks passed")
        return 1 if errors else 0
    elif args.command == "list-dumps":
        for r in store.dumps().withColumn("size", format_bytes(_or_zero("total_size_bytes"))).collect():
            print(f"{r['id']}  {r['created_at']}  {r['source_db']}  {len(r['tables'])} tables  {r['total_rows'] or 0} rows  {r['size']}")
    elif args.command == "show-dump":
        m = store.manifest(args.dump)
        print(f"{m['id']}\n  created {m['created_at']} from {m['source_db']}\n  {m.get('description', '')}")
        for r in store.tables(args.dump).withColumn("size", format_bytes(_or_zero("compressed_size_bytes"))).collect():
            masked = shortened([f"{c}={m}" for c, m in sorted((r["transformers"] or {}).items())], 2)
            print(f"  {r['schema']}.{r['name']}: {r['row_count']} rows, {r['size']}" + (f", masked: {masked}" if masked else ""))
        if args.columns:
            for r in store.columns(args.dump).collect():
                print(f"    {r['table']}.{r['column']} {r['type']} {r['transformer'] or ''}".rstrip())
        if args.show_config:
            print(m.get("config_snapshot", ""))
    elif args.command == "delete":
        store.delete(args.dump)
        print(f"deleted {args.dump}")
    return 0


def _or_zero(name: str):
    return F.coalesce(F.col(name), F.lit(0))


if __name__ == "__main__":
    sys.exit(main())
