"""Subsets: seed predicates, closed over foreign keys.

Rounds are synchronous: every step reads the state before the round, so a closure that is cut by ``max_depth`` is
still determined. A step is a left-semi join on distinct keys; NULL key parts match nothing. Only the rows that the
round before has added (the delta) send their keys on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.catalog import ForeignKey, Source
from veilspark.sources.shared import written

from .graph import Cyclic, Graph


@dataclass(frozen=True)
class Plan:
    seeds: dict[str, str]
    keys: tuple[ForeignKey, ...]
    columns: dict[str, tuple[str, ...]]
    parents: bool
    children: bool
    max_depth: int
    cycles: tuple[tuple[str, ...], ...] = ()
    skipped: tuple[str, ...] = field(default=())

    def steps(self) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
        """(from table, its columns, to table, its columns) in which rows are followed."""
        up = [(k.from_table, k.from_columns, k.to_table, k.to_columns) for k in self.keys] if self.parents else []
        return up + ([(k.to_table, k.to_columns, k.from_table, k.from_columns) for k in self.keys] if self.children else [])


def plan(source: Source, seeds: dict[str, str], parents: bool = False, children: bool = False, max_depth: int = 10) -> Plan:
    """Checks tables and columns; foreign keys with a missing table or column are left out and listed in ``skipped``."""
    schemas = source.schemas()
    for table in seeds:
        if table not in schemas:
            raise ValueError(f"no such table: {table}")
    known = lambda t, cs: t in schemas and all(c in schemas[t] for c in cs)
    keys = source.foreign_keys()
    good = tuple(k for k in keys if known(k.from_table, k.from_columns) and known(k.to_table, k.to_columns))
    return Plan(dict(seeds), good, {t: tuple(c) for t, c in schemas.items()}, parents, children, max_depth if max_depth > 0 else 10, tuple(map(tuple, Graph.of(schemas, good).cycles())), tuple(k.name for k in keys if k not in good))


def followed(rows: DataFrame, columns: tuple[str, ...], target: DataFrame, target_columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``target`` that the keys of ``rows`` name."""
    names = [f"__key{n}" for n in range(len(columns))]
    keys = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names))).dropna().distinct()
    same = reduce(lambda a, b: a & b, (target[f"`{c}`"] == keys[n] for c, n in zip(target_columns, names)))
    return target.join(keys, same, "left_semi")


def _longest_path(plan: Plan) -> int | None:
    """Steps on the longest way along the plan's direction; None if it may loop."""
    if plan.parents and plan.children:
        return None
    try:
        return len(Graph(plan.columns, ((a, b) for a, _, b, _ in plan.steps())).layers()) - 1
    except Cyclic:
        return None


def resolve(source: Source, plan: Plan) -> dict[str, DataFrame]:
    """table -> its rows in the subset, each once; tables that nothing reaches are absent."""
    seeds = {t: source.query(t, where).distinct() for t, where in plan.seeds.items()}
    if not plan.steps() or not seeds:
        return seeds
    longest = _longest_path(plan)
    return _in_order(source, plan, seeds) if longest is not None and plan.max_depth >= longest else _in_rounds(source, plan, seeds)


def _in_order(source: Source, plan: Plan, seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without loops: every table is complete once all tables that lead to it are, so one pass and no counting. A table
    whose keys are followed is written first, so that it is read from the source once and all see the same rows."""
    steps = plan.steps()
    order = [t for layer in Graph(plan.columns, ((b, a) for a, _, b, _ in steps)).layers() for t in layer]
    done: dict[str, DataFrame] = {}
    for table in order:
        parts = [seeds[table]] if table in seeds else []
        parts += [followed(done[a], ca, source.read(table), cb) for a, ca, b, cb in steps if b == table and a in done]
        if parts:
            rows = reduce(DataFrame.unionByName, parts)
            rows = rows if table in seeds and len(parts) == 1 else rows.distinct()  # seeds are distinct already
            done[table] = written(rows, f"subset-{table}") if any(a == table for a, *_ in steps) else rows
    return done


MARKS = ("__row1", "__row2")


def marked(rows: DataFrame) -> DataFrame:
    """With 128 bits that stand for the whole row, NULLs included."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    nulls = [c.isNull() for c in columns]
    return rows.select(*columns, F.xxhash64(*columns, *nulls).alias(MARKS[0]), F.xxhash64(F.lit(1), *nulls, *columns).alias(MARKS[1]))


def _in_rounds(source: Source, plan: Plan, seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each round's new rows are told by their marks from those there are, so only marks of old rows are read again."""
    have = {t: written(marked(df), f"subset-{t}") for t, df in seeds.items()}
    delta = dict(have)
    for _ in range(plan.max_depth):
        found: dict[str, list[DataFrame]] = {}
        for a, ca, b, cb in plan.steps():
            if a in delta:
                found.setdefault(b, []).append(followed(delta[a], ca, source.read(b), cb))
        delta = {}
        for table, parts in found.items():
            rows = marked(reduce(DataFrame.unionByName, parts))
            if table in have:
                rows = rows.join(have[table].select(*MARKS), list(MARKS), "left_anti").select(*rows.columns)
            new = written(rows.dropDuplicates(list(MARKS)), f"subset-{table}")
            if not new.isEmpty():
                delta[table] = new
        if not delta:
            break
        for table, new in delta.items():
            have[table] = have[table].unionByName(new) if table in have else new
    return {t: df.drop(*MARKS) for t, df in have.items()}


def subset(source: Source, seeds: dict[str, str], **options) -> dict[str, DataFrame]:
    return resolve(source, plan(source, seeds, **options))


def row_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows), without empty tables."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts).where("rows > 0") if counts else spark.createDataFrame([], "table string, rows long")
