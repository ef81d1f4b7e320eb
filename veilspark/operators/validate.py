"""Checks of a configuration against itself, the live schema, a dump, and sampled rows. Findings are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import masks, pgtypes
from veilspark.sources.catalog import Source
from veilspark.sources.config import Config

from .mask import bind, masked

FINDING = "severity string, category string, table string, column string, message string"
ERROR, WARNING = "ERROR", "WARNING"
CHECKS = ("config", "schema", "types", "diff")


def findings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING)


def render(row) -> str:
    place = ".".join(x for x in (row["table"], row["column"]) if x)
    return f"[{row['severity']}] {row['category']}: " + (f"{place}: " if place else "") + row["message"]


def check_config(config: Config) -> list[tuple]:
    out = []
    if not config.storage_dir:
        out.append((WARNING, "config", "", "", "no storage_dir is given: ./dumps is used"))
    if config.parallelism <= 0:
        out.append((WARNING, "config", "", "", "parallelism is not above 0: 4 is used"))
    out += [(ERROR, "config", "", "", f"the connection names no {k}") for k in ("host", "dbname", "user") if not getattr(config.connection, k)]
    for table, t in sorted(config.tables.items()):
        out += [(ERROR, "config", table, c, f"no mask is called {m}") for c, m in sorted(t.columns.items()) if m not in masks.names()]
    both = sorted(set(config.include_tables) & set(config.exclude_tables))
    return out + [(WARNING, "config", t, "", "listed to be included and to be excluded: it is excluded") for t in both]


def schema_rows(spark: SparkSession, schemas: dict[str, dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(t, c, kind) for t, columns in sorted(schemas.items()) for c, kind in columns.items()], "table string, column string, type string")


def rule_rows(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame([(t, c, m, v.exclude) for t, v in sorted(config.tables.items()) for c, m in sorted(v.columns.items())], "table string, column string, mask string, exclude boolean")


def _finding(severity: str | Column, category: str, message: Column, column: Column | None = None) -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return [severity.alias("severity"), F.lit(category).alias("category"), F.col("table"), (F.lit("") if column is None else column).alias("column"), message.alias("message")]


def check_schema(spark: SparkSession, config: Config, live: DataFrame) -> DataFrame:
    """live: (table, column, type). Missing tables and columns of rules, and missing included tables."""
    configured = spark.createDataFrame([(t,) for t, v in sorted(config.tables.items()) if not v.exclude], "table string")
    included = spark.createDataFrame([(t,) for t in config.include_tables], "table string")
    tables = live.select("table").distinct()
    no_table = configured.join(tables, "table", "left_anti").select(*_finding(ERROR, "schema", F.lit("has rules, but the source has no such table")))
    rules = rule_rows(spark, config).where("not exclude").join(tables, "table", "left_semi")
    no_column = rules.join(live, ["table", "column"], "left_anti").select(*_finding(ERROR, "schema", F.lit("has a rule, but the table has no such column"), F.col("column")))
    no_included = included.join(tables, "table", "left_anti").select(*_finding(WARNING, "schema", F.lit("listed to be included, but the source has no such table")))
    return no_table.unionByName(no_column).unionByName(no_included)


def _compared(dump: DataFrame, live: DataFrame) -> DataFrame:
    """Full outer comparison of two schemas, with whether each side has the table at all."""
    d = dump.select("table", "column", F.col("type").alias("d_type"), F.lit(True).alias("in_dump"))
    now = live.select("table", "column", F.col("type").alias("l_type"), F.lit(True).alias("in_live"))
    both = d.join(now, ["table", "column"], "full_outer")
    both = both.join(dump.select("table").distinct().withColumn("dump_table", F.lit(True)), "table", "left")
    return both.join(live.select("table").distinct().withColumn("live_table", F.lit(True)), "table", "left").na.fill(False, ["dump_table", "live_table", "in_dump", "in_live"])


def _changed() -> Column:
    return F.lower(F.trim("d_type")) != F.lower(F.trim("l_type"))


def drift_live(spark: SparkSession, config: Config, dump: DataFrame, live: DataFrame) -> DataFrame:
    """What has changed in the database since the dump; new tables count only if the configuration has them."""
    both = _compared(dump, live)
    gone = both.where("not live_table").select("table").distinct().select(*_finding(WARNING, "schema", F.lit("dumped, but gone from the source since")))
    known = both.where("live_table and dump_table")
    message = F.when(~F.col("in_live"), F.concat(F.lit("dumped as "), "d_type", F.lit(", but gone from the table since"))).when(~F.col("in_dump"), F.concat(F.lit("new since the dump, as "), "l_type")).when(_changed(), F.concat(F.lit("was "), "d_type", F.lit(" when dumped, is "), "l_type", F.lit(" now")))
    columns = known.withColumn("m", message).where("m is not null").select(*_finding(WARNING, "schema", F.col("m"), F.col("column")))
    added = both.where("not dump_table").select("table").distinct().where(F.col("table").isin(list(config.tables))).select(*_finding(WARNING, "schema", F.lit("new since the dump, and has rules")))
    return gone.unionByName(columns).unionByName(added)


def drift_restore(dump: DataFrame, target: DataFrame) -> DataFrame:
    """What stands in the way of a restore into ``target``."""
    both = _compared(dump, target).where("dump_table")
    gone = both.where("not live_table").select("table").distinct().select(*_finding(ERROR, "schema", F.lit("the target lacks this table")))
    message = F.when(~F.col("in_live"), F.concat(F.lit("the target lacks this column of type "), "d_type")).when(~F.col("in_dump"), F.concat(F.lit("only the target has this column, as "), "l_type", F.lit(": it gets no values"))).when(_changed(), F.concat(F.lit("dumped as "), "d_type", F.lit(", but the target has "), "l_type"))
    severity = F.when(~F.col("in_live"), ERROR).otherwise(WARNING)
    return gone.unionByName(both.where("live_table").withColumn("m", message).where("m is not null").select(*_finding(severity, "schema", F.col("m"), F.col("column"))))


def check_types(spark: SparkSession, config: Config, live: DataFrame) -> DataFrame:
    """Rules whose column type holds none of the mask's declared types. Excluded tables are checked too."""
    declared = spark.createDataFrame([(m.name, list(m.types)) for m in masks.all_masks()], "mask string, types array<string>")
    rules = rule_rows(spark, config).join(live, ["table", "column"]).join(F.broadcast(declared), "mask")  # one row for each registered mask
    fits = F.exists("types", lambda s: F.lower(F.trim(F.col("type"))).contains(F.lower(F.trim(s))))
    message = F.concat("mask", F.lit(" is made for "), F.array_join("types", ", "), F.lit(", not for "), "type")
    return rules.where(~fits).select(*_finding(WARNING, "type", message, F.col("column")))


def shown(c: Column) -> Column:
    """At most 30 bytes, cut with dots."""
    return F.when(F.octet_length(c) > 30, F.concat(F.decode(F.substring(c.cast("binary"), 1, 27), "UTF-8"), F.lit("..."))).otherwise(c)


def preview(df: DataFrame, table: str, rules: dict[str, str], rows: int = 5, order: list[str] | None = None) -> DataFrame:
    """A finding for each cell that masking changes in a sample, ordered to be repeatable where ``order`` is given."""
    rows = 5 if rows <= 0 else min(rows, 100)
    bound = [(f.name, m) for f, m in zip(df.schema.fields, bind(df.columns, rules)) if m is not None]
    if not bound:
        return findings(df.sparkSession, [])
    number = "row" + "_" * max(map(len, df.columns))  # a name that no column has
    sample = (df.orderBy(*order) if order else df).limit(rows).select(F.monotonically_increasing_id().alias(number), *(f"`{f}`" for f, _ in bound))  # one partition after limit
    fields = {f.name: f for f in df.schema.fields}
    text = lambda c, name: F.coalesce(pgtypes.encode(c, fields[name].dataType), F.lit("\\N"))
    # old and new of a row come from one reading of it
    cells = [F.struct(F.lit(name).alias("column"), F.lit(m.name).alias("mask"), text(F.col(f"`{name}`"), name).alias("old"), text(masked(fields[name], m), name).alias("new")) for name, m in bound]
    changed = sample.select(F.col(number).alias("n"), F.inline(F.array(*cells))).where(~F.col("old").eqNullSafe(F.col("new")))
    message = F.concat(F.lit("row "), (F.col("n") + 1).cast("string"), F.lit(": "), shown(F.col("old")), F.lit(" becomes "), shown(F.col("new")), F.lit(" by "), "mask")
    return changed.withColumn("table", F.lit(table)).select(*_finding(WARNING, "diff", message, F.col("column")))


class Validator:
    def __init__(self, spark: SparkSession, config: Config, source: Source | None = None, sample_rows: int = 5, order: dict[str, list[str]] | None = None):
        self.spark, self.config, self.source, self.sample_rows = spark, config, source, sample_rows
        self.order, self.dump = order or {}, None

    def set_dump(self, columns: DataFrame) -> None:
        """Columns (table, column, type) of a dump to compare with."""
        self.dump = columns.select("table", "column", "type")

    def _live(self) -> DataFrame:
        return schema_rows(self.spark, self.source.schemas())

    def _schema(self) -> DataFrame:
        found = check_schema(self.spark, self.config, self._live())
        return found if self.dump is None else found.unionByName(drift_live(self.spark, self.config, self.dump, self._live()))

    def _diff(self) -> DataFrame:
        out = [findings(self.spark, [])]
        known = set(self.source.names())
        for table, t in sorted(self.config.tables.items()):
            if t.exclude or not t.columns or table not in known:
                continue
            try:
                found = preview(self.source.read(table), table, t.columns, self.sample_rows, self.order.get(table)).collect()  # 100 rows at most
                out.append(findings(self.spark, [tuple(r) for r in found]))
            except Exception as e:  # a value that cannot be masked ends this table's preview
                out.append(findings(self.spark, [(ERROR, "diff", table, "", f"a sampled row can't be masked: {str(e).splitlines()[0][:300]}")]))
        return reduce(DataFrame.unionByName, out)

    def run(self, names: list[str] | tuple[str, ...] = CHECKS) -> DataFrame:
        """The named checks, unknown names passed over. Without a source every check that needs one reports an error."""
        out = [findings(self.spark, [])]
        for name in names:
            if name == "config":
                out.append(findings(self.spark, check_config(self.config)))
            elif name in CHECKS and self.source is None:
                out.append(findings(self.spark, [(ERROR, {"types": "type"}.get(name, name), "", "", "there is no source to look at")]))
            elif name == "schema":
                out.append(self._schema())
            elif name == "types":
                out.append(check_types(self.spark, self.config, self._live()))
            elif name == "diff":
                out.append(self._diff())
        return reduce(DataFrame.unionByName, out)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


