"""Registered queries of the masking and subsetting engine, each with its SQL counterpart."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import copytext, masks, pgtypes
from veilspark.operators import jobs, validate
from veilspark.operators.mask import check_masks, mask
from veilspark.plans import subset as subsets
from veilspark.plans.graph import Cyclic, Graph
from veilspark.sources import config as configs
from veilspark.sources import shared
from veilspark.sources import store as stores
from veilspark.sources.catalog import KEY_ROWS, ForeignKey, FrameSource, ParquetSource, keys_of
from veilspark.sources.store import Store, format_bytes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations"]
KEYS = [
    ForeignKey("nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier_nation", "supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("orders_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("events_customer", "events", ("user_id",), "customer", ("c_custkey",)),
    ForeignKey("labels_documents", "labels", ("doc_id",), "documents", ("doc_id",)),
]
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> ParquetSource:
    return ParquetSource(spark, sf_dir, tables, [k for k in KEYS if {k.from_table, k.to_table} <= set(tables)])


def values(spark: SparkSession, *rows, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def sql_list(items) -> str:
    return ", ".join("NULL" if i is None else "'" + str(i).replace("'", "''") + "'" for i in items)


# masks ------------------------------------------------------------------------------------------------------------

FIRST, LAST = sql_list(masks.FIRST_NAMES), sql_list(masks.LAST_NAMES)
EMAIL = "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com'"


def sql_name(c: str) -> str:
    n = f"('0x' || substr(sha256({c}), 1, 8))::BIGINT"
    return f"CASE WHEN {c} IS NOT NULL THEN ([{FIRST}])[{n} % 18 + 1] || ' ' || ([{LAST}])[({n} // 18) % 18 + 1] END"


def sql_email(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN strpos({c}, '@') = 0 THEN 'masked@example.com' ELSE substr(sha256(substr({c}, 1, strpos({c}, '@') - 1)), 1, 8) || substr({c}, strpos({c}, '@')) END"


@query("SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def mask_hash_sha256(spark, sf_dir):
    return mask(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "hash-sha256"})


@query(f"WITH c AS (SELECT c_custkey, {EMAIL} AS email FROM customer) SELECT c_custkey, {sql_email('email')} AS email FROM c")
def mask_email(spark, sf_dir):
    return mask(t(spark, sf_dir, "customer").select("c_custkey", F.expr(EMAIL).alias("email")), {"email": "mask-email"})


@query(f"SELECT c_custkey, {sql_name('c_name')} AS c_name FROM customer")
def mask_name(spark, sf_dir):
    return mask(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "mask-name"})


@query("SELECT o_orderkey, '***REDACTED***' AS o_orderpriority FROM orders")
def mask_redact(spark, sf_dir):
    return mask(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": "redact"})


@query("SELECT * FROM supplier")
def mask_preserve(spark, sf_dir):
    return mask(t(spark, sf_dir, "supplier"), {"s_name": "preserve", "s_suppkey": "preserve"})


@query(f"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS n FROM customer) SELECT c_custkey, {sql_name('n')} AS a, sha256(n) AS b, CASE WHEN n IS NOT NULL THEN '***REDACTED***' END AS c, {sql_email('n')} AS d FROM c")
def mask_null_passthrough(spark, sf_dir):
    n = F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END")
    df = t(spark, sf_dir, "customer").select("c_custkey", *(n.alias(x) for x in "abcd"))
    return mask(df, {"a": "mask-name", "b": "hash-sha256", "c": "redact", "d": "mask-email"})


EDGE = ["plain", "a@b@c", "@x", "", None, "élodie@x.org", "alice@company.com", "x@"]


@query(f"WITH e AS (SELECT unnest([{sql_list(EDGE)}]) AS email) SELECT email AS original, {sql_email('email')} AS email FROM e")
def mask_email_edge(spark, sf_dir):
    return mask(values(spark, *((e, e) for e in EDGE), schema="original string, email string"), {"email": "mask-email"})


@query("SELECT count(*) AS n, count(*) AS inside, 0::BIGINT AS nulls FROM orders")
def mask_random_int_range(spark, sf_dir):
    drawn = mask(t(spark, sf_dir, "orders").select("o_custkey"), {"o_custkey": "random-int"})
    return drawn.agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey").between(0, 999_999)).alias("inside"), F.count_if(F.col("o_custkey").isNull()).alias("nulls"))


@query(f"SELECT c_custkey, {sql_name('c_name')} AS c_name, c_nationkey, c_acctbal, '***REDACTED***' AS c_mktsegment, {sql_email('email')} AS email FROM (SELECT *, {EMAIL} AS email FROM customer)")
def mask_customer_full(spark, sf_dir):
    df = t(spark, sf_dir, "customer").withColumn("email", F.expr(EMAIL))
    return mask(df, {"c_name": "mask-name", "c_mktsegment": "redact", "email": "mask-email", "no_such_column": "redact"})


@query("SELECT o_orderkey, o_custkey, sha256(o_orderstatus) AS o_orderstatus, o_totalprice, o_orderdate, '***REDACTED***' AS o_orderpriority FROM orders")
def mask_orders_full(spark, sf_dir):
    return mask(t(spark, sf_dir, "orders"), {"o_orderstatus": "hash-sha256", "o_orderpriority": "redact", "o_orderdate": "preserve"})


@query("SELECT event_id, ts, user_id, sha256(event_type) AS event_type, value, '***REDACTED***' AS props FROM events")
def mask_events_full(spark, sf_dir):
    return mask(t(spark, sf_dir, "events"), {"event_type": "hash-sha256", "props": "redact", "value": "preserve"})


@query(f"SELECT doc_id, sha256(text) AS text, lang, {sql_name('source')} AS source, n_chars FROM documents")
def mask_documents_full(spark, sf_dir):
    return mask(t(spark, sf_dir, "documents"), {"text": "hash-sha256", "source": "mask-name"})


@query("SELECT l_orderkey, l_linenumber, sha256(l_returnflag) AS l_returnflag, '***REDACTED***' AS l_linestatus FROM lineitem")
def mask_lineitem(spark, sf_dir):
    return mask(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), {"l_returnflag": "hash-sha256", "l_linestatus": "redact"})


@query("SELECT sha256(c_name) AS c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def mask_hash_join_consistency(spark, sf_dir):
    customer = t(spark, sf_dir, "customer")
    left = mask(customer.select("c_name"), {"c_name": "hash-sha256"}).distinct()
    right = t(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_name")
    return mask(right, {"c_name": "hash-sha256"}).join(left, "c_name").groupBy("c_name").agg(F.count("*").alias("n"))


@query(f"SELECT {sql_name('c_name')} AS c_name, count(*) AS n FROM customer GROUP BY ALL")
def mask_name_distribution(spark, sf_dir):
    return mask(t(spark, sf_dir, "customer").select("c_name"), {"c_name": "mask-name"}).groupBy("c_name").agg(F.count("*").alias("n"))


@query("SELECT lower(c_mktsegment) || '.example.com' AS domain, count(*) AS n FROM customer GROUP BY ALL")
def mask_email_domain_counts(spark, sf_dir):
    masked = mask(t(spark, sf_dir, "customer").select(F.expr(EMAIL).alias("email")), {"email": "mask-email"})
    return masked.groupBy(F.substring_index("email", "@", -1).alias("domain")).agg(F.count("*").alias("n"))


# codecs -----------------------------------------------------------------------------------------------------------

CODEC_CASES = {
    "int": [("42", True), (" 42 ", False), ("+7", True), ("-9", True), ("1.5", False), ("9223372036854775807", True), ("9223372036854775808", False), ("", False), ("abc", False), (None, True)],
    "float": [("3.14", True), ("1d", False), ("1e400", False), ("NaN", True), ("-.5", True), ("2e3", True), (" 1", False), ("", False), ("x", False), (None, True)],
    "bool": [("t", True), ("on", True), ("YES", True), ("y", False), ("False", True), ("0", True), ("off", True), ("2", False), ("", False), (None, True)],
    "timestamp": [("2024-01-15 10:30:00", True), ("2024-01-15 10:30:00.123456", True), ("2024-01-15T10:30:00Z", True), ("2024-01-15 10:30:00+05:30", True), ("2024-01-15 10:30:00-07", True), ("2024-13-15 10:30:00", False), ("infinity", False), ("2024-01-15", False), (None, True)],
    "date": [("2024-01-15", True), ("2024-1-5", False), ("2024-02-30", False), ("", False), (" 2024-01-15", False), (None, True)],
    "json": [('{"a":1}', True), ('{"a":1} x', False), ("null", True), ("[1, 2]", True), ('"s"', True), ("", False), ("{", False), ("1, 2", False), (None, True)],
    "bytea": [("\\x00ff", True), ("\\x0g", False), ("\\x123", False), ("plain", True), ("", True), (None, True)],
}


def _codec_query(codec: str, cases: list[tuple[str | None, bool]]) -> None:
    def run(spark, sf_dir):
        return values(spark, *(c for c, _ in cases), schema="raw string").select("raw", pgtypes.valid(F.col("raw"), codec).alias("ok"))

    QUERIES[f"codec_{codec}_valid"] = run
    rows = ", ".join(f"({sql_list([c])}, {str(ok).lower()})" for c, ok in cases)
    ORACLES[f"codec_{codec}_valid"] = f"SELECT raw::VARCHAR AS raw, ok FROM (VALUES {rows}) v(raw, ok)"


for _codec, _cases in CODEC_CASES.items():
    _codec_query(_codec, _cases)


@query("SELECT raw, CASE WHEN lower(raw) IN ('t', 'true', '1', 'yes', 'on') THEN 't' WHEN lower(raw) IN ('f', 'false', '0', 'no', 'off') THEN 'f' END AS canonical FROM (SELECT unnest(['t', 'TRUE', '1', 'Yes', 'on', 'f', 'false', '0', 'NO', 'off', NULL]) AS raw)")
def codec_bool_canonical(spark, sf_dir):
    df = values(spark, "t", "TRUE", "1", "Yes", "on", "f", "false", "0", "NO", "off", None, schema="raw string").withColumn("canonical", F.col("raw"))
    return mask(df, {"canonical": "preserve"}, {"canonical": "boolean"})


@query("SELECT unnest(['00ff', '', '6162']) AS hex, unnest(['\\x00ff', '\\x', '\\x6162']) AS text")
def codec_bytea_hex(spark, sf_dir):
    raw = values(spark, "\\x00ff", "\\x", "\\x6162", schema="text string").select("text", pgtypes.decode(F.col("text"), "bytea").alias("b"))
    return raw.select(F.lower(F.hex("b")).alias("hex"), pgtypes.encode(F.col("b"), raw.schema["b"].dataType).alias("text"))


@query(
    "SELECT m AS mask, c AS codec, CASE m WHEN 'preserve' THEN true WHEN 'random-int' THEN c IN ('int', 'float', 'json', 'text') ELSE c IN ('bytea', 'text') END AS ok "
    "FROM (SELECT unnest(['preserve', 'redact', 'mask-email', 'mask-name', 'hash-sha256', 'random-int']) AS m), (SELECT unnest(['int', 'float', 'bool', 'timestamp', 'date', 'bytea', 'json', 'text']) AS c)"
)
def transformer_type_matrix(spark, sf_dir):
    """Tried out: a mask over one non-NULL text of each codec either writes or raises."""
    sample = {"int": "1", "float": "1.5", "bool": "t", "timestamp": "2024-01-15 10:30:00", "date": "2024-01-15", "bytea": "\\x00", "json": "{}", "text": "a@b"}
    types = {"int": "integer", "float": "numeric", "bool": "boolean", "timestamp": "timestamp", "date": "date", "bytea": "bytea", "json": "jsonb", "text": "text"}
    out = []
    for name in masks.names():
        if name in pgtypes.ACCEPTS:
            for codec, text in sample.items():
                try:
                    mask(values(spark, text, schema="x string"), {"x": name}, {"x": types[codec]}).collect()  # one row
                    ok = True
                except Exception as e:
                    if "encode error" not in str(e):
                        raise
                    ok = False
                out.append((name, codec, ok))
    return spark.createDataFrame(out, "mask string, codec string, ok boolean")


@query("SELECT * FROM (VALUES ('hash-sha256', 5::BIGINT), ('mask-email', 3), ('mask-name', 3), ('preserve', 17), ('random-int', 4), ('redact', 11)) v(name, n_types)")
def transformer_catalog(spark, sf_dir):
    builtin = ["hash-sha256", "mask-email", "mask-name", "preserve", "random-int", "redact"]
    return masks.catalog(spark).where(F.col("name").isin(builtin)).select("name", F.size(F.split("types", ", ")).cast("long").alias("n_types"))


# catalog ----------------------------------------------------------------------------------------------------------

PG = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'VARCHAR' THEN 'text' WHEN 'FLOAT[]' THEN 'real[]' ELSE 'timestamp without time zone' END"


@query(f"SELECT table_name AS \"table\", column_name AS \"column\", {PG} AS type, ordinal_position::BIGINT AS position FROM information_schema.columns WHERE table_name IN ({sql_list(TABLES)})")
def catalog_columns(spark, sf_dir):
    return source(spark, sf_dir).catalog().select("table", "column", "type", "position")


@query(f"SELECT table_name AS \"table\", count(*) AS n_columns, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name IN ({sql_list(TABLES)}) GROUP BY ALL")
def catalog_table_summary(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("position", "column")))  # the columns of one table
    return source(spark, sf_dir).catalog().groupBy("table").agg(F.count("*").alias("n_columns"), F.array_join(F.transform(ordered, lambda x: x["column"]), ",").alias("columns"))


SELECTION = [("public", "users"), ("public", "orders"), ("public", "logs"), ("public", "sessions"), ("audit", "logs"), ("audit", "users"), ("public", "products")]


@query("SELECT * FROM (VALUES ('users', true), ('orders', true), ('logs', false), ('sessions', false), ('audit.logs', false), ('audit.users', false), ('products', false)) v(\"table\", included)")
def table_filter_include_exclude(spark, sf_dir):
    config = configs.from_dict({"tables": {"logs": {"exclude": True}}, "exclude_tables": ["sessions", "audit.users"], "include_tables": ["users", "orders", "logs", "sessions"]})
    return values(spark, *((configs.full_name(s, n), config.includes(s, n)) for s, n in SELECTION), schema="table string, included boolean")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k.name}', '{k.from_table}', '{k.from_columns[0]}', '{k.to_table}', '{k.to_columns[0]}')" for k in KEYS) + ") v(name, from_table, from_column, to_table, to_column)")
def fk_edges(spark, sf_dir):
    rows = [(k.name, k.from_table, a, k.to_table, b) for k in source(spark, sf_dir).foreign_keys() for a, b in zip(k.from_columns, k.to_columns)]
    return spark.createDataFrame(rows, "name string, from_table string, from_column string, to_table string, to_column string")


@query(" UNION ALL ".join(f"SELECT '{k.name}' AS name, count(*) AS orphans FROM {k.from_table} c WHERE c.{k.from_columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.to_table} p WHERE p.{k.to_columns[0]} = c.{k.from_columns[0]})" for k in KEYS))
def fk_orphans(spark, sf_dir):
    s = source(spark, sf_dir)
    return reduce(DataFrame.unionByName, (jobs.orphans(s.read(k.from_table), s.read(k.to_table), k).agg(F.count("*").alias("orphans")).select(F.lit(k.name).alias("name"), "orphans") for k in KEYS))


@query("SELECT * FROM (VALUES ('region', 0::BIGINT), ('part', 0), ('nation', 1), ('customer', 2), ('supplier', 2), ('orders', 3), ('lineitem', 4)) v(\"table\", layer)")
def topo_layers(spark, sf_dir):
    layers = Graph.of(STAR, source(spark, sf_dir, STAR).foreign_keys()).layers()
    return spark.createDataFrame([(n, i) for i, layer in enumerate(layers) for n in layer], "table string, layer long")


CYCLIC = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "g"), ("g", "f")]


@query("SELECT * FROM (VALUES ('a,b,c', 3::BIGINT), ('f,g', 2)) v(members, size)")
def cycle_groups(spark, sf_dir):
    return spark.createDataFrame([(",".join(g), len(g)) for g in Graph(edges=CYCLIC).cycles()], "members string, size long")


@query("SELECT true AS cyclic, 1::BIGINT AS layers_before")
def topo_cycle_detected(spark, sf_dir):
    try:
        Graph(["h"], CYCLIC).layers()
    except Cyclic as e:
        return spark.createDataFrame([(True, len(e.layers))], "cyclic boolean, layers_before long")
    raise AssertionError("no cycle found")


@query("SELECT * FROM (VALUES ('a,b,c', 0::BIGINT), ('e', 0), ('f,g', 0), ('h', 0), ('d', 1)) v(members, layer)")
def restore_order(spark, sf_dir):
    layers = Graph(["h"], CYCLIC).restore_layers()
    return spark.createDataFrame([(",".join(g), n) for n, layer in enumerate(layers) for g in layer], "members string, layer long")


# subsets ----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM customer WHERE c_custkey < 20 AND c_acctbal > 0")
def subset_seed_only(spark, sf_dir):
    return subsets.subset(source(spark, sf_dir, STAR), {"customer": "c_custkey < 20 AND c_acctbal > 0"})["customer"]


def _parents_of_orders(table: str):
    def run(spark, sf_dir):
        return subsets.subset(source(spark, sf_dir, STAR), {"orders": "o_orderkey < 50"}, parents=True)[table]

    return run


_O = "SELECT * FROM orders WHERE o_orderkey < 50"
_C = "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 50)"
_N = f"SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM ({_C}))"
for _name, _sql in (("orders", _O), ("customer", _C), ("nation", _N), ("region", f"SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM ({_N}))")):
    QUERIES[f"subset_parents_{_name}"] = _parents_of_orders(_name)
    ORACLES[f"subset_parents_{_name}"] = _sql


@query("SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey < 20)")
def subset_children_lineitem(spark, sf_dir):
    return subsets.subset(source(spark, sf_dir, STAR), {"customer": "c_custkey < 20"}, children=True)["lineitem"]


@query("SELECT * FROM orders WHERE o_custkey < 20")
def subset_children_orders(spark, sf_dir):
    return subsets.subset(source(spark, sf_dir, STAR), {"customer": "c_custkey < 20"}, children=True)["orders"]


_S = "o_orderkey < 5"
_D1C = f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_S})"
_D1L = f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_S})"
_DEPTH1 = f"SELECT 'orders' AS \"table\", count(*) AS rows FROM orders WHERE {_S} UNION ALL SELECT 'customer', count(*) FROM ({_D1C}) UNION ALL SELECT 'lineitem', count(*) FROM ({_D1L})"


@query(f"SELECT * FROM ({_DEPTH1}) WHERE rows > 0")
def subset_both_depth1(spark, sf_dir):
    return subsets.row_counts(spark, subsets.subset(source(spark, sf_dir, STAR), {"orders": _S}, parents=True, children=True, max_depth=1))


@query(
    f"SELECT * FROM (SELECT 'orders' AS \"table\", count(*) AS rows FROM orders WHERE {_S} OR o_custkey IN ({_D1C}) UNION ALL SELECT 'customer', count(*) FROM ({_D1C}) "
    f"UNION ALL SELECT 'lineitem', count(*) FROM ({_D1L}) UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN ({_D1C})) "
    f"UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM ({_D1L})) UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM ({_D1L}))) WHERE rows > 0"
)
def subset_depth_limited(spark, sf_dir):
    return subsets.row_counts(spark, subsets.subset(source(spark, sf_dir, STAR), {"orders": _S}, parents=True, children=True, max_depth=2))


@query(f"SELECT 'orders' AS \"table\", count(*) AS rows FROM ({_O}) UNION ALL SELECT 'customer', count(*) FROM ({_C}) UNION ALL SELECT 'nation', count(*) FROM ({_N}) UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM ({_N}))")
def subset_row_counts(spark, sf_dir):
    return subsets.row_counts(spark, subsets.subset(source(spark, sf_dir, STAR), {"orders": "o_orderkey < 50"}, parents=True))


@query("SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem WHERE l_orderkey < 100 AND l_linenumber > 1")
def subset_composite_fk(spark, sf_dir):
    lineitem = t(spark, sf_dir, "lineitem")
    frames = {"lineitem": lineitem.withColumn("l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))), "partsupp": lineitem.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()}
    # the key's second part is NULL in first lines; such rows refer to nothing
    key = ForeignKey("lineitem_partsupp", "lineitem", ("l_partkey", "l_suppkey"), "partsupp", ("ps_partkey", "ps_suppkey"))
    return subsets.subset(FrameSource(spark, frames, [key]), {"lineitem": "l_orderkey < 100"}, parents=True)["partsupp"]


@query("WITH RECURSIVE r AS (SELECT p_partkey FROM part WHERE p_partkey IN (77, 1500) UNION SELECT p_partkey // 2 FROM r) SELECT p_partkey, p_partkey // 2 AS parent FROM r WHERE p_partkey IN (SELECT p_partkey FROM part)")
def subset_self_fk(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    key = ForeignKey("part_parent", "part", ("parent",), "part", ("p_partkey",))
    return subsets.subset(FrameSource(spark, {"part": part}, [key]), {"part": "p_partkey IN (77, 1500)"}, parents=True, max_depth=40)["part"]


@query("SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 5) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)")
def subset_multi_seed(spark, sf_dir):
    return subsets.subset(source(spark, sf_dir, STAR), {"customer": "c_custkey < 5", "supplier": "s_suppkey < 5"}, parents=True)["nation"]


@query(f"SELECT c_custkey, {sql_name('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM ({_C})")
def subset_masked(spark, sf_dir):
    return mask(subsets.subset(source(spark, sf_dir, STAR), {"orders": "o_orderkey < 50"}, parents=True)["customer"], {"c_name": "mask-name"})


@query("SELECT * FROM nation")
def dedup_rows(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    return subsets.subset(FrameSource(spark, {"nation": nation.unionByName(nation)}), {"nation": "true"})["nation"]


# validation -------------------------------------------------------------------------------------------------------

DUMPED = {"users": {"id": "bigint", "email": "text", "age": "integer", "note": "TEXT"}, "gone": {"id": "bigint"}}
LIVE = {"users": {"id": "bigint", "email": "character varying(255)", "note": "text", "born": "date"}, "fresh": {"id": "bigint"}, "other": {"id": "bigint"}}
RULES = {"storage_dir": "./dumps", "parallelism": 2, "include_tables": ["users", "lost"], "exclude_tables": ["users"], "connection": {"host": "h", "user": "u"}, "tables": {"users": {"columns": {"email": "mask-email", "born": "mask-name", "phone": "redact", "id": "no-such"}}, "fresh": {"columns": {"id": "random-int"}}, "absent": {"columns": {"x": "redact"}}, "hidden": {"columns": {"x": "redact"}, "exclude": True}}}


def sql_findings(*rows: tuple[str, str, str, str, str]) -> str:
    return 'SELECT * FROM (VALUES ' + ", ".join(f"({sql_list(r)})" for r in rows) + ') v(severity, category, "table", "column", message)'


@query(
    sql_findings(
        ("WARNING", "schema", "gone", "", "dumped, but gone from the source since"),
        ("WARNING", "schema", "users", "age", "dumped as integer, but gone from the table since"),
        ("WARNING", "schema", "users", "email", "was text when dumped, is character varying(255) now"),
        ("WARNING", "schema", "users", "born", "new since the dump, as date"),
        ("WARNING", "schema", "fresh", "", "new since the dump, and has rules"),
    )
)
def schema_drift_live(spark, sf_dir):
    return validate.drift_live(spark, configs.from_dict(RULES), validate.schema_rows(spark, DUMPED), validate.schema_rows(spark, LIVE))


@query(
    sql_findings(
        ("ERROR", "schema", "gone", "", "the target lacks this table"),
        ("ERROR", "schema", "users", "age", "the target lacks this column of type integer"),
        ("WARNING", "schema", "users", "email", "dumped as text, but the target has character varying(255)"),
        ("WARNING", "schema", "users", "born", "only the target has this column, as date: it gets no values"),
    )
)
def schema_drift_restore(spark, sf_dir):
    return validate.drift_restore(validate.schema_rows(spark, DUMPED), validate.schema_rows(spark, LIVE))


@query(
    sql_findings(
        ("ERROR", "schema", "absent", "", "has rules, but the source has no such table"),
        ("ERROR", "schema", "users", "phone", "has a rule, but the table has no such column"),
        ("WARNING", "schema", "lost", "", "listed to be included, but the source has no such table"),
    )
)
def schema_check_missing(spark, sf_dir):
    return validate.check_schema(spark, configs.from_dict(RULES), validate.schema_rows(spark, LIVE))


@query(sql_findings(("WARNING", "type", "users", "born", "mask-name is made for text, varchar, character varying, not for date")))
def type_compat_findings(spark, sf_dir):
    return validate.check_types(spark, configs.from_dict(RULES), validate.schema_rows(spark, LIVE))


@query(sql_findings(("ERROR", "config", "", "", "the connection names no dbname"), ("ERROR", "config", "users", "id", "no mask is called no-such"), ("WARNING", "config", "users", "", "listed to be included and to be excluded: it is excluded")))
def config_findings(spark, sf_dir):
    return validate.findings(spark, validate.check_config(configs.from_dict(RULES)))


@query("SELECT * FROM (VALUES ('ERROR', 4::BIGINT), ('WARNING', 3)) v(severity, n)")
def finding_severity_counts(spark, sf_dir):
    config, live = configs.from_dict(RULES), validate.schema_rows(spark, LIVE)
    found = validate.findings(spark, validate.check_config(config)).unionByName(validate.check_schema(spark, config, live)).unionByName(validate.check_types(spark, config, live))
    return validate.severity_counts(found)


def _cut(c: str) -> str:
    return f"CASE WHEN strlen({c}) > 30 THEN left({c}, 27) || '...' ELSE {c} END"


@query(
    f"WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5), m AS (SELECT n, 'c_name' AS col, c_name AS a, sha256(c_name) AS b, 'hash-sha256' AS k FROM s UNION ALL SELECT n, 'c_mktsegment', c_mktsegment, '***REDACTED***', 'redact' FROM s) "
    f"SELECT 'WARNING' AS severity, 'diff' AS category, 'customer' AS \"table\", col AS \"column\", 'row ' || n || ': ' || {_cut('a')} || ' becomes ' || {_cut('b')} || ' by ' || k AS message FROM m WHERE a IS DISTINCT FROM b"
)
def diff_preview(spark, sf_dir):
    return validate.preview(t(spark, sf_dir, "customer"), "customer", {"c_name": "hash-sha256", "c_mktsegment": "redact", "c_custkey": "preserve"}, order=["c_custkey"])


# dumps ------------------------------------------------------------------------------------------------------------

_NATION_LINE = "strlen(n_nationkey::VARCHAR || chr(9) || replace(n_name, '\\', '\\\\') || chr(9) || n_regionkey::VARCHAR) + 1"


def _folder(spark: SparkSession) -> str:
    return shared.folder(spark, "query")


@query(f"SELECT 'nation' AS \"table\", count(*) AS rows, sum({_NATION_LINE})::BIGINT AS bytes FROM nation UNION ALL SELECT 'labels', count(*), sum(strlen(doc_id::VARCHAR || chr(9) || quality::VARCHAR || chr(9) || toxic::VARCHAR) + 1)::BIGINT FROM labels")
def dump_row_stats(spark, sf_dir):
    return reduce(DataFrame.unionByName, (jobs.line_stats(t(spark, sf_dir, n)).select(F.lit(n).alias("table"), "rows", "bytes") for n in ("nation", "labels")))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT * FROM (VALUES (-1, NULL, '', '\\N', 0), (-2, 'a' || chr(9) || 'b' || chr(10) || '\\t', 'x' || chr(13), chr(92), NULL)) v(doc_id, text, lang, source, n_chars)")
def copytext_roundtrip(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(-1, None, "", "\\N", 0), (-2, "a\tb\n\\t", "x\r", "\\", None)], docs.schema)
    path = _folder(spark)
    copytext.write(docs.unionByName(odd), path)
    return copytext.read(spark, path, docs.schema)


def _dumped(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    config = configs.from_dict({"parallelism": 3, "include_tables": ["region", "nation", "customer", "supplier"], "tables": {"customer": {"columns": {"c_name": "mask-name"}}}}).with_defaults()
    store = Store(spark, _folder(spark))
    return store, jobs.dump(spark, source(spark, sf_dir, STAR), config, store, "tpch")


@query("SELECT 'region' AS name, (SELECT count(*) FROM region) AS row_count UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier)")
def dump_tables(spark, sf_dir):
    store, dump = _dumped(spark, sf_dir)
    return store.tables(dump).select("name", "row_count")


@query("SELECT 'tpch' AS source_db, 4::BIGINT AS n_tables, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total_rows")
def dump_manifest_totals(spark, sf_dir):
    store, _ = _dumped(spark, sf_dir)
    return store.dumps().select("source_db", F.size("tables").cast("long").alias("n_tables"), "total_rows")


@query(f"SELECT c_custkey, {sql_name('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def restore_roundtrip_customer(spark, sf_dir):
    store, dump = _dumped(spark, sf_dir)
    target = _folder(spark)
    jobs.restore(spark, store, dump, target)
    return spark.read.parquet(f"{target}/customer.parquet")


@query("SELECT 'region' AS \"table\", 0::BIGINT AS layer, (SELECT count(*) FROM region) AS rows, 0::BIGINT AS orphans UNION ALL SELECT 'nation', 1, (SELECT count(*) FROM nation), 0 UNION ALL SELECT 'customer', 2, (SELECT count(*) FROM customer), 0 UNION ALL SELECT 'supplier', 2, (SELECT count(*) FROM supplier), 0")
def restore_ordered_counts(spark, sf_dir):
    store, dump = _dumped(spark, sf_dir)
    done = jobs.restore_in_order(spark, store, dump, _folder(spark), KEYS)
    orphans = {k.from_table: done.orphans.get(k.name, 0) for k in KEYS if k.name in done.orphans}
    rows = [(n, i, done.rows[n], orphans.get(n, 0)) for i, layer in enumerate(done.order) for group in layer for n in group]
    return spark.createDataFrame(rows, "table string, layer long, rows long, orphans long")


@contextmanager
def _database(spark: SparkSession) -> Iterator[jobs.DatabaseTarget]:
    """An empty database of the engine that comes with Spark, in the driver's process and on its disk; gone afterwards."""
    path = f"{spark.sparkContext._temp_dir}/database-{uuid.uuid4().hex}"
    target = jobs.DatabaseTarget(spark, {"url": f"jdbc:derby:directory:{path};create=true"}, parts=2)
    try:
        yield target
    finally:
        target.database.end()
        shutil.rmtree(path, ignore_errors=True)


@query(f"SELECT c_custkey, {sql_name('c_name')} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def restore_into_database(spark, sf_dir):
    """Through JDBC into tables made from the dump's schema file, and read back."""
    store, dump = _dumped(spark, sf_dir)
    with _database(spark) as target:
        jobs.restore(spark, store, dump, target)
        return target.kept("customer")


@query("SELECT 'region' AS \"table\", 0::BIGINT AS layer, (SELECT count(*) FROM region) AS rows, 0::BIGINT AS orphans, NULL AS parent UNION ALL SELECT 'nation', 1, (SELECT count(*) FROM nation), 0, 'region' UNION ALL SELECT 'customer', 2, (SELECT count(*) FROM customer), 0, 'nation' UNION ALL SELECT 'supplier', 2, (SELECT count(*) FROM supplier), 0, 'nation'")
def restore_database_in_order(spark, sf_dir):
    """In the order of the dump's keys, which the target has afterwards; parents as the target tells them."""
    store, dump = _dumped(spark, sf_dir)
    with _database(spark) as target:
        done = jobs.restore_in_order(spark, store, dump, target)
        parents = {k.from_table: k.to_table for k in target.database.foreign_keys()}
        orphans = {k.from_table: done.orphans[k.name] for k in KEYS if k.name in done.orphans}
        rows = [(n, i, target.database.count(n), orphans.get(n, 0), parents.get(n)) for i, layer in enumerate(done.order) for group in layer for n in group]
    return spark.createDataFrame(rows, "table string, layer long, rows long, orphans long, parent string")


@query(f"SELECT table_name AS \"table\", column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' ELSE 'varchar(32672)' END AS type, ordinal_position::BIGINT AS position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier')")
def database_catalog(spark, sf_dir):
    """Tables and columns as a live database tells them."""
    store, dump = _dumped(spark, sf_dir)
    with _database(spark) as target:
        target.prepare(store.read_text(store.schema_path(dump)), drop=False)
        rows = [(t, c.name, c.type, n) for t, info in target.database.describe().items() for n, c in enumerate(info.columns, 1)]
    return spark.createDataFrame(rows, "table string, column string, type string, position long")


SIZES = [0, 1, 1023, 1024, 1536, 1048576, 5000000, 1073741824, 123456789012]


@query(f"SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS shown FROM (SELECT unnest({SIZES}::BIGINT[]) AS n)")
def format_bytes_sizes(spark, sf_dir):
    return values(spark, *SIZES, schema="n long").select("n", format_bytes(F.col("n")).alias("shown"))


# what has one row of expectations each ---------------------------------------------------------------------------


def sql_values(columns: str, *rows: tuple) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else sql_list([v])
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({columns})"


CONFIG_TEXT = """
parallelism: 3
exclude_tables: [log]
tables:
  users: {columns: {mail: mask-email, name: mask-name}}
  crm.users: {columns: {name: redact}}
  trail: {exclude: true, columns: {who: redact}}
subset: {tables: {users: {where: id < 3}}, resolve_children: true, max_depth: 0}
"""


@query(sql_values('"table", "column", mask, excluded, seed, depth', ("crm.users", "name", "redact", False, None, 10), ("trail", "who", "redact", True, None, 10), ("users", "mail", "mask-email", False, "id < 3", 10), ("users", "name", "mask-name", False, "id < 3", 10)))
def config_rules(spark, sf_dir):
    """The YAML configuration as rows."""
    config = configs.from_dict(yaml.safe_load(CONFIG_TEXT))
    rows = [(t, c, m, v.exclude, config.subset.seeds.get(t), config.subset.max_depth) for t, v in config.tables.items() for c, m in v.columns.items()]
    return spark.createDataFrame(rows, "table string, column string, mask string, excluded boolean, seed string, depth long")


@query(sql_values('"schema", "table", rules', ("public", "users", "mail=mask-email,name=mask-name"), ("crm", "users", "name=redact"), ("hr", "users", "mail=mask-email,name=mask-name"), ("public", "other", "")))
def rule_lookup(spark, sf_dir):
    """Rules under the full name replace those under the bare name as a whole."""
    config = configs.from_dict(yaml.safe_load(CONFIG_TEXT))
    rows = [(s, n, ",".join(f"{c}={m}" for c, m in sorted(config.rules(s, n).items()))) for s, n in (("public", "users"), ("crm", "users"), ("hr", "users"), ("public", "other"))]
    return spark.createDataFrame(rows, "schema string, table string, rules string")


@query(sql_values("mask, known", *((m, m != "no-such") for m in ("preserve", "redact", "hash-sha256", "mask-email", "mask-name", "random-int", "no-such"))))
def mask_names_checked(spark, sf_dir):
    out = []
    for name in ("preserve", "redact", "hash-sha256", "mask-email", "mask-name", "random-int", "no-such"):
        try:
            check_masks({"t": {"c": name}})
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "mask string, known boolean")


CATALOG_KEYS = [
    ("public", "a", "fk", 2, "y", "public", "p", "q"), ("public", "b", "fk", 1, "x", "audit", "p", "p"), ("public", "a", "fk", 1, "x", "public", "p", "p"),
    ("audit", "a", "fk", 1, "z", "public", "r", "r"), ("public", "c", "fk", 1, "k", "public", "c", "id"),
]


@query(
    "SELECT name, CASE fs WHEN 'public' THEN ft ELSE fs || '.' || ft END AS from_table, string_agg(fc, ',' ORDER BY pos) AS from_columns, CASE ts WHEN 'public' THEN tt ELSE ts || '.' || tt END AS to_table, string_agg(tc, ',' ORDER BY pos) AS to_columns "
    "FROM (VALUES " + ", ".join(f"({sql_list(r)})" for r in CATALOG_KEYS) + ") v(fs, ft, name, pos, fc, ts, tt, tc) GROUP BY fs, ft, name, ts, tt"
)
def fk_regrouped(spark, sf_dir):
    """Catalog rows, one for each column pair, put together by the table that has the key and the key's name."""
    keys = keys_of(spark.createDataFrame(CATALOG_KEYS, KEY_ROWS))
    return spark.createDataFrame([(k.name, k.from_table, ",".join(k.from_columns), k.to_table, ",".join(k.to_columns)) for k in keys], "name string, from_table string, from_columns string, to_table string, to_columns string")


@query(sql_values("name, followed", ("good", True), ("no_column", False), ("no_table", False)))
def fk_without_column(spark, sf_dir):
    """Keys whose columns or tables are missing are not followed, and named."""
    nation, region = (t(spark, sf_dir, n) for n in ("nation", "region"))
    keys = [ForeignKey("good", "nation", ("n_regionkey",), "region", ("r_regionkey",)), ForeignKey("no_column", "nation", ("gone",), "region", ("r_regionkey",)), ForeignKey("no_table", "nation", ("n_regionkey",), "gone", ("id",))]
    plan = subsets.plan(FrameSource(spark, {"nation": nation, "region": region}, keys), {"nation": "true"}, parents=True)
    return spark.createDataFrame([(k.name, True) for k in plan.keys] + [(n, False) for n in plan.skipped], "name string, followed boolean")


@query(sql_values("place, statement", (0, 'CREATE TABLE "public"."nation" ("n_nationkey" bigint, "n_name" text, "n_regionkey" bigint)'), (1, 'CREATE TABLE "public"."region" ("r_regionkey" bigint, "r_name" text)'), (2, 'ALTER TABLE "public"."region" ADD UNIQUE ("r_regionkey")'), (3, 'ALTER TABLE "public"."nation" ADD CONSTRAINT "nation_region" FOREIGN KEY ("n_regionkey") REFERENCES "public"."region" ("r_regionkey")')))
def schema_ddl(spark, sf_dir):
    """Statements from a dump's schema file; widths of whole numbers aside."""
    s = source(spark, sf_dir, ["nation", "region"])
    text = stores.schema_text({n: s.read(n) for n in s.names()}, s.foreign_keys())
    return values(spark, *enumerate(x.replace(" integer", " bigint") for x in stores.ddl(text)), schema="place long, statement string")


@query(sql_values("category, severity, n", ("config", "ERROR", 1), ("diff", "ERROR", 1), ("type", "ERROR", 1)))
def check_runner(spark, sf_dir):
    """Named checks only, unknown names passed over; without a source the others report an error."""
    config = configs.from_dict({"storage_dir": "d", "parallelism": 1, "connection": {"host": "h", "dbname": "d"}})
    return validate.Validator(spark, config).run(["diff", "no-such", "config", "types"]).groupBy("category", "severity").agg(F.count("*").alias("n"))


def _manifest(store: Store, name: str, at: str) -> None:
    store.write_manifest(name, {"id": name, "created_at": at, "source_db": "db", "tables": [], "schema_file": "s", "duration_ns": 1})


@query(sql_values("place, id", (0, "c"), (1, "a"), (2, "b")))
def dumps_newest_first(spark, sf_dir):
    """Folders without a readable manifest are passed over."""
    store = Store(spark, _folder(spark))
    for name, at in (("a", "2024-02-02T00:00:00+00:00"), ("b", "2024-01-01T00:00:00+00:00"), ("c", "2024-02-02T00:00:00.5+00:00")):
        _manifest(store, name, at)
    store.write_text(f"{store.folder('broken')}/metadata.json", "{")
    store.create("db", now=datetime(2024, 1, 1))
    return values(spark, *enumerate(r["id"] for r in store.dumps().collect()), schema="place long, id string")


@query(sql_values("step, n", ("made", 1), ("found", 1), ("refused", 5), ("left", 0)))
def dump_lifecycle(spark, sf_dir):
    """A dump is made, found and deleted; ids that lead elsewhere, and unknown ones, are refused."""
    store = Store(spark, _folder(spark))
    name = store.create("db", "x", datetime(2024, 5, 6, 7, 8, 9))
    _manifest(store, name, "2024-05-06T07:08:09+00:00")
    found, refused = store.dumps().count(), 0
    for bad in ("..", "", "a/b", "a\\b", "unknown"):
        try:
            store.delete(bad)
        except (ValueError, FileNotFoundError):
            refused += 1
    store.delete(name)
    return values(spark, ("made", int(name == "20240506_070809_db_x")), ("found", found), ("refused", refused), ("left", store.dumps().count()), schema="step string, n long")


@query('SELECT column_name AS "column", CASE data_type WHEN \'BIGINT\' THEN \'bigint\' WHEN \'INTEGER\' THEN \'integer\' WHEN \'DOUBLE\' THEN \'double precision\' ELSE \'text\' END AS type, CASE column_name WHEN \'c_name\' THEN \'mask-name\' END AS transformer FROM information_schema.columns WHERE table_name = \'customer\'')
def show_dump_columns(spark, sf_dir):
    store, dump = _dumped(spark, sf_dir)
    return store.columns(dump).where("table = 'customer'").select("column", "type", "transformer")


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier']) AS name, true AS as_on_disk, true AS smaller_than_text")
def dump_sizes(spark, sf_dir):
    """Compressed sizes are those of the files; these rows compress well, but for the smallest tables' headers."""
    store, dump = _dumped(spark, sf_dir)
    found = store.tables(dump).collect()  # a row for each table
    return values(spark, *((r["name"], r["compressed_size_bytes"] == store.size(store.data_path(dump, r["schema"], r["name"])), r["compressed_size_bytes"] < r["original_size_bytes"] + 200) for r in found), schema="name string, as_on_disk boolean, smaller_than_text boolean")


@query(f"SELECT 'orders' AS name, count(*) AS row_count FROM ({_O}) UNION ALL SELECT 'customer', count(*) FROM ({_C}) UNION ALL SELECT 'nation', count(*) FROM ({_N}) UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM ({_N}))")
def subset_job(spark, sf_dir):
    """Plan, closure, masks, files and manifest in one job."""
    config = configs.from_dict({"tables": {"customer": {"columns": {"c_name": "redact"}}}, "subset": {"tables": {"orders": {"where": "o_orderkey < 50"}}, "resolve_parents": True}}).with_defaults()
    store = Store(spark, _folder(spark))
    dump = jobs.subset_dump(spark, source(spark, sf_dir, STAR), config, store, "tpch")
    return store.tables(dump).select("name", "row_count")


@query(sql_values('"table", "column", mask', *((n, c, m) for n, v in yaml.safe_load(configs.SAMPLE)["tables"].items() for c, m in (v.get("columns") or {}).items())))
def init_sample(spark, sf_dir):
    """The sample configuration holds known masks only, and is read as it is written."""
    config = configs.from_dict(yaml.safe_load(configs.SAMPLE))
    check_masks({n: v.columns for n, v in config.tables.items()})
    return spark.createDataFrame([(n, c, m) for n, v in config.tables.items() for c, m in v.columns.items()], "table string, column string, mask string")


# a share of the tables, and all of them --------------------------------------------------------------------------

_SEGMENT = "c_mktsegment = 'BUILDING'"


@query(f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {_SEGMENT}))")
def subset_children_of_segment(spark, sf_dir):
    """Seeds that take a share of their table, whatever its size."""
    return subsets.subset(source(spark, sf_dir, STAR), {"customer": _SEGMENT}, children=True)["lineitem"]


@query(
    "WITH RECURSIVE e AS (SELECT 'o' AS a, o_orderkey AS x, 'c' AS b, o_custkey AS y FROM orders UNION ALL SELECT 'c', c_custkey, 'n', c_nationkey FROM customer UNION ALL SELECT 's', s_suppkey, 'n', s_nationkey FROM supplier "
    "UNION ALL SELECT 'n', n_nationkey, 'r', n_regionkey FROM nation UNION ALL SELECT 'o', l_orderkey, 'p', l_partkey FROM lineitem UNION ALL SELECT 'o', l_orderkey, 's', l_suppkey FROM lineitem), "
    "d AS (SELECT DISTINCT a, x, b, y FROM e UNION SELECT DISTINCT b, y, a, x FROM e), "
    f"k(a, x) AS (SELECT 'o', o_orderkey FROM orders WHERE {_S} UNION SELECT d.b, d.y FROM k JOIN d ON k.a = d.a AND k.x = d.x) "
    "SELECT * FROM (SELECT 'orders' AS \"table\", count(*) AS rows FROM orders WHERE o_orderkey IN (SELECT x FROM k WHERE a = 'o') UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT x FROM k WHERE a = 'c') "
    "UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT x FROM k WHERE a = 'n') UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT x FROM k WHERE a = 'r') "
    "UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey IN (SELECT x FROM k WHERE a = 's') UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT x FROM k WHERE a = 'p') "
    "UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT x FROM k WHERE a = 'o') OR l_partkey IN (SELECT x FROM k WHERE a = 'p') OR l_suppkey IN (SELECT x FROM k WHERE a = 's')) WHERE rows > 0"
)
def subset_both_converged(spark, sf_dir):
    """In both directions until nothing is added."""
    return subsets.row_counts(spark, subsets.subset(source(spark, sf_dir, STAR), {"orders": _S}, parents=True, children=True, max_depth=30))


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS row_count" for n in TABLES))
def dump_all_tables(spark, sf_dir):
    store = Store(spark, _folder(spark))
    dump = jobs.dump(spark, source(spark, sf_dir), configs.from_dict({}).with_defaults(), store, "all")
    return store.tables(dump).select("name", "row_count")
