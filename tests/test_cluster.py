"""Queries with executors in processes of their own, as on a cluster: what only the driver's process holds is not there."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

import __spark_entry__

CHILD = '''
import datetime, decimal, json, os, sys
from pyspark.sql import SparkSession, functions as F
import __spark_entry__
from veilspark import catalog_queries as q
from veilspark.sources import database, store as stores

sf_dir, base = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.session.timeZone", "Asia/Tokyo").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", f"file://{base}/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
found = {n: sorted(map(str, __spark_entry__.queries()[n](spark, sf_dir).collect())) for n in ("database_catalog", "restore_into_database", "restore_database_in_order")}

database.HELD_BYTES, database.HELD_ROWS = 3000, 7  # many pieces
texts = ["", None, '"', '""', "a,b", "a\\nb\\r\\nc", "\\r", "\\t", " x ", "\\\\N", "'", '","', "\\u00e9\\u4e2d\\U0001f600", "NULL"]
odd = [(n, texts[n % 14], None if n % 5 == 0 else decimal.Decimal(n) / 100 - 1, None if n % 3 == 0 else datetime.date(1969, 12, n % 28 + 1), datetime.datetime(2024, 2, 3, 4, 5, n, 600), datetime.datetime(1960, 1, 1, 0, 0, n), None if n % 4 == 0 else n % 2 == 0, n / 7, bytes([n, 0, 34])) for n in range(30)]
df = spark.createDataFrame(odd, "`row id` long, `no,te` string, pay decimal(10,2), born date, at timestamp, seen timestamp_ntz, fine boolean, share double, raw binary").repartition(3)
one = spark.createDataFrame([(None,), ("",), ("x",)], "only string").coalesce(1)
frames = {"odd": df, "one": one, "none": one.limit(0)}
with q._database(spark) as target:
    target.prepare(stores.schema_text(frames, []), False)
    counts = {t: target.load(f, t) for t, f in frames.items()}
    back = {t: target.kept(t) for t in frames}
    turned = [target.load(df.select(*reversed(df.columns)), "odd"), target.read("odd").distinct().count(), target.load(df.select("pay", "`row id`"), "odd"), target.read("odd").where("`no,te` is null and fine is null and born is null and share is null").count()]  # columns go by name
    target.database.execute(['CREATE TABLE "public"."key" ("n" BIGINT NOT NULL PRIMARY KEY)'])
    try:
        target.load(spark.range(40).select((F.col("id") % 39).alias("n")), "key")
    except Exception:
        turned.append(target.database.count("key"))
frames["odd"] = df.withColumn("seen", F.convert_timezone(F.lit("America/New_York"), F.lit("Asia/Tokyo"), "seen").cast("timestamp"))  # JDBC knows the driver's clock only
rows = {t: [sorted(map(str, x[t].collect())) for x in (frames, back)] for t in frames}
left = [p for p in os.listdir(spark.sparkContext._temp_dir) if p.startswith(("database-", "rows-"))]
print(json.dumps({"queries": found, "counts": counts, "rows": rows, "turned": turned, "left": left}))
'''


@pytest.fixture(scope="module")
def cluster(tmp_path_factory, sf_dir):
    base = tmp_path_factory.mktemp("cluster")
    (base / "home").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in a folder of Spark's home
        if p.name != "work":
            (base / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(base / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-java-options -Duser.timezone=America/New_York pyspark-shell", "PYTHONPATH": str(Path(__spark_entry__.__file__).parent)}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", CHILD, sf_dir, str(base)], env=env, cwd=base, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    return json.loads(run.stdout.splitlines()[-1])


@pytest.mark.parametrize("name", ["database_catalog", "restore_into_database", "restore_database_in_order"])
def test_database_queries(spark, sf_dir, cluster, name):
    assert cluster["queries"][name] == sorted(map(str, __spark_entry__.queries()[name](spark, sf_dir).collect())) != []


def test_rows_through_the_driver(cluster):
    assert cluster["counts"] == {"odd": 30, "one": 3, "none": 0}
    for given, back in cluster["rows"].values():
        assert back == given
    assert {t: len(back) for t, (_, back) in cluster["rows"].items()} == {"odd": 30, "one": 3, "none": 0}
    assert cluster["turned"] == [30, 30, 30, 30, 0] and cluster["left"] == []
