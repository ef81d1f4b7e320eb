"""Databases through JDBC, on the engine that comes with Spark."""

import pytest
from pyspark.sql import functions as F

from veilspark import cli
from veilspark.operators import jobs
from veilspark.sources import config as configs
from veilspark.sources import store as stores
from veilspark.sources.catalog import KEY_ROWS, JdbcSource, keys_of
from veilspark.sources.database import ForeignKey, table_ddl
from veilspark.sources.store import Store

MAKE = [
    'CREATE TABLE "public"."team" ("id" INTEGER NOT NULL PRIMARY KEY, "title" VARCHAR(40) DEFAULT \'none\')',
    'CREATE TABLE "public"."person" ("id" BIGINT NOT NULL PRIMARY KEY, "team id" INTEGER, "boss" BIGINT, "name" VARCHAR(40), "born" DATE)',
    'CREATE TABLE "hr"."person" ("id" BIGINT NOT NULL PRIMARY KEY, "team" INTEGER)',
    'CREATE TABLE "public"."badge" ("person" BIGINT NOT NULL, "no" INTEGER NOT NULL, "pay" DECIMAL(10,2), PRIMARY KEY ("person", "no"))',
    'CREATE TABLE "public"."swipe" ("person" BIGINT, "no" INTEGER, "at" TIMESTAMP, "fine" BOOLEAN)',
    'CREATE INDEX "swipe_at" ON "public"."swipe" ("at")',
    # one name on two tables, as names are unique within a table only
    'ALTER TABLE "public"."person" ADD CONSTRAINT "in_team" FOREIGN KEY ("team id") REFERENCES "public"."team" ("id")',
    'ALTER TABLE "hr"."person" ADD CONSTRAINT "in_team" FOREIGN KEY ("team") REFERENCES "public"."team" ("id")',
    'ALTER TABLE "public"."person" ADD CONSTRAINT "has_boss" FOREIGN KEY ("boss") REFERENCES "public"."person" ("id")',
    'ALTER TABLE "public"."badge" ADD CONSTRAINT "of_person" FOREIGN KEY ("person") REFERENCES "public"."person" ("id")',
    'ALTER TABLE "public"."swipe" ADD CONSTRAINT "of_badge" FOREIGN KEY ("person", "no") REFERENCES "public"."badge" ("person", "no")',
]


def url(name):
    return {"url": f"jdbc:derby:memory:{name};create=true"}


@pytest.fixture(scope="module")
def database(spark):
    source = JdbcSource(spark, url("people"), parts=3, schemas=["public", "hr"])
    source.database.execute(['CREATE SCHEMA "public"', 'CREATE SCHEMA "hr"', *MAKE])
    source.database.execute([f"INSERT INTO \"public\".\"team\" VALUES ({n}, 'team {n}')" for n in range(3)])
    source.database.execute([f"INSERT INTO \"public\".\"person\" VALUES ({n}, {n % 3 if n % 5 else 'NULL'}, {n // 2 if n else 'NULL'}, {f'name {n}'!r}, {'NULL' if n == 7 else f"DATE('2020-01-{n + 1:02}')"})" for n in range(20)])
    source.database.execute([f'INSERT INTO "hr"."person" VALUES ({n}, {n % 2})' for n in range(4)])
    source.database.execute([f'INSERT INTO "public"."badge" VALUES ({n}, {k}, {n}.25)' for n in range(20) for k in range(2)])
    source.database.execute([f"INSERT INTO \"public\".\"swipe\" VALUES ({n % 20}, {n % 2}, TIMESTAMP('2024-02-03 04:05:{n:02}.5'), {'TRUE' if n % 3 else 'FALSE'})" for n in range(30)])
    return source


def test_catalog(database):
    assert database.names() == ["hr.person", "badge", "person", "swipe", "team"]
    info = database.describe()
    assert [(c.name, c.type, c.nullable) for c in info["badge"].columns] == [("person", "bigint", False), ("no", "integer", False), ("pay", "decimal(10,2)", True)]
    assert info["badge"].primary_key == ("person", "no") and info["team"].columns[1].default == "'none'"
    assert ("swipe_at", False, ("at",)) in info["swipe"].indexes
    assert database.version().startswith("10.")


def test_foreign_keys(database):
    found = {(k.from_table, k.name): k for k in database.foreign_keys()}
    assert found["person", "in_team"] == ForeignKey("in_team", "person", ("team id",), "team", ("id",))
    assert found["hr.person", "in_team"] == ForeignKey("in_team", "hr.person", ("team",), "team", ("id",))
    assert found["swipe", "of_badge"] == ForeignKey("of_badge", "swipe", ("person", "no"), "badge", ("person", "no"))
    assert len(found) == 5


def test_keys_with_one_name_stay_apart(spark):
    rows = [("public", "a", "fk", 2, "y", "public", "p", "q"), ("public", "b", "fk", 1, "x", "audit", "p", "p"), ("public", "a", "fk", 1, "x", "public", "p", "p"), ("audit", "a", "fk", 1, "z", "", "r", "r")]
    assert keys_of(spark.createDataFrame(rows, KEY_ROWS)) == [ForeignKey("fk", "audit.a", ("z",), "r", ("r",)), ForeignKey("fk", "a", ("x", "y"), "p", ("p", "q")), ForeignKey("fk", "b", ("x",), "audit.p", ("p",))]


def test_parallel_read_and_pushdown(database):
    person = database.read("person")
    assert person.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in person.collect()) == list(range(20))
    assert database.read("swipe").rdd.getNumPartitions() == 1 and database.read("swipe").count() == 30
    plan = database.query("person", "id < 5").select("name")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(id), *LessThan(id,5)]" in plan or "PushedPredicates" in plan


def test_dump_and_restore_through_the_target(spark, database, tmp_path):
    config = configs.from_dict({"tables": {"person": {"columns": {"name": "mask-name"}}}}).with_defaults()
    store = Store(spark, f"file://{tmp_path}")
    dump = jobs.dump(spark, database, config, store, "people")
    assert store.manifest(dump)["pg_version"].startswith("10.")
    target = jobs.DatabaseTarget(spark, url("copy"), parts=2, batch=7)
    done = jobs.restore_in_order(spark, store, dump, target)
    assert done.errors == {}
    assert done.rows == {"team": 3, "person": 20, "hr.person": 4, "badge": 40, "swipe": 30} and not done.errors and not any(done.orphans.values())
    place = {t: n for n, layer in enumerate(done.order) for group in layer for t in group}
    assert place["team"] < place["person"] < place["badge"] < place["swipe"]
    assert target.database.describe() .keys() == database.describe().keys()
    assert target.database.foreign_keys() == database.foreign_keys()
    copied, origin = target.database.describe(), database.describe()
    assert all((copied[t].columns, copied[t].primary_key) == (origin[t].columns, origin[t].primary_key) for t in origin)
    assert ("swipe_at", False, ("at",)) in copied["swipe"].indexes
    copy = target.read("swipe")
    assert copy.exceptAll(database.read("swipe")).isEmpty() and copy.count() == 30
    people = {r["id"]: r for r in target.read("person").collect()}
    assert people[7]["born"] is None and people[0]["boss"] is None and people[1]["name"] != "name 1" and " " in people[1]["name"]

    # into tables that are there, with their keys on: the order makes it possible; then once more from nothing
    target.database.execute([f'DELETE FROM "public"."{t}"' for t in ("swipe", "badge")])
    target.database.execute(['ALTER TABLE "public"."person" DROP CONSTRAINT "has_boss"', 'DELETE FROM "public"."person"', 'DELETE FROM "hr"."person"', 'DELETE FROM "public"."team"'])
    again = jobs.restore_in_order(spark, store, dump, jobs.DatabaseTarget(spark, url("copy"), parts=1))
    assert again.rows == done.rows and not again.errors
    whole = jobs.restore(spark, store, dump, jobs.DatabaseTarget(spark, url("copy")), drop=True)
    assert whole.total == 97 and target.database.foreign_keys() == database.foreign_keys()


def test_a_row_too_many_is_an_error(spark, database, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    dump = jobs.dump(spark, database, configs.from_dict({"include_tables": ["team"]}).with_defaults(), store)
    target = jobs.DatabaseTarget(spark, url("twice"))
    counts = iter([0, 4])
    target._count = lambda table: next(counts)
    done = jobs.restore_in_order(spark, store, dump, target)
    assert done.rows == {} and done.errors == {"team": "team: 4 rows came of 3"}
    with pytest.raises(jobs.PartlyFailed):  # the key is taken
        jobs.restore(spark, store, dump, jobs.DatabaseTarget(spark, url("twice")))


def test_command_line(spark, database, tmp_path, capsys):
    config = tmp_path / "c.yaml"
    config.write_text(f"storage_dir: file://{tmp_path}/dumps\nsubset: {{tables: {{swipe: {{where: 'no = 1 and person = 3'}}}}, resolve_parents: true}}\n")
    dsn, base = url("people")["url"], ["--config", str(config)]
    assert cli.main([*base, "subset", "--dsn", dsn, "--description", "a few"], spark) == 0
    dump = capsys.readouterr().out.strip()
    store = Store(spark, f"file://{tmp_path}/dumps")
    made = store.manifest(dump)
    assert made["description"] == "a few" and {t["name"]: t["row_count"] for t in made["tables"]} == {"swipe": 2, "badge": 1, "person": 3, "team": 2}
    assert cli.main([*base, "restore-in-order", dump, "--target-dsn", url("few")["url"], "--no-disable-triggers"], spark) == 0
    assert "8 rows in 4 tables" in capsys.readouterr().out
    assert cli.main([*base, "restore", dump, "--target-dsn", url("few")["url"], "--drop-schema"], spark) == 0
    assert cli.main([*base, "validate", "--dsn", dsn, "--check", "schema"], spark) == 0


def test_addresses():
    assert configs.options_of("jdbc:x:y") == {"url": "jdbc:x:y"}
    one = configs.options_of("postgres://me:p%40ss@db:5433/shop?sslmode=require")
    two = configs.options_of("host=db port=5433 user=me password='p@ss' dbname=shop sslmode=require")
    assert one == two and one["url"].startswith("jdbc:postgresql://db:5433/shop?sslmode=require") and (one["user"], one["password"]) == ("me", "p@ss")
    with pytest.raises(ValueError):
        configs.options_of("mysql://h/db")


def test_ddl_text(spark):
    df = spark.createDataFrame([(1, "a", None)], "id bigint not null, name string, at timestamp_ntz")
    text = stores.schema_text({"t": df, "s.u": df}, [ForeignKey("k", "s.u", ("id",), "t", ("id",))])
    assert stores.ddl(text) == [
        'CREATE TABLE "s"."u" ("id" bigint NOT NULL, "name" text, "at" timestamp without time zone)',
        'CREATE TABLE "public"."t" ("id" bigint NOT NULL, "name" text, "at" timestamp without time zone)',
        'ALTER TABLE "public"."t" ADD UNIQUE ("id")',
        'ALTER TABLE "s"."u" ADD CONSTRAINT "k" FOREIGN KEY ("id") REFERENCES "public"."t" ("id")',
    ]
    assert stores.schema_of(text)["t"] == df.schema
    assert table_ddl(lambda t: t, 'o"dd', stores.info_of(df.select(F.col("id").alias('a"b'))))[0].startswith('CREATE TABLE o"dd ("a""b" bigint')


def test_triggers_come_on_again(spark):
    target = jobs.DatabaseTarget(spark, {"url": "jdbc:postgresql://h/db"})
    said = []
    target.database.execute = said.extend
    with pytest.raises(RuntimeError), target.group(["a", "s.b"], True):
        raise RuntimeError
    assert said == ['ALTER TABLE "public"."a" DISABLE TRIGGER ALL', 'ALTER TABLE "s"."b" DISABLE TRIGGER ALL', 'ALTER TABLE "public"."a" ENABLE TRIGGER ALL', 'ALTER TABLE "s"."b" ENABLE TRIGGER ALL']
    said.clear()
    target.database.reset()
    assert said == ['DROP SCHEMA IF EXISTS "public" CASCADE', 'CREATE SCHEMA "public"']
