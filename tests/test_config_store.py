import json

import pytest

from veilspark import cli
from veilspark.catalog_queries import KEYS, STAR, source
from veilspark.operators import jobs, validate
from veilspark.sources import config as configs
from veilspark.sources.catalog import driver, drivers
from veilspark.sources.store import Store

FULL = """
storage_dir: /tmp/d
parallelism: 8
connection: {host: h, port: 5433, user: u, password: secret, dbname: db, sslmode: require}
exclude_tables: [migrations]
tables:
  users: {columns: {email: mask-email, name: mask-name}}
  logs: {exclude: true}
subset: {tables: {users: {where: id < 3}}, resolve_parents: true}
"""


def test_load(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(FULL)
    c = configs.load(str(path))
    assert c.connection.dsn() == "host=h port=5433 user=u dbname=db sslmode=require password=secret"
    assert [c.includes("public", t) for t in ("users", "logs", "migrations")] == [True, False, False]
    assert c.rules("public", "users") == {"email": "mask-email", "name": "mask-name"}
    assert (c.subset.seeds, c.subset.max_depth, c.subset.resolve_parents, c.subset.resolve_children) == ({"users": "id < 3"}, 10, True, False)
    assert "secret" not in c.snapshot()


def test_defaults_and_lists():
    c = configs.from_dict({"connection": {"host": "h", "dbname": "d"}}).with_defaults()
    assert (c.parallelism, c.storage_dir, c.connection.dsn()) == (4, "./dumps", "host=h port=5432 user= dbname=d sslmode=disable")
    c = configs.from_dict({"include_tables": ["users", "orders"], "exclude_tables": ["orders"]})
    assert [c.includes("", t) for t in ("users", "orders", "logs")] == [True, False, False]
    c = configs.from_dict({"tables": {"users": {"columns": {"a": "redact"}}, "x.users": {"columns": {"b": "redact"}}}})
    assert c.rules("x", "users") == {"b": "redact"} and c.rules("y", "users") == {"a": "redact"}


def test_init_refuses_to_overwrite(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert cli.main(["init", path]) == 0
    assert configs.load(path).tables["patients"].columns["contact"] == "mask-email"
    with pytest.raises(FileExistsError):
        configs.init(path)


def test_drivers():
    assert drivers() == ["frames", "jdbc", "parquet"]
    with pytest.raises(ValueError):
        driver("oracle")


def test_dump_subset_restore_and_cli(spark, sf_dir, tmp_path, capsys):
    conf = {"storage_dir": f"file://{tmp_path}/dumps", "parallelism": 2, "include_tables": ["region", "nation", "customer"], "connection": {"dbname": "tpch"}, "tables": {"customer": {"columns": {"c_name": "mask-name"}}}, "subset": {"tables": {"customer": {"where": "c_custkey < 5"}}, "resolve_parents": True}}
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps(conf))
    keys = [x for k in KEYS[:2] for x in ("--foreign-key", f"{k.from_table}({k.from_columns[0]})={k.to_table}({k.to_columns[0]})")]
    base = ["--config", str(path), "--parquet", sf_dir, *keys]
    assert cli.main([*base, "dump", "--tag", "x"], spark) == 0
    dump = capsys.readouterr().out.strip().splitlines()[-1]
    assert cli.main([*base, "subset"], spark) == 0
    part = capsys.readouterr().out.strip().splitlines()[-1]
    store = Store(spark, conf["storage_dir"])
    assert {r["id"] for r in store.dumps().collect()} == {dump, part}
    assert {t["name"] for t in store.manifest(part)["tables"]} == {"customer", "nation", "region"}
    assert cli.main([*base, "restore", dump, "--target", f"file://{tmp_path}/a"], spark) == 0
    assert cli.main([*base, "restore-in-order", part, "--target", f"file://{tmp_path}/b"], spark) == 0
    assert "orphans" not in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/a/customer.parquet").count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert cli.main([*base, "show-dump", dump, "--columns", "--show-config"], spark) == 0
    assert "mask-name" in capsys.readouterr().out
    assert cli.main([*base, "list-dumps"], spark) == 0
    assert cli.main([*base, "validate", "--check", "schema", "--check", "types", "--check", "diff", "--dump", dump], spark) == 0
    assert "row 1" in capsys.readouterr().out
    assert cli.main([*base, "delete", part], spark) == 0
    with pytest.raises(FileNotFoundError):
        store.delete(part)
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            store.delete(bad)


def test_failed_table_keeps_the_others(spark, sf_dir, tmp_path):
    config = configs.from_dict({"include_tables": ["region", "nation"], "tables": {"region": {"columns": {"r_regionkey": "redact"}}}})
    store = Store(spark, f"file://{tmp_path}/dumps")
    with pytest.raises(jobs.PartlyFailed) as e:
        jobs.dump(spark, source(spark, sf_dir, STAR), config, store)
    assert set(e.value.errors) == {"region"}
    assert [t["name"] for t in store.manifest(e.value.result)["tables"]] == ["nation"]


def test_validator_without_source(spark):
    v = validate.Validator(spark, configs.from_dict({}))
    found = v.run(["schema", "types", "diff", "nonsense"]).collect()
    assert [(r["severity"], r["category"]) for r in found] == [("ERROR", "schema"), ("ERROR", "type"), ("ERROR", "diff")]
    assert validate.render(found[0]) == "[ERROR] schema: there is no source to look at"
    assert {r["message"] for r in v.run(["config"]).collect()} >= {"the connection names no host", "no storage_dir is given: ./dumps is used"}


def test_commands_without_session(capsys):
    assert cli.main(["list-transformers"]) == 0 and cli.main(["show-transformer", "redact"]) == 0
    assert "mask-email" in capsys.readouterr().out
