import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import copytext, pgtypes


@pytest.mark.parametrize("name, codec", [("integer", "int"), ("BIGINT ", "int"), ("numeric(10,2)", "float"), ("timestamp(3) without time zone", "timestamp"), ("timestamptz", "timestamp"), ("jsonb", "json"), ("character varying(255)", "text"), ("text[]", "text"), ("daterange", "text"), ("bytea", "bytea"), ("boolean", "bool")])
def test_family(name, codec):
    assert pgtypes.family(name) == codec


def test_decode(spark):
    row = spark.createDataFrame([("42", "t", "2024-01-15 10:30:00", "3.14", "\\x4142")], "i string, b string, ts string, f string, y string").select(*(pgtypes.decode(F.col(c), k).alias(c) for c, k in (("i", "int"), ("b", "bool"), ("ts", "timestamp"), ("f", "float"), ("y", "bytea")))).first()
    assert (row["i"], row["b"], str(row["ts"]), row["f"], bytes(row["y"])) == (42, True, "2024-01-15 10:30:00", 3.14, b"AB")


def test_encode_floats(spark):
    df = spark.createDataFrame([(1e7,), (0.5,), (3.0,), (-2.25e-5,), (None,)], "x double")
    assert [r[0] for r in df.select(pgtypes.encode(F.col("x"), df.schema["x"].dataType)).collect()] == ["10000000", "0.5", "3", "-0.0000225", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(st.characters(blacklist_characters="\0", blacklist_categories=("Cs",)))), st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.booleans())), min_size=1, max_size=12))
def test_copy_text_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "s string, n long, b boolean")
    back = copytext.parse(df.select(copytext.line(df).alias("value")), df.schema)
    assert [tuple(r) for r in back.collect()] == rows
