import hashlib

import pytest
from pyspark.sql import functions as F

from veilspark.functions import masks
from veilspark.operators.mask import bind, check_masks, mask


def one(spark, name, value):
    return mask(spark.createDataFrame([(value,)], "x string"), {"x": name}).first()[0]


@pytest.mark.parametrize(
    "name, value, expected",
    [
        ("hash-sha256", "hello", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"),
        ("mask-email", "alice@company.com", "2bd806c9@company.com"),
        ("mask-email", "bob.smith@gmail.com", "365b77fb@gmail.com"),
        ("mask-email", "@x", "e3b0c442@x"),
        ("mask-email", "", "masked@example.com"),
        ("mask-email", "a@b@c", hashlib.sha256(b"a").hexdigest()[:8] + "@b@c"),
        ("mask-name", "Alice Johnson", "Emma Taylor"),
        ("mask-name", "Bob Smith", "Isabella Johnson"),
        ("mask-name", "Alice Wonderland", "Robert Davis"),
        ("redact", "sensitive data", "***REDACTED***"),
        ("preserve", "keep me", "keep me"),
    ],
)
def test_golden(spark, name, value, expected):
    assert one(spark, name, value) == expected


def test_nulls_stay(spark):
    assert all(one(spark, name, None) is None for name in masks.names() if name in ("preserve", "redact", "hash-sha256", "mask-email", "mask-name", "random-int"))


def test_mixed_row(spark):
    df = spark.createDataFrame([(1, "alice@example.com", "Alice", 30)], "id int, email string, name string, age int")
    out = mask(df, {"email": "mask-email", "name": "redact", "nowhere": "redact"}).first()
    assert (out["id"], out["age"], out["name"]) == (1, 30, "***REDACTED***")
    assert out["email"].endswith("@example.com") and out["email"] != "alice@example.com"
    assert mask(df, {}).schema == df.schema


def test_unknown_mask(spark):
    with pytest.raises(ValueError, match="nonexistent"):
        bind(["id"], {"id": "nonexistent"})
    with pytest.raises(ValueError, match="table t, column c"):
        check_masks({"t": {"c": "nonexistent"}})


def test_type_errors_only_on_values(spark):
    df = spark.createDataFrame([(1, 42)], "id int, count int")
    with pytest.raises(Exception, match="encode error"):
        mask(df, {"count": "redact"}).collect()
    nulls = spark.createDataFrame([(1, None)], "id int, count int")
    assert mask(nulls, {"count": "redact"}).first()["count"] is None
    drawn = mask(df, {"count": "random-int"}).first()
    assert drawn["id"] == 1 and 0 <= drawn["count"] < 1_000_000


def test_decode_errors(spark):
    df = spark.createDataFrame([("x1",)], "n string")
    with pytest.raises(Exception, match="decode error"):
        mask(df, {"n": "preserve"}, {"n": "integer"}).collect()


def test_registry(spark):
    assert {"hash-sha256", "mask-email", "mask-name", "preserve", "random-int", "redact"} <= set(masks.names())
    masks.register(masks.Mask("reverse", F.reverse, "", "", ("text",)))
    assert one(spark, "reverse", "abc") == "cba"
    assert [r["name"] for r in masks.catalog(spark).collect()] == masks.names()
    assert "Examples" in masks.show("mask-email")
    masks._registry.pop("reverse")


def test_stream(spark, tmp_path):
    from veilspark.streaming.masking import mask_stream, write_masked

    spark.createDataFrame([("a@b",), (None,)], "e string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("e string").parquet(f"{tmp_path}/in")
    write_masked(stream, {"e": "mask-email"}, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {r["e"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"ca978112@b", None}
    with pytest.raises(ValueError):
        mask_stream(spark.range(1), {})


def test_preview_shows_old_and_new_of_one_reading(spark):
    """The rows of this frame differ each time that they are read."""
    import hashlib

    from pyspark.sql import functions as F

    from veilspark.operators import validate

    df = spark.range(40).select(F.uuid().substr(1, 20).alias("x"), F.when(F.rand() < 0.5, "same").alias("y"))
    found = validate.preview(df, "t", {"x": "hash-sha256", "y": "preserve"}, rows=30).collect()
    assert len(found) == 30 and {r["column"] for r in found} == {"x"}
    for r in found:
        old, new = r["message"].partition(": ")[2].removesuffix(" by hash-sha256").split(" becomes ")
        assert new == hashlib.sha256(old.encode()).hexdigest()[:27] + "..."
    drawn = validate.preview(spark.range(5).withColumnRenamed("id", "n"), "t", {"n": "random-int"}).collect()
    assert 4 <= len(drawn) <= 5
