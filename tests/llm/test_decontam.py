import random

import brute
from veilspark.llm import decontam, queries


def result(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_window_lookup(spark, sf_dir):
    pairs = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()]
    expected = brute.decontamination(pairs("documents", "doc_id"), pairs("benchmark", "item_id"))
    assert result(queries.op10_decontamination(spark, sf_dir)) == expected
    assert any(v[4] for v in expected.values())


def test_random_texts_short_items_and_shards(spark):
    rng = random.Random(3)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice("abcdé").upper() if rng.random() < 0.2 else rng.choice("abcdé") for _ in range(n))
    items = [(i, text(rng.randrange(0, 30))) for i in range(40)] + [(3, "a b a"), (77, "q r"), (78, None), (79, "!!")]
    rows = [(i, text(rng.randrange(0, 120)) + rng.choice(["", " q r zz a b"])) for i in range(120)] + [(900, None), (901, ""), (902, "zz " * 20000 + "q R")]
    docs = spark.createDataFrame([(*r, b"x", "c") for r in rows], "doc_id long, text string, decon_mask binary, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.decontamination(rows, items, window=6)
    assert result(decontam.report(docs, bench, window=6)) == expected
    assert result(decontam.report(docs, bench, window=6, shard_bytes=150)) == expected
    clean = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, window=6).collect()}
    assert set(clean) == {i for i, v in expected.items() if not v[4]}
    assert all(clean[i] == t for i, t in rows if expected[i][1] == 0)
    assert decontam.decontaminate(docs, bench, window=6).columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, window=6, shard_bytes=400).collect()} == clean


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.report(docs, bench).collect()] == [(1, 2, 0, 0)]
    assert decontam.report(docs.limit(0), bench).count() == 0


def test_spans_are_cut_out():
    import numpy as np

    bits = np.packbits(np.array([0, 1, 1, 0, 0, 1], bool)).tobytes()
    assert decontam.without_spans("a, b c. d e f!", bits) == "a, d e "
