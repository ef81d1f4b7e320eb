import random
import time

import brute
from veilspark.llm import minhash, queries
from veilspark.llm.components import components


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    out = queries.op7_minhash(spark, sf_dir)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(out) == brute.near_duplicates(rows)


def test_large_cluster_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(240)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(240)] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(30)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8)
    assert result(out) == brute.near_duplicates(rows)


def test_clusters_of_many_kinds(spark):
    """Larger than a block: several centres, chains that no centre joins, texts under one id, all against all pairs."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(150)]
        words = list(base)
        for i in range(35):
            if family % 2:  # a chain: each differs a little from the one before
                words[(i * 4) % 150] = f"c{family}x{i}"
                own = list(words)
            else:
                own = list(base)
                for _ in range(rng.randrange(5)):
                    own[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(own)))
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.near_duplicates(rows)
    for central in (0, 8):
        assert result(minhash.near_duplicates(df, block=6, central=central)) == expected
    two = [(1, rows[0][1]), (1, rows[40][1])]
    linked = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([(i + 10, t) for i, t in rows] + two, "doc_id long, text string"), block=6).collect()}
    merged = {i for i, (_, c) in expected.items() if c in (expected[rows[0][0]][1], expected[rows[40][0]][1])}
    assert {i - 10 for i, c in linked.items() if c == 1 and i > 1} == merged


def test_a_cluster_of_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{n}" for n in range(100)]
    rows = [(7_000, " ".join(base))]
    for i in range(20_000):
        words = list(base)
        words[rng.randrange(100)] = f"x{i}"
        rows.append((10_000 + i, " ".join(words)))
    began = time.time()
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {r["component_id"] for r in out.select("component_id").distinct().collect()} == {7_000}
    assert time.time() - began < 150


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "a b"), (9, "A  b"), (10, "a b c"), (11, "Ä x"), (12, "ä x"), (None, "a b"), (13, "long " * 30000), (14, "long " * 30001), (8, "a b")]
    df = spark.createDataFrame([(*r, "z", i) for i, r in enumerate(rows)], "doc_id long, text string, node string, component long")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (8, 1, 8, True), (9, 1, 8, False), (10, 1, 10, True), (11, 1, 11, True), (12, 1, 12, True), (-1, 1, None, True), (13, 1, 13, True), (14, 1, 13, False)], key=lambda r: (r[0], r[1]))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {1}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (5, 6), (6, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert got == {i: root(i) for i in linked}
