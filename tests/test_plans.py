import random

import pytest

from veilspark.plans import subset as subsets
from veilspark.plans.graph import Cyclic, Graph
from veilspark.sources.catalog import ForeignKey, FrameSource


def test_layers():
    assert Graph(edges=[("orders", "users"), ("orders", "products")]).layers() == [["products", "users"], ["orders"]]
    assert Graph(["solo"]).layers() == [["solo"]]
    with pytest.raises(Cyclic):
        Graph(edges=[("a", "b"), ("b", "c"), ("c", "a")]).layers()
    with pytest.raises(Cyclic) as e:
        Graph(["x"], [("a", "a")]).layers()
    assert e.value.layers == [["x"]]


def test_cycles_and_neighbours():
    g = Graph(edges=[("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    assert g.cycles() == [["a", "b", "c"]]
    assert Graph(edges=[("a", "b"), ("b", "c")]).cycles() == []
    assert (g.parents_of("d"), g.children_of("a")) == (["a"], ["c", "d"])


def test_restore_layers_on_random_graphs():
    rng = random.Random(1)
    for _ in range(50):
        edges = [(str(rng.randrange(8)), str(rng.randrange(8))) for _ in range(rng.randrange(14))]
        g = Graph(map(str, range(8)), edges)
        place = {n: (i, j) for i, layer in enumerate(g.restore_layers()) for j, group in enumerate(layer) for n in group}
        assert set(place) == set(map(str, range(8)))
        assert all(place[a][0] > place[b][0] or place[a] == place[b] for a, b in edges)


def family(spark, rows, depth=40, **options):
    df = spark.createDataFrame(rows, "id long, boss long")
    key = ForeignKey("boss", "staff", ("boss",), "staff", ("id",))
    return lambda where, **more: {r["id"] for r in subsets.subset(FrameSource(spark, {"staff": df}, [key]), {"staff": where}, **{"max_depth": depth, **options, **more})["staff"].collect()}


def test_self_reference_and_depth(spark):
    up = family(spark, [(i, i // 2) for i in range(1, 40)], parents=True)
    assert up("id = 37") == {37, 18, 9, 4, 2, 1}
    assert up("id = 37", max_depth=2) == {37, 18, 9}
    assert up("id = 99") == set()


def test_ring_of_tables_with_nulls(spark):
    a = spark.createDataFrame([(1, 10), (2, None), (3, 30), (4, 40)], "id long, b long")
    b = spark.createDataFrame([(10, 3), (30, 2), (40, None)], "id long, a long")
    source = FrameSource(spark, {"a": a, "b": b}, [ForeignKey("ab", "a", ("b",), "b", ("id",)), ForeignKey("ba", "b", ("a",), "a", ("id",))])
    got = subsets.subset(source, {"a": "id = 1"}, parents=True)
    assert ({r[0] for r in got["a"].collect()}, {r[0] for r in got["b"].collect()}) == ({1, 2, 3}, {10, 30})
    assert subsets.plan(source, {"a": "true"}, parents=True).cycles == (("a", "b"),)


def test_both_strategies_agree_and_closure_is_whole(spark, sf_dir):
    from veilspark.catalog_queries import STAR, source
    from veilspark.operators.jobs import orphans

    s = source(spark, sf_dir, STAR)
    plan = subsets.plan(s, {"lineitem": "l_orderkey < 40", "customer": "c_custkey = 3"}, parents=True)
    seeds = {t: s.query(t, w).distinct() for t, w in plan.seeds.items()}
    one, two = subsets._in_order(s, plan, seeds), subsets._in_rounds(s, plan, seeds)
    assert set(one) == set(two)
    for t in one:
        assert sorted(map(tuple, one[t].collect())) == sorted(map(tuple, two[t].collect()))
    assert all(orphans(two[k.from_table], two[k.to_table], k).isEmpty() for k in plan.keys if k.from_table in two)


def test_plan_checks(spark):
    df = spark.createDataFrame([(1,)], "id long")
    source = FrameSource(spark, {"t": df}, [ForeignKey("bad", "t", ("missing",), "t", ("id",))])
    assert subsets.plan(source, {"t": "true"}, parents=True).skipped == ("bad",)
    with pytest.raises(ValueError):
        subsets.plan(source, {"nope": "true"})
