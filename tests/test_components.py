import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators.components import connected_components
from millrace.operators.skew import lookup_join, self_pairs
from pyspark.sql import functions as F


def naive(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(root))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=40))
def test_components_match_union_find(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == naive(edges)


def test_long_chain_loops_nulls_and_empty(spark):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(chain)
    df = spark.createDataFrame([*chain, (5, 5), (None, 3), (500, 500)], "src long, dst long")
    got = connected_components(df).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_self_pairs_with_a_heavy_key(spark):
    rows = [("hot", i) for i in range(60)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = self_pairs(df, ["k"], "id", F.lit(True), total=63, block=7).select("a.k", F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y")).collect()
    assert len(got) == len({tuple(r) for r in got}) == 60 * 59 // 2 + 3


def test_lookup_join_keeps_every_row(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [("none", 1)]
    df = spark.createDataFrame(rows, "k string, id int")
    dim = df.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_join(df, dim, ["k"], "n", df.count())
    assert got.count() == 3050 and got.where("k = 'hot' and n = 3000").count() == 3000


def test_dealt_join_of_a_hot_key_is_a_join(spark):
    from millrace.operators.skew import dealt_join

    many = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 1 else id end as k")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9999, "d")], "k long, v string")
    got = sorted(tuple(r) for r in dealt_join(many, few, ["k"], "id", 100).select("id", "v").collect())
    assert got == sorted(tuple(r) for r in many.join(few, "k").select("id", "v").collect()) and len(got) > 2000
