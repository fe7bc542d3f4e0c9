"""One key, record or group of copies with a third of all rows: results stay whole."""

from pyspark.sql import functions as F

from millrace.llm.clusters import alike_groups
from millrace.llm.frequency import value_frequencies
from millrace.llm.sets import Overlap, set_links, similar_sets
from millrace.llm.topn import top_n


def test_similar_sets_with_a_hot_value_a_hot_record_and_copies(spark):
    n = 6000
    # Every record has the hot value and four of its own; the last 40 repeat those of the first 40 but one.
    own = spark.range(n).selectExpr("id as r", "explode(sequence(0, 3)) as k").selectExpr("r", "concat('v', case when r >= 5960 and k < 3 then r - 5960 else r end, '-', k) as v")
    hot = spark.range(n).selectExpr("id as r", "'hot' as v")
    big = spark.range(12_000).selectExpr("cast(-1 as long) as r", "concat('b', id) as v")
    copies = spark.range(3000).selectExpr("id + 100000 as r", "explode(array('c1', 'c2', 'c3')) as v")
    rows = own.unionByName(hot).unionByName(big).unionByName(copies)
    links = set_links(rows, "r", ["v"], Overlap(2, 3), 3, giant=5000)
    got = {(r["class_id"], r["copies"], r["links"]): r["count"] for r in links.groupBy("class_id", "copies", "links").count().collect() if r["copies"] > 1 or r["links"]}
    assert got.pop((100000, 3000, 2999)) == 3000
    assert len(got) == 80 and set(got.values()) == {1} and {k[2] for k in got} == {1}
    pairs = similar_sets(rows.where("r < 100000"), "r", ["v"], Overlap(2, 3), 3, giant=5000)
    assert {(r["record_a"], r["record_b"]) for r in pairs.collect()} == {(i, 5960 + i) for i in range(40)}


def test_top_n_with_a_hot_group(spark):
    df = spark.range(200_000).selectExpr("case when id % 3 = 0 then 0 else id % 5000 + 1 end as g", "id as i", "cast(pmod(xxhash64(id), 100000) as double) as s", "cast(null as double) as t")
    got = {(r["g"], r["place"]): r["i"] for r in top_n(df, "g", "i", "s", "t", 3).collect()}
    want = df.toPandas().sort_values(["g", "s", "i"], ascending=[True, False, True]).groupby("g").head(3)
    want["place"] = want.groupby("g").cumcount() + 1
    assert got == {(r.g, r.place): r.i for r in want.itertuples()}


def test_frequencies_with_a_hot_value_and_a_hot_record(spark):
    df = spark.range(90_000).selectExpr("case when id % 3 = 0 then 7 else id end as rec", "case when id % 3 = 1 then 'hot' else concat('v', id % 999) end as v")
    got = {r["v"]: (r["occurrences"], r["records"]) for r in value_frequencies(df, "rec", ["v"]).collect()}
    want = {r["v"]: (r["n"], r["d"]) for r in df.groupBy("v").agg(F.count("*").alias("n"), F.count_distinct("rec").alias("d")).collect()}
    assert got == want


def test_groups_with_a_hot_member_and_copies(spark, rows):
    hot = spark.range(2000).selectExpr("id as rec", "explode(array(-1, 10 * id, 10 * id + 1, 10 * id + 2)) as m")
    copies = spark.range(3000).selectExpr("id + 10000 as rec", "explode(array(-1, -2, -3)) as m")
    got = alike_groups(hot.unionByName(copies), "rec", "m")
    assert rows(got.groupBy("group_key").count()) == [(10000, 3000)]
