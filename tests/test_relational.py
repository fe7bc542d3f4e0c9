import pytest
from pyspark.sql import functions as F

from millrace.checks import audit
from millrace.checks.rules import RULES, register, unregister
from millrace.operators import extract
from millrace.operators.relational import numbered, running_sum, within_budget
from millrace.session import counted
from millrace.sources import sinks


def test_running_sum_of_a_hot_group_and_null_groups(spark):
    df = spark.range(30_000).selectExpr("case when id % 3 = 0 then 7 when id % 1000 = 1 then null else id % 500 end as g", "id", "id % 11 as v")
    got = {r["id"]: (r["g"], r["s"]) for r in running_sum(df, ["g"], [F.desc("v"), F.asc("id")], F.col("v"), "s").collect()}
    p = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    p["s"] = p.groupby("g", dropna=False)["v"].cumsum()
    assert len(got) == 30_000 and all(got[r.id][1] == r.s for r in p.itertuples())


def test_numbered_and_budget(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 3, 9), (None, 4, 2)], "g string, id long, n long")
    assert rows(numbered(df, ["g"], [F.asc("n")]), "id", "place") == [(1, 2), (2, 1), (3, 1), (4, 1)]
    assert rows(within_budget(df, ["g"], [F.asc("n")], "n", 8), "id") == [(1,), (2,), (4,)]
    assert numbered(df.limit(0), ["g"], [F.asc("n")]).count() == 0


def test_counted(spark):
    df, n = counted(spark.range(10).where("id > 3"), "x")
    assert n == 6 == df.count()


def test_a_registered_check_runs_and_ids_are_taken_once(spark):
    @register("no-print", "low", 0.5, "cleanliness", 1, on="file")
    def fires():
        return F.col("bare").contains("print(")

    try:
        with pytest.raises(ValueError):
            register("no-print", "low", 0.5, "cleanliness", 1)
        files = spark.createDataFrame([(1, "a.py", "print(1)"), (2, "a.py", "# print(1)")], "repo_id long, path string, text string")
        tree = spark.createDataFrame([(1, "a.py", 1), (2, "a.py", 1)], "repo_id long, path string, size long")
        assert [r["repo_id"] for r in audit.findings(tree, files).where("check_id = 'no-print'").collect()] == [1]
    finally:
        unregister("no-print")
    assert len(RULES) == 62


def test_readers_keep_the_table_they_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.committed(spark, path)
    sinks.commit(spark.range(3), path)
    old = sinks.committed(spark, path)
    sinks.commit(spark.range(5), path)
    assert old.count() == 3 and sinks.committed(spark, path).count() == 5
    sinks.commit_parts(spark, path, {})
    assert sinks.committed(spark, path).count() == 5


def test_forks_may_keep_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (1, "b", None, 6), (2, "c", 9, 1)], "id long, name string, parent_id long, stars long")
    assert extract.originals_and_forks(df, 1).count() == 2 and extract.originals_and_forks(df, 1, distinct=False).count() == 3
