from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators.orphans import Reference, orphan_references, orphan_report


def at(text):
    return datetime.fromisoformat(text) if text else None


def reference(spark, refs, parents, name="t"):
    # ref_table, there and seen clash with names used inside
    r = spark.createDataFrame([(k, at(s), "x", 1) for k, s in refs], "k string, seen timestamp, ref_table string, there int")
    p = spark.createDataFrame([(k, at(a), at(g), 0) for k, a, g in parents], "k string, there timestamp, gone timestamp, n int")
    return Reference(name, r, F.col("k"), F.col("seen"), p, F.col("k"), F.col("there"), F.col("gone"))


PARENTS = [("a", "2024-02-01", None), ("a", "2024-01-10", "2024-06-15"), ("b", None, None), (None, "2024-01-01", None), ("c", "2024-05-01", "2024-04-01")]


@pytest.mark.parametrize(
    "refs, want",
    [
        ([("a", "2024-01-09"), ("a", "2024-01-10")], [("2024-01", "a", "late")]),
        ([("a", "2024-06-15"), ("a", "2024-06-14")], [("2024-06", "a", "deleted")]),
        ([("a", "2024-06-14"), ("b", "1999-01-01"), (None, "2024-01-01")], []),
        ([("x", "2024-01-01"), ("x", None), ("", "2024-01-01")], [("2024-01", "", "missing"), ("2024-01", "x", "missing"), ("unknown", "x", "missing")]),
        ([("a", None)], []),
        # gone before there: late before it, deleted after it
        ([("c", "2024-04-20"), ("c", "2024-05-20")], [("2024-04", "c", "late"), ("2024-05", "c", "deleted")]),
    ],
)
def test_reasons(spark, rows, refs, want):
    got = orphan_references([reference(spark, refs, PARENTS)])
    assert rows(got, "period", "ref_key", "reason") == want


def test_counts_repeated_rows_once_per_key(spark, rows):
    got = orphan_references([reference(spark, [("x", "2024-01-05")] * 3 + [("y", "2024-01-06")], PARENTS)])
    assert rows(orphan_report(got)) == [("t", "2024-01", "missing", 2, 4)]


def test_empty_tables(spark, rows):
    assert rows(orphan_references([reference(spark, [], PARENTS)])) == []
    assert rows(orphan_references([reference(spark, [("a", "2024-01-01")], [])]), "reason") == [("missing",)]


def test_tables_do_not_mix(spark, rows):
    got = orphan_references([reference(spark, [("a", "2024-03-01")], PARENTS, "one"), reference(spark, [("a", "2024-03-01")], [], "two")])
    assert rows(got, "ref_table", "reason") == [("two", "missing")]


@pytest.mark.parametrize(
    "eco, name, want",
    [
        (" PyPI ", "\tA_b..C ", ("pypi", "a-b-c")), ("crates.io", "X__y", ("cargo", "x-y")), ("Go", " Mod/Hivi\n", ("go", "Mod/Hivi")),
        ("NPM", "@A/B_c", ("npm", "@a/b_c")), (None, "x", (None, "x")), ("npm", None, ("npm", None)), ("npm", "  ", ("npm", "")),
    ],
)
def test_spelling(spark, eco, name, want):
    e = keys.ecosystem(F.col("e"))
    row = spark.createDataFrame([(eco, name)], "e string, n string").select(e.alias("e2"), keys.package(e, F.col("n")).alias("n2")).first()
    assert tuple(row) == want
