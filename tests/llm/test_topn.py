import math
import random

import pytest

from millrace.llm.topn import skipping, top_n


def brute(rows, n):
    best = {}
    for g, i, s, t in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        t = None if t is None or math.isnan(t) else t
        k = (s, -math.inf if t is None else t, t is not None)
        if (g, i) not in best or k > best[g, i]:
            best[g, i] = k
    out = []
    for g in {g for g, _ in best}:
        mine = sorted(((-s, t is False, -r, i) for (gg, i), (s, r, t) in best.items() if gg == g), key=lambda x: x)
        out += [(g, p, x[3]) for p, x in enumerate(mine[:n], 1)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, math.nan, *[round(rng.random(), 2) for _ in range(20)]])
    return [(rng.choice([1, 1, 1, rng.randrange(60), None]), rng.choice([None, *range(40)]), pick(), pick()) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 5])
def test_matches_brute_force_with_ties_nulls_nan_and_repeats(spark, n):
    rows = made(n, 3000)
    rows += rows[:200]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "id long, nb long, sim double, sc double, g string, item int")
    got = sorted((r["id"], r["place"], r["nb"]) for r in top_n(df, "id", "nb", "sim", "sc", n).collect())
    assert got == brute(rows, n)


def test_text_groups_and_no_second(spark, rows):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 2.0), ("b", "x", -0.0), ("b", "w", 0.0)], "k string, v string, s double")
    assert rows(top_n(df, "k", "v", "s", n=2), "k", "place", "v") == [("a", 1, "y"), ("a", 2, "z"), ("b", 1, "w"), ("b", 2, "x")]


def test_empty_and_only_unusable(spark):
    kind = "id long, nb long, sim double, sc double"
    assert top_n(spark.createDataFrame([], kind), "id", "nb", "sim", "sc").count() == 0
    assert top_n(spark.createDataFrame([(1, 2, None, 1.0), (1, 2, math.nan, 1.0)], kind), "id", "nb", "sim", "sc").count() == 0


def test_a_huge_group_is_mostly_left_unread(spark):
    df = spark.range(400_000).selectExpr("cast(1 as long) as id", "id as nb", "cast(pmod(xxhash64(id), 1000003) as double) as sim", "cast(0 as double) as sc")
    r = skipping(df, "id", "nb", "sim", "sc").groupBy().sum("row_groups", "skipped").first()
    assert r[0] > 10 and r[1] > 0.6 * r[0]
