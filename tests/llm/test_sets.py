import random
from itertools import combinations

import pytest

from millrace.llm.sets import Overlap, set_links, similar_sets, similar_sets_between


def brute(sets, rule, least):
    big = {r: s for r, s in sets.items() if len(s) >= least}
    return sorted((a, b) for a, b in combinations(sorted(big), 2) if len(big[a] & big[b]) * rule.den >= rule.num * len(big[a] | big[b]))


def made(seed, n=120):
    """Sets of 1 to 60 values around shared cores, with copies."""
    rng, out = random.Random(seed), {}
    cores = [rng.sample(range(400), rng.choice([3, 4, 5, 7, 9, 12, 20, 45])) for _ in range(25)]
    for r in range(n):
        core = set(rng.choice(cores))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            core.symmetric_difference_update({rng.randrange(400)})
        out[r] = core or {1}
    return out


def long(spark, sets, extra=()):
    # token, size and class_no are names used inside
    rows = [(r, f"v{x}", "e", 0, 0, 0) for r, s in sets.items() for x in s] + list(extra)
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "repo long, name string, eco string, token int, size int, class_no int")


@pytest.mark.parametrize("rule, least, budget, giant", [(Overlap(7, 10), 4, 64, 50_000), (Overlap(7, 10), 1, 8, 50_000), (Overlap(1, 2), 2, 64, 50_000), (Overlap(9, 10), 3, 200, 50_000), (Overlap(1, 2), 2, 64, 30), (Overlap(1, 5), 2, 64, 5), (Overlap(1, 6), 2, 64, 40)])
def test_pairs_and_links_match_brute_force(spark, rows, rule, least, budget, giant):
    sets = made(least + budget)
    df = long(spark, sets, [(0, None, "e", 0, 0, 0), (None, "v1", "e", 0, 0, 0), (3, "v1", None, 0, 0, 0)] + [(5, f"v{x}", "e", 0, 0, 0) for x in sets[5]])
    want = brute(sets, rule, least)
    got = rows(similar_sets(df, "repo", ["eco", "name"], rule, least, budget, giant), "record_a", "record_b")
    assert sorted(got) == want and len(want) > 20
    links = {r["record"]: (r["class_id"], r["copies"], r["links"]) for r in set_links(df, "repo", ["eco", "name"], rule, least, budget, giant).collect()}
    assert set(links) == {r for r, s in sets.items() if len(s) >= least}
    for r, (class_id, copies, n) in links.items():
        assert n == sum(r in p for p in want)
        same = [x for x in sets if sets[x] == sets[r]]
        assert (class_id, copies) == (min(same), len(same))


def test_every_class_of_copies_is_spread_out(spark):
    df = long(spark, {r: {1, 2, 3, 4} for r in range(70)})
    assert similar_sets(df, "repo", ["eco", "name"], Overlap(7, 10), 4).distinct().count() == 70 * 69 // 2
    assert {tuple(r) for r in set_links(df, "repo", ["name"], Overlap(7, 10), 4).select("class_id", "copies", "links").collect()} == {(0, 70, 69)}


def test_between_two_tables(spark, rows):
    left, right = made(1, 40), made(1, 50)
    got = rows(similar_sets_between(long(spark, left), long(spark, right), "repo", ["name"], Overlap(7, 10), 2))
    want = sorted((a, b) for a in left for b in right if len(left[a]) > 1 and len(right[b]) > 1 and len(left[a] & right[b]) * 10 >= 7 * len(left[a] | right[b]))
    assert sorted(got) == want


def test_empty(spark):
    assert similar_sets(long(spark, {}), "repo", ["name"], Overlap(1, 2)).count() == 0
    assert set_links(long(spark, {}), "repo", ["name"], Overlap(1, 2)).count() == 0


def test_small_sets_meet_exactly_when_similar():
    for rule in (Overlap(7, 10), Overlap(1, 2)):
        x = rule.boundary(2, 64)
        for n in range(2, x + 1):
            for m in range(n, x + 1):
                for shared in range(n + 1):
                    alike = shared * rule.den >= rule.num * (n + m - shared)
                    assert alike == (m in rule.partners(n) and shared >= rule.needed(n, m))
