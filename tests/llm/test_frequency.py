import random
from collections import Counter, defaultdict

from millrace.llm import frequency
from millrace.llm.frequency import dictionary, value_frequencies


def made(seed, n=5000):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(50)]), rng.choice(["a", "b", None]), rng.choice([None, "", "hot", "hot", f"t{rng.randrange(900)}"]), 1, 2) for _ in range(n)]


def test_matches_counter(spark, monkeypatch):
    monkeypatch.setattr(frequency, "RANGE", 4096)
    data = made(1)
    df = spark.createDataFrame(data, "rec long, eco string, name string, n int, term_no int")
    usable = [(r, (e, v)) for r, e, v, *_ in data if r is not None and e is not None and v is not None]
    occ, rec = Counter(v for _, v in usable), defaultdict(set)
    for r, v in usable:
        rec[v].add(r)
    total = len({r for r, _ in usable})
    for held in (512, 1):
        got = {(r["eco"], r["name"]): (r["occurrences"], r["records"], r["mark"]) for r in value_frequencies(df, "rec", ["eco", "name"], 3, 0.2, held).collect()}
        want = {v: (occ[v], len(rec[v]), "rare" if len(rec[v]) < 3 else "common" if len(rec[v]) > 0.2 * total else None) for v in occ}
        assert got == want


def test_dictionary_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(f"w{i:04d}", 1) for i in random.Random(2).sample(range(5000), 3000)], "v string, pairs long")
    got = sorted((r["term_no"], r["v"]) for r in dictionary(df, ["v"]).collect())
    assert [n for n, _ in got] == list(range(3000)) and [v for _, v in got] == sorted(v for _, v in got)


def test_empty(spark):
    assert value_frequencies(spark.createDataFrame([], "rec long, v string"), "rec", ["v"]).count() == 0
    assert value_frequencies(spark.createDataFrame([(None, "a"), (1, None)], "rec long, v string"), "rec", ["v"]).count() == 0
