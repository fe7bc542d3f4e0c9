import math
import random
from collections import Counter

import pytest

from millrace.operators import graph, vectors


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [], "src long, dst long")


def naive_closure(pairs, start):
    depth, front, d = {}, {start}, 0
    while front and d < 20:
        d += 1
        front = {a for a, b in pairs if b in front} - set(depth)
        depth.update({x: d for x in front})
    return depth


def naive_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return {x: min(s) for x in nodes if len(s := {y for y in reach[x] if x in reach[y]}) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_scc_match_naive(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)]
    df = edges(spark, pairs)
    starts = spark.createDataFrame([(1,), (7,)], "node long")
    got = {(r["start"], r["node"]): r["depth"] for r in graph.reverse_closure(df, starts).collect()}
    assert got == {(s, n): d for s in (1, 7) for n, d in naive_closure(pairs, s).items()}
    want = naive_scc([p for p in pairs if p[0] != p[1]])
    for bound in (10**6, 0):  # in one task, and in distributed rounds
        if bound or seed == 0:
            assert {r["node"]: r["scc"] for r in graph.strong_components(df, bound=bound).collect()} == want


def test_strong_components_out_of_rounds_raise(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], "u long, v long")
    with pytest.raises(RuntimeError, match="settle"):
        graph._scc_rounds(df, rounds=1)


def test_a_start_on_a_cycle_comes_back_at_its_length(spark):
    got = graph.reverse_closure(edges(spark, [(1, 2), (2, 3), (3, 1)]), spark.createDataFrame([(1,)], "node long"))
    assert {(r["node"], r["depth"]) for r in got.collect()} == {(3, 1), (2, 2), (1, 3)}
    assert graph.reverse_closure(edges(spark, []), spark.createDataFrame([(1,)], "node long")).count() == 0


BARBELL = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9), (4, 5, 0.9), (5, 6, 0.9), (4, 6, 0.9), (3, 4, 0.7), (6, 9, 0.4)]


def test_communities_part_a_barbell_and_refine_components(spark):
    df = spark.createDataFrame(BARBELL, "src long, dst long, sim double")
    got = {r["node"]: r["community"] for r in graph.communities(df, "src", "dst", "sim", 0.68).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    rounds = {r["node"]: r["community"] for r in graph.communities(df, "src", "dst", "sim", 0.68, bound=1).collect()}
    assert rounds == got


def test_communities_are_the_same_in_one_task_and_in_rounds(spark, rows):
    rnd = random.Random(4)
    other = {tuple(sorted(rnd.sample(range(10, 34), 2))) for _ in range(45)}
    df = spark.createDataFrame(BARBELL + [(a, b, rnd.randrange(70, 100) / 100) for a, b in sorted(other)], "src long, dst long, sim double")
    want = rows(graph.communities(df, "src", "dst", "sim", 0.68))
    assert rows(graph.communities(df, "src", "dst", "sim", 0.68, bound=0)) == want


def test_labels(spark):
    df = edges(spark, [(a, b) for a, b, _ in BARBELL[:6]])
    for bound in (10**6, 0):
        got = {r["node"]: r["label"] for r in graph.label_propagation(df, bound=bound).collect()}
        assert len({got[1], got[2], got[3]}) == 1 and len({got[4], got[5], got[6]}) == 1 and got[1] != got[4]


@pytest.mark.parametrize("seed", range(2))
def test_labels_are_the_same_in_one_task_and_in_rounds(spark, rows, seed):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)} | {(100, 201), (100, 202), (101, 201), (101, 202), (300, 301), (301, 302), (302, 303)}
    df = edges(spark, sorted(pairs))
    assert rows(graph.label_propagation(df, bound=0)) == rows(graph.label_propagation(df))


def test_small_shapes(spark, rows):
    df = edges(spark, [(1, 2), (1, 2), (2, 2), (3, 2)])
    assert rows(graph.degrees(df)) == [(1, 0, 1), (2, 2, 0), (3, 0, 1)]
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert rows(graph.within(df, nodes, "id").distinct()) == [(1, 2), (2, 2)]
    assert rows(graph.roots(nodes, df, "id")) == [(1,)]
    paths = spark.createDataFrame([(1, "a/b/c.py"), (1, "a/d.py")], "repo long, path string")
    assert rows(graph.path_edges(paths, "path", "repo")) == [(1, "", "a", False), (1, "a", "a/b", False), (1, "a", "a/d.py", True), (1, "a/b", "a/b/c.py", True)]
    imports = spark.createDataFrame([(1, "a.py", ["b.py", "b/__init__.py"]), (1, "b.py", ["a.py"]), (1, "b.py", ["b.py"]), (1, "a.py", ["numpy.py"])], "repo_id long, src string, candidates array<string>")
    files = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (1, "b/__init__.py")], "repo_id long, path string")
    assert rows(graph.import_edges(imports, files)) == [(1, "a.py", "b.py"), (1, "b.py", "a.py")]


@pytest.fixture(scope="module")
def program(spark):
    symbols = [(1, n, k, f, i) for i, (n, k, f) in enumerate([("main", "function", "cli.py"), ("load", "function", "io.py"), ("save", "function", "io.py"), ("fetch", "function", "net.py"), ("App", "class", "app.py"), ("helper", "function", "util.py"), ("run", "function", "util.py"), ("constructor", "function", "app.py"), ("idle", "function", "server.py")])]
    calls = [(1, "main", "load", 3), (1, "main", "helper", 1), (1, "load", "fetch", 1), (1, "helper", "save", 1), (1, "run", "helper", 2), (1, "fetch", "fetch", 1), (1, "save", "constructor", 1)]
    effects = [(1, "fetch", "network"), (1, "save", "db"), (1, "load", "db")]
    return (
        spark.createDataFrame(symbols, "repo_id long, n string, k string, f string, l int"),
        spark.createDataFrame(calls, "repo_id long, src string, dst string, n int"),
        spark.createDataFrame(effects, "repo_id long, fn string, kind string"),
    )


def test_flow(program):
    symbols, calls, effects = program
    entries = graph.entry_points(symbols, calls).orderBy("place").collect()
    assert [(e["name"], e["reach"], e["score"]) for e in entries] == [("main", 5, 95), ("run", 3, 58)]
    paths = graph.effect_paths(graph.entry_points(symbols, calls), calls, effects).orderBy("place").collect()
    assert [(p["entry"], p["chain"], p["kinds"]) for p in paths] == [("main", ["main", "load"], ["db"]), ("run", ["run", "helper", "save"], ["db"])]
    roles = {r["file"]: r for r in graph.file_roles(symbols, calls, effects).collect()}
    assert roles["io.py"]["inbound"] == 2 and roles["io.py"]["kinds"] == ["db"] and roles["app.py"]["classes"] == 1
    assert roles["io.py"]["weight"] == 2 * 4 + 2 + 2 + 0 + 8


def test_vectors(spark, rows):
    v = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0])]
    df = spark.createDataFrame(v, "id long, v array<double>")
    for block in (4096, 2):
        assert rows(vectors.nearest(df, "id", "v", 2, 0.3, block)) == [(1, 2, 0.994), (1, 6, 1.0), (2, 1, 0.994), (2, 6, 0.994), (6, 1, 1.0), (6, 2, 0.994)]
    with pytest.raises(ValueError):
        vectors.check_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)] * 3, "v array<double>"), "v")
    with pytest.raises(ValueError):
        vectors.check_width(df, "v", 9)


def test_rare_terms_tie_more_than_common_ones(spark):
    sets = {1: "rare a b c", 2: "rare d e f", 3: "a b c", 4: "a b", 5: "b c", 6: "g", 7: "h", 8: "i", 9: "j", 10: "k", 11: "l", 12: "m"}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s.split()], "id long, t string")
    got = {(r["id"], r["other"]): (r["weight"], r["shared"]) for r in vectors.idf_overlap(df, "id", "t", 0.0001).collect()}
    assert got[1, 2][1] == ["rare"] and (1, 6) not in got and got[1, 3][0] == got[3, 1][0]


def test_idf_overlap_of_equal_and_common_sets(spark, rows, monkeypatch):
    """Ties go to the lower id, copies included, in one turn and in many; few of all pairs are written at a time."""
    rng, sets = random.Random(8), {}
    for i in range(400):
        sets[i] = {"k0", "c1"} if i % 4 == 1 else {f"c{rng.randrange(9)}" for _ in range(2)} | {f"r{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randrange(7))}
    n, df = len(sets), Counter(t for s in sets.values() for t in s)
    w = {t: math.log(n / c) for t, c in df.items()}
    norm = {i: math.sqrt(sum(w[t] ** 2 for t in s)) or 1.0 for i, s in sets.items()}
    tie = {t for t, c in df.items() if 2 <= c <= n // 4}
    want = []
    for i, s in sets.items():
        scores = [(sum(w[t] ** 2 for t in s & sets[j] & tie) / (norm[i] * norm[j]), j) for j in sets if j != i]
        want += [(i, j, -x) for x, j in sorted((-math.floor(x * 1000 + 0.5) / 1000, j) for x, j in scores if x >= 0.12)[:12]]
    pairs, written = vectors.self_pairs, []

    def counted(*args, **kw):
        out = pairs(*args, **kw)
        written.append(out.count())
        return out

    frame = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] + [(None, "c1"), (3, None), (1, "k0")], "id long, t string")
    assert rows(vectors.idf_overlap(frame, "id", "t"), "id", "other", "weight") == sorted(want, key=repr)
    monkeypatch.setattr(vectors, "FEW_ROWS", 1, raising=False)
    monkeypatch.setattr(vectors, "BUCKETS", 8, raising=False)
    monkeypatch.setattr(vectors, "self_pairs", counted)
    assert rows(vectors.idf_overlap(frame, "id", "t"), "id", "other", "weight") == sorted(want, key=repr)
    assert max(written) < 5_000
    assert vectors.idf_overlap(frame.limit(0), "id", "t").count() == 0


def test_axes(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [x := rng.random() * 10, 2 * x, rng.random(), 0.1]) for i in range(50)], "id long, v array<double>")
    got = {r["id"]: r["x0"] for r in vectors.principal_axes(df, "id", "v", 2).collect()}
    first = {r["id"]: r["v"][0] for r in df.collect()}
    assert sorted(got, key=got.get) == sorted(first, key=first.get) and min(got.values()) == 0 and max(got.values()) == 1
