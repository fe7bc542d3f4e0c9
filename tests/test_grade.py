from datetime import datetime

import pytest

from millrace.checks.grade import SIGNALS, axis_scores, grade, slim, weights

DAY = datetime(2026, 1, 10)
HEALTHY = dict(
    repo_id=1, name="a", kind="Web app", domain="Web", language="TypeScript", updated_at=datetime(2026, 1, 1), as_of=DAY, health=(True, True, True, True, True), total_files=200, n_tests=30,
    n_docs=4, ci_seen=True, has_manifest=True, vulns=0, modules=40, cycles=0, high=0, medium=2, low=1,
)


def signals(spark, *changes):
    return spark.createDataFrame([tuple({**HEALTHY, **c}.values()) for c in changes], SIGNALS)


def found(spark, *rows):
    return spark.createDataFrame(list(rows), "repo_id long, check_id string, n long")


def one(spark, change=None, *findings):
    return grade(signals(spark, change or {}), found(spark, *findings)).first()


def test_weights_sum_to_a_hundred(spark):
    sums = {r["profile"]: r["s"] for r in weights(spark).groupBy("profile").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert len(sums) == 8 and all(abs(s - 100) < 0.25 for s in sums.values())


def test_healthy(spark):
    r = one(spark)
    assert r["score"] >= 75 and r["profile"] == "frontend" and not r["partial"]
    assert [x["score"] for x in r["axes"]] == sorted(x["score"] for x in r["axes"])


def test_charges_and_cap(spark):
    axes = {r["axis"]: r for r in axis_scores(signals(spark, {}), found(spark, (1, "private-key-committed", 1), (1, "no-license", 1), (1, "unknown-check", 9))).collect()}
    assert axes["security"]["score"] == 0 and axes["security"]["charged"] == ["private-key-committed"]
    assert axes["docs"]["score"] == pytest.approx(88 - 35)
    many = {r["axis"]: r["score"] for r in axis_scores(signals(spark, {}), found(spark, (1, "gha-missing-job-timeout", 10**6))).collect()}
    assert many["cicd"] == pytest.approx(85 - 8 * 1.6)


@pytest.mark.parametrize(
    "change, axis, score",
    [
        ({"n_tests": 0, "health": (False, True, True, True, True)}, "tests", 0), ({"n_tests": 1}, "tests", 25), ({"ci_seen": False, "health": (True, False, True, True, True)}, "cicd", 0),
        ({"health": (True, True, False, False, True), "n_docs": 0}, "docs", 20), ({"has_manifest": False}, "deps", 75), ({"vulns": 20}, "deps", 33), ({"updated_at": None}, "history", 50),
        ({"updated_at": datetime(2020, 1, 1)}, "history", 20), ({"modules": 2}, "architecture", 55), ({"modules": None}, "cleanliness", 60), ({"cycles": 40, "high": 40}, "architecture", 17),
    ],
)
def test_axes(spark, change, axis, score):
    r = one(spark, change)
    assert {x["axis"]: x["score"] for x in r["axes"]}[axis] == pytest.approx(score)
    assert r["partial"] == (change.get("modules", 40) in (2, None))


@pytest.mark.parametrize("kind, lang, domain, want", [("dataset", "x", "x", "notebook"), ("CLI tool", "x", "x", "cli"), ("", "HCL", None, "infra"), (None, None, None, "default"), ("api", "x", "Agent Skills & Plugins", "docs")])
def test_profiles(spark, kind, lang, domain, want):
    assert one(spark, {"kind": kind, "language": lang, "domain": domain})["profile"] == want


def test_slim_agrees(spark):
    g = grade(signals(spark, {}, {"repo_id": 2, "modules": 1}), found(spark))
    assert {tuple(r) for r in slim(g).collect()} == {(r["repo_id"], r["score"], r["letter"], r["partial"]) for r in g.collect()}
