import pytest

from millrace.checks.audit import findings, ranked, severity_totals
from millrace.checks.calls import arguments
from millrace.checks.rules import RULES
from millrace.plans.fixtures import PAIRS, TREES, WF


def run(spark, tree, files):
    t = spark.createDataFrame(tree or [], "repo_id long, path string, size long")
    f = spark.createDataFrame(files or [], "repo_id long, path string, text string")
    return findings(t, f)


@pytest.fixture(scope="module")
def outcome(spark):
    rows = [(2 * i, p, bad) for i, (_, p, bad, _) in enumerate(PAIRS)] + [(2 * i + 1, p, good) for i, (_, p, _, good) in enumerate(PAIRS)]
    got = run(spark, [(r, p, len(t)) for r, p, t in rows], rows)
    return {(r["repo_id"], r["check_id"]) for r in got.collect()}


@pytest.mark.parametrize("i", range(len(PAIRS)), ids=[p[0] for p in PAIRS])
def test_fires_on_the_fault_and_is_silent_on_its_fix(outcome, i):
    assert (2 * i, PAIRS[i][0]) in outcome
    assert (2 * i + 1, PAIRS[i][0]) not in outcome


def test_trees(spark):
    tree = [(2 * i + k, p, s) for i, (_, *both) in enumerate(TREES) for k, t in enumerate(both) for p, s in t]
    got = {(r["repo_id"], r["check_id"]) for r in run(spark, tree, []).collect()}
    for i, (check, *_) in enumerate(TREES):
        assert (2 * i, check) in got, check
        assert (2 * i + 1, check) not in got, check


def test_workflows_together_and_second_pass(spark):
    tests = [(1, f"tests/test_{i}.py", 9) for i in range(3)]
    tree = [*tests, (1, WF, 1), (1, "package-lock.json", 1), (1, "package.json", 1), (1, ".env", 1), (2, WF, 1), (2, ".env", 1), *[(2, f"tests/test_{i}.py", 9) for i in range(3)]]
    files = [(1, WF, "run: npm install"), (1, ".gitignore", "# x\n/.env\n"), (2, WF, "run: pytest\nuses: osv-scanner\nrun: gitleaks"), (3, WF, None)]
    got = {(r["repo_id"], r["check_id"]) for r in run(spark, tree, files).collect()}
    for check in ("ci-never-runs-tests", "ci-install-ignores-lockfile", "no-dependency-vulnerability-gate", "no-secret-scanning-gate", "gitignore-contradicts-tracked-secret"):
        assert (1, check) in got and (2, check) not in got, check
    assert not any(r == 3 for r, _ in got)


def test_a_value_in_three_repositories_is_a_sample(spark):
    value = "API_KEY=q9Zx7Lk2Pv8Rt4Wm6Yb1"
    hit = lambda n: [r for r in run(spark, [], [(i, ".env", value) for i in range(n)]).collect() if r["check_id"] == "env-secret-value-real"]
    assert len(hit(2)) == 2 and len(hit(3)) == 0


def test_vulnerable_dependencies(spark):
    tree = spark.createDataFrame([(1, "a", 1), (2, "yarn.lock", 1)], "repo_id long, path string, size long")
    files = spark.createDataFrame([], "repo_id long, path string, text string")
    v = spark.createDataFrame([(1, "p", "1.0", True, "X-1", "critical"), (1, "q", "1", True, "X-2", "low"), (1, "r", "1", False, "X-3", "high"), (2, "r", "1", False, "X-3", "high")], "repo_id long, package string, version string, pinned boolean, osv_id string, severity string")
    got = {(r["repo_id"], r["check_id"]) for r in findings(tree, files, v).collect()}
    assert {(1, "dependency-pinned-to-critical-vulnerability"), (1, "dependency-pinned-to-known-vulnerability"), (1, "dependency-range-permits-vulnerability")} <= got
    assert (2, "dependency-range-permits-vulnerability") not in got


def test_rank_dismissal_and_totals(spark):
    found = spark.createDataFrame([(1, "no-license", "", "e", 1), (1, "private-key-committed", "k", "e", 1), (2, "no-license", "", "e", 1)], "repo_id long, check_id string, where string, evidence string, n long")
    repos = spark.createDataFrame([(1, True, False, False), (2, False, True, False)], "repo_id long, is_original boolean, has_ci boolean, has_docker boolean")
    gone = spark.createDataFrame([(1, "private-key-committed", "k")], "repo_id long, check_id string, where string")
    assert [(r["repo_id"], r["check_id"], r["rank"]) for r in ranked(found, repos).orderBy("repo_id", "place").collect()] == [(1, "private-key-committed", 7.6), (1, "no-license", 4.25), (2, "no-license", 2.55)]
    assert ranked(found, repos, gone).count() == 2
    assert {(r["repo_id"], r["total"], r["critical"], r["high"]) for r in severity_totals(found).collect()} == {(1, 2, 1, 1), (2, 1, 0, 1)}


def test_catalogue_is_covered():
    tested = {p[0] for p in PAIRS} | {t[0] for t in TREES} | {"ci-never-runs-tests", "ci-install-ignores-lockfile", "no-dependency-vulnerability-gate", "no-secret-scanning-gate", "gitignore-contradicts-tracked-secret"}
    tested |= {k for k in RULES if "vulnerability" in k}
    assert set(RULES) == tested and len(RULES) == 62


def test_arguments_balance():
    assert arguments("f(a(b), c) + g(d)", 1) == "a(b), c"
    assert arguments("f(" + "x" * 900, 1, 400) == "x" * 399
