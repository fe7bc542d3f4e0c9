"""Grades of the estate from what the tables measure: health flags, documents, dependencies, advisories, age.

No file trees or module graphs are given, so architecture and cleanliness stay neutral and every grade is
marked partial, which is what unmeasured means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.checks import grade as g
from millrace.checks.rules import RULES
from millrace.functions import scalar
from millrace.plans import estate, supply
from millrace.session import table


def _signals(spark: SparkSession, root: str) -> DataFrame:
    r = estate.current(spark, root).withColumnRenamed("id", "repo_id")
    docs = table(spark, root, "documents", "repo_id").where("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n_docs"))
    deps = supply.repo_packages(spark, root).select("repo_id").distinct().withColumn("has_manifest", F.lit(True))
    live = supply.advisories(spark, root).where("not withdrawn").select("osv_id")
    vulns = supply._met(spark, root).join(live, "osv_id", "left_semi").groupBy("repo_id").agg(F.count_distinct("osv_id").alias("vulns"))
    as_of = table(spark, root, "repo", "loaded_at").agg(F.max("loaded_at")).first()[0]
    s = r.join(docs, "repo_id", "left").join(deps, "repo_id", "left").join(vulns, "repo_id", "left")
    nulls = {"total_files": "long", "n_tests": "long", "ci_seen": "boolean", **dict.fromkeys(("modules", "cycles", "high", "medium", "low"), "long")}
    s = s.withColumns({c: F.lit(None).cast(k) for c, k in nulls.items()}).withColumn("as_of", F.lit(as_of))
    return s.select("repo_id", "name", "kind", "domain", "language", "updated_at", "as_of", "health", "total_files", "n_tests", "n_docs", "ci_seen", "has_manifest", "vulns", *["modules", "cycles", "high", "medium", "low"])


#: Health flag that is false -> the check it speaks for.
_BY_FLAG = {"has_license": "no-license", "has_tests": "no-tests-at-all", "has_ci": "ci-absent-entirely"}


def _findings(signals: DataFrame) -> DataFrame:
    hits = [F.when(~F.col(f"health.{f}"), F.struct(F.lit(c).alias("check_id"), F.lit(1).alias("n"))) for f, c in _BY_FLAG.items()]
    hits.append(F.when(~F.col("health.has_lockfile") & F.col("has_manifest"), F.struct(F.lit("manifest-without-lockfile").alias("check_id"), F.lit(1).alias("n"))))
    hits.append(F.when(F.col("vulns") > 0, F.struct(F.lit("dependency-range-permits-vulnerability").alias("check_id"), F.col("vulns").cast("int").alias("n"))))
    return signals.select("repo_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("repo_id", "h.*")


def graded_repos(spark: SparkSession, root: str) -> DataFrame:
    """2.13, J5, J13: score, letter and profile of every repository that was looked at; others get none."""
    s = _signals(spark, root).where("health is not null")
    return g.grade(s, _findings(s)).select("repo_id", "profile", "score", "letter", "partial", F.col("next.letter").alias("next"))


def axis_grades(spark: SparkSession, root: str) -> DataFrame:
    """G-5 to G-13, W5: each axis' mean score per profile and how often it was charged."""
    s = _signals(spark, root).where("health is not null")
    a = g.axis_scores(s, _findings(s))
    return a.groupBy("profile", "axis").agg(F.count("*").alias("n"), scalar.half_up(F.avg("score"), 2).alias("mean"), F.count_if(F.size("charged") > 0).alias("charged"))


def profile_weights(spark: SparkSession, root: str) -> DataFrame:
    """G-2, A4: weights of every profile and axis."""
    return g.weights(spark)


def repeat_costs(spark: SparkSession, root: str) -> DataFrame:
    """G-3, G-4: what each repository's advisories cost as one finding."""
    s = _signals(spark, root).where("vulns > 0")
    return g.charges(_findings(s).where("check_id = 'dependency-range-permits-vulnerability'")).select("repo_id", "cost")


def _round1(x: str) -> str:
    return f"(floor(({x}) * 10.0 + 0.5) / 10.0)"


_KIND = " ".join(f"WHEN regexp_matches(lower(coalesce(kind, '')), '{p}') THEN '{n}'" for p, n in g.KIND_WORDS)
_LANG = " ".join(f"WHEN lower(coalesce(language, '')) = '{v}' THEN '{n}'" for v, n in g.LANGUAGE_PROFILE.items())
_PROFILE = f"CASE WHEN domain = 'Agent Skills & Plugins' THEN 'docs' {_KIND} {_LANG} ELSE 'default' END"
_W = ", ".join(f"('{p}', '{a}', {float({**g.AXES, **own}[a])})" for p, own in g.PROFILES.items() for a in g.AXES)
_WEIGHTS = f"raw(profile, axis, w) AS (VALUES {_W}), wt AS (SELECT profile, axis, {_round1('w / sum(w) OVER (PARTITION BY profile) * 100')} AS weight FROM raw)"
_COST = lambda check, n: _round1(f"{RULES[check][3]} * least(1.6, 1 + 0.18 * log2(greatest(1, {n})))")
_DAYS = "greatest(0.0, (as_of - epoch_us(updated_at)) / 86400000000.0)"
_BASE = {
    "architecture": ("55.0", "0.0"), "cleanliness": ("60.0", "0.0"),
    "docs": ("CASE WHEN NOT health.has_readme THEN 20.0 ELSE 70.0 END + CASE WHEN health.has_license THEN 8.0 ELSE 0.0 END + least(18.0, nd * 2.5)", f"CASE WHEN NOT health.has_license THEN {_COST('no-license', '1')} ELSE 0 END"),
    "tests": ("CASE WHEN NOT coalesce(health.has_tests, false) THEN 0.0 ELSE 25.0 END", f"CASE WHEN NOT health.has_tests THEN {_COST('no-tests-at-all', '1')} ELSE 0 END"),
    "cicd": ("CASE WHEN health.has_ci THEN 85.0 ELSE 0.0 END", f"CASE WHEN NOT health.has_ci THEN {_COST('ci-absent-entirely', '1')} ELSE 0 END"),
    "deps": ("CASE WHEN NOT hm THEN 75.0 ELSE CASE WHEN health.has_lockfile THEN 88.0 ELSE 60.0 END - least(55.0, nv * 6.0) END",
             f"CASE WHEN NOT health.has_lockfile AND hm THEN {_COST('manifest-without-lockfile', '1')} ELSE 0 END + CASE WHEN nv > 0 THEN {_COST('dependency-range-permits-vulnerability', 'nv')} ELSE 0 END"),
    "security": ("90.0", "0.0"),
    "history": (f"CASE WHEN updated_at IS NULL THEN 50.0 WHEN {_DAYS} <= 30 THEN 95.0 WHEN {_DAYS} >= 730 THEN 20.0 ELSE 95 - ({_DAYS} - 30) / 700 * 75 END", "0.0"),
}
_SIG = f"""{supply._MET}, {estate._LAST}, nd AS (SELECT repo_id, count(*) AS n FROM documents WHERE repo_id IS NOT NULL GROUP BY 1), dp AS (SELECT DISTINCT repo_id FROM rp),
nv AS (SELECT repo_id, count(DISTINCT osv_id) AS n FROM met JOIN adv USING (osv_id) WHERE NOT withdrawn GROUP BY 1), big AS (SELECT max(epoch_us(loaded_at)) AS as_of FROM repo),
sig AS (SELECT cur.id AS repo_id, {_PROFILE} AS profile, health, updated_at, as_of, coalesce(nd.n, 0) AS nd, coalesce(nv.n, 0) AS nv, dp.repo_id IS NOT NULL AS hm
  FROM cur LEFT JOIN nd ON cur.id = nd.repo_id LEFT JOIN dp ON cur.id = dp.repo_id LEFT JOIN nv ON cur.id = nv.repo_id, big),
{_WEIGHTS}, ax AS ({" UNION ALL ".join(f"SELECT repo_id, profile, '{a}' AS axis, {_round1(f'greatest(0.0, least(100.0, ({b}) - ({c})))')} AS score, ({c}) > 0 AS charged FROM sig WHERE health IS NOT NULL" for a, (b, c) in _BASE.items())})"""
_LETTERS = "CASE " + " ".join(f"WHEN score >= {a} THEN '{b}'" for a, b in scalar.LADDER) + " ELSE 'F' END"

QUERIES = {f.__name__: f for f in (graded_repos, axis_grades, profile_weights, repeat_costs)}
SQL = {
    "graded_repos": f"{_SIG}, tot AS (SELECT repo_id, profile, floor(sum(CAST(round(score * 10) AS BIGINT) * CAST(round(weight * 10) AS BIGINT)) / 1000.0 + 0.5) / 10.0 AS score FROM ax JOIN wt USING (profile, axis) GROUP BY 1, 2) SELECT repo_id, profile, score, {_LETTERS} AS letter, true AS partial, {estate._NEXT} AS next FROM tot",
    "axis_grades": f"{_SIG} SELECT profile, axis, count(*) AS n, floor(avg(score) * 100.0 + 0.5) / 100.0 AS mean, count(*) FILTER (charged) AS charged FROM ax GROUP BY 1, 2",
    "profile_weights": f"WITH {_WEIGHTS} SELECT profile, axis, weight FROM wt",
    "repeat_costs": f"{_SIG} SELECT repo_id, {_COST('dependency-range-permits-vulnerability', 'nv')} AS cost FROM sig WHERE nv > 0",
}
