"""Grades: eight weighted axes, every step a column.

Input: one row of signals per repository (SIGNALS) and its findings. What wasn't measured gives a
neutral score and the mark ``partial``, never a clean one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.checks.rules import catalogue
from millrace.functions.scalar import clamp, letter, next_step, repeat_factor, round1

#: What a repository's row of signals holds.
SIGNALS = (
    "repo_id long, name string, kind string, domain string, language string, updated_at timestamp, as_of timestamp, "
    "health struct<has_tests:boolean,has_ci:boolean,has_license:boolean,has_readme:boolean,has_lockfile:boolean>, "
    "total_files long, n_tests long, n_docs long, ci_seen boolean, has_manifest boolean, vulns long, modules long, cycles long, high long, medium long, low long"
)
#: Weights by axis, then what each profile sets apart from them (fixed values).
AXES = {"architecture": 21, "cleanliness": 17, "docs": 14, "tests": 12, "cicd": 10, "deps": 10, "security": 8, "history": 8}
PROFILES = {
    "frontend": {"tests": 12, "cicd": 10, "architecture": 21, "cleanliness": 17},
    "service": {"tests": 14, "cicd": 14, "security": 12, "architecture": 20, "docs": 10},
    "library": {"tests": 18, "docs": 18, "architecture": 20, "cleanliness": 16, "cicd": 8},
    "notebook": {"tests": 4, "cicd": 4, "cleanliness": 22, "docs": 20, "architecture": 14, "history": 12},
    "cli": {"tests": 14, "docs": 16, "cicd": 8, "architecture": 18},
    "infra": {"security": 24, "cicd": 16, "tests": 6, "architecture": 16, "cleanliness": 12},
    "docs": {"docs": 34, "cleanliness": 20, "tests": 2, "cicd": 4, "architecture": 8, "deps": 6},
    "default": {},
}
#: Words of a kind that decide the profile, in this order (fixed values).
KIND_WORDS = [
    ("notebook|dataset|analysis|research", "notebook"), ("infra|terraform|devops|deploy|kubernetes|docker", "infra"), (r"\b(cli|tool)\b", "cli"), ("librar|sdk|package|framework", "library"),
    ("api|service|server|backend|bot|agent", "service"), ("web app|frontend|site|ui|extension|game", "frontend"), ("docs|book|awesome|list|course|tutorial", "docs"),
]
LANGUAGE_PROFILE = {"jupyter notebook": "notebook", "hcl": "infra", "dockerfile": "infra", "html": "frontend", "css": "frontend", "vue": "frontend", "svelte": "frontend", "markdown": "docs"}
#: Modules from which an import graph says something.
LEAST_MODULES = 3


def weights(spark: SparkSession) -> DataFrame:
    """``profile, axis, weight``: overrides over defaults, scaled to 100, then rounded to a tenth as published."""
    rows = []
    for profile, own in PROFILES.items():
        raw = {**AXES, **own}
        total = sum(raw.values())
        rows += [(profile, axis, int(w / total * 100 * 10 + 0.5) / 10) for axis, w in raw.items()]
    return spark.createDataFrame(rows, "profile string, axis string, weight double")


def profile(kind: Column, language: Column, domain: Column) -> Column:
    k, lang = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(language, F.lit("")))
    out = F.when(domain == "Agent Skills & Plugins", "docs")
    for pattern, name in KIND_WORDS:
        out = out.when(k.rlike(pattern), name)
    for value, name in LANGUAGE_PROFILE.items():
        out = out.when(lang == value, name)
    return out.otherwise("default")


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def base_scores() -> dict[str, Column]:
    """What each axis scores before findings are charged."""
    is_ = lambda f, want=True: F.coalesce(F.col(f"health.{f}") == want, F.lit(False))
    files = F.greatest(F.lit(1), F.coalesce("total_files", F.lit(1)))
    ratio = _zero("n_tests") / files
    low, high = 1 / 60, 1 / 10
    tests = F.when((_zero("n_tests") == 0) & ~is_("has_tests"), 0.0).when(ratio >= high, 92.0).when(ratio <= low, 25.0).otherwise(25 + (ratio - low) / (high - low) * 67)
    docs = F.when(is_("has_readme", False), 20.0).otherwise(70.0) + F.when(is_("has_license"), 8.0).otherwise(0.0) + F.least(F.lit(18.0), _zero("n_docs") * 2.5)
    deps = F.when(~F.coalesce("has_manifest", F.lit(False)), 75.0).otherwise(F.when(is_("has_lockfile"), 88.0).otherwise(60.0) - F.least(F.lit(55.0), _zero("vulns") * 6.0))
    days = F.greatest(F.lit(0.0), (F.unix_micros("as_of") - F.unix_micros("updated_at")) / 86_400_000_000)
    history = F.when(F.col("updated_at").isNull(), 50.0).when(days <= 30, 95.0).when(days >= 730, 20.0).otherwise(95 - (days - 30) / 700 * 75)
    seen = _zero("modules") >= LEAST_MODULES
    cyclic, severe, untidy = _zero("cycles") / F.col("modules"), _zero("high") / F.col("modules"), (_zero("medium") + _zero("low") * 0.4) / F.col("modules")
    return {
        "architecture": F.when(seen, 92 - F.least(F.lit(40.0), cyclic * 160) - F.least(F.lit(35.0), severe * 220)).otherwise(55.0),
        "cleanliness": F.when(seen, 95 - F.least(F.lit(55.0), untidy * 90)).otherwise(60.0),
        "docs": docs,
        "tests": tests,
        "cicd": F.when(F.coalesce("ci_seen", F.lit(False)) | is_("has_ci"), 85.0).otherwise(0.0),
        "deps": deps,
        "security": F.lit(90.0),
        "history": history,
    }


def charges(findings: DataFrame) -> DataFrame:
    """``repo_id, axis, check_id, cost``: each finding once, dearer the more often it hits, at most 1.6 times."""
    rules = F.broadcast(catalogue(findings.sparkSession).select("check_id", "axis", "points"))
    return findings.join(rules, "check_id").select("repo_id", "axis", "check_id", round1(F.col("points") * repeat_factor(F.col("n"))).alias("cost"))


def axis_scores(signals: DataFrame, findings: DataFrame) -> DataFrame:
    """``repo_id, profile, axis, weight, score, partial, charged``: eight rows per repository."""
    spark = signals.sparkSession
    unseen = _zero("modules") < LEAST_MODULES
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), s.alias("base"), (unseen if a in ("architecture", "cleanliness") else F.lit(False)).alias("partial")) for a, s in base_scores().items()])
    long = signals.select("repo_id", profile(F.col("kind"), F.col("language"), F.col("domain")).alias("profile"), F.explode(axes).alias("a")).select("repo_id", "profile", "a.*")
    spent = charges(findings).groupBy("repo_id", "axis").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct((-F.col("cost")).alias("c"), "check_id"))).alias("l"))
    out = long.join(spent, ["repo_id", "axis"], "left").join(F.broadcast(weights(spark)), ["profile", "axis"])
    score = round1(clamp(F.col("base") - F.coalesce("cost", F.lit(0.0))))
    return out.select("repo_id", "profile", "axis", "weight", score.alias("score"), "partial", F.coalesce(F.col("l.check_id"), F.array().cast("array<string>")).alias("charged"))


def grade(signals: DataFrame, findings: DataFrame) -> DataFrame:
    """``repo_id, profile, score, letter, next, partial, axes``; axes run from the worst to the best."""
    rows = axis_scores(signals, findings)
    axes = F.sort_array(F.collect_list(F.struct("score", (-F.col("weight")).alias("w"), "axis", "weight", "partial", "charged")))
    # Scores and weights are whole tenths, so the weighted sum is exact in whole numbers, in any order.
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    total = F.floor(F.sum(tenths("score") * tenths("weight")) / 1000 + 0.5) / 10
    out = rows.groupBy("repo_id", "profile").agg(total.alias("score"), F.max("partial").alias("partial"), axes.alias("axes"))
    return out.select("repo_id", "profile", "score", letter(F.col("score")).alias("letter"), next_step(F.col("score")).alias("next"), "partial", F.transform("axes", lambda x: x.dropFields("w")).alias("axes"))


def slim(graded: DataFrame) -> DataFrame:
    """K9: ``repo_id, score, letter, partial``."""
    return graded.select("repo_id", "score", "letter", "partial")
