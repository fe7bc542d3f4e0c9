"""The catalogue: severity, confidence, axis and points of every check (fixed values)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

#: id -> severity, confidence, axis, points. The thirteen secret checks' confidence is ours.
RULES: dict[str, tuple[str, float, str, float]] = {
    # tests
    "no-tests-at-all": ("high", 0.8, "tests", 100), "test-suite-too-small": ("medium", 0.5, "tests", 45), "ci-never-runs-tests": ("high", 0.6, "tests", 25),
    # cicd
    "ci-absent-entirely": ("high", 0.7, "cicd", 100), "deploy-artifacts-without-ci": ("high", 0.7, "cicd", 40), "gha-step-swallows-exit-code": ("high", 0.7, "cicd", 20),
    "gha-continue-on-error-masks-failure": ("high", 0.6, "cicd", 16), "no-dependency-vulnerability-gate": ("medium", 0.8, "cicd", 15), "ci-install-ignores-lockfile": ("medium", 0.8, "cicd", 15),
    "gha-pushes-to-default-branch": ("high", 0.6, "cicd", 10), "gha-missing-job-timeout": ("low", 0.9, "cicd", 8),
    # security
    "private-key-committed": ("critical", 0.95, "security", 100), "cloud-credential-file-committed": ("critical", 0.9, "security", 100), "service-account-json-committed": ("critical", 0.95, "security", 100),
    "env-secret-value-real": ("critical", 0.8, "security", 90), "provider-token-committed": ("critical", 0.9, "security", 90), "registry-auth-committed": ("critical", 0.85, "security", 70),
    "db-url-inline-password": ("high", 0.7, "security", 60), "terraform-state-committed": ("critical", 0.9, "security", 55), "database-dump-committed": ("high", 0.7, "security", 50),
    "gitignore-contradicts-tracked-secret": ("high", 0.85, "security", 45), "env-file-committed": ("high", 0.6, "security", 40), "gha-pr-target-untrusted-checkout": ("critical", 0.9, "security", 40),
    "hardcoded-secret-key-fallback": ("high", 0.6, "security", 35), "gha-script-injection": ("critical", 0.85, "security", 35), "gha-secrets-in-forkable-trigger": ("critical", 0.7, "security", 35),
    "shell-history-committed": ("high", 0.9, "security", 30), "unsafe-deserialization": ("high", 0.55, "security", 30), "sql-built-by-string-interpolation": ("high", 0.6, "security", 30),
    "shell-command-from-interpolation": ("high", 0.6, "security", 30), "eval-on-runtime-value": ("high", 0.5, "security", 28), "tls-verification-disabled": ("high", 0.75, "security", 28),
    "secret-passed-as-build-arg": ("high", 0.6, "security", 25), "compose-privileged-or-host-network": ("high", 0.7, "security", 22), "gha-permissions-write-all": ("critical", 0.95, "security", 20),
    "allowed-hosts-wildcard": ("medium", 0.5, "security", 18), "cors-allows-any-origin": ("high", 0.65, "security", 18), "debug-mode-enabled-in-config": ("high", 0.6, "security", 18),
    "gha-checkout-persists-credentials": ("medium", 0.6, "security", 15), "gha-third-party-action-unpinned": ("high", 0.9, "security", 12), "container-runs-as-root": ("medium", 0.55, "security", 12),
    "gha-no-permissions-block": ("medium", 0.85, "security", 10), "no-secret-scanning-gate": ("medium", 0.7, "security", 10), "network-call-without-timeout": ("medium", 0.7, "security", 8),
    # docs
    "readme-stub": ("medium", 0.7, "docs", 45), "no-license": ("high", 0.85, "docs", 35), "notebook-no-environment": ("high", 0.85, "docs", 20), "repo-conventions-not-configured": ("low", 0.7, "docs", 15),
    # deps
    "dependency-pinned-to-critical-vulnerability": ("critical", 0.9, "deps", 45), "manifest-without-lockfile": ("high", 0.75, "deps", 30), "dependency-pinned-to-known-vulnerability": ("high", 0.85, "deps", 25),
    "no-automated-dependency-updates": ("medium", 0.85, "deps", 20), "dependency-directory-committed": ("high", 0.9, "deps", 20), "dependency-range-permits-vulnerability": ("medium", 0.5, "deps", 12),
    "dockerfile-base-image-unpinned": ("medium", 0.8, "deps", 15), "install-lifecycle-script": ("medium", 0.5, "deps", 15),
    # cleanliness
    "build-output-committed": ("medium", 0.6, "cleanliness", 22), "notebook-outputs-committed": ("medium", 0.8, "cleanliness", 20), "large-binary-not-in-lfs": ("medium", 0.7, "cleanliness", 16),
    "notebook-monolithic-cell": ("medium", 0.75, "cleanliness", 14), "notebook-absolute-local-path": ("high", 0.8, "cleanliness", 12),
    # architecture
    "notebook-missing-random-seed": ("medium", 0.7, "architecture", 12),
}

#: Checks registered by callers: id -> where it looks (``file`` or ``tree``) and whether it fires.
REGISTERED: dict[str, tuple[str, Callable[[], Column]]] = {}


def register(check_id: str, severity: str, confidence: float, axis: str, points: float, on: str = "file"):
    """Adds a check to the catalogue; decorates a function that gives the Column telling whether it fires.

    On a ``file`` it may read ``path``, ``text``, ``bare`` (without comments), ``sites`` and ``cells``; on a
    ``tree`` the columns of audit.tree_facts. An id in use is refused, so is an unknown severity or place.
    """
    if check_id in RULES:
        raise ValueError(f"{check_id} is registered already")
    if severity not in SEVERITY_WEIGHT or on not in ("file", "tree"):
        raise ValueError(f"{check_id}: severity {severity}, on {on}")

    def add(fires: Callable[[], Column]) -> Callable[[], Column]:
        RULES[check_id], REGISTERED[check_id] = (severity, confidence, axis, points), (on, fires)
        return fires

    return add


def unregister(check_id: str) -> None:
    """Takes a registered check out again."""
    del REGISTERED[check_id], RULES[check_id]


#: Weight of each severity in a finding's rank (fixed values).
SEVERITY_WEIGHT = {"critical": 8.0, "high": 5.0, "medium": 2.0, "low": 1.0}


def catalogue(spark: SparkSession) -> DataFrame:
    """``check_id, severity, confidence, axis, points``, one row per check."""
    return spark.createDataFrame([(k, *v[:3], float(v[3])) for k, v in RULES.items()], "check_id string, severity string, confidence double, axis string, points double")
