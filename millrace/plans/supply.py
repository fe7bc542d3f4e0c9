"""Packages, advisories and the repositories they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keys, scalar
from millrace.operators import relational
from millrace.operators.skew import dealt_join
from millrace.session import saved, table


def dependencies(spark: SparkSession, root: str) -> DataFrame:
    """Usable rows of dependency in one spelling."""
    d = table(spark, root, "dependency", "dep_id", "repo_id", "ecosystem", "package_name", "spec", "manifest_path", "seen_at", "loaded_at")
    d = d.withColumn("ecosystem", keys.ecosystem(F.col("ecosystem"))).withColumn("package_name", keys.package(F.col("ecosystem"), F.col("package_name")))
    return d.where("repo_id is not null and package_name is not null and package_name <> ''")


def affected(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (osv_id, ecosystem, package_name), the registry's cargo name mapped back."""
    a = table(spark, root, "advisory_affects", "osv_id", "ecosystem", "package_name")
    a = a.select(keys.advisory(F.col("osv_id")).alias("osv_id"), keys.ecosystem(F.col("ecosystem")).alias("ecosystem"), F.col("package_name").alias("p"))
    return a.withColumn("package_name", keys.package(F.col("ecosystem"), F.col("p"))).drop("p").dropna().distinct()


def advisories(spark: SparkSession, root: str) -> DataFrame:
    """One row per advisory: least loaded row, severity as a word, whether it was ever withdrawn."""
    a = table(spark, root, "advisory", "osv_id", "severity", "loaded_at", "withdrawn_at").withColumn("osv_id", keys.advisory(F.col("osv_id")))
    return a.groupBy("osv_id").agg(
        F.min(F.struct("loaded_at", scalar.severity(F.col("severity")).alias("severity"))).alias("f"), F.max(F.col("withdrawn_at").isNotNull()).alias("withdrawn")
    ).select("osv_id", "f.severity", "withdrawn")


def first_wins(spark: SparkSession, root: str) -> DataFrame:
    """K3: one row per (repository, ecosystem, package); the first loaded row wins."""
    return relational.first_wins(dependencies(spark, root).select("repo_id", "ecosystem", "package_name", "dep_id", "spec"), ["repo_id", "ecosystem", "package_name"], ["dep_id"])


def repo_packages(spark: SparkSession, root: str) -> DataFrame:
    return dependencies(spark, root).select("repo_id", "ecosystem", "package_name").distinct()


def _met(spark: SparkSession, root: str) -> DataFrame:
    """affected x dependency on (ecosystem, package): a package in half of all repositories is dealt over tasks."""
    deps = saved(repo_packages(spark, root), "repo-packages")
    return dealt_join(deps, affected(spark, root), ["ecosystem", "package_name"], "repo_id").select("osv_id", "repo_id", "ecosystem", "package_name")


def advisory_reach(spark: SparkSession, root: str) -> DataFrame:
    """Every repository an advisory reaches through a package, with its known status if any."""
    status = table(spark, root, "repo_advisory", "repo_id", "osv_id", "status").withColumn("osv_id", keys.advisory(F.col("osv_id")))
    status = status.groupBy("repo_id", "osv_id").agg(F.min("status").alias("status"))
    return _met(spark, root).join(status, ["repo_id", "osv_id"], "left").select("osv_id", "repo_id", "ecosystem", "package_name", "status")


def package_reach(spark: SparkSession, root: str) -> DataFrame:
    """Per package, its repositories, advisories and worst severity; packages without advisories too."""
    deps = repo_packages(spark, root).groupBy("ecosystem", "package_name").agg(F.count("*").alias("repos"))
    worst = affected(spark, root).join(advisories(spark, root), "osv_id", "left").groupBy("ecosystem", "package_name").agg(
        F.count("*").alias("n_advisories"), F.min(scalar.severity_rank(F.coalesce("severity", F.lit("unknown")))).alias("worst")
    )
    return deps.join(worst, ["ecosystem", "package_name"], "left").select("ecosystem", "package_name", "repos", F.coalesce("n_advisories", F.lit(0)).alias("n_advisories"), "worst")


def widest_advisory(spark: SparkSession, root: str) -> DataFrame:
    """A1: the high-severity advisory that reaches most repositories."""
    high = advisories(spark, root).where("severity = 'high'").select("osv_id")
    return _met(spark, root).join(high, "osv_id", "left_semi").groupBy("osv_id").agg(F.count_distinct("repo_id").alias("repos")).orderBy(F.desc("repos"), "osv_id").limit(1)


def busiest_repos(spark: SparkSession, root: str) -> DataFrame:
    """A3: the ten repositories with most declared packages."""
    return repo_packages(spark, root).groupBy("repo_id").agg(F.count("*").alias("packages")).orderBy(F.desc("packages"), "repo_id").limit(10)


def fk_violations(spark: SparkSession, root: str) -> DataFrame:
    """K5: distinct foreign keys without a parent, per reference."""
    repos = table(spark, root, "repo", "id")
    adv = table(spark, root, "advisory", "osv_id").select(keys.advisory(F.col("osv_id")).alias("osv_id"))
    ids = lambda t: table(spark, root, t, "osv_id").select(keys.advisory(F.col("osv_id")).alias("osv_id"))
    checks = [
        ("dependency.repo_id", table(spark, root, "dependency", "repo_id"), ["repo_id"], repos, ["id"]),
        ("repo_advisory.repo_id", table(spark, root, "repo_advisory", "repo_id"), ["repo_id"], repos, ["id"]),
        ("repo_advisory.osv_id", ids("repo_advisory"), ["osv_id"], adv, ["osv_id"]),
        ("advisory_affects.osv_id", ids("advisory_affects"), ["osv_id"], adv, ["osv_id"]),
        ("kin.id", table(spark, root, "kin", "id"), ["id"], repos, ["id"]),
        ("kin.neighbour_id", table(spark, root, "kin", "neighbour_id"), ["neighbour_id"], repos, ["id"]),
        ("repo.parent_id", table(spark, root, "repo", "parent_id"), ["parent_id"], repos, ["id"]),
        ("documents.repo_id", table(spark, root, "documents", "repo_id"), ["repo_id"], repos, ["id"]),
    ]
    parts = [relational.missing_references(c, k, p, pk).select(F.lit(name).alias("reference")) for name, c, k, p, pk in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("reference").agg(F.count("*").alias("violations"))


def package_inversion(spark: SparkSession, root: str) -> DataFrame:
    """Packages by number of repositories, ranked."""
    n = repo_packages(spark, root).groupBy("ecosystem", "package_name").agg(F.count("*").alias("repos"), F.min("repo_id").alias("first_repo"))
    return n


def ranked_packages(spark: SparkSession, root: str) -> DataFrame:
    """The first 120 packages of each ecosystem by repositories."""
    return relational.top_k(package_inversion(spark, root), ["ecosystem"], [F.desc("repos"), F.asc("package_name")], 120)


def worst_advisory(spark: SparkSession, root: str) -> DataFrame:
    """Worst severity of a repository's advisories that weren't withdrawn."""
    live = advisories(spark, root).where("not withdrawn")
    return _met(spark, root).join(live, "osv_id").groupBy("repo_id").agg(F.min(scalar.severity_rank(F.col("severity"))).alias("worst"), F.count_distinct("osv_id").alias("n_advisories"))


def severity_lists(spark: SparkSession, root: str) -> DataFrame:
    """The severities of a repository's advisories, worst first."""
    pairs = _met(spark, root).select("repo_id", "osv_id").distinct().join(advisories(spark, root), "osv_id")
    return pairs.groupBy("repo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(scalar.severity_rank(F.col("severity")).alias("r"), "severity"))), lambda x: x["severity"]), ",").alias("severities"))


def version_queries(spark: SparkSession, root: str) -> DataFrame:
    """One lookup per (ecosystem, package, version), with its repositories and pins."""
    d = dependencies(spark, root).withColumn("c", scalar.constraint(F.col("spec"))).where("c is not null")
    version = F.when(F.col("ecosystem") == "go", scalar.go_version(F.col("c.version"))).otherwise(F.col("c.version"))
    per_repo = d.groupBy("ecosystem", "package_name", version.alias("version"), "repo_id").agg(F.max("c.pinned").alias("pinned"))
    return per_repo.groupBy("ecosystem", "package_name", "version").agg(F.count("*").alias("repos"), F.count_if("pinned").alias("pinned_repos"))


def pin_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Per repository, packages pinned, ranged and without a version."""
    d = first_wins(spark, root).withColumn("c", scalar.constraint(F.col("spec")))
    return d.groupBy("repo_id").agg(F.count_if(F.col("c.pinned")).alias("pinned"), F.count_if(~F.col("c.pinned")).alias("ranged"), F.count_if(F.col("c").isNull()).alias("open"))


def stale_majors(spark: SparkSession, root: str) -> DataFrame:
    """Dependencies whose declared major is behind the registry's latest."""
    r = table(spark, root, "registry_package", "ecosystem", "name", "latest_version", "loaded_at")
    eco = keys.ecosystem(F.col("ecosystem"))
    r = r.select(eco.alias("ecosystem"), keys.package(eco, F.col("name")).alias("package_name"), "latest_version", "loaded_at").where("latest_version is not null")
    r = r.groupBy("ecosystem", "package_name").agg(F.max(F.struct("loaded_at", "latest_version")).alias("l")).select("ecosystem", "package_name", F.col("l.latest_version").alias("latest"))
    d = first_wins(spark, root)
    d = d.join(r, ["ecosystem", "package_name"]).withColumn("behind", scalar.major(F.col("latest")) - scalar.major(F.col("spec")))
    return d.where("behind > 0").select("repo_id", "ecosystem", "package_name", "spec", "latest", "behind")


def unresolved_packages(spark: SparkSession, root: str) -> DataFrame:
    """The 200 most used npm and pypi packages that no registry row knows."""
    eco = keys.ecosystem(F.col("ecosystem"))
    known = table(spark, root, "registry_package", "ecosystem", "name").select(eco.alias("ecosystem"), keys.package(eco, F.col("name")).alias("package_name")).distinct()
    used = package_inversion(spark, root).where(F.col("ecosystem").isin("npm", "pypi"))
    return used.join(known, ["ecosystem", "package_name"], "left_anti").orderBy(F.desc("repos"), "ecosystem", "package_name").limit(200).select("ecosystem", "package_name", "repos")


def manifest_ecosystems(spark: SparkSession, root: str) -> DataFrame:
    """Rows by stated ecosystem and the one their manifest's path says."""
    return dependencies(spark, root).groupBy("ecosystem", scalar.manifest_ecosystem(F.col("manifest_path")).alias("by_path")).agg(F.count("*").alias("n"))


def advisory_ids_without_detail(spark: SparkSession, root: str) -> DataFrame:
    """Advisory ids that are referred to and have no advisory row."""
    ids = table(spark, root, "repo_advisory", "osv_id").unionByName(table(spark, root, "advisory_affects", "osv_id"))
    known = table(spark, root, "advisory", "osv_id").select(keys.advisory(F.col("osv_id")).alias("osv_id"))
    return relational.missing_references(ids.select(keys.advisory(F.col("osv_id")).alias("osv_id")), ["osv_id"], known, ["osv_id"])


def severity_counts(spark: SparkSession, root: str) -> DataFrame:
    """Advisories by severity, those withdrawn apart."""
    return advisories(spark, root).groupBy("severity").agg(F.count("*").alias("n"), F.count_if("withdrawn").alias("withdrawn"))


def merged_specs(spark: SparkSession, root: str) -> DataFrame:
    """U4: of one repository's manifests, the spec declared last overrides the others."""
    d = dependencies(spark, root).select("repo_id", "ecosystem", "package_name", "dep_id", "spec", "manifest_path")
    at_root = F.instr(F.coalesce("manifest_path", F.lit("")), "/") == 0
    return relational.latest_wins(d.where(at_root).drop("manifest_path"), d.where(~at_root).drop("manifest_path"), ["repo_id", "ecosystem", "package_name"], ["dep_id"])


_E = keys.sql_ecosystem("ecosystem")
_DEP = f"""dep AS (SELECT * FROM (SELECT dep_id, repo_id, {_E} AS ecosystem, {keys.sql_package(_E, 'package_name')} AS package_name, spec, manifest_path FROM dependency)
  WHERE repo_id IS NOT NULL AND package_name IS NOT NULL AND package_name <> ''),
rp AS (SELECT DISTINCT repo_id, ecosystem, package_name FROM dep)"""
_AFF = f"aff AS (SELECT DISTINCT * FROM (SELECT {keys.sql_advisory('osv_id')} AS osv_id, {_E} AS ecosystem, {keys.sql_package(_E, 'package_name')} AS package_name FROM advisory_affects) WHERE package_name IS NOT NULL AND osv_id IS NOT NULL)"
_SEV = "CASE WHEN regexp_extract(lower(severity), '(critical|high|moderate|medium|low)', 1) = 'moderate' THEN 'medium' WHEN regexp_extract(lower(severity), '(critical|high|moderate|medium|low)', 1) <> '' THEN regexp_extract(lower(severity), '(critical|high|moderate|medium|low)', 1) ELSE 'unknown' END"
_ADV = f"""adv AS (SELECT osv_id, s AS severity, withdrawn FROM (SELECT osv_id, s, row_number() OVER (PARTITION BY osv_id ORDER BY loaded_at NULLS FIRST, s) AS k, bool_or(withdrawn_at IS NOT NULL) OVER (PARTITION BY osv_id) AS withdrawn
  FROM (SELECT {keys.sql_advisory('osv_id')} AS osv_id, {_SEV} AS s, loaded_at, withdrawn_at FROM advisory)) WHERE k = 1)"""
_RANK = "CASE {c} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
_MET = f"WITH {_DEP}, {_AFF}, {_ADV}, met AS (SELECT aff.osv_id, rp.repo_id, rp.ecosystem, rp.package_name FROM aff JOIN rp ON aff.ecosystem = rp.ecosystem AND aff.package_name = rp.package_name)"
_FW = "fw AS (SELECT repo_id, ecosystem, package_name, dep_id, spec FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, ecosystem, package_name ORDER BY dep_id) AS k FROM dep) WHERE k = 1)"
_REG = f"reg AS (SELECT {_E} AS ecosystem, {keys.sql_package(_E, 'name')} AS package_name, latest_version, loaded_at FROM registry_package)"
_HEAD = "trim(regexp_split_to_array(trim(spec), '\\s*(?:,|\\|\\|)\\s*')[1])"
_VERSION = scalar.VERSION
_CON = f"""CASE WHEN spec IS NULL OR trim(spec) IN ('', '*', 'latest') OR regexp_matches(trim(spec), '^(https?:|git\\+|file:|workspace:|link:)') OR regexp_extract({_HEAD}, '{_VERSION}', 2) = '' THEN NULL ELSE regexp_extract({_HEAD}, '{_VERSION}', 2) END"""
_PIN = f"(NOT regexp_matches(trim(spec), '[,|]') AND regexp_extract({_HEAD}, '{_VERSION}', 1) IN ('', '=', '=='))"
_MAJOR = "TRY_CAST(nullif(regexp_extract({c}, '(\\d{{1,9}})', 1), '') AS INTEGER)"
_KNOWN_MANIFEST = "CASE " + " ".join(f"WHEN regexp_matches(manifest_path, '{p}') THEN '{e}'" for p, e in scalar.MANIFESTS) + " WHEN manifest_path IS NULL THEN NULL ELSE 'other' END"


def _fk(name: str, child: str, parent: str) -> str:
    return f"SELECT '{name}' AS reference, count(*) AS violations FROM (SELECT DISTINCT k FROM ({child}) WHERE k IS NOT NULL AND k NOT IN ({parent})) HAVING count(*) > 0"


_UP = keys.sql_advisory("osv_id")
QUERIES = {
    "advisory_reach": advisory_reach, "package_reach": package_reach, "widest_advisory": widest_advisory, "busiest_repos": busiest_repos, "fk_violations": fk_violations,
    "first_wins_dedupe": first_wins, "package_inversion": package_inversion, "ranked_packages": ranked_packages, "worst_advisory": worst_advisory, "severity_lists": severity_lists,
    "version_queries": version_queries, "pin_rollup": pin_rollup, "stale_majors": stale_majors, "unresolved_packages": unresolved_packages, "manifest_ecosystems": manifest_ecosystems,
    "advisory_ids_without_detail": advisory_ids_without_detail, "severity_counts": severity_counts, "merged_specs": merged_specs,
}
SQL = {
    "advisory_reach": f"{_MET}, st AS (SELECT repo_id, {_UP} AS osv_id, min(status) AS status FROM repo_advisory GROUP BY 1, 2) SELECT met.osv_id, met.repo_id, ecosystem, package_name, status FROM met LEFT JOIN st ON met.repo_id = st.repo_id AND met.osv_id = st.osv_id",
    "package_reach": f"{_MET}, n AS (SELECT ecosystem, package_name, count(*) AS repos FROM rp GROUP BY 1, 2), w AS (SELECT ecosystem, package_name, count(*) AS n_advisories, min({_RANK.format(c='severity')}) AS worst FROM aff LEFT JOIN adv USING (osv_id) GROUP BY 1, 2) SELECT ecosystem, package_name, repos, coalesce(n_advisories, 0) AS n_advisories, worst FROM n LEFT JOIN w USING (ecosystem, package_name)",
    "widest_advisory": f"{_MET} SELECT osv_id, count(DISTINCT repo_id) AS repos FROM met SEMI JOIN (SELECT osv_id FROM adv WHERE severity = 'high') USING (osv_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "busiest_repos": f"WITH {_DEP} SELECT repo_id, count(*) AS packages FROM rp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "fk_violations": " UNION ALL ".join([
        _fk("dependency.repo_id", "SELECT repo_id AS k FROM dependency", "SELECT id FROM repo"), _fk("repo_advisory.repo_id", "SELECT repo_id AS k FROM repo_advisory", "SELECT id FROM repo"),
        _fk("repo_advisory.osv_id", f"SELECT {_UP} AS k FROM repo_advisory", f"SELECT {_UP} FROM advisory"), _fk("advisory_affects.osv_id", f"SELECT {_UP} AS k FROM advisory_affects", f"SELECT {_UP} FROM advisory"),
        _fk("kin.id", "SELECT id AS k FROM kin", "SELECT id FROM repo"), _fk("kin.neighbour_id", "SELECT neighbour_id AS k FROM kin", "SELECT id FROM repo"),
        _fk("repo.parent_id", "SELECT parent_id AS k FROM repo", "SELECT id FROM repo"), _fk("documents.repo_id", "SELECT repo_id AS k FROM documents", "SELECT id FROM repo"),
    ]),
    "first_wins_dedupe": f"WITH {_DEP}, {_FW} SELECT * FROM fw",
    "package_inversion": f"WITH {_DEP} SELECT ecosystem, package_name, count(*) AS repos, min(repo_id) AS first_repo FROM rp GROUP BY 1, 2",
    "ranked_packages": f"WITH {_DEP}, n AS (SELECT ecosystem, package_name, count(*) AS repos, min(repo_id) AS first_repo FROM rp GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem ORDER BY repos DESC, package_name) AS place FROM n) WHERE place <= 120",
    "worst_advisory": f"{_MET} SELECT repo_id, min({_RANK.format(c='severity')}) AS worst, count(DISTINCT osv_id) AS n_advisories FROM met JOIN adv USING (osv_id) WHERE NOT withdrawn GROUP BY 1",
    "severity_lists": f"{_MET} SELECT repo_id, string_agg(severity, ',' ORDER BY {_RANK.format(c='severity')}) AS severities FROM (SELECT DISTINCT repo_id, osv_id FROM met) JOIN adv USING (osv_id) GROUP BY 1",
    "version_queries": f"WITH {_DEP}, c AS (SELECT ecosystem, package_name, repo_id, CASE WHEN ecosystem = 'go' THEN 'v' || {_CON} ELSE {_CON} END AS version, {_PIN} AS pinned FROM dep), r AS (SELECT ecosystem, package_name, version, repo_id, bool_or(pinned) AS pinned FROM c WHERE version IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT ecosystem, package_name, version, count(*) AS repos, count(*) FILTER (pinned) AS pinned_repos FROM r GROUP BY 1, 2, 3",
    "pin_rollup": f"WITH {_DEP}, {_FW} SELECT repo_id, count(*) FILTER ({_CON} IS NOT NULL AND {_PIN}) AS pinned, count(*) FILTER ({_CON} IS NOT NULL AND NOT {_PIN}) AS ranged, count(*) FILTER ({_CON} IS NULL) AS open FROM fw GROUP BY 1",
    "stale_majors": f"WITH {_DEP}, {_FW}, {_REG}, l AS (SELECT ecosystem, package_name, latest_version AS latest FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, package_name ORDER BY loaded_at DESC NULLS LAST, latest_version DESC) AS k FROM reg WHERE latest_version IS NOT NULL) WHERE k = 1), b AS (SELECT repo_id, ecosystem, package_name, spec, latest, {_MAJOR.format(c='latest')} - {_MAJOR.format(c='spec')} AS behind FROM fw JOIN l USING (ecosystem, package_name)) SELECT * FROM b WHERE behind > 0",
    "unresolved_packages": f"WITH {_DEP}, {_REG} SELECT ecosystem, package_name, count(*) AS repos FROM rp ANTI JOIN reg USING (ecosystem, package_name) WHERE ecosystem IN ('npm', 'pypi') GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 200",
    "manifest_ecosystems": f"WITH {_DEP} SELECT ecosystem, {_KNOWN_MANIFEST} AS by_path, count(*) AS n FROM dep GROUP BY 1, 2",
    "advisory_ids_without_detail": f"SELECT DISTINCT k AS osv_id FROM (SELECT {_UP} AS k FROM repo_advisory UNION ALL SELECT {_UP} FROM advisory_affects) WHERE k IS NOT NULL AND k NOT IN (SELECT {_UP} FROM advisory)",
    "severity_counts": f"WITH {_ADV} SELECT severity, count(*) AS n, count(*) FILTER (withdrawn) AS withdrawn FROM adv GROUP BY 1",
    "merged_specs": f"WITH {_DEP} SELECT repo_id, ecosystem, package_name, dep_id, spec FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, ecosystem, package_name ORDER BY dep_id DESC) AS k FROM dep) WHERE k = 1",
}
