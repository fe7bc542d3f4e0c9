"""p2: orphan references of dependency, repo_advisory and advisory_affects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators.orphans import Reference, orphan_references, orphan_report
from millrace.session import table


def _references(spark: SparkSession, root: str) -> list[Reference]:
    c = F.col
    eco = keys.ecosystem(c("ecosystem"))
    package = lambda name: F.when(eco.isNotNull() & c(name).isNotNull(), F.concat(eco, F.lit(":"), keys.package(eco, c(name))))
    return [
        Reference(
            "dependency", table(spark, root, "dependency", "repo_id", "seen_at"), c("repo_id").cast("string"), c("seen_at"),
            table(spark, root, "repo", "id", "loaded_at", "deleted_at"), c("id").cast("string"), c("loaded_at"), c("deleted_at"),
        ),
        Reference(
            "repo_advisory", table(spark, root, "repo_advisory", "osv_id", "seen_at"), keys.advisory(c("osv_id")), c("seen_at"),
            table(spark, root, "advisory", "osv_id", "loaded_at", "withdrawn_at"), keys.advisory(c("osv_id")), c("loaded_at"), c("withdrawn_at"),
        ),
        Reference(
            "advisory_affects", table(spark, root, "advisory_affects", "ecosystem", "package_name", "seen_at"), package("package_name"), c("seen_at"),
            table(spark, root, "registry_package", "ecosystem", "name", "loaded_at", "removed_at"), package("name"), c("loaded_at"), c("removed_at"),
        ),
    ]


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return orphan_references(_references(spark, root)).select("ref_table", "period", "ref_key", "reason")


def p2_orphan_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(orphan_references(_references(spark, root)))


_ECO = keys.sql_ecosystem("ecosystem")
_ROWS = f"""
WITH refs AS (
  SELECT 'dependency' AS ref_table, CAST(repo_id AS VARCHAR) AS ref_key, epoch_us(seen_at) AS seen FROM dependency
  UNION ALL SELECT 'repo_advisory', {keys.sql_advisory('osv_id')}, epoch_us(seen_at) FROM repo_advisory
  UNION ALL SELECT 'advisory_affects', {_ECO} || ':' || {keys.sql_package(_ECO, 'package_name')}, epoch_us(seen_at) FROM advisory_affects
), parents AS (
  SELECT ref_table, ref_key, min(there) AS there, min(gone) AS gone FROM (
    SELECT 'dependency' AS ref_table, CAST(id AS VARCHAR) AS ref_key, epoch_us(loaded_at) AS there, epoch_us(deleted_at) AS gone FROM repo
    UNION ALL SELECT 'repo_advisory', {keys.sql_advisory('osv_id')}, epoch_us(loaded_at), epoch_us(withdrawn_at) FROM advisory
    UNION ALL SELECT 'advisory_affects', {_ECO} || ':' || {keys.sql_package(_ECO, 'name')}, epoch_us(loaded_at), epoch_us(removed_at) FROM registry_package
  ) GROUP BY 1, 2
), judged AS (
  SELECT r.ref_table, coalesce(strftime(make_timestamp(r.seen), '%Y-%m'), 'unknown') AS period, r.ref_key,
    CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN r.seen < p.there THEN 'late' WHEN r.seen >= p.gone THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN parents p ON r.ref_table = p.ref_table AND r.ref_key = p.ref_key WHERE r.ref_key IS NOT NULL
)"""

QUERIES = {"p2_found": p2_found, "p2_orphan_report": p2_orphan_report}
SQL = {
    "p2_found": _ROWS + "\nSELECT DISTINCT ref_table, period, ref_key, reason FROM judged WHERE reason IS NOT NULL",
    "p2_orphan_report": _ROWS
    + """, months AS (SELECT ref_table, period, ref_key, count(*) AS n FROM judged GROUP BY ALL),
hits AS (SELECT DISTINCT ref_table, period, ref_key, reason FROM judged WHERE reason IS NOT NULL)
SELECT h.ref_table, h.period, h.reason, count(*) AS n_keys, CAST(sum(m.n) AS BIGINT) AS n_rows
FROM hits h JOIN months m ON h.ref_table = m.ref_table AND h.period = m.period AND h.ref_key = m.ref_key GROUP BY 1, 2, 3""",
}
