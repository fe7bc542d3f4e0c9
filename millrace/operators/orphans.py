"""References to records that do not exist: missing, deleted, or there only later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import saved


@dataclass(frozen=True)
class Reference:
    """A foreign key: rows of ``refs`` point at rows of ``parents``.

    ``key`` and ``parent_key`` are expressions over the respective table that give the same text
    form; a null key refers to nothing. ``seen_at``, ``there_at`` and ``gone_at`` are timestamp
    expressions, any of which may be null in a row.
    """

    name: str
    refs: DataFrame
    key: Column
    seen_at: Column
    parents: DataFrame
    parent_key: Column
    there_at: Column
    gone_at: Column


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_references(references: Sequence[Reference]) -> DataFrame:
    """Every key of every table and month that points at nothing, with the reason and its counts.

    Result: ``ref_table, period, ref_key, reason, n_rows, first_seen, last_seen``, one row for each
    table, month, key and reason. ``missing``: no parent row has the key at all. ``late``: some row
    of that month was seen before its parent's earliest ``there_at``. ``deleted``: some row not late
    was seen at or after its parent's earliest non-null ``gone_at``. ``n_rows``, ``first_seen`` and
    ``last_seen`` describe all rows of that key in that month.

    Defined cases: null keys are no references; an empty key is one. A row without ``seen_at`` has
    the period ``unknown`` and can only be missing. A parent without any ``there_at`` was always
    there. Repeated rows count in ``n_rows`` and give no further result rows. An empty ``refs``
    gives no rows, an empty ``parents`` makes every key missing. Other columns are never read, so
    their names can't clash.

    Plan: rows are first reduced to one for each table, key and month with map-side aggregation.
    The earliest and latest moment of a month decide all three reasons exactly, so a key that has a
    third of all rows is as many rows as it has months before anything is joined. Then one
    anti-join of the distinct keys against the parents' keys, joined back for the counts.
    """
    parents = _union(
        [
            r.parents.select(F.lit(r.name).alias("ref_table"), r.parent_key.alias("ref_key"), r.there_at.alias("there"), r.gone_at.alias("gone"))
            for r in references
        ]
    )
    parents = (
        parents.where(F.col("ref_key").isNotNull())
        .groupBy("ref_table", "ref_key")
        .agg(F.min("there").alias("there"), F.min("gone").alias("gone"))
    )
    rows = _union([r.refs.select(F.lit(r.name).alias("ref_table"), r.key.alias("ref_key"), r.seen_at.alias("seen")) for r in references])
    rows = rows.where(F.col("ref_key").isNotNull()).withColumn("period", F.coalesce(F.date_format("seen", "yyyy-MM"), F.lit("unknown")))
    on = ["ref_table", "ref_key"]
    by_month = saved(
        rows.groupBy(*on, "period").agg(F.count("*").alias("n_rows"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")), "orphan-months"
    )

    absent = by_month.select(*on).distinct().join(parents, on, "left_anti")
    missing = by_month.join(absent, on, "left_semi").withColumn("reason", F.lit("missing"))

    late = F.col("first_seen") < F.col("there")
    deleted = (F.col("last_seen") >= F.col("gone")) & (F.col("there").isNull() | (F.col("last_seen") >= F.col("there")))
    reasons = F.filter(F.array(F.when(late, F.lit("late")), F.when(deleted, F.lit("deleted"))), lambda x: x.isNotNull())
    untimely = by_month.where(F.col("first_seen").isNotNull()).join(parents, on).where(late | deleted).withColumn("reason", F.explode(reasons))
    columns = ["ref_table", "period", "ref_key", "reason", "n_rows", "first_seen", "last_seen"]
    return missing.select(*columns).unionByName(untimely.select(*columns))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, period and reason: distinct keys, and rows of those keys in that period."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))
