"""Ranked, budgeted and incremental shapes over plain relations. Ties always end on a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import saved


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows of each group; a window group limit runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w).cast("long")).where(F.col(place) <= k)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: of rows with equal key the first in load order stays, all its columns with it.

    An aggregate with map-side combining, not a window, so repeated keys are thinned before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_wins(old: DataFrame, new: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Upsert: the row of the greatest version of each key, from either side."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*both.columns)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the running total of ``value`` within each group, the row itself included; ``order`` is total.

    No group has to fit a task: rows are dealt by ranges of group and order, totals run inside each
    range, and what came before is added from one small row per group and range. Groups may be null.
    """
    keys = [F.col(c) for c in by]
    ranged = saved(df.withColumn(name, value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(F.sum(name).alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    run = ranged.withColumn(name, F.sum(name).over(inside)).alias("r").join(parts.alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, "_part"]])
    return run.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col(f"r.{name}") + F.col("p._n")).alias(name))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], place: str = "place") -> DataFrame:
    """Rows numbered 1, 2, ... within each group of any size, in a total order."""
    return running_sum(df, by, order, F.lit(1).cast("long"), place)


def interleave(df: DataFrame, group: str, order: Sequence[Column], place: str = "turn") -> DataFrame:
    """Round robin: every group's first row, then every group's second, and so on."""
    return numbered(df, [group], order, place).orderBy(place, group)


def within_budget(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group, in a total order, as long as their running total stays within the budget."""
    return running_sum(df, by, order, F.coalesce(F.col(size), F.lit(0)), "_spent").where(F.col("_spent") <= budget).drop("_spent")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 10) -> DataFrame:
    """The ``number``-th page (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def stratified(df: DataFrame, strata: Column, shares: dict[str, float], n: int, seed: int, key: str) -> DataFrame:
    """About ``n`` rows with the given share from each stratum, drawn by a seeded hash.

    The largest share bounds what any stratum sends, so a group limit runs before the shuffle.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    ranked = df.withColumn("_s", strata).withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy(drawn, key)))
    keep = F.lit(False)
    for name, share in shares.items():
        keep = keep | ((F.col("_s") == name) & (F.col("_k") <= round(n * share)))
    return ranked.where(F.col("_k") <= round(n * max(shares.values()))).where(keep).drop("_k").withColumnRenamed("_s", "stratum")


def undirected(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Each undirected edge once, loops dropped, with its greatest weight."""
    e = edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias(src), F.greatest(src, dst).alias(dst), weight)
    return e.groupBy(src, dst).agg(F.max(weight).alias(weight))


def both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Every edge in both directions."""
    return edges.unionByName(edges.withColumnsRenamed({src: "_t", dst: src}).withColumnRenamed("_t", dst))


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """Values at nearest-rank percentiles, one column ``p0, p1, ...`` for each share.

    The aggregate keeps counts per distinct value, combined before the shuffle.
    """
    return df.where(F.col(value).isNotNull()).selectExpr(*[f"percentile_disc({s}) within group (order by {value}) as p{i}" for i, s in enumerate(shares)])


def min_max(df: DataFrame, columns: Sequence[str], places: int = 4) -> DataFrame:
    """Columns scaled to [0, 1] over the whole table; a constant column becomes 0."""
    from millrace.functions.scalar import half_up

    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    scaled = {}
    for c in columns:
        low, high = ends[f"lo_{c}"], ends[f"hi_{c}"]
        flat = low is None or high <= low
        scaled[c] = F.when(F.col(c).isNotNull(), F.lit(0.0) if flat else half_up((F.col(c) - F.lit(low)) / F.lit(high - low), places))
    return df.withColumns(scaled)


def missing_references(child: DataFrame, key: Sequence[str], parent: DataFrame, parent_key: Sequence[str]) -> DataFrame:
    """Foreign keys (non-null, distinct) that no parent row has: empty when the reference is sound."""
    refs = child.select(*[F.col(c) for c in key]).dropna().distinct()
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, key)]).distinct()
    return refs.join(known, list(key), "left_anti")


def due(items: DataFrame, done: DataFrame, key: str, version: int, as_of: Column, days: int) -> DataFrame:
    """Items never done, done by another version, or last done ``days`` or more before ``as_of``."""
    fresh = done.where((F.col("version") == version) & (F.col("done_at") > as_of - F.expr(f"interval {days} days"))).select(key)
    return items.join(fresh, key, "left_anti")


def quota(retries: DataFrame, fresh: DataFrame, order: Sequence[Column], most: int, share: float = 0.3) -> DataFrame:
    """A run's batch: at most ``share`` of ``most`` retried items, the rest fresh ones, each in order."""
    again = retries.orderBy(*order).limit(int(most * share))
    return again.withColumn("retry", F.lit(True)).unionByName(fresh.orderBy(*order).limit(most - int(most * share)).withColumn("retry", F.lit(False)))


def ranked_reads(tree: DataFrame, wanted: Sequence[tuple[str, int]], budget: int = 20) -> DataFrame:
    """The files of each repository to read first, ``budget`` of them.

    ``wanted``: pattern and the most files of it, in order of importance; a file counts under the first
    pattern that it matches.
    """
    kind = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(wanted))):
        kind = F.when(F.col("path").rlike(pattern), i).otherwise(kind)
    most = F.element_at(F.array(*[F.lit(n) for _, n in wanted]), F.col("kind") + 1)
    t = tree.withColumn("kind", kind).where("kind is not null")
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id", "kind").orderBy("path"))).where(F.col("_k") <= most)
    return t.withColumn("turn", F.row_number().over(Window.partitionBy("repo_id").orderBy("kind", "path"))).where(F.col("turn") <= budget).drop("_k")
