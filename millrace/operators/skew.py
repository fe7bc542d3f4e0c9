"""Joins that hold when one key has a third of all rows.

A *heavy* key has at least ``1 / HEAVY_KEYS`` of the rows, so there can never be more than
``HEAVY_KEYS`` of them: the only broadcasts here are of that proven size. All other keys together
hash evenly, as none of them can fill a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that can be heavy, by the pigeonhole principle.
HEAVY_KEYS = 10_000


def heavy_keys(counts: DataFrame, count: str, total: int, least: int = 1000) -> DataFrame:
    """Rows of ``counts`` (one per key) with at least 1/HEAVY_KEYS of ``total`` and ``least`` rows."""
    return counts.where(F.col(count) >= F.lit(max(least, -(-total // HEAVY_KEYS))))


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a dimension that has one row per key and the key's row count.

    Heavy keys meet a broadcast of their few dimension rows and are never shuffled; the rest is
    an ordinary shuffle join.
    """
    hot = heavy_keys(dim, count, total)
    many = F.broadcast(hot)
    head = df.join(many, list(on))
    rest = df.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(dim, list(on))
    return head.select(*rest.columns).unionByName(rest)


def self_pairs(df: DataFrame, on: Sequence[str], ident: str, keep: Column, total: int, block: int = 2000) -> DataFrame:
    """Each pair of rows with equal ``on`` and different ``ident`` for which ``keep`` holds, once.

    ``keep`` is symmetric and speaks of the aliases ``a`` and ``b``; which of the two rows is
    ``a`` is not defined, so callers order the pair themselves. The rows of a heavy key are dealt into blocks
    of about ``block`` rows and block is joined with block, so no task holds a whole heavy group.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = F.broadcast(heavy_keys(counts, "_n", total, 4 * block))
    rows = df.join(hot, list(on), "left").withColumn("_k", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")).drop("_n")
    rows = rows.withColumn("_i", F.pmod(F.xxhash64(ident), F.col("_k")).cast("int"))
    # A row of block i stands on the left against blocks j >= i and on the right against blocks j <= i.
    left = rows.withColumn("_j", F.explode(F.sequence("_i", F.col("_k") - 1))).withColumnRenamed("_i", "_bi").withColumnRenamed("_j", "_bj")
    right = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), "_i"))).withColumnRenamed("_j", "_bi").withColumnRenamed("_i", "_bj")
    a, b = left.drop("_k").alias("a"), right.drop("_k").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*on, "_bi", "_bj"]]
    on_all = same[0]
    for c in same[1:]:
        on_all = on_all & c
    ordered = (F.col(f"a.{ident}") < F.col(f"b.{ident}")) | ((F.col("a._bi") < F.col("b._bj")) & (F.col(f"a.{ident}") != F.col(f"b.{ident}")))
    return a.join(b, on_all & ordered & keep)


def dealt_join(many: DataFrame, few: DataFrame, on: Sequence[str], ident: str, block: int = 100_000) -> DataFrame:
    """Inner join on keys that repeat on both sides; a key with more than ``block`` rows of ``many`` is dealt.

    Its rows of ``many`` go to as many places as it has blocks, by a hash of ``ident``, and its rows of
    ``few`` to each of them, so no task gets a hot key whole. No name may begin with an underscore.
    """
    counts = many.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("_k")).where("_k > 1")
    # Keys above a block each: at most as many as there are blocks of rows.
    places = F.coalesce("_k", F.lit(1))
    left = many.join(counts, list(on), "left").withColumn("_i", F.pmod(F.xxhash64(ident), places).cast("int")).drop("_k")
    right = few.join(counts, list(on), "left").withColumn("_i", F.explode(F.sequence(F.lit(0), places - 1))).drop("_k")
    return left.join(right, [*on, "_i"]).drop("_i")
