"""Top N items within every group by statistics-guided skipping.

The table is first written clustered by group: a file holds a range of groups, and within a file the
rows of a group lie together, best first. Parquet keeps the least and greatest group and score of
every row group. A reader takes the row groups of a file in descending greatest score and skips,
unread, those whose greatest score is strictly below the N-th score that every contained group
already has.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import new_path

_NAMES = ["g", "item", "score", "second"]


def write_clustered(df: DataFrame, group: str, item: str, score: str, second: str | None, row_group_bytes: int = 1 << 18) -> str:
    """Write the rows that can count, clustered by group and best first; returns the path.

    The rows are dealt by ranges of (group, descending score): a group with a third of all rows
    spreads over as many files as it needs.
    """
    spare = F.col(second).cast("double") if second else F.lit(None).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.when(~F.isnan(spare), spare).alias("second"))
    rows = rows.where("g is not null and item is not null and score is not null and not isnan(score)")
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))
    order = [F.col("g"), F.col("score").desc()]
    path = new_path(df.sparkSession, "top-n")
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.block.size.row.check.min", 256)
        .option("parquet.page.size.row.check.min", 256)
        .parquet(path)
    )
    return path


def _open(path: str):
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return pq.ParquetFile(u.path)
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(where.open_input_file(name))


def _best(t: pa.Table, n: int) -> pa.Table:
    """The first n distinct items of every group, in order."""
    t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("item", "ascending"), ("score", "descending"), ("second", "descending")], null_placement="at_end"))
    if len(t) > 1:
        new = pc.or_(pc.not_equal(t["g"][1:], t["g"][:-1]), pc.not_equal(t["item"][1:], t["item"][:-1]))
        t = t.filter(pa.chunked_array([pa.array([True]), *new.chunks]))
    t = t.take(pc.sort_indices(t, sort_keys=[("g", "ascending"), ("score", "descending"), ("second", "descending"), ("item", "ascending")], null_placement="at_end"))
    return t.filter(pc.less_equal(_places(t["g"]), n))


def _places(g: pa.ChunkedArray) -> pa.Array:
    """1, 2, ... within runs of equal values."""
    if not len(g):
        return pa.array([], pa.int64())
    at = np.arange(len(g))
    new = np.concatenate([[True], pc.not_equal(g[1:], g[:-1]).to_numpy()]) if len(g) > 1 else np.array([True])
    return pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) + 1)


class _Bests:
    """What has been kept so far, and every full group's N-th score."""

    def __init__(self, n: int):
        self.n, self.kept, self.waiting, self.rows = n, None, [], 0
        self.full, self.nth = None, np.array([])

    def add(self, t: pa.Table) -> None:
        self.waiting.append(t)
        self.rows += len(t)
        if self.rows >= max(50_000, 0 if self.kept is None else len(self.kept)):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        self.kept = _best(pa.concat_tables(([self.kept] if self.kept is not None else []) + self.waiting), self.n)
        self.waiting, self.rows = [], 0
        last = self.kept.filter(pc.equal(_places(self.kept["g"]), self.n))
        self.full, self.nth = last["g"].combine_chunks(), last["score"].to_numpy()

    def beaten(self, groups: pa.Array, most: float) -> bool:
        """Whether every one of the groups already has N items, all above ``most``."""
        if self.full is None or not len(self.full):
            return False
        at = pc.index_in(groups, value_set=self.full)
        return at.null_count == 0 and bool((self.nth[at.to_numpy()] > most).all())


def _read(n: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                f, bests, skipped = _open(path), _Bests(n), 0
                names = f.schema_arrow.names
                g, s = names.index("g"), names.index("score")
                parts = []
                for i in range(f.num_row_groups):
                    m = f.metadata.row_group(i)
                    groups, scores = m.column(g).statistics, m.column(s).statistics
                    known = groups is not None and groups.has_min_max and scores is not None and scores.has_min_max
                    parts.append((-scores.max if known else -np.inf, i, groups.min if known and groups.min == groups.max else None))
                for most, i, only in sorted(parts, key=lambda p: p[:2]):
                    if bests.full is not None or bests.waiting:
                        if only is not None or i % 8 == 0:
                            bests.settle()
                        held = pa.array([only], f.schema_arrow.field("g").type) if only is not None else None
                        if held is None and bests.full is not None and len(bests.full) and bests.nth.max() > -most:
                            held = pc.unique(f.read_row_group(i, columns=["g"])["g"])
                        if held is not None and bests.beaten(held, -most):
                            skipped += 1
                            continue
                    bests.add(f.read_row_group(i, columns=_NAMES))
                if counts:
                    yield pa.RecordBatch.from_pydict({"row_groups": [f.num_row_groups], "skipped": [skipped], "row_count": [f.metadata.num_rows]}, schema=pa.schema([("row_groups", pa.int64()), ("skipped", pa.int64()), ("row_count", pa.int64())]))
                    continue
                bests.settle()
                if bests.kept is not None:
                    yield from bests.kept.select(_NAMES).combine_chunks().to_batches(max_chunksize=20_000)

    return run


def _files(df: DataFrame, path: str) -> DataFrame:
    """One row for each file of a written table, spread over tasks."""
    spark = df.sparkSession
    files = sorted(spark.read.parquet(path).inputFiles())
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)), "path")


def top_n(df: DataFrame, group: str, item: str, score: str, second: str | None = None, n: int = 5, layout: str | None = None) -> DataFrame:
    """``group, place, item, score, second``: the first n distinct items of every group.

    Order: ``score`` descending, ``second`` descending with null last, ``item`` ascending; an item
    counts once, with its row of highest score, then highest second. The result columns keep the
    given names. ``layout`` is where write_clustered put the same table before: kept as a table, it
    answers any n without a row being shuffled again, which is where skipping saves reading; ``df``
    then only gives the types.

    Defined cases: rows with a null group, item or score, or a NaN score, don't count; a NaN second
    is null; a group with fewer than n items keeps them all; equal rows count once; an empty table
    gives no rows. Only the named columns are read, so others can't clash. -0.0 equals 0.0.
    """
    names = [group, "place", item, score] + ([second] if second else [])
    kinds = dict(df.dtypes)
    files = _files(df, layout or write_clustered(df, group, item, score, second))
    best = files.mapInArrow(_read(n, False), f"g {kinds[group]}, item {kinds[item]}, score double, second double")
    # A group that spans files has at most n rows from each; merge them.
    once = best.groupBy("g", "item").agg(F.max(F.struct("score", F.coalesce(F.col("second"), F.lit(float("-inf"))).alias("rank"), "second")).alias("b"))
    order = Window.partitionBy("g").orderBy(F.col("b.score").desc(), F.col("b.second").desc_nulls_last(), F.col("item"))
    placed = once.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)
    out = placed.select(F.col("g"), F.col("place"), F.col("item"), F.col("b.score"), F.col("b.second"))
    return out.select(*[F.col(c).alias(name) for c, name in zip(["g", "place", "item", "score", "second"], names)])


def skipping(df: DataFrame, group: str, item: str, score: str, second: str | None = None, n: int = 5) -> DataFrame:
    """``row_groups, skipped, row_count`` per file: how much top_n leaves unread."""
    path = write_clustered(df, group, item, score, second)
    return _files(df, path).mapInArrow(_read(n, True), "row_groups long, skipped long, row_count long")
