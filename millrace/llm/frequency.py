"""Frequency of every distinct value: occurrences, records with it, and a mark on the useless.

A global integer dictionary gives every value a number; blocks of rows count into arrays indexed by
number; the arrays are summed by ranges of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import lookup_join
from millrace.session import saved

#: Values whose counts lie in one array.
RANGE = 4096


def dictionary(counted: DataFrame, values: list[str]) -> DataFrame:
    """Values numbered 0, 1, ... in order: ``values..., pairs, term_no``.

    ``counted`` has one row per value with ``pairs``, its number of rows. The rows are sorted by
    range across tasks; a task's offset is the number of values before it: a table of one row a task.
    """
    ordered = saved(counted.repartitionByRange(*values).sortWithinPartitions(*values).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "dictionary")
    parts = ordered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_offset"))
    # One row a task, so it may be broadcast.
    return ordered.join(F.broadcast(offsets), "_part").select(*values, "pairs", (F.col("_id") + F.col("_offset")).alias("term_no"))


_SCHEMA = pa.schema([("range_no", pa.int64()), ("at", pa.list_(pa.int32())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_DDL = "range_no long, at array<int>, occurrences array<long>, records array<long>"


def _arrays(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The non-zero part of each range's arrays, so that what is shuffled never exceeds the rows counted."""
    if not held:
        return
    used = {r: np.flatnonzero(rec) for r, (_, rec) in held.items()}
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in used.values()])]).astype(np.int32))
    lists = lambda parts, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(used), pa.int64()),
            lists(list(used.values()), pa.int32()),
            lists([held[r][0][at] for r, at in used.items()], pa.int64()),
            lists([held[r][1][at] for r, at in used.items()], pa.int64()),
        ],
        schema=_SCHEMA,
    )


def _count_block(limit: int):
    """Counts of a task's rows, in arrays by range; arrays leave when ``limit`` of them are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            no, n = b.column("term_no").to_numpy(), b.column("n").to_numpy()
            order = np.argsort(no, kind="stable")
            no, n = no[order], n[order]
            cuts = np.flatnonzero(np.diff(no // RANGE)) + 1
            for part, times in zip(np.split(no, cuts), np.split(n, cuts)):
                if not len(part):
                    continue
                r = int(part[0]) // RANGE
                if r not in held:
                    if len(held) >= limit:
                        yield from _arrays(held)
                        held = {}
                    held[r] = (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64))
                held[r][0][:] += np.bincount(part - r * RANGE, weights=times, minlength=RANGE).astype(np.int64)
                held[r][1][:] += np.bincount(part - r * RANGE, minlength=RANGE)
        yield from _arrays(held)

    return run


def _sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up arrays of equal range and gives each number its counts."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for r, at, occ, rec in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
            if r not in held:
                held[r] = (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64))
            where = at.values.to_numpy()
            held[r][0][where] += occ.values.to_numpy()
            held[r][1][where] += rec.values.to_numpy()
    for r, (o, p) in held.items():
        at = np.flatnonzero(p)
        yield pa.RecordBatch.from_arrays([pa.array(at + r * RANGE), pa.array(o[at]), pa.array(p[at])], names=["term_no", "occurrences", "records"])


def value_frequencies(rows: DataFrame, record: str, values: list[str], rare_below: int = 2, common_share: float = 0.2, held: int = 512) -> DataFrame:
    """``values..., occurrences, records, mark`` for every distinct value.

    ``occurrences`` counts rows, ``records`` distinct records. ``mark`` is ``rare`` with fewer than
    ``rare_below`` records, else ``common`` with more than ``common_share`` of all distinct records
    that have any value, else null.

    Defined cases: rows with a null record or a null in any of ``values`` don't count; an empty
    value is a value; repeated rows are occurrences but one record; an empty table gives no rows.
    Only the named columns are read, so others can't clash. Ties don't arise.

    Plan: rows are counted per (record, value) with map-side combining, which no hot value or record
    can skew. Values get their numbers by a join in which heavy values are broadcast; then only
    arrays are shuffled: ``held`` at a time by each task, summed where their range lives.
    """
    names, values = values, [f"_value{i}" for i in range(len(values))]
    given = rows.select(F.col(record).alias("record"), *[F.col(n).alias(v) for n, v in zip(names, values)]).where(F.col("record").isNotNull()).dropna(subset=values)
    pairs = saved(given.groupBy("record", *values).agg(F.count("*").alias("n")), "value-pairs")
    terms = dictionary(pairs.groupBy(*values).agg(F.count("*").alias("pairs")), values)
    encoded = lookup_join(pairs.select(*values, "n"), terms, values, "pairs", pairs.count()).select("term_no", "n")
    blocks = encoded.mapInArrow(_count_block(held), _DDL)
    # A width of its own: the array exchange must not shrink to so few tasks that sums fill memory.
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    summed = blocks.repartition(width, "range_no").mapInArrow(_sum_arrays, "term_no long, occurrences long, records long")
    everyone = pairs.select("record").distinct().count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_share) * everyone, "common")
    return summed.join(terms.drop("pairs"), "term_no").select(*[F.col(v).alias(n) for n, v in zip(names, values)], "occurrences", "records", mark.alias("mark"))
