"""All similar pairs between set-valued records: a size-aware overlap join.

Sets up to a size ``x`` enumerate their subsets of exactly the size that a partner would have to
share, so that equal subsets are similar pairs and nothing else is looked at. Larger sets scan the
inverted lists of their rarest values. Both give candidate pairs, which are united and filtered by
their true similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import lookup_join, self_pairs
from millrace.session import saved


@dataclass(frozen=True)
class Overlap:
    """Jaccard similarity of at least ``num / den``, kept in whole numbers."""

    num: int
    den: int

    def needed(self, n: int, m: int) -> int:
        """Values that sets of ``n`` and ``m`` must share."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def partners(self, n: int) -> range:
        """Sizes that a set of ``n`` can pair with."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def needed_col(self, n: Column, m: Column) -> Column:
        both = self.num + self.den
        return F.floor((F.lit(self.num) * (n + m) + F.lit(both - 1)) / F.lit(both)).cast("int")

    def subset_sizes(self, n: int, least: int, x: int) -> list[int]:
        """Subset sizes by which a small set of ``n`` meets small partners."""
        return sorted({self.needed(n, m) for m in self.partners(n) if least <= m <= x})

    def boundary(self, least: int, budget: int) -> int:
        """The largest size, 64 at most, up to which no set enumerates more than ``budget`` subsets."""
        x = least
        while x < 64 and all(sum(comb(n, c) for c in self.subset_sizes(n, least, x + 1)) <= budget for n in range(least, x + 2)):
            x += 1
        return x


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; sums of mixed values are order-free hashes of subsets."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _subsets(rule: Overlap, least: int, x: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = {(n, c): np.array(list(combinations(range(n), c))) for n in range(least, x + 1) for c in rule.subset_sizes(n, least, x)}
        for b in batches:
            sizes = b.column("size").to_numpy()
            values, starts = b.column("tokens").flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mixed, classes = _mix(values), b.column("class_no").to_numpy()
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                own = mixed[starts[rows][:, None] + np.arange(n)]
                for c in rule.subset_sizes(int(n), least, x):
                    keys = _mix(own[:, picks[int(n), c]].sum(axis=2) + np.uint64(c))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel().view(np.int64)),
                            pa.array(np.repeat(classes[rows], keys.shape[1])),
                            pa.array(np.full(keys.size, n, np.int32)),
                            pa.array(np.full(keys.size, c, np.int32)),
                        ],
                        names=["key", "class_no", "size", "c"],
                    )

    return run


@dataclass(frozen=True)
class SetClasses:
    """``members``: record, class_no, copies, lowest. ``sets``: class_no, size, tokens, copies, lowest. ``giants``: class_no, size, copies, token."""

    members: DataFrame
    sets: DataFrame
    giants: DataFrame | None
    heads: DataFrame


def set_classes(rows: DataFrame, record: str, values: list[str], least: int, giant: int = 50_000, rule: Overlap = Overlap(1, 1), ranked: bool = True) -> SetClasses:
    """Distinct value sets of records, equal sets once.

    Rows with a null record or a null value (any of ``values``) count for nothing; repeated rows
    count once; records with fewer than ``least`` values are left out. Values are compared by a
    64-bit hash; the chance that any two of a billion values meet is about 3 in 100. Equal sets are
    told by their size and order-free sums of their values' hashes, so copies go before any set is
    gathered. Sets of more than ``giant`` values are never gathered into one row, but stay in long
    form as ``giants`` (None if there are none), together with those that ``rule`` lets be their
    partners. ``heads``, one row per class, has all classes: class_no, size, copies, lowest. Tokens
    stand rarest first, which class_pairs asks for, or with ``ranked`` false in any order.
    """
    given = rows.where(F.col(record).isNotNull())
    for v in values:
        given = given.where(F.col(v).isNotNull())
    pairs = saved(given.select(F.col(record).alias("record"), F.xxhash64(*values).alias("token")).distinct(), "set-pairs")
    h = F.xxhash64("token")
    per_record = pairs.groupBy("record").agg(
        F.count("*").alias("size"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("low"), F.bit_xor(F.xxhash64("token", F.lit(1))).alias("mixed")
    )
    sign = ["size", "high", "low", "mixed"]
    per_record = per_record.where(F.col("size") >= least)
    heads = per_record.groupBy(*sign).agg(F.count("*").alias("copies"), F.min("record").alias("lowest"))
    heads = saved(heads.withColumn("class_no", F.monotonically_increasing_id()), "set-classes")
    # A set which a third of the records share meets a broadcast.
    members = saved(lookup_join(per_record, heads, sign, "copies", pairs.count()).select("record", "class_no", "copies", "lowest"), "set-members")
    one = heads.select(F.col("lowest").alias("record"), "class_no", "size", "copies")
    own = lookup_join(pairs, one, ["record"], "size", pairs.count()).select("class_no", "size", "copies", "token")
    some = bool(heads.where(F.col("size") > giant).limit(1).count())
    giants = own.where(F.col("size") > giant * rule.num // rule.den) if some else None
    small = own.where(F.col("size") <= giant)

    if ranked:
        # Rarest first: a value's frequency decides its place, its hash breaks ties.
        small = saved(small.select("class_no", "token"), "set-tokens")
        df = small.groupBy("token").agg(F.count("*").alias("df"))
        placed = lookup_join(small, df, ["token"], "df", small.count())
        gathered = placed.groupBy("class_no").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).select("class_no", F.col("t.token").alias("tokens"))
    else:
        gathered = small.groupBy("class_no").agg(F.collect_list("token").alias("tokens"))
    sets = saved(gathered.join(heads.select("class_no", F.col("size").cast("int").alias("size"), "copies", "lowest"), "class_no"), "sets")
    return SetClasses(members, sets.select("class_no", "size", "tokens", "copies", "lowest"), giants, heads.select("class_no", "size", "copies", "lowest"))


def class_pairs(sets: DataFrame, rule: Overlap, least: int, budget: int = 64) -> DataFrame:
    """Pairs of different value sets that are similar: ``class_a < class_b`` and their overlap.

    ``sets`` comes from set_classes. ``budget`` bounds the subsets that one small set enumerates and
    so sets the boundary between small and large; it moves work, never results.
    """
    x = rule.boundary(least, budget)
    sets = sets.select("class_no", "size", "tokens", "copies")
    n, m = F.col("a.size"), F.col("b.size")
    small = sets.where(F.col("size") <= x).select("class_no", "size", "tokens")
    keys = saved(small.mapInArrow(_subsets(rule, least, x), "key long, class_no long, size int, c int"), "subset-keys")
    ordered = [F.least("a.class_no", "b.class_no").alias("class_a"), F.greatest("a.class_no", "b.class_no").alias("class_b")]
    from_small = self_pairs(keys, ["key"], "class_no", F.col("a.c") == rule.needed_col(n, m), keys.count()).select(*ordered)

    # A partner shares one of the values left over after the overlap that its size demands at least.
    prefix = F.expr(f"size - cast(ceil(size * {rule.num} / {rule.den}) as int) + 1")
    low = rule.partners(x + 1).start
    lists = saved(
        sets.where(F.col("size") >= low).select("class_no", "size", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "token")), "set-lists"
    )
    room = F.least(n - F.col("a.pos"), m - F.col("b.pos"))
    fits = (F.greatest(n, m) > x) & (room >= rule.needed_col(n, m)) & (F.least(n, m) * rule.den >= F.greatest(n, m) * rule.num)
    from_large = self_pairs(lists, ["token"], "class_no", fits, lists.count()).select(*ordered)

    found = from_small.unionByName(from_large).distinct()
    side = lambda x: sets.select(F.col("class_no").alias(f"class_{x}"), F.col("tokens").alias(f"t_{x}"), F.col("copies").alias(f"copies_{x}"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return (
        found.join(side("a"), "class_a")
        .join(side("b"), "class_b")
        .where(shared >= rule.needed_col(F.size("t_a"), F.size("t_b")))
        .select("class_a", "class_b", "copies_a", "copies_b")
    )


def _giant_pairs(giants: DataFrame, rule: Overlap, giant: int) -> DataFrame:
    """Pairs of classes with one too large for one row, counted in long form; hot values meet in blocks."""
    giants = saved(giants, "set-giants")
    n, m = F.col("a.size"), F.col("b.size")
    fits = (F.greatest(n, m) > giant) & (F.least(n, m) * rule.den >= F.greatest(n, m) * rule.num)
    both = self_pairs(giants, ["token"], "class_no", fits, giants.count())
    first = F.col("a.class_no") < F.col("b.class_no")
    ordered = [F.when(first, F.struct(f"{p}.class_no", f"{p}.size", f"{p}.copies")).otherwise(F.struct(f"{q}.class_no", f"{q}.size", f"{q}.copies")).alias(p) for p, q in (("a", "b"), ("b", "a"))]
    counted = both.select(*ordered).groupBy("a", "b").count().where(F.col("count") >= rule.needed_col(n, m))
    return counted.select(F.col("a.class_no").alias("class_a"), F.col("b.class_no").alias("class_b"), F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"))


def _class_links(classes: SetClasses, rule: Overlap, least: int, budget: int, giant: int) -> DataFrame:
    """Similar pairs of different classes, ``class_a < class_b``, with the copies of each."""
    links = class_pairs(classes.sets, rule, least, budget)
    return links if classes.giants is None else links.unionByName(_giant_pairs(classes.giants, rule, giant))


def similar_sets(rows: DataFrame, record: str, values: list[str], rule: Overlap, least: int = 1, budget: int = 64, giant: int = 50_000, block: int = 2000) -> DataFrame:
    """``record_a < record_b``: every pair of records whose value sets are similar enough.

    Defined cases: null records and null values count for nothing, repeated rows once, an empty
    table gives no pairs, records with fewer than ``least`` distinct values none; ties don't arise.
    Only ``record`` and ``values`` are read, so other columns can't clash. Equal sets are compared
    once, as a class, and spread out to pairs of records at the end, classes of more than ``block``
    records in blocks.
    """
    classes = set_classes(rows, record, values, least, giant, rule)
    links = _class_links(classes, rule, least, budget, giant)
    blocks = lambda copies: F.floor((F.col(copies) - 1) / block).cast("int")
    for x in ("a", "b"):
        links = links.withColumn(f"k_{x}", F.explode(F.sequence(F.lit(0), blocks(f"copies_{x}"))))
    who = classes.members.select("record", "class_no", F.pmod(F.xxhash64("record"), blocks("copies") + 1).cast("int").alias("k"))
    end = lambda x: who.withColumnsRenamed({"class_no": f"class_{x}", "record": f"r{x}", "k": f"k_{x}"})
    across = links.join(end("a"), ["class_a", "k_a"]).join(end("b"), ["class_b", "k_b"]).select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))
    repeated = classes.members.where(F.col("copies") > 1).select("record", "class_no")
    within = self_pairs(repeated, ["class_no"], "record", F.lit(True), classes.members.count(), block).select(
        F.least("a.record", "b.record").alias("record_a"), F.greatest("a.record", "b.record").alias("record_b")
    )
    return across.unionByName(within)


def set_links(rows: DataFrame, record: str, values: list[str], rule: Overlap, least: int = 1, budget: int = 64, giant: int = 50_000) -> DataFrame:
    """One row for each record with enough values: its class of equal sets and its number of links.

    ``record, class_id, copies, links``; ``class_id`` is the lowest record of the class and
    ``links`` counts all similar records, copies included, without spreading copies out to pairs.
    The edge cases are those of similar_sets.
    """
    classes = set_classes(rows, record, values, least, giant, rule)
    links = _class_links(classes, rule, least, budget, giant)
    ends = F.explode(F.array(F.struct(F.col("class_a").alias("class_no"), F.col("copies_b").alias("n")), F.struct(F.col("class_b").alias("class_no"), F.col("copies_a").alias("n"))))
    across = links.select(ends.alias("e")).groupBy(F.col("e.class_no").alias("class_no")).agg(F.sum("e.n").alias("across"))
    degree = classes.heads.select("class_no", "copies", "lowest").join(across, "class_no", "left")
    degree = degree.withColumn("links", F.col("copies") - 1 + F.coalesce("across", F.lit(0)))
    return lookup_join(classes.members.select("record", "class_no"), degree, ["class_no"], "copies", classes.members.count()).select(
        "record", F.col("lowest").alias("class_id"), "copies", "links"
    )


def similar_sets_between(left: DataFrame, right: DataFrame, record: str, values: list[str], rule: Overlap, least: int = 1, budget: int = 64) -> DataFrame:
    """``record_l, record_r``: pairs of a record of ``left`` and one of ``right`` with similar value sets.

    Both tables have the columns ``record`` and ``values``; the cases are those of similar_sets.
    """
    side = lambda df, n: df.select(F.when(F.col(record).isNotNull(), F.struct(F.lit(n).alias("side"), F.col(record).alias("id"))).alias("_r"), *values)
    pairs = similar_sets(side(left, 0).unionByName(side(right, 1)), "_r", values, rule, least, budget)
    return pairs.where("record_a.side = 0 and record_b.side = 1").select(F.col("record_a.id").alias("record_l"), F.col("record_b.id").alias("record_r"))
