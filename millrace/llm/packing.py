"""Filling contexts of fixed capacity with texts: first-fit decreasing in randomised groups."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import saved, spread

#: Where the public tokenizers' vocabularies lie, and the one used unless told otherwise.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is broadcast.
LARGEST_VOCABULARY = 64 << 20
#: How the byte-level vocabularies split text before merging (fixed value of the public tokenizer).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Tokens of a text under a byte-level vocabulary.

    Merges never cross the split, so a text has the sum of its pieces' tokens and the counts of
    pieces seen before are kept, up to ``most`` of them.
    """

    def __init__(self, path: str | bytes, most: int = 300_000):
        import tiktoken

        if isinstance(path, str):
            with open(path, "rb") as f:
                path = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in path.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(SPLIT, regex.V1).findall
        self.most = most
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces := self.pieces(text)))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encoding.encode_ordinary(p))
            return sum(known[p] if p in known else len(self.encoding.encode_ordinary(p)) for p in pieces)


@lru_cache(maxsize=2)
def _counter(vocabulary: bytes) -> TokenCounter:
    return TokenCounter(vocabulary)


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in batches:
            n = [counter.count(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64())], names=["doc", "n_tokens"])

    return run


def text_lengths(documents: DataFrame, doc_id: str, text: str, vocabulary: str = f"{VOCABULARIES}/{VOCABULARY}") -> DataFrame:
    """``doc, n_tokens``: tokens of every whole text, 0 for a null or empty one.

    The vocabulary, a file of at most LARGEST_VOCABULARY bytes, is read by the driver and broadcast.
    """
    if os.path.getsize(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError(f"{vocabulary} is too large to broadcast")
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    docs = spread(documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")))
    return docs.mapInArrow(_measure(shared), f"doc {dict(docs.dtypes)['doc']}, n_tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, items given in descending size: the first container with room.

    A tournament tree holds at every node the most room below it, so the first container that fits
    is found by one walk from the root. No item may exceed the capacity.
    """
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    most = [capacity] * (2 * leaves)
    out = np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if most[at] < size:
                at += 1
        out[k] = at - leaves
        left = most[at] - size
        most[at] = left
        while at > 1:
            a, b = most[at], most[at ^ 1]
            at >>= 1
            best = a if a > b else b
            if most[at] == best:
                break
            most[at] = best
    return out


def _pack(capacity_at: int, size_at: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc", "ascending"), ("piece", "ascending"), ("draw", "ascending")])
        bins = first_fit_decreasing(group["size"].to_numpy(), group["capacity"][0].as_py()) if len(group) else np.zeros(0, np.int64)
        return group.append_column("bin", pa.array(bins, pa.int64()))

    return run


def pack_texts(lengths: DataFrame, budgets: DataFrame, budget_id: str, capacity: str, reserve: str | None = None, group_items: int = 16_384, seed: int = 0) -> DataFrame:
    """Put every text into contexts: one row for each budget and piece of a text.

    ``budget, context_group, context_no, doc, piece, token_start, token_end, room``: a context is one
    (budget, context_group, context_no); ``room`` is what its capacity less the reserve is. A text
    longer than a context is cut into whole contexts and one rest, any other text is one piece.

    ``lengths`` comes from text_lengths. ``budgets`` is small: at most 1,000 rows, checked. Texts are
    dealt at random into groups of about ``group_items`` pieces, so a group never grows with the
    data and all groups pack at once; ties are broken by document, then piece. The draw depends on
    ``seed``, the document, its length and its number among equal ones, so another split of the table
    gives the same contexts. A whole context's number is a hash of what it holds.

    Defined cases: a text without tokens takes no room and gets one row with a null context; a
    repeated document is an item each time; a budget that is null or has no room left packs
    nothing; a null reserve reserves nothing; empty tables give no rows.
    """
    asked = budgets.select(F.col(budget_id).alias("b"), F.col(capacity).cast("long").alias("c"), (F.col(reserve).cast("long") if reserve else F.lit(None).cast("long")).alias("r"))
    rooms = [(x["b"], x["c"] - (x["r"] or 0)) for x in asked.distinct().limit(1001).collect() if x["c"] is not None and x["c"] > (x["r"] or 0)]
    if len(rooms) > 1000:
        raise ValueError("more than 1,000 budgets")
    kind = dict(lengths.dtypes)["doc"]
    kind_b = dict(asked.dtypes)["b"]
    ddl = f"b {kind_b}, grp long, bin long, doc {kind}, piece long, start long, size long, capacity long"
    spark = lengths.sparkSession
    if not rooms:
        return spark.createDataFrame([], f"budget {kind_b}, context_group long, context_no long, doc {kind}, piece long, token_start long, token_end long, room long")
    # Rows of equal document and length are alike; numbered from their count, however many there are.
    alike = saved(lengths.groupBy("doc", "n_tokens").agg(F.count("*").alias("c")), "text-lengths")
    some = alike.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 1000))))
    one = some.withColumn("j", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("c") - 1, F.col("thousand") * 1000 + 999))))
    lengths = one.select("doc", "n_tokens", F.xxhash64(F.lit(seed), "doc", "n_tokens", "j").alias("draw"))
    each = F.array(*[F.struct(F.lit(b).cast(kind_b).alias("b"), F.lit(c).cast("long").alias("capacity")) for b, c in rooms])
    items = lengths.withColumn("budget", F.explode(each)).select("doc", "n_tokens", "draw", "budget.b", "budget.capacity")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity"))).cast("long"))
    pieces = items.select("*", F.posexplode(cuts).alias("_p", "piece")).drop("_p").withColumn("start", F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("size", F.least(F.col("capacity"), F.col("n_tokens") - F.col("start")))
    # Whole contexts are contexts already; only what may share one is packed.
    small = F.col("size") < F.col("capacity")
    counts = {r["b"]: r["n"] for r in pieces.where(small & (F.col("size") > 0)).groupBy("b").agg(F.count("*").alias("n")).collect()}
    groups = F.create_map(*[x for b, _ in rooms for x in (F.lit(b).cast(kind_b), F.lit(max(1, -(-counts.get(b, 0) // group_items))))])
    dealt = pieces.where(small & (F.col("size") > 0)).withColumn("grp", F.pmod(F.xxhash64("draw", "piece"), groups[F.col("b")]).cast("long"))
    order = ["doc", "piece", "start", "size", "capacity", "draw", "b", "grp"]
    packed = dealt.select(*order).groupBy("b", "grp").applyInArrow(_pack(0, 0), f"doc {kind}, piece long, start long, size long, capacity long, draw long, b {kind_b}, grp long, bin long")
    whole = pieces.where(~small).select("b", F.lit(-1).cast("long").alias("grp"), F.xxhash64("draw", "piece").alias("bin"), "doc", "piece", "start", "size", "capacity")
    none = pieces.where("size = 0").select("b", F.lit(None).cast("long").alias("grp"), F.lit(None).cast("long").alias("bin"), "doc", "piece", "start", "size", "capacity")
    names = [c.split()[0] for c in ddl.split(", ")]
    return (
        packed.select(*names)
        .unionByName(whole)
        .unionByName(none)
        .select(
            F.col("b").alias("budget"), F.col("grp").alias("context_group"), F.col("bin").alias("context_no"), "doc", "piece",
            F.col("start").alias("token_start"), (F.col("start") + F.col("size")).alias("token_end"), F.col("capacity").alias("room"),
        )
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """``budget, room, contexts, tokens, least_contexts, filled`` for what pack_texts gives."""
    used = packed.where("context_no is not null").groupBy("budget", "room", "context_group", "context_no").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    total = used.groupBy("budget", "room").agg(F.count("*").alias("contexts"), F.sum("n").alias("tokens"))
    return total.select("*", F.ceil(F.col("tokens") / F.col("room")).alias("least_contexts"), (F.col("tokens") / (F.col("room") * F.col("contexts"))).alias("filled"))
