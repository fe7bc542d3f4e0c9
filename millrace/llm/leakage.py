"""Evaluation texts inside training texts, found by winnowing.

Every window of ``WINDOW`` successive word k-grams keeps its least hash. Two texts that share a run of
``K + WINDOW - 1`` words share a whole window and therefore a kept hash, so joining the kept hashes
misses no run of that length; each hit is then extended word by word to its full run.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import dealt_join
from millrace.session import saved, spread

#: Words of a k-gram, and k-grams of a window: together they guarantee runs of 13 words.
K, WINDOW = 7, 7
#: Most words of evaluation text that may be broadcast (8 bytes each, and its fingerprints less).
BROADCAST_WORDS = 4_000_000

_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_FORMAT = regex.compile(r"\p{Cf}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits after NFKC and lower case, format characters left out."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _WORD.findall(_FORMAT.sub("", unicodedata.normalize("NFKC", text).lower()))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> list[int]:
        return [self[w] for w in words(text)] if text else []


def grams(w: np.ndarray) -> np.ndarray:
    """Hash of the k-gram that begins at each word; the last K - 1 words begin none."""
    if len(w) < K:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(w) - K + 1, np.uint64)
    for i in range(K):
        out = out * _BASE + w[i : len(w) - K + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _batch(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch in one array, and where each text begins (one more at the end)."""
    each = [hashes.of(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    flat = np.fromiter((h for x in each for h in x), np.uint64, int(starts[-1]))
    return flat, starts


def _batch_winnow(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in ``flat`` and hash of what is kept, over a batch at once."""
    h = grams(flat)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, h
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    last = starts[1:] - K  # the last place where a text has a whole k-gram
    place = np.arange(len(h))
    own = text[: len(h)]
    whole = place <= last[own]
    h = np.where(whole, h, np.uint64(2**64 - 1))
    padded = np.concatenate([h, np.full(WINDOW - 1, 2**64 - 1, np.uint64)])
    at = np.lib.stride_tricks.sliding_window_view(padded, WINDOW).argmin(axis=1) + place
    at = np.unique(at[place + WINDOW - 1 <= last[own]])  # windows that lie whole in their text
    return text[at], at, h[at]


class Suite:
    """Evaluation texts with their fingerprints, in arrays that can be searched."""

    def __init__(self, texts: list[tuple[int, str]], least: int):
        hashes, self.least = WordHashes(), least
        kept = [(i, np.array(hashes.of(t), np.uint64)) for i, t in texts]
        kept = [(i, w) for i, w in kept if len(w) >= least]
        self.items = np.array([i for i, _ in kept], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(w) for _, w in kept])]).astype(np.int64)
        self.flat = np.concatenate([w for _, w in kept]) if kept else np.zeros(0, np.uint64)
        text, place, h = _batch_winnow(self.flat, self.starts)
        order = np.argsort(h, kind="stable")
        self.hash, self.text, self.place = h[order], text[order], place[order]

    def runs(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item id and length of every shared run of at least ``least`` words."""
        text, place, h = _batch_winnow(flat, starts)
        lo = np.searchsorted(self.hash, h, "left")
        n = np.searchsorted(self.hash, h, "right") - lo
        a = np.repeat(place, n)
        t = np.repeat(text, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        j = np.repeat(lo, n) + inside
        b, e = self.place[j], self.text[j]
        left = self._extend(flat, a - 1, starts[t], b - 1, self.starts[e], -1)
        right = self._extend(flat, a, starts[t + 1] - 1, b, self.starts[e + 1] - 1, 1)
        long = left + right >= self.least
        return t[long], self.items[e[long]], (left + right)[long]

    def _extend(self, flat: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, step: int) -> np.ndarray:
        """Equal words from (a, b) on in one direction, up to the ends of both texts."""
        room = np.minimum((a_end - a) * step, (b_end - b) * step) + 1
        got, live = np.zeros(len(a), np.int64), np.flatnonzero(room > 0)
        while len(live):
            same = flat[a[live] + step * got[live]] == self.flat[b[live] + step * got[live]]
            live = live[same]
            got[live] += 1
            live = live[got[live] < room[live]]
        return got


def _search(suite, doc: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = suite.value, WordHashes()
        for b in batches:
            flat, starts = _batch(b.column(text).to_pylist(), hashes)
            t, item, n = held.runs(flat, starts)
            if len(t):
                yield pa.RecordBatch.from_arrays([b.column(doc).take(pa.array(t)), pa.array(item), pa.array(n)], names=["doc", "item", "run_words"])

    return run


def _prints(ident: str, text: str):
    """Fingerprints of each text, for a test side too large to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            t, _, h = _batch_winnow(*_batch(b.column(text).to_pylist(), hashes))
            yield pa.RecordBatch.from_arrays([b.column(ident).take(pa.array(t)), pa.array(h.view(np.int64))], names=["ident", "print"])

    return run


def _verify(least: int) -> Callable:
    """Longest shared run of each document with the parts that it may share one with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows, items, runs = [], [], []
            for k, (text, parts) in enumerate(zip(b.column("text").to_pylist(), b.column("parts").to_pylist())):
                suite = Suite([(p["item"], p["item_text"]) for p in parts], least)
                _, item, n = suite.runs(*_batch([text], hashes))
                rows += [k] * len(item)
                items += item.tolist()
                runs += n.tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(runs, pa.int64())], names=["doc", "item", "run_words"])

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, parts: list[str], least: int = K + WINDOW - 1, broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """``doc_id, item_id, run_words``: every document with a run of at least ``least`` words from an item.

    One row per document and item with the longest run; each of the item's ``parts`` is taken alone.
    Item ids are whole numbers. ``least`` can't be below K + WINDOW - 1, what winnowing guarantees.

    Defined cases: null and empty texts and parts share nothing; a part of fewer than ``least`` words
    can't leak; repeated rows and items that share a passage each give their own pairs, once; empty
    tables give no rows. Texts are read whole, whatever their length. Only the named columns are
    read, so others can't clash; ties don't arise.

    The item side is counted first: up to ``broadcast_words`` words it is broadcast, words and
    fingerprints together, and no document is shuffled. Beyond that, fingerprints of both sides are
    joined in a shuffle, those of boilerplate dealt over tasks, and documents fetch the texts of their
    candidates, a hundred at a time, to be extended.
    """
    if least < K + WINDOW - 1:
        raise ValueError(f"winnowing with {K} and {WINDOW} guarantees runs of {K + WINDOW - 1} words only")
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    docs = spread(docs)
    kind = dict(docs.dtypes)["doc"]
    given = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.explode(F.array(*parts)).alias("item_text")).where("item_text is not null").distinct()
    size = given.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    # A word takes a letter and a break, so half the length bounds the words.
    if size // 2 + 1 <= broadcast_words:
        suite = spark.sparkContext.broadcast(Suite([(r["item"], r["item_text"]) for r in given.collect()], least))
        found = docs.mapInArrow(_search(suite, "doc", "text"), f"doc {kind}, item long, run_words long")
    else:
        parts_ = saved(given.withColumn("part", F.monotonically_increasing_id()), "leak-parts")
        ours = docs.mapInArrow(_prints("doc", "text"), f"ident {kind}, print long").select(F.col("ident").alias("doc"), "print").distinct()
        theirs = parts_.select("part", "item_text").mapInArrow(_prints("part", "item_text"), "ident long, print long").select(F.col("ident").alias("part"), "print").distinct()
        near = dealt_join(ours, theirs, ["print"], "doc").select("doc", "part").distinct()
        # A document travels once for each hundred or so parts, with their texts.
        blocks = max(1, -(-parts_.count() // 100))
        listed = near.join(parts_, "part").groupBy("doc", F.pmod(F.xxhash64("part"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "item_text")).alias("parts"))
        pairs = docs.join(saved(listed, "leak-candidates"), "doc").select("doc", "text", "parts")
        found = pairs.mapInArrow(_verify(least), f"doc {kind}, item long, run_words long")
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("run_words").alias("run_words"))
