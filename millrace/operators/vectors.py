"""Cosine, exact nearest neighbours in blocks, rarity-weighted overlap, principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.scalar import half_up
from millrace.operators.relational import min_max, top_k
from millrace.operators.skew import lookup_join, self_pairs
from millrace.session import release, saved


#: Parts of all classes that idf_overlap takes up one after the other, and rows that are few enough for one turn.
BUCKETS, FEW_ROWS = 64, 200_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 when either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def check_width(df: DataFrame, vector: str, least: int = 5) -> int:
    """The width of all vectors; refuses ragged or fewer than ``least`` vectors."""
    r = df.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)), F.max(F.size(vector)), F.count("*")).first()
    if r[2] < least:
        raise ValueError(f"{r[2]} vectors are too few")
    if r[0] != r[1]:
        raise ValueError(f"vectors of {r[0]} to {r[1]} numbers")
    return r[0]


def _matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    v = t["vector"].combine_chunks() if isinstance(t, pa.Table) else t.column("vector")
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def nearest(df: DataFrame, ident: str, vector: str, k: int = 3, floor: float = 0.3, block: int = 4096) -> DataFrame:
    """``src, dst, sim``: each vector's ``k`` nearest others by exact cosine, at least ``floor``, 3 places.

    All rows against all rows, block by block: rows are dealt into blocks, every pair of blocks is one
    matrix product in a task, only each row's best ``k`` leave it, and those are merged. Ties go to the
    lower id.
    """
    check_width(df, vector, 1)
    rows = df.where(F.col(vector).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    rows = saved(rows, "vectors")
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # Block i is queried against block j: each row is sent once for every j it is queried in, and once as a target.
    q = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = dealt.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        order = np.argsort(ib, kind="stable")
        ib, mb = ib[order], _matrix(b)[order]
        out = []
        ma = _matrix(a)
        for at in range(0, len(ia), 1024):
            s = ma[at : at + 1024] @ mb.T
            s[ia[at : at + 1024, None] == ib[None, :]] = -2
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(s)), top.shape[1])
            c = top.ravel()
            ok = s[r, c] >= floor
            out.append((ia[at + r[ok]], ib[c[ok]], s[r[ok], c[ok]]))
        src, dst, sim = (np.concatenate(x) for x in zip(*out))
        return pa.table({"src": src, "dst": dst, "sim": sim})

    near = q.groupBy("i", "j").cogroup(t.groupBy("i", "j")).applyInArrow(run, "src long, dst long, sim double")
    best = top_k(near, ["src"], [F.desc("sim"), F.asc("dst")], k)
    return best.select("src", "dst", half_up(F.col("sim"), 3).alias("sim"))


def _best_met(lists: DataFrame, size: int, n: int, least: float, k: int, low: int, high: int, seen: Observation) -> DataFrame:
    """``x, y, weight``: the ``k`` best other classes ``y`` of each class ``x`` in buckets from ``low`` to below ``high``; ``seen`` gets the pairs written."""
    turn = lambda p: F.col(f"{p}.bucket").between(low, high - 1)
    norms = F.col("a.norm") * F.col("b.norm")
    q = lambda of: f"pow(ln({float(max(n, 1))!r}D / {of}), 2)"
    # The rests are single precision, hence the slack.
    able = (turn("a") | turn("b")) & (F.expr(q("a.df")) + F.sqrt(F.col("a.rest").cast("double") * F.col("b.rest")) * (1 + 1e-6) >= (least - 1e-9) * norms)
    dot = F.expr(f"{q('a.df')} + aggregate(array_intersect(a.terms, b.terms), 0D, (s, x) -> s + {q('element_at(a.dfs, cast(array_position(a.terms, x) as int))')})")
    met = self_pairs(lists, ["t"], "c", able, size).select(F.col("a.c").alias("x"), F.col("b.c").alias("y"), turn("a").alias("for_x"), turn("b").alias("for_y"), (dot / norms).alias("s"))
    # Looked at behind the explode: in the join's condition the lambda would keep the join from being compiled.
    ends = F.array(F.struct("for_x", "x", "y", "s"), F.struct(F.col("for_y").alias("for_x"), F.col("y").alias("x"), F.col("x").alias("y"), "s"))
    both = met.select(F.explode(ends).alias("e")).where((F.col("e.s") >= least) & F.col("e.for_x"))
    # Thousandths: ranks and results are of three places.
    both = both.select("e.x", "e.y", F.floor(F.col("e.s") * 1000.0 + F.lit(0.5)).cast("int").alias("w")).observe(seen, F.count(F.lit(1)).alias("n"))
    # A pair may meet at several terms; the rarest gives all of its weight.
    best = both.repartition("x").groupBy("x", "y").agg(F.max("w").alias("w"))
    return saved(top_k(best, ["x"], [F.desc("w"), F.asc("y")], k).select("x", "y", (F.col("w") / 1000.0).alias("weight")), "best-classes", sweep=True)


def idf_overlap(pairs: DataFrame, ident: str, term: str, least: float = 0.12, cap: float = 0.25, k: int = 12, evidence: int = 6) -> DataFrame:
    """``id, other, weight, shared``: records tied by the rare terms they share.

    The weight is the cosine of rarity-weighted term sets; terms in more than a share ``cap`` of records
    count in a record's length but tie none together. ``shared`` are the rarest common terms.

    Records with equal terms are one class and weigh the same to all others, so classes meet instead of
    records, and at most ``k + 1`` members of a class stand for it. A class's most common terms, as long
    as their part of its length stays below ``least``, can't tie it to anything by themselves, so the
    lists that meet leave them out. A row of a list carries the terms more common than its own: where
    two classes meet at the rarest term they share, these give the whole weight. What they could share
    at most is looked at first, so no pair is written unless it holds. Pairs are written for some
    classes at a time, as many as keep them to a few times the lists, and only each class's best stay.
    ``evidence`` 0 leaves ``shared`` out.
    """
    given = pairs.select(F.col(ident).alias("id"), F.col(term).alias("t")).dropna()
    own = given.groupBy("id").agg(F.sort_array(F.collect_set(F.xxhash64("t"))).alias("terms"))
    own = saved(own.select("id", F.xxhash64("terms").alias("high"), F.xxhash64(F.lit(1), "terms").alias("low"), "terms"), "term-sets", sweep=True)
    n = own.count()
    # The lowest member names a class.
    classes = own.groupBy("high", "low").agg(F.min("id").alias("c"), F.count("*").alias("copies"), F.first("terms").alias("terms"))
    classes = saved(classes, "term-classes", sweep=True)
    values = classes.select("c", "copies", F.explode("terms").alias("t"))
    df = saved(values.groupBy("t").agg(F.sum("copies").alias("df"), F.count("*").alias("classes")).withColumn("no", F.monotonically_increasing_id()), "term-counts", sweep=True)
    # Terms by close numbers, which take half the room of hashes: the row in its part and the part, told apart by the longest part.
    part, row = F.shiftright("no", 33), F.col("no").bitwiseAND(F.lit(2**33 - 1))
    parts, longest = df.agg(F.coalesce(F.max(part), F.lit(0)) + 1, F.coalesce(F.max(row), F.lit(0)) + 1).first()
    number = (part * longest + row).cast("int" if parts * longest < 2**31 else "long")
    weighted = lookup_join(values, df, ["t"], "classes", values.count()).select("c", number.alias("t"), "df", "classes")
    gathered = weighted.groupBy("c").agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("common"), "t", "classes"))).alias("v"))
    gathered = gathered.withColumn("v", F.transform("v", lambda x: F.struct(x["t"].alias("t"), (-x["common"]).alias("df"), x["classes"].alias("classes"), F.pow(F.log(F.lit(float(max(n, 1))) / -x["common"]), 2).alias("q"))))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x["q"])
    gathered = gathered.withColumn("norm", F.sqrt(total("v"))).withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    gathered = gathered.withColumn("v", F.filter("v", lambda x: (x["df"] >= 2) & (x["df"] <= max(2, int(n * cap)))))
    alone = total("v") / (F.col("norm") * F.col("norm"))
    # Terms of one class only tie its own members.
    weighed = saved(gathered.select("c", "norm", alone.alias("alone"), F.filter("v", lambda x: x["classes"] >= 2).alias("v")), "weighed-terms", sweep=True)
    within = weighed.where(F.col("alone") >= least).select(F.col("c").alias("x"), F.col("c").alias("y"), half_up(F.col("alone"), 3).alias("weight"))
    within = saved(within.join(classes.where("copies > 1").select(F.col("c").alias("x")), "x", "left_semi"), "own-classes", sweep=True)
    rows = weighed.select("c", "norm", "v", F.posexplode("v").alias("i", "at")).withColumn("before", F.slice("v", F.lit(1), F.col("i"))).withColumn("rest", total("before"))
    rows = rows.where(F.sqrt(F.col("at.q") + F.col("rest")) >= (least - 1e-9) * F.col("norm"))
    number_of = "int" if n < 2**31 else "long"
    bucket = F.pmod(F.xxhash64("c"), F.lit(BUCKETS)).cast("int").alias("bucket")
    lists = saved(rows.select("c", bucket, "norm", "at.t", "at.df", F.col("rest").cast("float").alias("rest"), F.col("before.t").alias("terms"), F.transform("before.df", lambda x: x.cast(number_of)).alias("dfs")), "term-lists", sweep=True)
    release(weighed)
    size = lists.count()
    best, done, step = None, 0, BUCKETS if size <= FEW_ROWS else BUCKETS // 8
    while done < BUCKETS:
        seen = Observation()
        met = _best_met(lists, size, n, least, k, done, done + step, seen)
        best = met if best is None else best.unionByName(met)
        done, step = done + step, max(1, min(BUCKETS - done - step, step * max(FEW_ROWS, 3 * size) // max(1, seen.get["n"])))
    release(lists)
    first = top_k(own.select("id", "high", "low"), ["high", "low"], [F.asc("id")], k + 1).groupBy("high", "low").agg(F.collect_list("id").alias("ids"))
    first = saved(classes.select("c", "copies", "high", "low").join(first, ["high", "low"]), "first-members", sweep=True)
    others = best.unionByName(within).join(first.select(F.col("c").alias("y"), "ids"), "y").select("x", F.explode("ids").alias("other"), "weight")
    kept = top_k(others, ["x"], [F.desc("weight"), F.asc("other")], k + 1)
    kept = kept.groupBy(F.col("x").alias("c")).agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("less"), "other", "weight"))).alias("kept"))
    kept = saved(first.select("c", "copies", "high", "low").join(kept, "c").select("high", "low", "copies", "kept"), "kept-classes", sweep=True)
    mine = lookup_join(own.select("id", "high", "low"), kept, ["high", "low"], "copies", n)
    edges = mine.select("id", F.explode(F.slice(F.filter("kept", lambda x: x["other"] != F.col("id")), 1, k)).alias("e")).select("id", "e.other", "e.weight")
    if not evidence:
        return edges
    edges = saved(edges, "edges")
    named = given.distinct().withColumn("h", F.xxhash64("t")).join(df.where((F.col("df") >= 2) & (F.col("df") <= max(2, int(n * cap)))).select(F.col("t").alias("h"), "df"), "h").select("id", "t", "df")
    both = edges.select("id", "other").join(named, "id").join(named.select(F.col("id").alias("other"), "t"), ["other", "t"])
    shared = both.groupBy("id", "other").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "t"))), 1, evidence).alias("v"))
    return edges.join(shared, ["id", "other"]).select("id", "other", "weight", F.col("v.t").alias("shared"))


def principal_axes(df: DataFrame, ident: str, vector: str, axes: int = 3) -> DataFrame:
    """``id, x0, x1, ...``: vectors laid out on their principal axes, each scaled to [0, 1].

    The covariance is summed in the tasks; only a square matrix of the vectors' width reaches the
    driver. An axis points so that its largest loading is positive. A linear stand-in for a neighbour
    embedding, so callers should mark positions as inferred.
    """
    width = check_width(df, vector, 1)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            m = b.column("vector").flatten().to_numpy().reshape(b.num_rows, width)
            n, s, c = n + len(m), s + m.sum(axis=0), c + m.T @ m
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]}, schema=pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("c", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(sums, "n long, s array<double>, c array<double>")
    add = lambda name: F.posexplode(name)
    total = {kind: dict(parts.select(add(kind)).groupBy("pos").agg(F.sum("col")).collect()) for kind in ("s", "c")}
    n = parts.agg(F.sum("n")).first()[0]
    mean = np.array([total["s"][i] for i in range(width)]) / n
    cov = np.array([total["c"][i] for i in range(width * width)]).reshape(width, width) / n - np.outer(mean, mean)
    vecs = np.linalg.eigh(cov)[1][:, ::-1][:, :axes]
    vecs = vecs * np.sign(vecs[np.abs(vecs).argmax(axis=0), range(vecs.shape[1])])
    place = lambda i: F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in vecs[:, i]]), lambda a, b: a * b), F.lit(float(-mean @ vecs[:, i])), lambda a, b: a + b)
    laid = saved(rows.select("id", *[place(i).alias(f"x{i}") for i in range(vecs.shape[1])]), "axes")
    return min_max(laid, [f"x{i}" for i in range(vecs.shape[1])])


def corroborated(near: DataFrame, overlap: DataFrame) -> DataFrame:
    """Neighbours that both the vectors and the shared terms name, with both weights."""
    return near.select(F.col("src").alias("id"), F.col("dst").alias("other"), "sim").join(overlap.select("id", "other", "weight"), ["id", "other"])
