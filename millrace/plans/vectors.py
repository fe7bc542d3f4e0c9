"""Vectors and rarity: exact neighbours, pairs, overlap of packages, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import half_up
from millrace.operators import vectors
from millrace.plans.supply import repo_packages
from millrace.session import table


def knn_edges(spark: SparkSession, root: str) -> DataFrame:
    """Each vector's three nearest others of 0.3 or more, three places."""
    return vectors.nearest(table(spark, root, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 3, 0.3)


def cosine_to_label_mean(spark: SparkSession, root: str) -> DataFrame:
    """V1: the cosine of every vector with the mean vector of its label."""
    e = table(spark, root, "embeddings", "vec_id", "embedding", "label")
    mean = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
    return e.join(mean, "label").select("vec_id", half_up(vectors.cosine(F.col("embedding"), F.col("mean")), 4).alias("cosine"))


def vector_width(spark: SparkSession, root: str) -> DataFrame:
    """V3: the one width of all vectors, and their number."""
    e = table(spark, root, "embeddings", "embedding")
    w = vectors.check_width(e, "embedding")
    return e.agg(F.lit(w).alias("width"), F.count("*").alias("n"))


def idf_overlap_edges(spark: SparkSession, root: str) -> DataFrame:
    """Repositories tied by the rare packages they share."""
    p = repo_packages(spark, root).select("repo_id", F.concat("ecosystem", F.lit(":"), "package_name").alias("package"))
    return vectors.idf_overlap(p, "repo_id", "package", evidence=0)


def layout(spark: SparkSession, root: str) -> DataFrame:
    """V4: vectors laid out on three principal axes; positions are inferred."""
    return vectors.principal_axes(table(spark, root, "embeddings", "vec_id", "embedding"), "vec_id", "embedding").withColumn("provenance", F.lit("INFERRED"))


def layout_spread(spark: SparkSession, root: str) -> DataFrame:
    """P30 over the layout: every axis spans 0 to 1."""
    x = layout(spark, root)
    return x.agg(*[F.min(f"x{i}").alias(f"low{i}") for i in range(3)], *[F.max(f"x{i}").alias(f"high{i}") for i in range(3)])


_SIM = "CAST(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS DOUBLE)"

QUERIES = {f.__name__: f for f in (knn_edges, cosine_to_label_mean, vector_width, idf_overlap_edges, layout, layout_spread)}


def _sql() -> dict[str, str]:
    from millrace.plans.supply import _DEP

    return {
        "knn_edges": f"WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM s WHERE sim >= 0.3) SELECT src, dst, floor(sim * 1000.0 + 0.5) / 1000.0 AS sim FROM r WHERE k <= 3",
        "cosine_to_label_mean": "WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), m AS (SELECT label, list(m ORDER BY i) AS mean FROM x GROUP BY 1) SELECT vec_id, floor(list_cosine_similarity(embedding::DOUBLE[], mean) * 10000.0 + 0.5) / 10000.0 AS cosine FROM embeddings JOIN m USING (label)",
        "vector_width": "SELECT max(len(embedding)) AS width, count(*) AS n FROM embeddings",
        "idf_overlap_edges": f"""WITH {_DEP}, n AS (SELECT count(DISTINCT repo_id) AS n FROM rp), t AS (SELECT ecosystem || ':' || package_name AS t, repo_id AS id FROM rp),
df AS (SELECT t, count(*) AS df, ln((SELECT n FROM n)::DOUBLE / count(*)) AS w FROM t GROUP BY 1), w AS (SELECT id, t, df, w FROM t JOIN df USING (t)),
nm AS (SELECT id, CASE WHEN sqrt(sum(w * w)) > 0 THEN sqrt(sum(w * w)) ELSE 1 END AS n FROM w GROUP BY 1),
tie AS (SELECT * FROM w WHERE df >= 2 AND df <= greatest(2, floor(0.25 * (SELECT n FROM n)))),
d AS (SELECT a.id AS x, b.id AS y, sum(a.w * a.w) AS dot FROM tie a JOIN tie b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2),
s AS (SELECT x, y, dot / (p.n * q.n) AS s FROM d JOIN nm p ON p.id = x JOIN nm q ON q.id = y),
k AS (SELECT x, y, floor(s * 1000.0 + 0.5) / 1000.0 AS weight FROM s WHERE s >= 0.12)
SELECT x AS id, y AS other, weight FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY weight DESC, y) AS p FROM k) WHERE p <= 12""",
        "layout_spread": "SELECT 0.0 AS low0, 0.0 AS low1, 0.0 AS low2, 1.0 AS high0, 1.0 AS high1, 1.0 AS high2",
    }


SQL = _sql()
