"""Sources: schema-given JSON, per-entity shards, directory scans, trees, notebooks, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.session import saved


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def json_or_empty(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """A JSON source with a given schema; empty where there is none. ``json_lines`` tells what it leaves out."""
    return json_lines(spark, path, schema, multiline)[0]


def json_lines(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records of a JSON source and its broken ones, ``_corrupt`` holding their text: none is lost unseen."""
    asked = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], asked), spark.createDataFrame([], "_corrupt string")
    whole = StructType([*asked.fields, StructField("_corrupt", StringType())])
    read = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", str(multiline).lower()).json(path)
    read = saved(read, "json")  # parsed once for both sides
    return read.where("_corrupt is null").select(*asked.names), read.where("_corrupt is not null").select("_corrupt")


def shards(spark: SparkSession, directory: str, schema: StructType | str, glob: str = "*.json", ident: str = "id") -> DataFrame:
    """One JSON document per entity, its id taken from the file's name, a suffix chosen by ``glob``."""
    df = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", glob).json(directory)
    return df.withColumn(ident, F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long"))


def keyed_json(spark: SparkSession, path: str, value: str, ident: str = "id") -> DataFrame:
    """A JSON object of id -> record as rows; ``value`` is the record's schema."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(ident, "r")).select(F.col(ident).cast("long").alias(ident), "r.*")


def file_tree(spark: SparkSession, directory: str, repo_pattern: str = r"/(\d+)/") -> DataFrame:
    """Files below a directory as ``repo_id, path, size, content``; content is read only if selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    at = lambda i: F.regexp_extract("path", f"{repo_pattern}(.*)$", i)
    return df.select(at(1).cast("long").alias("repo_id"), at(2).alias("path"), F.col("length").alias("size"), "content")


#: Directories that hold no source of their own (fixed values).
SKIP_DIRS = r"(^|/)(\.git|node_modules|vendor|dist|build|target|\.venv|venv|__pycache__|third_party)/"


def walkable(tree: DataFrame, largest: int = 400_000, most: int = 4000) -> DataFrame:
    """Files worth reading: no vendored or built ones, none too large, the first ``most`` by path."""
    own = tree.where(~F.col("path").rlike(SKIP_DIRS) & (F.col("size") <= largest))
    return own.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))).where(F.col("_k") <= most).drop("_k")


def listed_repos(repos: DataFrame) -> DataFrame:
    """Repositories without archived ones and sites, newest first."""
    return repos.where(~F.coalesce("archived", F.lit(False)) & ~F.lower("name").endswith(".github.io")).orderBy(F.desc("updated_at"), "id")


def first_source(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Each key from the first source that has it."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    rest = [c for c in both.columns if c not in (key, "_p")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("r")).select(key, "r.*")


def decoded_edges(df: DataFrame, triples: str) -> DataFrame:
    """``[source, target, similarity]`` triples as an edge table."""
    return df.select(F.explode(triples).alias("t")).select(F.get("t", F.lit(0)).cast("long").alias("src"), F.get("t", F.lit(1)).cast("long").alias("dst"), F.get("t", F.lit(2)).cast("double").alias("sim"))


def cached_vectors(items: DataFrame, cache: DataFrame, key: str = "id", digest: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Items whose cached vector is current, and those that must be embedded again."""
    hit = items.join(cache, [key, digest])
    return hit, items.join(cache.select(key, digest), [key, digest], "left_anti")
