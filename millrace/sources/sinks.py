"""Sinks: write only what changed, staged commits, bucketed neighbourhoods, checks after loading."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.relational import missing_references, numbered
from millrace.sources.readers import exists


def row_digest(df: DataFrame, key: Sequence[str], masked: Sequence[str] = ()) -> DataFrame:
    """Rows with ``_digest`` over all columns in name order, times and other ``masked`` columns left out."""
    cols = sorted(c for c in df.columns if c not in masked)
    return df.withColumn("_digest", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def table_digest(df: DataFrame, masked: Sequence[str] = ()) -> tuple[int, str]:
    """Rows and an order-free digest of a table: equal tables agree whatever their order and files."""
    d = row_digest(df, [], masked)
    r = d.agg(F.count("*"), F.sum(F.xxhash64("_digest").cast("decimal(38,0)"))).first()
    return r[0], str(r[1])


def write_if_changed(df: DataFrame, path: str, masked: Sequence[str] = ()) -> bool:
    """K1: commit ``df`` to ``path`` only if the content differs, ``masked`` columns aside. Returns whether it wrote."""
    spark = df.sparkSession
    if _manifest(spark, path) is not None:
        old = committed(spark, path)
        if sorted(old.columns) == sorted(df.columns) and table_digest(old, masked) == table_digest(df, masked):
            return False
    commit(df, path)
    return True


def changed_rows(new: DataFrame, old: DataFrame, key: Sequence[str], masked: Sequence[str] = ()) -> DataFrame:
    """K2: rows of ``new`` that ``old`` lacks or has otherwise."""
    a, b = row_digest(new, key, masked), row_digest(old.select(*new.columns), key, masked)
    return a.join(b.select(*key, "_digest"), [*key, "_digest"], "left_anti").drop("_digest")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """What the table at ``path`` consists of now: ``parts``, directory by part, and ``before``, those of the commit before."""
    p, fs = _fs(spark, f"{path}/_manifest.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_parts(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Put directories in the place of the table's parts of the same names, all at once.

    The manifest is written beside the old one and renamed over it, which file systems do in one
    step. Directories stay one commit longer than they are needed, for readers that began before.
    """
    old = _manifest(spark, path) or {"parts": {}, "before": []}
    now = {**old["parts"], **parts}
    replaced = sorted(set(old["parts"].values()) - set(now.values()))
    jvm = spark.sparkContext._jvm
    aside, fs = _fs(spark, f"{path}/_manifest-{uuid.uuid4().hex}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"parts": now, "before": replaced}).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, _fs(spark, f"{path}/_manifest.json")[0], how)
    for directory in old["before"]:
        fs.delete(_fs(spark, f"{path}/{directory}")[0], True)


def commit(df: DataFrame, path: str) -> None:
    """K4: replace the table at ``path``; readers of ``committed`` see the old one or the new one, whole."""
    directory = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{directory}")
    commit_parts(df.sparkSession, path, {"": directory})


def committed(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The table that ``commit`` or ``commit_parts`` put at ``path``, or some parts of it."""
    m = _manifest(spark, path)
    if m is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(*[f"{path}/{d}" for p, d in sorted(m["parts"].items()) if parts is None or p in parts])


def committed_parts(spark: SparkSession, path: str) -> set[str]:
    """Names of the parts that a table has; none where there is no table."""
    return set((_manifest(spark, path) or {"parts": {}})["parts"])


def write_by_bucket(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """K8: neighbourhoods in hash buckets, sorted by key, so reading one id opens one bucket."""
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", b).repartition(buckets, "bucket").sortWithinPartitions(key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_key(spark: SparkSession, path: str, key: str, value: int, buckets: int = 64) -> DataFrame:
    """One id of what write_by_bucket wrote; only its bucket is listed and only its row groups read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast("long")), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def assert_references(checks: Sequence[tuple[str, DataFrame, Sequence[str], DataFrame, Sequence[str]]]) -> None:
    """K5: raises with the first reference that has orphans."""
    for name, child, key, parent, parent_key in checks:
        bad = missing_references(child, key, parent, parent_key).limit(5).collect()
        if bad:
            raise ValueError(f"{name}: no parent for {[tuple(r) for r in bad]}")


def assert_counts(expected: dict[str, int], tables: dict[str, DataFrame]) -> None:
    """K6: raises where a loaded table's rows differ from what its source said."""
    for name, n in expected.items():
        if (got := tables[name].count()) != n:
            raise ValueError(f"{name}: {got} rows, {n} expected")


def migrate(spark: SparkSession, path: str, steps: Sequence[tuple[int, str]], apply) -> list[int]:
    """K7: run numbered steps that the log at ``path`` lacks, in order, forward only; returns those run."""
    if not steps:
        raise ValueError("no migrations given")
    done = {r["version"] for r in spark.read.parquet(path).collect()} if exists(spark, f"{path}/_SUCCESS") else set()
    ran = []
    for version, statement in sorted(steps):
        if version in done:
            continue
        if done and version < max(done):
            raise ValueError(f"migration {version} is older than {max(done)}")
        apply(statement)
        spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(path)
        done.add(version)
        ran.append(version)
    return ran


def described(df: DataFrame, about: dict[str, str]) -> DataFrame:
    """The table with what each field means as its comment, so the schema travels with the data."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": about[c]}) if c in about else F.col(c) for c in df.columns])


def schema_rows(df: DataFrame) -> DataFrame:
    """A table's schema as data: ``field, type, nullable, about``."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "field string, type string, nullable boolean, about string")


def schema_gaps(df: DataFrame, about: dict[str, str]) -> DataFrame:
    """``field, gap``: fields that nothing describes, and descriptions of fields that aren't there."""
    rows = [(c, "undescribed") for c in df.columns if c not in about] + [(c, "absent") for c in about if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "field string, gap string")


def feed_items(df: DataFrame, title: str, link: str, at: str, n: int = 20) -> DataFrame:
    """The n latest as RSS items, one text per row."""
    from millrace.functions.scalar import escape_html

    newest = df.where(F.col(at).isNotNull()).orderBy(F.desc(at), link).limit(n)
    stamp = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return newest.select(F.concat(F.lit("<item><title>"), escape_html(F.col(title)), F.lit("</title><link>"), escape_html(F.col(link)), F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>")).alias("item"))


def atom_entries(df: DataFrame, title: str, link: str, at: str, n: int = 20) -> DataFrame:
    """The n latest as Atom entries, one text per row."""
    from millrace.functions.scalar import escape_html

    newest = df.where(F.col(at).isNotNull()).orderBy(F.desc(at), link).limit(n)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return newest.select(F.concat(F.lit("<entry><title>"), escape_html(F.col(title)), F.lit('</title><link href="'), escape_html(F.col(link)), F.lit('"/><id>'), escape_html(F.col(link)), F.lit("</id><updated>"), stamp, F.lit("</updated></entry>")).alias("entry"))


def _in_blocks(df: DataFrame, group: str, order: list, line, size: int) -> DataFrame:
    """``group, block, lines``: the lines of each group in order, ``size`` of them to a row, so no group need fit a task."""
    placed = numbered(df, [group], order, "_k").withColumn("block", F.expr(f"(_k - 1) div {size}"))
    return placed.groupBy(group, "block").agg(F.sort_array(F.collect_list(F.struct("_k", line.alias("line")))).alias("l")).select(group, "block", F.col("l.line").alias("lines"))


def sitemap(df: DataFrame, group: str, link: str, base: str, size: int = 50_000) -> DataFrame:
    """URL sets per group, 50,000 addresses to a set, as the protocol asks."""
    url = F.concat(F.lit(f"<url><loc>{base}"), F.col(link), F.lit("</loc></url>"))
    return _in_blocks(df, group, [F.asc(link)], url, size).select(group, "block", F.array_join("lines", "").alias("urlset"))


def markdown_tables(df: DataFrame, group: str, columns: Sequence[str], size: int = 1000) -> DataFrame:
    """A Markdown table per group of its rows in the order of ``columns``, in blocks of ``size`` rows; bars are escaped, nulls empty."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return _in_blocks(df, group, [F.asc(c) for c in columns], line, size).select(group, "block", F.concat(F.lit(head), F.array_join("lines", "\n")).alias("markdown"))


def llms_txt(df: DataFrame, group: str, title: str, link: str, about: str, size: int = 1000) -> DataFrame:
    """A section of llms.txt per group: a heading and a list of links with what they hold, in blocks of ``size``."""
    said = F.coalesce(F.concat(F.lit(": "), F.col(about)), F.lit(""))
    line = F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(link), F.lit(")"), said)
    blocks = _in_blocks(df, group, [F.asc(title), F.asc(link)], line, size)
    return blocks.select(group, "block", F.concat(F.lit("## "), F.col(group), F.lit("\n\n"), F.array_join("lines", "\n")).alias("section"))
