"""The training-data queries over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.llm.clusters import alike_groups, centroid_distances, hashed_features, kmeans, most_centres, typical
from millrace.llm.frequency import value_frequencies
from millrace.llm.leakage import leaked_items
from millrace.llm.packing import fill_report, pack_texts, text_lengths
from millrace.llm.reading import reading_levels
from millrace.llm.sets import Overlap, set_links, similar_sets
from millrace.llm.topn import skipping, top_n
from millrace.session import saved, table


def _usable(spark: SparkSession, root: str) -> DataFrame:
    """repo_id, ecosystem, package_name of usable dependency rows, in one spelling."""
    d = table(spark, root, "dependency", "repo_id", "ecosystem", "package_name")
    d = d.withColumn("ecosystem", keys.ecosystem(F.col("ecosystem")))
    d = d.withColumn("package_name", keys.package(F.col("ecosystem"), F.col("package_name")))
    return d.where("repo_id is not null and ecosystem is not null and package_name is not null and package_name <> ''")


_P1 = Overlap(7, 10)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = similar_sets(_usable(spark, root), "repo_id", ["ecosystem", "package_name"], _P1, least=4)
    return pairs.select(F.col("record_a").alias("repo_id_a"), F.col("record_b").alias("repo_id_b"))


def p1_repo_links(spark: SparkSession, root: str) -> DataFrame:
    return set_links(_usable(spark, root), "repo_id", ["ecosystem", "package_name"], _P1, least=4).withColumnRenamed("record", "repo_id")


_P3 = {"group": "id", "item": "neighbour_id", "score": "similarity", "second": "score", "n": 5}


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "kin", "id", "neighbour_id", "similarity", "score").where("id <> neighbour_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return top_n(_candidates(spark, root), **_P3).select("id", "place", "neighbour_id")


def p3_skipping(spark: SparkSession, root: str) -> DataFrame:
    """What the statistics save, over all files: row groups, those left unread, rows."""
    return skipping(_candidates(spark, root), **_P3).groupBy().sum("row_groups", "skipped", "row_count").toDF("row_groups", "skipped", "row_count")


def p4_package_frequency(spark: SparkSession, root: str) -> DataFrame:
    return value_frequencies(_usable(spark, root), "repo_id", ["ecosystem", "package_name"])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_package_frequency(spark, root).where("mark is not null").select("ecosystem", "package_name", "mark")


def _cluster_members(spark: SparkSession, root: str) -> DataFrame:
    """record_id, member: the non-null member ids of every cluster record."""
    c = table(spark, root, "clusters", "record_id", "members")
    return c.select("record_id", F.explode("members.id").alias("member")).where("member is not null")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return alike_groups(_cluster_members(spark, root), "record_id", "member")


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each group with its size, usual keeper, most frequent members and the records nearest its centroid."""
    members = _cluster_members(spark, root)
    groups = saved(alike_groups(members, "record_id", "member"), "groups")
    near = typical(centroid_distances(hashed_features(members, "record_id", "member"), groups, "record_id", "group_key"), "group_key", "record_id", "distance")
    keepers = table(spark, root, "clusters", "record_id", "keeper").select("record_id", F.col("keeper.id").alias("member")).where("member is not null")

    def usual(rows: DataFrame, name: str, n: int) -> DataFrame:
        """The n ids that most records of a group have, ties to the lower id."""
        counts = rows.distinct().join(groups, "record_id").groupBy("group_key", "member").agg(F.count("*").alias("k"))
        best = typical(counts.withColumn("rank", -F.col("k")), "group_key", "member", "rank", n)
        return best.select("group_key", F.col("typical").alias(name))

    return (
        near.withColumnRenamed("typical", "typical_records")
        .join(usual(keepers, "keepers", 1), "group_key", "left")
        .join(usual(members, "typical_members", 5), "group_key", "left")
        .select("group_key", "size", F.element_at("keepers", 1).alias("keeper"), "typical_members", "typical_records")
    )


def p5_kmeans(spark: SparkSession, root: str, per_cluster: int = 12) -> DataFrame:
    """All records in clusters of about ``per_cluster``, each with its size, spread and the records nearest its centroid."""
    features = saved(hashed_features(_cluster_members(spark, root), "record_id", "member"), "vectors")
    k = max(1, min(features.count() // per_cluster, most_centres(256)))
    assigned = saved(kmeans(features, k), "assigned")
    spread = assigned.groupBy("cluster").agg(F.sqrt(F.avg(F.col("distance"))).alias("spread"))
    return typical(assigned, "cluster", "record", "distance").join(spread, "cluster")


def _lengths(spark: SparkSession, root: str) -> DataFrame:
    return text_lengths(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")


def p6_pack_contexts(spark: SparkSession, root: str) -> DataFrame:
    packed = pack_texts(_lengths(spark, root), table(spark, root, "pack_budget"), "budget_id", "capacity_tokens", "reserved_tokens")
    return packed.withColumnsRenamed({"budget": "budget_id", "doc": "doc_id"})


def p6_fill_report(spark: SparkSession, root: str) -> DataFrame:
    return fill_report(pack_texts(_lengths(spark, root), table(spark, root, "pack_budget"), "budget_id", "capacity_tokens", "reserved_tokens"))


def p6_coverage(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of any packing: per budget, all documents placed, each whole and once, no context over its room."""
    packed = saved(p6_pack_contexts(spark, root), "packed")
    per_doc = packed.groupBy("budget_id", "doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.max("token_end").alias("end"), F.count_distinct("token_start").alias("starts"), F.count("*").alias("pieces"))
    docs = per_doc.groupBy("budget_id").agg(F.count("*").alias("documents"), F.count_if((F.col("n") != F.col("end")) | (F.col("starts") != F.col("pieces"))).alias("broken"))
    used = packed.where("context_no is not null").groupBy("budget_id", "room", "context_group", "context_no").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    return docs.join(used.groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("room")).alias("overfull"), F.max("room").alias("room")), "budget_id")


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the items that leaked into them and the longest run of each."""
    return leaked_items(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_item"), "doc_id", "text", "item_id", ["passage", "question"])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_leaks(spark, root).select("doc_id", "item_id")


def p8_reading(spark: SparkSession, root: str) -> DataFrame:
    """Counts, grade and level of every document."""
    docs, ratings = table(spark, root, "documents", "doc_id", "text"), table(spark, root, "reading_label", "doc_id", "level")
    return reading_levels(docs, "doc_id", "text", ratings, "doc_id", "level").withColumnRenamed("doc", "doc_id")


def p8_measured(spark: SparkSession, root: str) -> DataFrame:
    """The documents that get a level, and whether it is one of the scale."""
    return p8_reading(spark, root).select("doc_id", F.col("level").between(1, 5).alias("on_scale"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_reading(spark, root).select("doc_id", "level")


_ECO = keys.sql_ecosystem("ecosystem")
_USABLE = f"""usable AS (SELECT * FROM (
  SELECT repo_id, {_ECO} AS ecosystem, {keys.sql_package(_ECO, 'package_name')} AS package_name FROM dependency
) WHERE repo_id IS NOT NULL AND package_name IS NOT NULL AND package_name <> '')"""
_P1_SQL = f"""WITH {_USABLE}, item AS (SELECT DISTINCT repo_id, ecosystem || ':' || package_name AS k FROM usable),
size AS (SELECT repo_id, count(*) AS n FROM item GROUP BY 1 HAVING count(*) >= 4),
both_have AS (SELECT a.repo_id AS ra, b.repo_id AS rb, count(*) AS o FROM item a JOIN item b ON a.k = b.k AND a.repo_id < b.repo_id GROUP BY 1, 2),
pair AS (SELECT ra, rb FROM both_have JOIN size sa ON ra = sa.repo_id JOIN size sb ON rb = sb.repo_id WHERE o * 10 >= 7 * (sa.n + sb.n - o))"""

_P4_SQL = f"""WITH {_USABLE}, n AS (SELECT count(DISTINCT repo_id) AS everyone FROM usable),
freq AS (SELECT ecosystem, package_name, count(*) AS occurrences, count(DISTINCT repo_id) AS records FROM usable GROUP BY 1, 2),
marked AS (SELECT freq.*, CASE WHEN records = 1 THEN 'rare' WHEN records * 5 > everyone THEN 'common' END AS mark FROM freq, n)"""

# NFKC is beyond the SQL engine; its canonical form serves, as long as no text's matches hang on the difference.
_RUNS = "list_transform(range(1, len(w) - 11), lambda i : array_to_string(w[i : i + 12], ' '))"
_WORDS_OF = "regexp_extract_all(lower(nfc_normalize(regexp_replace({c}, '\\p{{Cf}}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+') AS w"
_P7_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_OF.format(c='text')} FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS_OF.format(c='t')} FROM (SELECT item_id, passage AS t FROM eval_item UNION ALL SELECT item_id, question FROM eval_item) WHERE t IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS r FROM d WHERE len(w) >= 13), ir AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS r FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_repo_links": p1_repo_links,
    "p3_found": p3_found,
    "p3_skipping": p3_skipping,
    "p4_found": p4_found,
    "p4_package_frequency": p4_package_frequency,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_kmeans": p5_kmeans,
    "p6_pack_contexts": p6_pack_contexts,
    "p6_fill_report": p6_fill_report,
    "p6_coverage": p6_coverage,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_reading": p8_reading,
    "p8_measured": p8_measured,
}
SQL = {
    "p1_found": f"{_P1_SQL} SELECT ra AS repo_id_a, rb AS repo_id_b FROM pair",
    "p1_repo_links": f"""{_P1_SQL}, ends AS (SELECT ra AS r, count(*) AS n FROM (SELECT ra, rb FROM pair UNION ALL SELECT rb, ra FROM pair) GROUP BY 1),
bag AS (SELECT repo_id, string_agg(k, '|' ORDER BY k) AS b FROM item SEMI JOIN size USING (repo_id) GROUP BY 1),
class AS (SELECT b, min(repo_id) AS class_id, count(*) AS copies FROM bag GROUP BY 1)
SELECT repo_id, class_id, copies, coalesce(n, 0) AS links FROM bag JOIN class USING (b) LEFT JOIN ends ON r = repo_id""",
    "p3_found": """SELECT id, place, neighbour_id FROM (
  SELECT id, neighbour_id, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, score DESC NULLS LAST, neighbour_id) AS place FROM (
    SELECT id, neighbour_id, similarity, score, row_number() OVER (PARTITION BY id, neighbour_id ORDER BY similarity DESC, score DESC NULLS LAST) AS k
    FROM kin WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND id <> neighbour_id) WHERE k = 1) WHERE place <= 5""",
    "p4_found": f"{_P4_SQL} SELECT ecosystem, package_name, mark FROM marked WHERE mark IS NOT NULL",
    "p4_package_frequency": f"{_P4_SQL} SELECT ecosystem, package_name, occurrences, records, mark FROM marked",
    "p6_coverage": """SELECT budget_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS broken, 0 AS overfull, capacity_tokens - coalesce(reserved_tokens, 0) AS room
FROM pack_budget WHERE capacity_tokens > coalesce(reserved_tokens, 0)""",
    "p7_found": _P7_SQL,
    "p8_measured": "SELECT doc_id, true AS on_scale FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]+'), lambda w : w <> '')) >= 60",
    "p5_found": """WITH RECURSIVE item AS (SELECT DISTINCT record_id AS r, m.id AS k FROM (SELECT record_id, unnest(members) AS m FROM clusters) WHERE m.id IS NOT NULL),
size AS (SELECT r, count(*) AS n FROM item GROUP BY 1 HAVING count(*) >= 2),
half AS (SELECT a.r AS x, b.r AS y FROM item a JOIN item b ON a.k = b.k AND a.r < b.r GROUP BY 1, 2
  HAVING 2 * count(*) >= (SELECT n FROM size WHERE size.r = a.r) + (SELECT n FROM size WHERE size.r = b.r) - count(*)),
alike AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
deg AS (SELECT x, count(*) AS d FROM alike GROUP BY 1),
hold AS (SELECT x, y FROM half WHERE EXISTS (SELECT 1 FROM alike p JOIN alike q ON p.y = q.y WHERE p.x = half.x AND q.x = half.y)
  OR ((SELECT d FROM deg WHERE deg.x = half.x) = 1 AND (SELECT d FROM deg WHERE deg.x = half.y) = 1)),
edge AS (SELECT x, y FROM hold UNION ALL SELECT y, x FROM hold),
reach AS (SELECT x AS r, x AS k FROM edge UNION SELECT reach.r, edge.y FROM reach JOIN edge ON edge.x = reach.k)
SELECT r AS record_id, min(k) AS group_key FROM reach GROUP BY 1""",
}
