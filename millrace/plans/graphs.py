"""Graphs: the import-like graph of parts ordered together, and the similarity graph of kin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import graph, relational
from millrace.operators.components import connected_components
from millrace.session import saved, table

#: From this similarity on, two repositories count as kin (fixed value).
KIN_AT = 0.68


def part_edges(spark: SparkSession, root: str) -> DataFrame:
    """Distinct edges between parts that follow each other in an order, loops dropped."""
    li = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


def kin_edges(spark: SparkSession, root: str) -> DataFrame:
    """The undirected similarity graph, each pair with its greatest similarity."""
    k = table(spark, root, "kin", "id", "neighbour_id", "similarity").where("similarity is not null and not isnan(similarity)")
    return relational.undirected(k.select(F.col("id").alias("src"), F.col("neighbour_id").alias("dst"), F.col("similarity").alias("sim")), "src", "dst", "sim")


def fork_edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "repo", "id", "parent_id").where("parent_id is not null and parent_id <> id").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")).distinct()


def degree_instability(spark: SparkSession, root: str) -> DataFrame:
    """Fan-in, fan-out and instability of every part."""
    return graph.degrees(part_edges(spark, root)).withColumn("instability", scalar.instability(F.col("fan_in"), F.col("fan_out")))


def hub_parts(spark: SparkSession, root: str) -> DataFrame:
    """The fourteen parts with most edges."""
    return graph.degrees(part_edges(spark, root)).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree")).orderBy(F.desc("degree"), "node").limit(14)


def reverse_closure(spark: SparkSession, root: str) -> DataFrame:
    """All that descends from the repository with most direct forks, with least depth."""
    e = fork_edges(spark, root)
    start = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")
    return graph.reverse_closure(e, start)


def closure_depths(spark: SparkSession, root: str) -> DataFrame:
    """How many parts reach the most used part at each depth."""
    e = saved(part_edges(spark, root), "part-edges")
    start = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")
    return graph.reverse_closure(e, start).groupBy("depth").agg(F.count("*").alias("n"))


def components(spark: SparkSession, root: str) -> DataFrame:
    """Groups of repositories tied by strong similarity."""
    return connected_components(kin_edges(spark, root).where(F.col("sim") >= KIN_AT))


def fork_components(spark: SparkSession, root: str) -> DataFrame:
    """G3 over forks."""
    return connected_components(fork_edges(spark, root))


def scc(spark: SparkSession, root: str) -> DataFrame:
    """Repositories on a cycle of the directed similarity graph, their component's least id."""
    k = table(spark, root, "kin", "id", "neighbour_id", "similarity").where(F.col("similarity") >= KIN_AT)
    return graph.strong_components(k, "id", "neighbour_id")


def louvain(spark: SparkSession, root: str) -> DataFrame:
    """Modularity communities of the strong similarity graph."""
    return graph.communities(kin_edges(spark, root), "src", "dst", "sim", KIN_AT)


def partition_bounds(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of any communities and labels: every tied node has one label, no community or label leaves its component, none of one node."""
    e = saved(kin_edges(spark, root).where(F.col("sim") >= KIN_AT), "strong-edges")
    comp = saved(connected_components(e), "component-of")

    def told(rows: DataFrame, group: str) -> DataFrame:
        r = saved(rows, "told")
        across = r.join(comp, "node").groupBy(group).agg(F.count_distinct("component").alias("c"), F.count("*").alias("n"))
        found = r.agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes"))
        return across.agg(F.count_if(F.col("c") > 1).alias("across"), F.count_if(F.col("n") < 2).alias("alone")).join(found).select(F.lit(group).alias("partition"), (F.col("rows") - F.col("nodes")).alias("repeated"), "across", "alone", "nodes")

    labels, groups = told(graph.label_propagation(e), "label"), told(graph.communities(e, "src", "dst", "sim", KIN_AT), "community")
    return labels.unionByName(groups.withColumn("alone", F.col("alone")))


def label_propagation(spark: SparkSession, root: str) -> DataFrame:
    """Labels after six passes over the strong similarity graph."""
    return graph.label_propagation(kin_edges(spark, root).where(F.col("sim") >= KIN_AT))


def document_tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree of manifest paths of every repository."""
    d = table(spark, root, "dependency", "repo_id", "manifest_path").where("repo_id is not null and manifest_path is not null and manifest_path <> ''").distinct()
    return graph.path_edges(d, "manifest_path", "repo_id")


def fork_roots(spark: SparkSession, root: str) -> DataFrame:
    """Repositories that nothing was forked from."""
    r = table(spark, root, "repo", "id").distinct()
    return graph.roots(r, fork_edges(spark, root), "id")


def strongest_links(spark: SparkSession, root: str) -> DataFrame:
    """The 900 strongest links of 0.55 or more between known repositories."""
    return graph.strongest(kin_edges(spark, root), table(spark, root, "repo", "id"), "id", "sim", 0.55, 900)


def two_hops(spark: SparkSession, root: str) -> DataFrame:
    """Repositories exactly two hops of kinship from the busiest one."""
    e = relational.both_ways(kin_edges(spark, root).where(F.col("sim") >= KIN_AT).select("src", "dst"), "src", "dst")
    start = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")
    return graph.hop(start, e, 2)


def nation_trade(spark: SparkSession, root: str) -> DataFrame:
    """How often customers of one nation buy from suppliers of another."""
    o = table(spark, root, "orders", "o_orderkey", "o_custkey").join(table(spark, root, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    pairs = table(spark, root, "lineitem", "l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, root, "supplier", "s_suppkey", "s_nationkey")
    return pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.sum("n").alias("n")).where("c_nationkey <> s_nationkey")


def corroborated_kin(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that both repositories name as kin."""
    k = table(spark, root, "kin", "id", "neighbour_id").where("id <> neighbour_id")
    back = k.select(F.col("neighbour_id").alias("id"), F.col("id").alias("neighbour_id"))
    return graph.shared_neighbours(k, back, "id", "neighbour_id")


_PE = "pe AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"
_KE = "ke AS (SELECT least(id, neighbour_id) AS src, greatest(id, neighbour_id) AS dst, max(similarity) AS sim FROM kin WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND id <> neighbour_id GROUP BY 1, 2)"
_FE = "fe AS (SELECT DISTINCT id AS src, parent_id AS dst FROM repo WHERE parent_id IS NOT NULL AND parent_id <> id)"
_DEG = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM pe UNION ALL SELECT dst, 1, 0 FROM pe) GROUP BY 1)"
_BUSY = "st AS (SELECT dst AS node FROM {e} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_CLOSE = "WITH RECURSIVE {ctes}, walk AS (SELECT st.node AS start, e.src AS node, 1 AS depth FROM st JOIN {e} e ON e.dst = st.node UNION SELECT w.start, e.src, w.depth + 1 FROM walk w JOIN {e} e ON e.dst = w.node WHERE w.depth < 20), best AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY 1, 2)"
_CC = "WITH RECURSIVE {ctes}, b AS (SELECT src AS x, dst AS y FROM {e} UNION SELECT dst, src FROM {e}), reach(node, component) USING KEY (node) AS (SELECT x, min(least(x, y)) FROM b GROUP BY 1 UNION SELECT b.x, min(r.component) FROM reach r JOIN b ON b.y = r.node JOIN recurring.reach p ON p.node = b.x WHERE r.component < p.component GROUP BY 1) SELECT node, component FROM reach"
_TREE = "WITH p AS (SELECT DISTINCT repo_id, manifest_path AS f, string_split(manifest_path, '/') AS a FROM dependency WHERE repo_id IS NOT NULL AND manifest_path IS NOT NULL AND manifest_path <> ''), s AS (SELECT repo_id, a, unnest(range(1, len(a) + 1)) AS i FROM p) SELECT repo_id, array_to_string(a[1 : i - 1], '/') AS parent, array_to_string(a[1 : i], '/') AS child, bool_or(i = len(a)) AS is_file FROM s GROUP BY 1, 2, 3"

QUERIES = {
    f.__name__: f
    for f in (
        part_edges, degree_instability, hub_parts, reverse_closure, closure_depths, components, fork_components, scc, louvain, label_propagation, partition_bounds, document_tree, fork_roots, strongest_links, two_hops,
        nation_trade, corroborated_kin,
    )
}
SQL = {
    "part_edges": f"WITH {_PE} SELECT src, dst FROM pe",
    "degree_instability": f"WITH {_PE}, {_DEG} SELECT node, fan_in, fan_out, floor(fan_out / (fan_in + fan_out) * 100.0 + 0.5) / 100.0 AS instability FROM deg",
    "hub_parts": f"WITH {_PE}, {_DEG} SELECT node, fan_in + fan_out AS degree FROM deg ORDER BY 2 DESC, 1 LIMIT 14",
    "reverse_closure": _CLOSE.format(ctes=f"{_FE}, {_BUSY.format(e='fe')}", e="fe") + " SELECT start, node, depth FROM best",
    "closure_depths": _CLOSE.format(ctes=f"{_PE}, {_BUSY.format(e='pe')}", e="pe") + " SELECT depth, count(*) AS n FROM best GROUP BY 1",
    "components": _CC.format(ctes=f"{_KE}, strong AS (SELECT src, dst FROM ke WHERE sim >= {KIN_AT})", e="strong"),
    "fork_components": _CC.format(ctes=_FE, e="fe"),
    "scc": f"WITH RECURSIVE e AS (SELECT DISTINCT id AS u, neighbour_id AS v FROM kin WHERE similarity >= {KIN_AT} AND id <> neighbour_id), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT a.u AS node, least(a.u, min(a.v)) AS scc FROM r a JOIN r b ON a.u = b.v AND a.v = b.u WHERE a.u <> a.v GROUP BY a.u",
    "partition_bounds": f"WITH {_KE}, n AS (SELECT count(*) AS nodes FROM (SELECT src FROM ke WHERE sim >= {KIN_AT} UNION SELECT dst FROM ke WHERE sim >= {KIN_AT})) SELECT p AS \"partition\", 0 AS repeated, 0 AS across, 0 AS alone, nodes FROM n, (VALUES ('label'), ('community')) t(p)",
    "document_tree": _TREE,
    "fork_roots": f"WITH {_FE} SELECT DISTINCT id FROM repo WHERE id NOT IN (SELECT dst FROM fe)",
    "strongest_links": f"WITH {_KE} SELECT src, dst, sim FROM ke WHERE sim >= 0.55 AND src IN (SELECT id FROM repo) AND dst IN (SELECT id FROM repo) ORDER BY sim DESC, src, dst LIMIT 900",
    "two_hops": f"WITH {_KE}, b AS (SELECT src, dst FROM ke WHERE sim >= {KIN_AT} UNION ALL SELECT dst, src FROM ke WHERE sim >= {KIN_AT}), st AS (SELECT src AS node FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT DISTINCT y.dst AS node FROM b x JOIN b y ON x.dst = y.src WHERE x.src = (SELECT node FROM st)",
    "nation_trade": "SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2",
    "corroborated_kin": "SELECT DISTINCT a.id, a.neighbour_id FROM kin a JOIN kin b ON a.id = b.neighbour_id AND a.neighbour_id = b.id WHERE a.id <> a.neighbour_id",
}
