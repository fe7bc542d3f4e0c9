"""Repositories: current rows, facets, rollups, ranking, percentiles, neighbours and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import relational
from millrace.session import table


def current(spark: SparkSession, root: str) -> DataFrame:
    """I4: the last loaded row of every repository that isn't deleted."""
    r = table(spark, root, "repo")
    rest = [c for c in r.columns if c != "id"]
    last = r.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("loaded_at", "updated_at", "name", "stars")).alias("r")).select("id", "r.*")
    return last.where("deleted_at is null")


def current_repos(spark: SparkSession, root: str) -> DataFrame:
    return current(spark, root).select("id", "name", "kind", "domain", "language", "stars", "forks", "parent_id")


def grades(spark: SparkSession, root: str) -> DataFrame:
    """The latest non-null score of every neighbour in kin: what the audit said last."""
    k = table(spark, root, "kin", "neighbour_id", "score", "built_at").where("score is not null and not isnan(score)")
    return k.groupBy(F.col("neighbour_id").alias("id")).agg(F.max(F.struct("built_at", "score")).alias("s")).select("id", "s.score")


def lean_projection(spark: SparkSession, root: str) -> DataFrame:
    """The short record with five capability bits and the score, null where never audited."""
    h = lambda c: F.col(f"health.{c}")
    bits = scalar.bits(h("has_tests"), h("has_ci"), h("has_license"), h("has_readme"), h("has_lockfile"))
    return current(spark, root).join(grades(spark, root), "id", "left").select(
        F.col("id").alias("i"), F.left("name", F.lit(180)).alias("n"), F.col("domain").alias("d"), F.col("language").alias("l"), F.col("stars").alias("s"),
        F.when(F.col("health").isNotNull(), bits).alias("c"), F.col("score").alias("g"),
    )


def expanded_flags(spark: SparkSession, root: str) -> DataFrame:
    """The bits of the short record read back, repositories with tests and CI but no lockfile."""
    x = lean_projection(spark, root).select(F.col("i").alias("id"), *[scalar.bit(F.col("c"), k).alias(f) for k, f in enumerate(("tests", "ci", "license", "readme", "lockfile"), 1)])
    return x.where("tests and ci and not lockfile")


def search(spark: SparkSession, root: str) -> DataFrame:
    """Repositories with a word in one of four fields, most stars first."""
    word = F.lit("agent")
    hit = F.lit(False)
    for c in ("name", "domain", "language", "kind"):
        hit = hit | F.coalesce(F.lower(c).contains(word), F.lit(False))
    return current(spark, root).where(hit).select("id", "name", "stars")


def page_slice(spark: SparkSession, root: str) -> DataFrame:
    """The third page of ten by stars."""
    return relational.page(current(spark, root), [F.desc("stars"), F.asc("id")], 3).select("id", "name", "stars")


def featured(spark: SparkSession, root: str) -> DataFrame:
    """The three repositories with most stars of their own or their parent."""
    r = current(spark, root)
    p = r.select(F.col("id").alias("parent_id"), F.col("stars").alias("parent_stars"))
    return r.join(p, "parent_id", "left").select("id", F.coalesce("parent_stars", "stars").alias("shine")).orderBy(F.desc("shine"), "id").limit(3)


def fork_parents(spark: SparkSession, root: str) -> DataFrame:
    """Repositories whose parent is in the estate, by id, not themselves."""
    r = current(spark, root)
    return r.alias("c").join(r.alias("p"), F.col("c.parent_id") == F.col("p.id")).where("c.id <> p.id").select(F.col("c.id").alias("id"), F.col("p.id").alias("parent"), F.col("p.stars").alias("parent_stars"))


def taxonomy_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts by domain, language, kind and all, in one pass of grouping sets."""
    r = current(spark, root).select(F.coalesce("domain", F.lit("Other")).alias("domain"), F.coalesce("language", F.lit("Other")).alias("language"), "kind")
    g = r.groupingSets([["domain"], ["language"], ["kind"], []], "domain", "language", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    facet = F.when(F.col("gid") == 3, "domain").when(F.col("gid") == 5, "language").when(F.col("gid") == 6, "kind").otherwise("all")
    return g.select(facet.alias("facet"), F.coalesce(F.when(F.col("gid") == 3, F.col("domain")), F.when(F.col("gid") == 5, F.col("language")), F.when(F.col("gid") == 6, F.col("kind")), F.lit("all")).alias("value"), "n")


def hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Rollup of domain and language with repositories and stars."""
    r = current(spark, root).select(F.coalesce("domain", F.lit("Other")).alias("domain"), F.coalesce("language", F.lit("-")).alias("language"), "stars")
    return r.rollup("domain", "language").agg(F.count("*").alias("repos"), F.sum("stars").alias("stars"))


def region_rollup(spark: SparkSession, root: str) -> DataFrame:
    """G11 over region, nation and customer."""
    n = table(spark, root, "nation").join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, root, "customer", "c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("r_name", "n_name").agg(F.sum("n").alias("customers"), scalar.half_up(F.sum("b"), 1).alias("balance"))


def estate_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals and shares over the estate."""
    r = current(spark, root)
    return r.agg(
        F.count("*").alias("repos"), F.count_distinct("language").alias("languages"), F.sum("stars").alias("stars"), F.count_if(F.col("health.has_ci")).alias("with_ci"),
        F.count_if(F.col("health").isNull()).alias("unaudited"), scalar.round1(100 * F.count_if(F.col("health.has_tests")) / F.count("health")).alias("tests_percent"),
    )


def coverage_floors(spark: SparkSession, root: str) -> DataFrame:
    """The share of repositories with each field, against its floor in percent."""
    r = current(spark, root).join(grades(spark, root), "id", "left")
    floors = {"domain": 85.0, "language": 85.0, "health": 80.0, "score": 50.0}
    parts = [r.agg(F.lit(c).alias("field"), scalar.round1(100 * F.count(c) / F.count("*")).alias("percent")).withColumn("reached", F.col("percent") >= f) for c, f in floors.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def firing_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each capability is missing, of repositories that were looked at."""
    flags = ["has_tests", "has_ci", "has_license", "has_readme", "has_lockfile"]
    r = current(spark, root).where("health is not null").select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"health.{f}").alias("has")) for f in flags])).alias("x"))
    return r.groupBy("x.flag").agg(F.count_if(~F.col("x.has")).alias("missing"), F.count("*").alias("seen"), scalar.half_up(F.count_if(~F.col("x.has")) / F.count("*"), 4).alias("rate"))


def grade_ladder(spark: SparkSession, root: str) -> DataFrame:
    """G-15, A11: letters with their number of repositories and mean score."""
    g = grades(spark, root).withColumn("letter", scalar.letter(F.col("score")))
    return g.groupBy("letter").agg(F.count("*").alias("n"), scalar.round1(F.avg("score")).alias("mean"))


def next_letter(spark: SparkSession, root: str) -> DataFrame:
    """G-15: the next better letter of each repository and the points to it."""
    g = grades(spark, root).withColumn("n", scalar.next_step(F.col("score")))
    return g.select("id", "score", F.col("n.letter").alias("next"), F.col("n.points").alias("points"))


def band_vs_outcome(spark: SparkSession, root: str) -> DataFrame:
    """Signals outside the rubric per grade band: stars, forks, share of forks of others."""
    r = current(spark, root).join(grades(spark, root), "id")
    b = r.withColumn("band", scalar.band(F.col("score"), [(75, "high"), (50, "middle")], "low"))
    return b.groupBy("band").agg(F.count("*").alias("n"), scalar.half_up(F.avg("stars"), 2).alias("stars"), scalar.half_up(F.avg("forks"), 2).alias("forks"), scalar.half_up(F.avg(F.col("parent_id").isNotNull().cast("int")), 4).alias("forked"))


def percentile_fit(spark: SparkSession, root: str) -> DataFrame:
    """Nearest-rank 2nd and 98th percentile of stars, and the stars clamped between them, summed."""
    r = current(spark, root)
    p = relational.nearest_rank(r, "stars", [0.02, 0.98]).first()
    low, high = p["p0"], p["p1"]
    return r.agg(F.lit(low).alias("low"), F.lit(high).alias("high"), F.sum(F.greatest(F.lit(low), F.least(F.lit(high), F.col("stars")))).alias("clamped"))


def minmax_norm(spark: SparkSession, root: str) -> DataFrame:
    """Stars and forks scaled to [0, 1]."""
    return relational.min_max(current(spark, root).select("id", F.col("stars").cast("double").alias("stars"), F.col("forks").cast("double").alias("forks")), ["stars", "forks"])


def short_numbers(spark: SparkSession, root: str) -> DataFrame:
    """P25: order totals of each customer in short form."""
    o = table(spark, root, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(scalar.half_up(F.sum("o_totalprice"), 0).alias("total"))
    return o.select("o_custkey", scalar.short_number(F.col("total")).alias("short"))


def keeper(spark: SparkSession, root: str) -> DataFrame:
    """The best member of every cluster record by score, stars, manifests, then lowest id; unaudited members last."""
    c = table(spark, root, "clusters", "record_id", "members").select("record_id", F.explode("members").alias("m")).where("m.id is not null")
    m = c.groupBy("record_id", F.col("m.id").alias("member")).agg(F.max(F.coalesce("m.score", F.lit(-1.0))).alias("score"))
    stars = current(spark, root).select(F.col("id").alias("member"), "stars")
    files = table(spark, root, "dependency", "repo_id", "manifest_path").dropna().distinct().groupBy(F.col("repo_id").alias("member")).agg(F.count("*").alias("files"))
    m = m.join(stars, "member", "left").join(files, "member", "left").fillna(0, ["stars", "files"])
    return m.groupBy("record_id").agg(F.max_by("member", F.struct("score", "stars", "files", -F.col("member"))).alias("keeper"), F.max("score").alias("score"))


def cluster_summary(spark: SparkSession, root: str) -> DataFrame:
    """A25, A40, G-17: per build, clusters, repositories covered, cross-domain, largest, ungraded members, wholly ungraded clusters, mean score."""
    c = table(spark, root, "clusters", "record_id", "build_no", "members").select("record_id", "build_no", F.explode("members").alias("m")).where("m.id is not null")
    one = c.groupBy("build_no", "record_id", F.col("m.id").alias("id")).agg(F.max("m.score").alias("score"), F.collect_set("m.domain").alias("domains"))
    m = one.groupBy("build_no", "record_id").agg(
        F.count("*").alias("size"), F.size(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("domains"), F.count_if(F.col("score").isNull()).alias("ungraded"),
        F.sum(F.round(F.col("score") * 100).cast("long")).alias("hundredths"),
    )
    graded = F.sum("size") - F.sum("ungraded")
    return m.groupBy("build_no").agg(
        F.count("*").alias("clusters"), F.sum("size").alias("covered"), F.count_if(F.col("domains") > 1).alias("cross_domain"), F.max("size").alias("largest"), F.sum("ungraded").alias("ungraded"),
        F.count_if(F.col("ungraded") == F.col("size")).alias("blind"), F.when(graded > 0, scalar.half_up(F.sum("hundredths") / graded / 100, 1)).alias("mean_score"),
    )


def cluster_numbers(spark: SparkSession, root: str) -> DataFrame:
    """G-17: clusters of each build numbered c001, c002, ... by size, then least member."""
    c = table(spark, root, "clusters", "record_id", "build_no", "members").select("record_id", "build_no", F.explode("members.id").alias("m")).where("m is not null")
    m = c.groupBy("build_no", "record_id").agg(F.count_distinct("m").alias("size"), F.min("m").alias("least"))
    n = relational.numbered(m, ["build_no"], [F.desc("size"), F.asc("least"), F.asc("record_id")], "n")
    return n.select("record_id", "build_no", F.concat(F.lit("c"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("number"))


def cluster_mismatches(spark: SparkSession, root: str) -> DataFrame:
    """K6: cluster records whose stated size or keeper disagrees with their members."""
    c = table(spark, root, "clusters", "record_id", "size", "keeper", "members")
    ids = F.array_compact(F.array_distinct(F.col("members.id")))
    return c.select("record_id", F.col("size").alias("stated"), F.size(ids).alias("found"), F.array_contains(ids, F.col("keeper.id")).alias("keeper_in")).where("stated is distinct from found or not coalesce(keeper_in, false)").select("record_id", "stated", "found")


def neighbours(spark: SparkSession, root: str) -> DataFrame:
    """A repository's twelve nearest with their briefs, and the neighbours before and after each."""
    k = table(spark, root, "kin", "id", "neighbour_id", "similarity").where("id <> neighbour_id and similarity is not null and not isnan(similarity)")
    best = k.groupBy("id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    top = relational.top_k(best, ["id"], [F.desc("similarity"), F.asc("neighbour_id")], 12)
    w = Window.partitionBy("id").orderBy("place")
    walked = top.withColumn("previous", F.lag("neighbour_id").over(w)).withColumn("following", F.lead("neighbour_id").over(w))
    brief = current(spark, root).select(F.col("id").alias("neighbour_id"), "name", "domain")
    return walked.join(brief, "neighbour_id", "left").select("id", "place", "neighbour_id", "similarity", "name", "domain", "previous", "following")


def interleaved(spark: SparkSession, root: str) -> DataFrame:
    """Repositories taken from the domains in turn, most stars first; everyone's turn."""
    r = current(spark, root).select("id", F.coalesce("domain", F.lit("Other")).alias("domain"), "stars")
    return relational.numbered(r, ["domain"], [F.desc_nulls_last("stars"), F.asc("id")], "turn").select("id", "domain", "turn")


def running_budget(spark: SparkSession, root: str) -> DataFrame:
    """Per repository, its smallest documents first while 20,000 characters last."""
    d = table(spark, root, "documents", "doc_id", "repo_id", "n_chars").where("repo_id is not null")
    return relational.within_budget(d, ["repo_id"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 20_000)


def strata_sample(spark: SparkSession, root: str) -> DataFrame:
    """100 repositories, 40, 35 and 25 percent from three strata of stars."""
    r = current(spark, root).select("id", "stars")
    s = F.when(F.col("stars") >= 100, "many").when(F.col("stars") >= 20, "some").otherwise("few")
    return relational.stratified(r, s, {"many": 0.4, "some": 0.35, "few": 0.25}, 100, 7, "id").select("stratum", "id")


def due_items(spark: SparkSession, root: str) -> DataFrame:
    """Customers whose last order is 14 days or more before the last order of all, or who have none."""
    o = table(spark, root, "orders", "o_custkey", "o_orderdate")
    as_of = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    done = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("done_at")).withColumn("version", F.lit(1))
    return relational.due(table(spark, root, "customer", "c_custkey"), done, "c_custkey", 1, as_of, 14)


def latest_upsert(spark: SparkSession, root: str) -> DataFrame:
    """I4, K2: repositories merged from their rows, the last loaded wins; deleted ones stay."""
    r = table(spark, root, "repo", "id", "name", "stars", "loaded_at")
    none = r.limit(0)
    return relational.latest_wins(none, r, ["id"], ["loaded_at", "name", "stars"]).select("id", "name", "stars")


def posts_by_domain(spark: SparkSession, root: str) -> DataFrame:
    """Repositories with at least one document, by domain."""
    have = table(spark, root, "documents", "repo_id").where("repo_id is not null").select(F.col("repo_id").alias("id")).distinct()
    return current(spark, root).join(have, "id", "left_semi").groupBy(F.coalesce("domain", F.lit("Other")).alias("domain")).agg(F.count("*").alias("repos"))


def recent_feed(spark: SparkSession, root: str) -> DataFrame:
    """The twenty latest published documents, the newest first."""
    d = table(spark, root, "documents", "doc_id", "title", "published_at").where("published_at is not null")
    return d.orderBy(F.desc("published_at"), "doc_id").limit(20).select("doc_id", "title")


def visible_parents(spark: SparkSession, root: str) -> DataFrame:
    """repositories in one domain and size band, and parents of any such."""
    r = current(spark, root)
    seen = r.where("domain = 'Infra & Ops' and stars between 10 and 100")
    parents = r.join(seen.select(F.col("parent_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    return seen.select("id").unionByName(parents.select("id")).distinct()


def name_set_difference(spark: SparkSession, root: str) -> DataFrame:
    """Spellings of ecosystems that one of two tables has and the other hasn't."""
    a, b = (table(spark, root, t, "ecosystem").dropna().distinct() for t in ("dependency", "advisory_affects"))
    only = lambda x, y, name: x.join(y, "ecosystem", "left_anti").withColumn("only_in", F.lit(name))
    return only(a, b, "dependency").unionByName(only(b, a, "advisory_affects"))


_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, updated_at DESC NULLS LAST, name DESC NULLS LAST, stars DESC NULLS LAST) AS k FROM repo) WHERE k = 1),
cur AS (SELECT * FROM last WHERE deleted_at IS NULL)"""
_GR = "gr AS (SELECT neighbour_id AS id, score FROM (SELECT *, row_number() OVER (PARTITION BY neighbour_id ORDER BY built_at DESC NULLS LAST, score DESC) AS k FROM kin WHERE score IS NOT NULL AND NOT isnan(score)) WHERE k = 1)"
_LETTER = "CASE " + " ".join(f"WHEN score >= {a} THEN '{b}'" for a, b in scalar.LADDER) + " ELSE 'F' END"
_H1 = "floor(({x}) * 10.0 + 0.5) / 10.0"
_H2 = "floor(({x}) * 100.0 + 0.5) / 100.0"
_H4 = "floor(({x}) * 10000.0 + 0.5) / 10000.0"
_BIT = lambda f: f"CASE WHEN health.{f} THEN '1' ELSE '0' END"
_FLAGS = ["has_tests", "has_ci", "has_license", "has_readme", "has_lockfile"]
_NEXT = "CASE " + " ".join(f"WHEN score < {a} THEN '{b}'" for a, b in reversed(scalar.LADDER)) + " END"
_PTS = "CASE " + " ".join(f"WHEN score < {a} THEN {_H1.format(x=f'{a}.0 - score')}" for a, b in reversed(scalar.LADDER)) + " END"
_MEM = "mem AS (SELECT record_id, build_no, m FROM (SELECT record_id, build_no, unnest(members) AS m FROM clusters) WHERE m.id IS NOT NULL)"

QUERIES = {
    f.__name__: f
    for f in (
        current_repos, lean_projection, expanded_flags, search, page_slice, featured, fork_parents, taxonomy_counts, hierarchy, region_rollup, estate_totals, coverage_floors, firing_rates,
        grade_ladder, next_letter, band_vs_outcome, percentile_fit, minmax_norm, short_numbers, keeper, cluster_summary, cluster_numbers, cluster_mismatches, neighbours, interleaved,
        running_budget, strata_sample, due_items, latest_upsert, posts_by_domain, recent_feed, visible_parents, name_set_difference,
    )
}
SQL = {
    "current_repos": f"WITH {_LAST} SELECT id, name, kind, domain, language, stars, forks, parent_id FROM cur",
    "lean_projection": f"WITH {_LAST}, {_GR} SELECT cur.id AS i, left(name, 180) AS n, domain AS d, language AS l, stars AS s, CASE WHEN health IS NOT NULL THEN {' || '.join(map(_BIT, _FLAGS))} END AS c, score AS g FROM cur LEFT JOIN gr ON cur.id = gr.id",
    "expanded_flags": f"WITH {_LAST} SELECT id, health.has_tests AS tests, health.has_ci AS ci, health.has_license AS license, health.has_readme AS readme, health.has_lockfile AS lockfile FROM cur WHERE health.has_tests AND health.has_ci AND NOT health.has_lockfile",
    "search": f"WITH {_LAST} SELECT id, name, stars FROM cur WHERE contains(lower(coalesce(name, '')), 'agent') OR contains(lower(coalesce(domain, '')), 'agent') OR contains(lower(coalesce(language, '')), 'agent') OR contains(lower(coalesce(kind, '')), 'agent')",
    "page_slice": f"WITH {_LAST} SELECT id, name, stars FROM cur ORDER BY stars DESC NULLS LAST, id LIMIT 10 OFFSET 20",
    "featured": f"WITH {_LAST} SELECT c.id, coalesce(p.stars, c.stars) AS shine FROM cur c LEFT JOIN cur p ON c.parent_id = p.id ORDER BY 2 DESC NULLS LAST, 1 LIMIT 3",
    "fork_parents": f"WITH {_LAST} SELECT c.id, p.id AS parent, p.stars AS parent_stars FROM cur c JOIN cur p ON c.parent_id = p.id WHERE c.id <> p.id",
    "taxonomy_counts": f"WITH {_LAST} SELECT 'domain' AS facet, coalesce(domain, 'Other') AS value, count(*) AS n FROM cur GROUP BY 2 UNION ALL SELECT 'language', coalesce(language, 'Other'), count(*) FROM cur GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM cur GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM cur",
    "hierarchy": f"WITH {_LAST}, c AS (SELECT coalesce(domain, 'Other') AS domain, coalesce(language, '-') AS language, stars FROM cur) SELECT domain, language, count(*) AS repos, CAST(sum(stars) AS BIGINT) AS stars FROM c GROUP BY ROLLUP (domain, language)",
    "region_rollup": f"SELECT r_name, n_name, count(*) AS customers, {_H1.format(x='sum(c_acctbal)')} AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "estate_totals": f"WITH {_LAST} SELECT count(*) AS repos, count(DISTINCT language) AS languages, CAST(sum(stars) AS BIGINT) AS stars, count(*) FILTER (health.has_ci) AS with_ci, count(*) FILTER (health IS NULL) AS unaudited, {_H1.format(x='100 * count(*) FILTER (health.has_tests) / count(health)')} AS tests_percent FROM cur",
    "coverage_floors": f"WITH {_LAST}, {_GR}, j AS (SELECT cur.*, score FROM cur LEFT JOIN gr ON cur.id = gr.id), f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {_H1.format(x=f'100 * count({c}) / count(*)')} AS percent, {v} AS floor_at FROM j" for c, v in (("domain", 85), ("language", 85), ("health", 80), ("score", 50))) + ") SELECT field, percent, percent >= floor_at AS reached FROM f",
    "firing_rates": f"WITH {_LAST} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (NOT health.{f}) AS missing, count(*) AS seen, {_H4.format(x=f'count(*) FILTER (NOT health.{f}) / count(*)')} AS rate FROM cur WHERE health IS NOT NULL" for f in _FLAGS),
    "grade_ladder": f"WITH {_GR} SELECT {_LETTER} AS letter, count(*) AS n, {_H1.format(x='avg(score)')} AS mean FROM gr GROUP BY 1",
    "next_letter": f"WITH {_GR} SELECT id, score, {_NEXT} AS next, {_PTS} AS points FROM gr",
    "band_vs_outcome": f"WITH {_LAST}, {_GR} SELECT CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, {_H2.format(x='avg(stars)')} AS stars, {_H2.format(x='avg(forks)')} AS forks, {_H4.format(x='avg(CAST(parent_id IS NOT NULL AS INT))')} AS forked FROM cur JOIN gr ON cur.id = gr.id GROUP BY 1",
    "percentile_fit": f"WITH {_LAST}, p AS (SELECT quantile_disc(stars, 0.02) AS low, quantile_disc(stars, 0.98) AS high FROM cur) SELECT low, high, CAST(sum(greatest(low, least(high, stars))) AS BIGINT) AS clamped FROM cur, p WHERE stars IS NOT NULL GROUP BY 1, 2",
    "minmax_norm": f"WITH {_LAST}, e AS (SELECT min(stars) AS a, max(stars) AS b, min(forks) AS c, max(forks) AS d FROM cur) SELECT id, {_H4.format(x='(stars - a) / (b - a)')} AS stars, {_H4.format(x='(forks - c) / (d - c)')} AS forks FROM cur, e",
    "short_numbers": "WITH t AS (SELECT o_custkey, floor(sum(o_totalprice) + 0.5) AS total FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN total < 10000 THEN CAST(CAST(total AS BIGINT) AS VARCHAR) WHEN total < 1000000 THEN printf('%.1f', floor(total / 1e3 * 10.0 + 0.5) / 10.0) || 'K' ELSE printf('%.1f', floor(total / 1e6 * 10.0 + 0.5) / 10.0) || 'M' END AS short FROM t",
    "keeper": f"WITH {_LAST}, {_MEM}, m AS (SELECT record_id, m.id AS member, max(coalesce(m.score, -1.0)) AS score FROM mem GROUP BY 1, 2), f AS (SELECT repo_id, count(DISTINCT manifest_path) AS files FROM dependency GROUP BY 1) SELECT record_id, member AS keeper, score FROM (SELECT m.*, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, coalesce(stars, 0) DESC, coalesce(files, 0) DESC, member) AS k FROM m LEFT JOIN cur ON cur.id = member LEFT JOIN f ON f.repo_id = member) WHERE k = 1",
    "cluster_summary": f"WITH {_MEM}, s AS (SELECT build_no, record_id, m.id AS id, max(m.score) AS score FROM mem GROUP BY 1, 2, 3), d AS (SELECT record_id, count(DISTINCT m.domain) AS domains FROM mem GROUP BY 1), m AS (SELECT build_no, record_id, count(*) AS size, count(*) FILTER (score IS NULL) AS ungraded, sum(CAST(round(score * 100) AS BIGINT)) AS h FROM s GROUP BY 1, 2) SELECT build_no, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS covered, count(*) FILTER (domains > 1) AS cross_domain, max(size) AS largest, CAST(sum(ungraded) AS BIGINT) AS ungraded, count(*) FILTER (ungraded = size) AS blind, CASE WHEN sum(size) > sum(ungraded) THEN {_H1.format(x='sum(h) / (sum(size) - sum(ungraded)) / 100')} END AS mean_score FROM m JOIN d USING (record_id) GROUP BY 1",
    "cluster_numbers": f"WITH {_MEM}, m AS (SELECT build_no, record_id, count(DISTINCT m.id) AS size, min(m.id) AS least FROM mem GROUP BY 1, 2) SELECT record_id, build_no, 'c' || lpad(CAST(row_number() OVER (PARTITION BY build_no ORDER BY size DESC, least, record_id) AS VARCHAR), 3, '0') AS number FROM m",
    "cluster_mismatches": f"WITH {_MEM}, f AS (SELECT record_id, count(DISTINCT m.id) AS found, list(m.id) AS ids FROM mem GROUP BY 1) SELECT c.record_id, c.size AS stated, coalesce(found, 0) AS found FROM clusters c LEFT JOIN f USING (record_id) WHERE c.size IS DISTINCT FROM coalesce(found, 0) OR NOT coalesce(list_contains(ids, c.keeper.id), false)",
    "neighbours": f"WITH {_LAST}, b AS (SELECT id, neighbour_id, max(similarity) AS similarity FROM kin WHERE id <> neighbour_id AND similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY 1, 2), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour_id) AS place FROM b) WHERE place <= 12), w AS (SELECT *, lag(neighbour_id) OVER (PARTITION BY id ORDER BY place) AS previous, lead(neighbour_id) OVER (PARTITION BY id ORDER BY place) AS following FROM t) SELECT w.id, place, neighbour_id, similarity, name, domain, previous, following FROM w LEFT JOIN cur ON cur.id = neighbour_id",
    "interleaved": f"WITH {_LAST} SELECT id, coalesce(domain, 'Other') AS domain, row_number() OVER (PARTITION BY coalesce(domain, 'Other') ORDER BY stars DESC NULLS LAST, id) AS turn FROM cur",
    "running_budget": "SELECT doc_id, repo_id, n_chars FROM (SELECT doc_id, repo_id, n_chars, sum(n_chars) OVER (PARTITION BY repo_id ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents WHERE repo_id IS NOT NULL) WHERE s <= 20000",
    "strata_sample": f"WITH {_LAST}, s AS (SELECT id, CASE WHEN stars >= 100 THEN 'many' WHEN stars >= 20 THEN 'some' ELSE 'few' END AS stratum FROM cur), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || id), id) AS k FROM s) SELECT stratum, id FROM k WHERE k <= CASE stratum WHEN 'many' THEN 40 WHEN 'some' THEN 35 ELSE 25 END",
    "due_items": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) > (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY)",
    "latest_upsert": "SELECT id, name, stars FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, name DESC NULLS LAST, stars DESC NULLS LAST) AS k FROM repo) WHERE k = 1",
    "posts_by_domain": f"WITH {_LAST} SELECT coalesce(domain, 'Other') AS domain, count(*) AS repos FROM cur WHERE id IN (SELECT repo_id FROM documents WHERE repo_id IS NOT NULL) GROUP BY 1",
    "recent_feed": "SELECT doc_id, title FROM documents WHERE published_at IS NOT NULL ORDER BY published_at DESC, doc_id LIMIT 20",
    "visible_parents": f"WITH {_LAST}, s AS (SELECT * FROM cur WHERE domain = 'Infra & Ops' AND stars BETWEEN 10 AND 100) SELECT id FROM s UNION SELECT id FROM cur WHERE id IN (SELECT parent_id FROM s WHERE parent_id IS NOT NULL)",
    "name_set_difference": "SELECT DISTINCT ecosystem, 'dependency' AS only_in FROM dependency WHERE ecosystem NOT IN (SELECT ecosystem FROM advisory_affects WHERE ecosystem IS NOT NULL) UNION ALL SELECT DISTINCT ecosystem, 'advisory_affects' FROM advisory_affects WHERE ecosystem NOT IN (SELECT ecosystem FROM dependency WHERE ecosystem IS NOT NULL)",
}
