"""Checks, manifests, programs and trees: the operators that need file trees, over the fixtures held in code.

The data tables hold no trees or source texts, so these queries run over small tables of their own, whole.
The SQL is what must come out, written by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.checks import audit, classify, grade
from millrace.functions import scalar, text
from millrace.operators import extract, graph, relational
from millrace.plans import fixtures as fx
from millrace.session import new_path, saved, table
from millrace.sources import manifests, readers, sinks, symbols
from millrace.streaming.incremental import file_stream, shared_values

#: Groups of checks, by what they read.
GROUPS = {
    "ci_checks": "gha-third-party-action-unpinned gha-no-permissions-block gha-permissions-write-all gha-pr-target-untrusted-checkout gha-script-injection gha-secrets-in-forkable-trigger gha-step-swallows-exit-code "
    "gha-continue-on-error-masks-failure gha-checkout-persists-credentials gha-missing-job-timeout gha-pushes-to-default-branch ci-absent-entirely ci-never-runs-tests deploy-artifacts-without-ci "
    "no-dependency-vulnerability-gate ci-install-ignores-lockfile",
    "quality_checks": "no-tests-at-all test-suite-too-small no-license readme-stub build-output-committed large-binary-not-in-lfs repo-conventions-not-configured notebook-outputs-committed "
    "notebook-monolithic-cell notebook-missing-random-seed notebook-absolute-local-path notebook-no-environment",
    "runtime_checks": "debug-mode-enabled-in-config cors-allows-any-origin allowed-hosts-wildcard tls-verification-disabled hardcoded-secret-key-fallback unsafe-deserialization shell-command-from-interpolation "
    "sql-built-by-string-interpolation eval-on-runtime-value network-call-without-timeout container-runs-as-root secret-passed-as-build-arg compose-privileged-or-host-network",
    "supply_checks": "no-automated-dependency-updates manifest-without-lockfile dependency-directory-committed dockerfile-base-image-unpinned install-lifecycle-script",
    "secret_checks": "env-file-committed no-secret-scanning-gate gitignore-contradicts-tracked-secret env-secret-value-real database-dump-committed private-key-committed provider-token-committed "
    "db-url-inline-password cloud-credential-file-committed terraform-state-committed service-account-json-committed registry-auth-committed shell-history-committed",
}


def _checks(group: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        tree, files, asked = fx.check_tables(spark)
        wanted = asked.where(F.col("check_id").isin(GROUPS[group].split()))
        found = audit.findings(tree, files).select("repo_id", "check_id", "n")
        met = wanted.join(found, ["repo_id", "check_id"], "left").groupBy("check_id")
        hits = lambda fault: F.sum(F.when(F.col("fault") == fault, F.coalesce("n", F.lit(0))))
        return met.agg(hits(True).alias("at_fault"), hits(False).alias("mended"))

    query.__doc__ = f"{group}: hits of each check in a repository at fault and in one where it is mended."
    return query


def vulnerable_checks(spark: SparkSession, root: str) -> DataFrame:
    """Advisories against pinned and ranged dependencies, with the worst of each package as evidence."""
    v = spark.createDataFrame([r for r in fx.VULNERABLE], "repo_id long, package string, version string, pinned boolean, osv_id string, severity string")
    return audit.vulnerable_findings(v, spark.createDataFrame(fx.VULNERABLE_TREE, "repo_id long, path string, size long")).select("repo_id", "check_id", "evidence", "n")


def ranked_findings(spark: SparkSession, root: str) -> DataFrame:
    """Findings by rank, one dismissed, and reach by what the repository is."""
    f = [(1, "no-license", ""), (1, "private-key-committed", "k"), (1, "gha-missing-job-timeout", "w"), (2, "no-license", ""), (3, "no-license", ""), (3, "env-file-committed", ".env")]
    found = spark.createDataFrame([(*x, "e", 1) for x in f], "repo_id long, check_id string, where string, evidence string, n long")
    repos = spark.createDataFrame([(1, True, False, False), (2, False, True, False), (3, False, False, False)], "repo_id long, is_original boolean, has_ci boolean, has_docker boolean")
    gone = spark.createDataFrame([(3, "env-file-committed", ".env")], "repo_id long, check_id string, where string")
    return audit.ranked(found, repos, gone).select("repo_id", F.col("place").cast("long").alias("place"), "check_id", "severity", "rank")


def axis_cases(spark: SparkSession, root: str) -> DataFrame:
    """G-5, G-10, G-11: tests by their share of files, architecture and cleanliness by what was measured of the modules."""
    rows = [(1, 100, 5, 50, 5, 2, 10, 5), (2, 10, 2, 4, 4, 4, 0, 0), (3, 1000, 1, 2, 0, 0, 0, 0)]
    asked = ["repo_id", "total_files", "n_tests", "modules", "cycles", "high", "medium", "low"]
    given = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in asked))
    signals = given.select(*[F.col(f.split()[0]) if f.split()[0] in asked else F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _fields(grade.SIGNALS)])
    none = spark.createDataFrame([], "repo_id long, check_id string, n int")
    return grade.axis_scores(signals, none).where(F.col("axis").isin("tests", "architecture", "cleanliness")).select("repo_id", "axis", "score", "partial")


def _fields(ddl: str) -> list[str]:
    """``name type`` of each field of a schema."""
    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


def declared_packages(spark: SparkSession, root: str) -> DataFrame:
    """Packages and constraints of manifests in nine formats; lock files, broken and null ones give none."""
    files = spark.createDataFrame([(1, p, t) for p, t in fx.MANIFEST_FILES], "repo_id long, path string, text string")
    return manifests.manifest_packages(files).select("path", "name", "spec")


def _program(spark: SparkSession) -> DataFrame:
    return saved(symbols.source_facts(spark.createDataFrame([(1, p, t) for p, t in fx.PROGRAM], "repo_id long, path string, text string")), "facts")


def program_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Functions and classes with their lines, and whether patterns alone read them."""
    return symbols.symbols(_program(spark)).select("f", "n", "k", F.col("l").cast("long").alias("l"), "partial")


def program_calls(spark: SparkSession, root: str) -> DataFrame:
    """Calls of declared functions with their number and the callee's distinct callers, where more than one."""
    calls = saved(symbols.call_edges(_program(spark)), "calls")
    return calls.join(symbols.fan_in(calls).withColumnRenamed("name", "dst"), ["repo_id", "dst"], "left").select("src", "dst", "n", "callers")


def program_effects(spark: SparkSession, root: str) -> DataFrame:
    """What functions do to the world, with an example."""
    return symbols.effects(_program(spark)).select("fn", "kind", "example")


def program_flow(spark: SparkSession, root: str) -> DataFrame:
    """Entry points, and the shortest path from each to an effect."""
    facts = _program(spark)
    own, calls, effects = saved(symbols.symbols(facts), "symbols"), saved(symbols.call_edges(facts), "calls"), symbols.effects(facts)
    entries = saved(graph.entry_points(own, calls), "entries")
    paths = graph.effect_paths(entries, calls, effects)
    e = entries.select("name", "reach", "score")
    return e.join(paths.select(F.col("entry").alias("name"), F.array_join("chain", ">").alias("chain"), F.array_join("kinds", ",").alias("kinds")), "name", "left").select(
        "name", F.col("reach").cast("long").alias("reach"), F.col("score").cast("long").alias("score"), "chain", "kinds"
    )


def program_files(spark: SparkSession, root: str) -> DataFrame:
    """What routes through each file."""
    facts = _program(spark)
    roles = graph.file_roles(symbols.symbols(facts), symbols.call_edges(facts), symbols.effects(facts))
    return roles.select("file", "functions", "classes", "inbound", "outbound", F.array_join("kinds", ",").alias("kinds"), F.col("weight").cast("long").alias("weight"))


def resolved_imports(spark: SparkSession, root: str) -> DataFrame:
    """Import specifiers resolved to files of the same repository."""
    facts = _program(spark)
    base = F.replace(F.col("a"), F.lit("."), F.lit("/"))
    imports = facts.where("what = 'import'").select("repo_id", F.col("path").alias("src"), F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))).alias("candidates"))
    files = spark.createDataFrame([(1, p) for p, _ in fx.PROGRAM], "repo_id long, path string")
    return graph.import_edges(imports, files).select("src", "dst")


def tree_census(spark: SparkSession, root: str) -> DataFrame:
    """Files, tests, documents, Docker, CI platform and package manager of each tree."""
    t = fx.trees(spark)
    out = extract.census(t).join(extract.last_signal(t, extract.CI_FILES, "ci"), "repo_id", "left").join(extract.last_signal(t, extract.MANAGER_FILES, "manager", True), "repo_id", "left")
    langs = F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")
    return out.select("repo_id", "total_files", "has_docker", "n_tests", "n_docs", "ci", "manager", langs.alias("languages"))


def tree_technologies(spark: SparkSession, root: str) -> DataFrame:
    """Technologies that paths suggest, with the first path."""
    return extract.technologies(fx.trees(spark))


def tree_issues(spark: SparkSession, root: str) -> DataFrame:
    """Six rules on what a tree lacks."""
    return extract.tree_issues(fx.trees(spark)).select("repo_id", "severity", "issue", "where")


def tree_collections(spark: SparkSession, root: str) -> DataFrame:
    """Repositories of several sub-projects."""
    return extract.collections(fx.trees(spark))


def classified_trees(spark: SparkSession, root: str) -> DataFrame:
    """Language, domain, kind and capabilities of each tree."""
    c = classify.classified(fx.trees(spark), fx.names(spark))
    return c.select("repo_id", "language", "domain", "kind", "confidence", F.array_join("capabilities", ", ").alias("capabilities"))


def read_first(spark: SparkSession, root: str) -> DataFrame:
    """The two files of each tree to read first, by pattern and then code before the rest."""
    t = fx.trees(spark)
    wanted = relational.ranked_reads(t, [(r"\.ya?ml$", 1), (r"(package\.json|\.toml|go\.mod)$", 1)], 2).select("repo_id", "path", F.col("turn").cast("long").alias("turn"), F.lit("wanted").alias("by"))
    code = extract.code_first(t, 2).select("repo_id", "path", F.col("place").cast("long").alias("turn"), F.lit("code").alias("by"))
    return wanted.unionByName(code)


def _structure(spark: SparkSession) -> DataFrame:
    files = spark.createDataFrame([(1, *r) for r in fx.STRUCTURE], "repo_id long, path string, text string")
    return saved(extract.structure_findings(files, _modules(spark)), "structure")


def _modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, *m) for m in fx.MODULES], "repo_id long, path string, fan_in long, in_cycle boolean")


def structure(spark: SparkSession, root: str) -> DataFrame:
    """X2, G-16: structural findings by severity, leverage and removability."""
    return _structure(spark).select("path", "finding", "severity", "rank")


def structure_groups(spark: SparkSession, root: str) -> DataFrame:
    """Findings by kind, with the files of greatest rank and the report's totals."""
    f = _structure(spark)
    totals = extract.report_totals(f).select("repo_id", F.col("findings").alias("total"), "high")
    g = extract.finding_groups(f).join(totals, "repo_id")
    return g.select("finding", "n", "severity", "rank", F.array_join("files", ", ").alias("files"), "total", "high")


def area_imports(spark: SparkSession, root: str) -> DataFrame:
    """Imports between areas of more than one module."""
    imports = spark.createDataFrame([(1, *i) for i in fx.IMPORTS], "repo_id long, src string, dst string")
    return extract.area_imports(imports, _modules(spark)).select("src", "dst", "n")


def area_chart(spark: SparkSession, root: str) -> DataFrame:
    """The chart of imports between areas."""
    imports = spark.createDataFrame([(1, *i) for i in fx.IMPORTS], "repo_id long, src string, dst string")
    return extract.mermaid(extract.area_imports(imports, _modules(spark)), "repo_id", "src", "dst", "n").select("chart")


def repeated_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Runs of six lines that stand in two files of a repository."""
    return extract.duplicated_blocks(spark.createDataFrame([(1, *r) for r in fx.STRUCTURE], "repo_id long, path string, text string"))


def fact_texts(spark: SparkSession, root: str) -> DataFrame:
    """The facts of a repository in their sections: hubs, findings, calls."""
    place = lambda *order: F.row_number().over(relational.Window.partitionBy("repo_id").orderBy(*order))
    hubs = _modules(spark).where("fan_in >= 3").withColumn("place", place(F.desc("fan_in"), "path")).withColumn("line", F.concat("path", F.lit(" used by "), F.col("fan_in").cast("string")))
    groups = extract.finding_groups(_structure(spark)).withColumn("place", place(F.desc("rank"), "finding")).where("place <= 2").withColumn("line", F.concat("finding", F.lit(" x"), F.col("n").cast("string")))
    calls = symbols.call_edges(_program(spark)).withColumn("place", place(F.desc("n"), "src", "dst")).where("place <= 2").withColumn("line", F.concat("src", F.lit(" -> "), "dst"))
    return extract.fact_sections([("MODULES", hubs, "line"), ("FINDINGS", groups, "line"), ("CALLS", calls, "line")])


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Which articles are current, and what the others wait for."""
    a = spark.createDataFrame([(1, 3, "s"), (2, 2, "s"), (3, 2, "s"), (4, None, "s"), (5, 3, "s"), (6, 3, None), (7, 1, "s")], "repo_id long, version int, summary string")
    i = spark.createDataFrame([(1, 5, 9), (2, 5, 9), (3, 4, 9), (4, None, 9), (5, 5, 9), (7, 5, 8)], "repo_id long, symbols int, audit int")
    return extract.article_state(a, i, 3, 9, 5, spark.createDataFrame([(5,)], "repo_id long"))


def upstream_gate(spark: SparkSession, root: str) -> DataFrame:
    """Repositories whose day of change moved, or that were never described."""
    old = [(1, "2026-01-02 03:00:00", ["a"]), (2, "2026-01-02 03:00:00", ["a"]), (3, "2026-01-02 03:00:00", None)]
    new = [(1, "2026-01-02 23:00:00"), (2, "2026-01-03 00:00:01"), (3, "2026-01-02 03:00:00"), (4, "2026-01-01 00:00:00")]
    at = F.to_timestamp("updated_at").alias("updated_at")
    return extract.changed_upstream(spark.createDataFrame(old, "repo_id long, updated_at string, topics array<string>").select("repo_id", at, "topics"), spark.createDataFrame(new, "repo_id long, updated_at string").select("repo_id", at))


def originals_and_forks(spark: SparkSession, root: str) -> DataFrame:
    """Originals and the two best forks; an id counts once."""
    rows = [(1, "a", None, 5), (1, "a2", None, 6), (2, "b", 9, 50), (3, "c", 9, 40), (4, "d", 9, 40), (5, "e", None, 1)]
    return extract.originals_and_forks(spark.createDataFrame(rows, "id long, name string, parent_id long, stars long"), 2).select("id", "name")


def batch_quota(spark: SparkSession, root: str) -> DataFrame:
    """A run's batch of ten, three of them retried."""
    return relational.quota(spark.range(0, 10), spark.range(100, 200), [F.asc("id")], 10)


def scalar_cases(spark: SparkSession, root: str) -> DataFrame:
    """Scalar functions, case by case."""
    cases = [
        ("effect", "cursor.execute"), ("effect", "requests.get"), ("effect", "x.generate.create(client)"), ("effect", "nothing.here"), ("import", "@a/b/c"), ("import", "os.path"), ("import", "a/b"), ("extension", "a/b.PY"),
        ("extension", "Makefile"), ("module", "a/b.test.js"), ("top", "a/b/c"), ("top", "c"), ("base", "a/b/c.x"), ("language", "x/y.rs"), ("language", "x"), ("day", "January 5, 2026"), ("day", "Mon, 05 Jan 2026 23:30:00 -0200"),
        ("day", "2026-01-05T01:00:00Z"), ("day", "soon"), ("bare", "x = 1 # kept\n# gone\ny"), ("bare", "a /* b\nc */ d"), ("noindex", "<meta name='robots' content='noindex'>"), ("noindex", "<meta name='robots' content='all'>"),
        ("language_accepted", "TSX"), ("language_accepted", "Go"), ("reasoning", "First, let me draft the article."), ("reasoning", "We need to keep it under 300 words"), ("reasoning", "A parser for logs."),
    ]
    x = F.col("x")
    value = {
        "effect": scalar.effect(x), "import": scalar.import_root(x), "extension": scalar.extension(x), "module": scalar.module_id(x), "top": scalar.top_dir(x), "base": scalar.base_name(x), "language": scalar.language_of(x),
        "day": F.date_format(text.parsed_time(x), "yyyy-MM-dd"), "bare": text.strip_comments(x), "noindex": text.noindex(x).cast("string"), "language_accepted": text.accepts_language(x, "TypeScript", ["tsx"]).cast("string"),
        "reasoning": text.reasoning_leak(x).cast("string"),
    }
    out = F.lit(None).cast("string")
    for name, v in value.items():
        out = F.when(F.col("f") == name, v).otherwise(out)
    return spark.createDataFrame(cases, "f string, x string").select("f", "x", out.alias("y"))


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sources, from files written to the shared folder."""
    at = new_path(spark, "sources")
    one = lambda rows, path: spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    one(['{"a": 1}', "{broken", '{"a": 3}'], f"{at}/lines")
    one(['{"7": {"x": 1}, "8": {"x": null}}'], f"{at}/keyed")
    lines, broken = readers.json_lines(spark, f"{at}/lines", "a int")
    keyed = readers.keyed_json(spark, f"{at}/keyed", "struct<x:int>")
    none = readers.json_or_empty(spark, f"{at}/none.json", "a int")
    tree = spark.createDataFrame([(5, "src/a.py", 2), (5, "node_modules/b.js", 2), (6, "c.py", 2), (6, "d.bin", 900_000)], "repo_id long, path string, size long")
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id long, v string")
    repos = spark.createDataFrame([(1, "a", False, 3), (2, "x.github.io", False, 2), (3, "c", True, 1), (4, "d", None, 4)], "id long, name string, archived boolean, updated_at long")
    triples = spark.createDataFrame([([[1.0, 2.0, 0.5]],)], "t array<array<double>>")
    items = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "id long, hash string")
    hit, stale = readers.cached_vectors(items, spark.createDataFrame([(1, "h1", [0.5]), (2, "old", [0.1])], "id long, hash string, vector array<double>"))
    parts = [
        ("json", lines, "a"), ("broken", broken, "_corrupt"), ("keyed", keyed, "id"), ("none", none, "a"), ("walkable", readers.walkable(tree), "path"), ("first", readers.first_source([a, b], "id"), "v"),
        ("repos", readers.listed_repos(repos), "name"), ("edges", readers.decoded_edges(triples, "t"), "sim"), ("cached", hit, "id"), ("stale", stale, "id"),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), F.col(c).cast("string").alias("value")) for name, df, c in parts])


def written_sinks(spark: SparkSession, root: str) -> DataFrame:
    """K1, K2, K4, K6-K8: what sinks did, step by step."""
    at = new_path(spark, "sinks")
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, v string, generated int")
    steps = [
        ("first write", sinks.write_if_changed(df, f"{at}/t", ["generated"])),
        ("same but for the time", sinks.write_if_changed(df.selectExpr("id", "v", "11 as generated").orderBy("v"), f"{at}/t", ["generated"])),
        ("one row less", sinks.write_if_changed(df.where("id = 1"), f"{at}/t", ["generated"])),
        ("rows left", sinks.committed(spark, f"{at}/t").count()),
        ("changed rows", sinks.changed_rows(spark.createDataFrame([(1, "a", 1), (2, "c", 1), (3, None, 1)], "id int, v string, generated int"), df, ["id"], ["generated"]).count()),
    ]
    sinks.write_by_bucket(spark.range(1000).withColumnRenamed("id", "k"), f"{at}/b", "k", 8)
    steps.append(("rows of key 77", sinks.read_key(spark, f"{at}/b", "k", 77, 8).count()))
    ran: list[str] = []
    steps.append(("migrations", sinks.migrate(spark, f"{at}/m", [(2, "b"), (1, "a")], ran.append)))
    steps.append(("later migrations", sinks.migrate(spark, f"{at}/m", [(1, "a"), (2, "b"), (3, "c")], ran.append)))
    return spark.createDataFrame([(s, str(v).lower()) for s, v in steps], "step string, outcome string")


def described_schema(spark: SparkSession, root: str) -> DataFrame:
    """A table's schema as rows, with meanings, and where meanings and fields disagree."""
    about = {"region": "number of the region", "population": "people in it"}
    r = table(spark, root, "region", "r_regionkey", "r_name").toDF("region", "name")
    rows = sinks.schema_rows(sinks.described(r, about)).select("field", F.regexp_replace("type", "^(int|bigint)$", "number").alias("type"), "about")
    return rows.withColumn("gap", F.lit(None).cast("string")).unionByName(sinks.schema_gaps(r, about).select("field", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("about"), "gap"))


def text_sinks(spark: SparkSession, root: str) -> DataFrame:
    """A feed item, an Atom entry, a URL set, a Markdown table and an llms.txt of two pages."""
    rows = [("A & B", "/a", "2026-01-05 10:00:00", "x", "First."), ("C", "/c", "2026-01-06 10:00:00", "x", None)]
    df = spark.createDataFrame(rows, "title string, link string, at string, domain string, about string").withColumn("at", F.to_timestamp("at"))
    out = [
        sinks.feed_items(df, "title", "link", "at", 1).select(F.lit("rss").alias("sink"), F.col("item").alias("text")), sinks.atom_entries(df, "title", "link", "at", 1).select(F.lit("atom"), "entry"),
        sinks.sitemap(df, "domain", "link", "https://x").select(F.lit("sitemap"), "urlset"), sinks.markdown_tables(df, "domain", ["title", "link"]).select(F.lit("markdown"), "markdown"),
        sinks.llms_txt(df, "domain", "title", "link", "about").select(F.lit("llms.txt"), "section"),
    ]
    return reduce(DataFrame.union, out)


def streamed_shared_values(spark: SparkSession, root: str) -> DataFrame:
    """I8: values and how many repositories share them, as a stream that ran to its end; from three on they are shared."""
    at, name = new_path(spark, "values"), f"shared_{abs(hash(root)) % 10**8}"
    spark.createDataFrame([("k", 1), ("k", 1), ("k", 2), ("k", 3), ("k", 4), ("j", 1)], "key string, repo_id long").coalesce(1).write.parquet(at)
    q = shared_values(file_stream(spark, at, spark.read.parquet(at).schema)).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).groupBy("key").agg(F.max("shared").alias("shared"))


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


QUERIES = {g: _checks(g) for g in GROUPS} | {
    f.__name__: f
    for f in (
        vulnerable_checks, ranked_findings, axis_cases, declared_packages, program_symbols, program_calls, program_effects, program_flow, program_files, resolved_imports, tree_census, tree_technologies, tree_issues, tree_collections,
        classified_trees, read_first, structure, structure_groups, area_imports, area_chart, repeated_blocks, fact_texts, articles, upstream_gate, originals_and_forks, batch_quota, scalar_cases, read_sources, written_sinks,
        described_schema, text_sinks, streamed_shared_values,
    )
}


def _hits(group: str, **several: int) -> str:
    """Every check of the group fires once where the fault is, unless said otherwise, and never where it is mended."""
    return _values("check_id, at_fault, mended", *[f"('{c}', {several.get(c.replace('-', '_'), 1)}, 0)" for c in GROUPS[group].split()])


#: Written by hand from the fixtures.
SQL = {
    "ci_checks": _hits("ci_checks", ci_never_runs_tests=3),
    "quality_checks": _hits("quality_checks", no_tests_at_all=12, build_output_committed=5, repo_conventions_not_configured=3, notebook_no_environment=3),
    "runtime_checks": _hits("runtime_checks"),
    "supply_checks": _hits("supply_checks", dependency_directory_committed=20),
    "secret_checks": _hits("secret_checks"),
    "vulnerable_checks": _values(
        "repo_id, check_id, evidence, n", "(1, 'dependency-pinned-to-critical-vulnerability', 'p 1.0 X-1 critical', 1)", "(1, 'dependency-pinned-to-known-vulnerability', 'q 1 X-2 low', 1)",
        "(1, 'dependency-range-permits-vulnerability', 'r 1 X-3 high', 1)", "(3, 'dependency-pinned-to-known-vulnerability', 'q 1 X-2 medium', 1)",
        "(3, 'dependency-pinned-to-critical-vulnerability', 'q 1 X-4 critical', 1)", "(4, 'dependency-range-permits-vulnerability', 't 2 X-6 high; s 2 X-5 low', 2)",
    ),
    "ranked_findings": _values(
        "repo_id, place, check_id, severity, rank", "(1, 1, 'private-key-committed', 'critical', 7.6)", "(1, 2, 'no-license', 'high', 4.25)", "(1, 3, 'gha-missing-job-timeout', 'low', 0.9)",
        "(2, 1, 'no-license', 'high', 2.55)", "(3, 1, 'no-license', 'high', 1.27)",
    ),
    "axis_cases": _values(
        "repo_id, axis, score, partial", "(1, 'tests', 51.8, false)", "(1, 'architecture', 67.2, false)", "(1, 'cleanliness', 73.4, false)", "(2, 'tests', 92.0, false)", "(2, 'architecture', 17.0, false)",
        "(2, 'cleanliness', 95.0, false)", "(3, 'tests', 25.0, false)", "(3, 'architecture', 55.0, true)", "(3, 'cleanliness', 60.0, true)",
    ),
    "declared_packages": _values(
        "path, name, spec", "('package.json', 'a', '^1')", "('package.json', 'b', '2')", "('package.json', 'c', NULL)", "('requirements-dev.txt', 'flask', '==2.0')", "('requirements-dev.txt', 'uvicorn', '>=0.2,<1')",
        "('requirements-dev.txt', 'plain', NULL)", "('a/pyproject.toml', 'pydantic', '==2.6.1')", "('a/pyproject.toml', 'rich', NULL)", "('a/pyproject.toml', 'pytest', '>=7')", "('a/pyproject.toml', 'httpx', '0.2')",
        "('go.mod', 'github.com/Mast/Sem', 'v3.2.0')", "('go.mod', 'a.b/c', 'v1.0.0')", "('Cargo.toml', 'serde', '1.0')", "('Cargo.toml', 'tokio', '1.36')", "('Cargo.toml', 'local', NULL)", "('composer.json', 'a/b', '^2')",
        "('pubspec.yaml', 'http', '^1.0.0')", "('pubspec.yaml', 'path', NULL)", "('pubspec.yaml', 'lints', '2.0')", "('Gemfile', 'rails', '~> 7.0')", "('Gemfile', 'pg', NULL)", "('app/build.gradle.kts', 'Lib', '1.2')",
        "('app/build.gradle.kts', 'x', NULL)",
    ),
    "program_symbols": _values(
        "f, n, k, l, partial", "('cli.py', 'main', 'function', 3, false)", "('store.py', 'load', 'function', 2, false)", "('store.py', 'helper', 'function', 5, false)", "('store.py', 'Store', 'class', 7, false)",
        "('net.py', 'fetch', 'function', 2, false)", "('web/app.ts', 'draw', 'function', 2, true)", "('web/app.ts', 'paint', 'function', 3, true)", "('web/app.ts', 'View', 'class', 1, true)",
    ),
    "program_calls": _values(
        "src, dst, n, callers", "('main', 'load', 1, NULL)", "('main', 'fetch', 2, NULL)", "('<module>', 'main', 1, NULL)", "('load', 'helper', 1, 2)", "('fetch', 'helper', 1, 2)", "('draw', 'paint', 1, NULL)", "('paint', 'draw', 1, NULL)",
    ),
    "program_effects": _values("fn, kind, example", "('load', 'db', 'cursor.execute')", "('helper', 'filesystem', 'open')", "('fetch', 'network', 'requests.get')", "('main', 'network', 'fetch')"),
    "program_flow": _values("name, reach, score, chain, kinds", "('main', 3, 78, 'main>fetch', 'network')", "('draw', 1, 36, NULL, NULL)", "('paint', 1, 36, NULL, NULL)"),
    "program_files": _values(
        "file, functions, classes, inbound, outbound, kinds, weight", "('cli.py', 1, 0, 0, 2, 'network', 11)", "('store.py', 2, 1, 2, 0, 'db,filesystem', 28)", "('net.py', 1, 0, 1, 1, 'network', 14)",
        "('web/app.ts', 2, 1, 0, 0, '', 4)",
    ),
    "resolved_imports": _values("src, dst", "('cli.py', 'store.py')", "('cli.py', 'net.py')"),
    "tree_census": _values(
        "repo_id, total_files, has_docker, n_tests, n_docs, ci, manager, languages", "(10, 4, false, 0, 1, NULL, NULL, 'Jupyter Notebook 2, Markdown 1, Python 1')",
        "(11, 7, false, 0, 1, NULL, 'yarn', 'JSON 1, JavaScript 2, TypeScript 2')", "(12, 8, true, 1, 1, 'GitHub Actions', 'pip', 'Markdown 1, Python 2, YAML 2')",
        "(13, 7, false, 0, 1, 'Travis CI', 'go modules', 'Go 2, Markdown 1, YAML 1')", "(14, 4, false, 0, 1, NULL, NULL, 'Markdown 3, Python 1')", "(15, 4, false, 0, 0, NULL, NULL, 'JSON 1, Markdown 3')",
        "(16, 4, false, 1, 0, NULL, NULL, 'Rust 3, TOML 1')", "(17, 6, false, 0, 1, NULL, NULL, 'C 4, Jupyter Notebook 1')", "(18, 1, false, 0, 0, NULL, NULL, NULL)",
    ),
    "tree_technologies": _values(
        "repo_id, technology, example", "(10, 'OpenCV', 'opencv/c.py')", "(11, 'React', 'src/App.tsx')", "(11, 'Next.js', 'next.config.js')", "(11, 'Tailwind', 'tailwind.config.js')", "(12, 'Docker', 'Dockerfile')",
        "(12, 'FastAPI', 'fastapi/server.py')",
    ),
    "tree_issues": _values(
        'repo_id, severity, issue, "where"', *[f"({r}, 'Medium', 'no tests', '')" for r in (10, 11, 13, 14, 15, 17)], *[f"({r}, 'Medium', 'no CI', '')" for r in (10, 11, 14, 15, 16, 17)],
        *[f"({r}, 'Medium', 'no licence', '')" for r in (10, 12, 14, 15, 16, 17, 18)], *[f"({r}, 'Low', 'no README', '')" for r in (11, 15, 16, 18)],
        "(12, 'Low', 'dependencies without lockfile', 'requirements.txt')", "(16, 'Low', 'dependencies without lockfile', 'Cargo.toml')", "(12, 'Low', 'secret-shaped paths', '.env')",
    ),
    "tree_collections": _values("repo_id, projects", "(17, 4)"),
    "classified_trees": _values(
        "repo_id, language, domain, kind, confidence, capabilities", "(10, 'Jupyter Notebook', 'AI & Data', 'Notebook / research', 0.7, 'Computer Vision')", "(11, 'JavaScript', 'Web & Interfaces', 'Web app', 0.7, 'Full-Stack Web')",
        "(12, 'Python', 'AI & Data', 'Service / API', 0.7, 'MLOps, Backend & APIs')", "(13, 'Go', 'Systems & Infra', 'CLI tool', 0.7, 'Backend & APIs')", "(14, 'Python', 'Agent Skills & Plugins', 'Docs / content', 0.7, '')",
        "(15, NULL, 'Knowledge & Content', 'Docs / content', 0.7, '')", "(16, 'Rust', 'Systems & Infra', 'Library / SDK', 0.7, 'Backend & APIs')", "(17, 'C', 'Systems & Infra', 'Notebook / research', 0.7, '')",
        "(18, NULL, 'Other', 'Unknown', 0.0, '')",
    ),
    "read_first": _values(
        'repo_id, path, turn, "by"', "(11, 'package.json', 1, 'wanted')", "(12, '.github/workflows/ci.yml', 1, 'wanted')", "(13, '.travis.yml', 1, 'wanted')", "(13, 'go.mod', 2, 'wanted')", "(16, 'Cargo.toml', 1, 'wanted')",
        "(10, 'a.ipynb', 1, 'code')", "(10, 'b.ipynb', 2, 'code')", "(11, 'src/App.tsx', 1, 'code')", "(11, 'src/page.tsx', 2, 'code')", "(12, 'fastapi/server.py', 1, 'code')", "(12, 'tests/test_a.py', 2, 'code')",
        "(13, 'cmd/root.go', 1, 'code')", "(13, 'cmd/run.go', 2, 'code')", "(14, 'x.py', 1, 'code')", "(14, 'skills/a/SKILL.md', 2, 'code')", "(15, 'a.md', 1, 'code')", "(15, 'b.md', 2, 'code')",
        "(16, 'src/lib.rs', 1, 'code')", "(16, 'tests/it.rs', 2, 'code')", "(17, 'alpha/main.c', 1, 'code')", "(17, 'beta/x.c', 2, 'code')", "(18, 'data.bin', 1, 'code')",
    ),
    "structure": _values(
        "path, finding, severity, rank", "('src/deep.py', 'deep nesting', 'high', 23.1)", "('src/deep.py', 'import cycle', 'high', 16.5)", "('src/deep.py', 'hub module', 'high', 7.2)", "('src/loose.py', 'broad except', 'medium', 3.2)",
        "('src/loose.py', 'open without with', 'medium', 3.4)", "('src/loose.py', 'open markers', 'low', 0.9)", "('web/catch.js', 'empty catch', 'medium', 1.7)",
    ),
    "structure_groups": _values(
        "finding, n, severity, rank, files, total, high", "('deep nesting', 1, 'high', 23.1, 'src/deep.py', 7, 3)", "('import cycle', 1, 'high', 16.5, 'src/deep.py', 7, 3)", "('hub module', 1, 'high', 7.2, 'src/deep.py', 7, 3)",
        "('broad except', 1, 'medium', 3.2, 'src/loose.py', 7, 3)", "('open without with', 1, 'medium', 3.4, 'src/loose.py', 7, 3)", "('open markers', 1, 'low', 0.9, 'src/loose.py', 7, 3)",
        "('empty catch', 1, 'medium', 1.7, 'web/catch.js', 7, 3)",
    ),
    "area_imports": _values("src, dst, n", "('src', 'web', 2)", "('web', 'src', 1)"),
    "area_chart": """SELECT 'flowchart LR' || chr(10) || '  src["src"] -->|2| web["web"]' || chr(10) || '  web["web"] -->|1| src["src"]' AS chart""",
    "repeated_blocks": _values("repo_id, blocks, files", "(1, 2, 2)"),
    "fact_texts": "SELECT 1 AS repo_id, array_to_string(['MODULES:', '  src/deep.py used by 30', '  src/loose.py used by 3', '', 'FINDINGS:', '  deep nesting x1', '  import cycle x1', '', 'CALLS:', '  main -> fetch', '  <module> -> main'], chr(10)) AS facts",
    "articles": _values(
        "repo_id, version, symbols, audit, current", "(1, 3, 'current', 'current', true)", "(2, 2, 'current', 'current', false)", "(3, 2, 'stale', 'current', true)", "(4, 1, 'absent', 'current', false)",
        "(5, 3, 'current', 'current', false)", "(7, 1, 'current', 'stale', true)",
    ),
    "upstream_gate": _values("repo_id", "(2)", "(3)", "(4)"),
    "originals_and_forks": _values("id, name", "(1, 'a')", "(2, 'b')", "(3, 'c')", "(5, 'e')"),
    "batch_quota": "SELECT range AS id, true AS retry FROM range(0, 3) UNION ALL SELECT range, false FROM range(100, 107)",
    "scalar_cases": "SELECT f, replace(x, '~', chr(10)) AS x, replace(y, '~', chr(10)) AS y FROM (VALUES "
    "('effect', 'cursor.execute', 'db'), ('effect', 'requests.get', 'network'), ('effect', 'x.generate.create(client)', 'model'), ('effect', 'nothing.here', NULL), ('import', '@a/b/c', '@a/b'), ('import', 'os.path', 'os'), "
    "('import', 'a/b', 'a'), ('extension', 'a/b.PY', 'py'), ('extension', 'Makefile', ''), ('module', 'a/b.test.js', 'a/b.test'), ('top', 'a/b/c', 'a'), ('top', 'c', '(root)'), ('base', 'a/b/c.x', 'c.x'), ('language', 'x/y.rs', 'Rust'), "
    "('language', 'x', NULL), ('day', 'January 5, 2026', '2026-01-05'), ('day', 'Mon, 05 Jan 2026 23:30:00 -0200', '2026-01-06'), ('day', '2026-01-05T01:00:00Z', '2026-01-05'), ('day', 'soon', NULL), "
    "('bare', 'x = 1 # kept~# gone~y', 'x = 1 # kept~~y'), ('bare', 'a /* b~c */ d', 'a  d'), ('noindex', '<meta name=''robots'' content=''noindex''>', 'true'), ('noindex', '<meta name=''robots'' content=''all''>', 'false'), "
    "('language_accepted', 'TSX', 'true'), ('language_accepted', 'Go', 'false'), "
    "('reasoning', 'First, let me draft the article.', 'true'), ('reasoning', 'We need to keep it under 300 words', 'true'), ('reasoning', 'A parser for logs.', 'false')) t(f, x, y)",
    "read_sources": _values(
        "source, value", "('json', '1')", "('json', '3')", "('broken', '{broken')", "('keyed', '7')", "('keyed', '8')", "('walkable', 'src/a.py')", "('walkable', 'c.py')", "('first', 'x')", "('first', 'z')", "('repos', 'a')", "('repos', 'd')",
        "('edges', '0.5')", "('cached', '1')", "('stale', '2')", "('stale', '3')",
    ),
    "written_sinks": _values(
        "step, outcome", "('first write', 'true')", "('same but for the time', 'false')", "('one row less', 'true')", "('rows left', '1')", "('changed rows', '2')", "('rows of key 77', '1')", "('migrations', '[1, 2]')",
        "('later migrations', '[3]')",
    ),
    "described_schema": _values(
        "field, type, about, gap", "('region', 'number', 'number of the region', NULL)", "('name', 'string', NULL, NULL)", "('name', NULL, NULL, 'undescribed')",
        "('population', NULL, NULL, 'absent')",
    ),
    "text_sinks": "SELECT sink, replace(t, '~', chr(10)) AS text FROM (VALUES "
    "('rss', '<item><title>C</title><link>/c</link><pubDate>Tue, 06 Jan 2026 10:00:00 GMT</pubDate></item>'), ('atom', '<entry><title>C</title><link href=\"/c\"/><id>/c</id><updated>2026-01-06T10:00:00Z</updated></entry>'), "
    "('sitemap', '<url><loc>https://x/a</loc></url><url><loc>https://x/c</loc></url>'), ('markdown', '| title | link |~| --- | --- |~| A & B | /a |~| C | /c |'), ('llms.txt', '## x~~- [A & B](/a): First.~- [C](/c)')) t(sink, t)",
    "streamed_shared_values": _values('"key", shared', "('k', 3)", "('j', 1)"),
}
