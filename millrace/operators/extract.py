"""Facts from file trees and source texts: census, sub-projects, structure findings, readiness, fact blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalar, text as tx

#: Signals of a technology in a path (fixed values).
TECHNOLOGIES = [
    (r"(?i)react|\.(jsx|tsx)$", "React"), (r"(^|/)next\.config\.", "Next.js"), (r"\.vue$|(^|/)(vue|nuxt)\.config\.", "Vue"), (r"\.svelte$|(^|/)svelte\.config", "Svelte"), (r"(^|/)angular\.json$", "Angular"),
    (r"(?i)(manage|settings|wsgi)\.py", "Django"), (r"(?i)flask|app\.py", "Flask"), (r"(?i)fastapi", "FastAPI"), (r"(?i)express|(app|server)\.js", "Express"), (r"(^|/)nest-cli\.json$", "NestJS"), (r"(?i)gemfile|config/routes\.rb$", "Rails"),
    (r"(?i)spring|pom\.xml", "Spring"), (r"(?i)artisan|composer\.json", "Laravel"), (r"(^|/)tailwind\.config", "Tailwind"), (r"(^|/)(Dockerfile|docker-compose\.ya?ml)$", "Docker"), (r"(?i)(deployment|service|k8s).*\.yaml$", "Kubernetes"), (r"\.tf$", "Terraform"), (r"\.graphql$", "GraphQL"),
    (r"(?i)(^|/)torch|\.(pt|pth|ckpt)$|lightning", "PyTorch"), (r"(?i)tensorflow|keras|\.h5$|saved_model", "TensorFlow"), (r"(?i)opencv|cv2|haarcascade", "OpenCV"), (r"(?i)transformers|tokenizer|\.safetensors$|huggingface", "Transformers"),
    (r"(?i)yolo|ultralytics|darknet", "YOLO"), (r"(?i)\.onnx$|onnxruntime", "ONNX"), (r"(?i)langchain|langgraph|llama_?index", "LangChain"), (r"(?i)faiss|chroma|pinecone|qdrant|weaviate|pgvector", "Vector store"),
    (r"(?i)(^|/)(pandas|dataframe)|\.parquet$", "pandas"), (r"(?i)pyspark|spark-|\.scala$", "Spark"), (r"(?i)airflow|(^|/)dags/", "Airflow"), (r"(^|/)dbt_project\.yml$", "dbt"), (r"(?i)mlflow|mlruns", "MLflow"),
    (r"(^|/)dvc\.yaml$|\.dvc$", "DVC"), (r"(?i)\.cu$|cudnn|nvidia", "CUDA"), (r"(?i)neo4j|cypher|\.cql$", "Neo4j"),
]
#: Files that name the CI platform and the package manager; the later a rule stands, the more it counts (fixed values).
CI_FILES = [(r"\.github/workflows", "GitHub Actions"), (r"\.gitlab-ci\.yml", "GitLab CI"), (r"\.circleci/config\.yml", "CircleCI"), (r"\.travis\.yml", "Travis CI"), (r"Jenkinsfile", "Jenkins"), (r"azure-pipelines\.yml", "Azure Pipelines")]
MANAGER_FILES = [
    ("package-lock.json", "npm"), ("yarn.lock", "yarn"), ("pnpm-lock.yaml", "pnpm"), ("requirements.txt", "pip"), ("poetry.lock", "poetry"), ("Cargo.lock", "cargo"), ("go.sum", "go modules"),
    ("composer.lock", "composer"), ("Gemfile.lock", "bundler"), ("pom.xml", "maven"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"),
]
#: Top directories that are no project of their own (fixed values).
NO_PROJECT = (
    ".github .vscode .idea node_modules venv .venv env assets images img static public docs doc data datasets plots figures output outputs test tests __pycache__ dist build src lib app api core server client "
    "backend frontend web ui cli scripts notebooks config migrations models utils common internal pkg cmd"
).split()
CODE_FILE = r"(?i)\.(py|js|jsx|ts|tsx|go|rs|java|kt|rb|php|cs|c|cc|cpp|swift|scala|r|jl|ipynb|sh)$"


def census(tree: DataFrame) -> DataFrame:
    """Per repository, files by language, directory and type as maps, and flags, in one aggregation each."""
    p = F.col("path")
    t = tree.select("repo_id", "path", scalar.language_of(p).alias("language"), scalar.top_dir(p).alias("directory"), scalar.extension(p).alias("type"))

    def counts(c: str) -> DataFrame:
        n = t.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("repo_id", c).agg(F.count("*").alias("n"))
        return n.groupBy("repo_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"{c}s"))

    flags = t.groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.bool_or(p.rlike(r"(?i)dockerfile|docker-compose")).alias("has_docker"),
        F.count_if(p.rlike(r"(?i)test|spec")).alias("n_tests"), F.count_if(p.rlike(r"(?i)docs?/|readme|changelog|contributing|license|guide")).alias("n_docs"),
    )
    return flags.join(counts("language"), "repo_id", "left").join(counts("directory"), "repo_id", "left").join(counts("type"), "repo_id", "left")


def last_signal(tree: DataFrame, rules: list[tuple[str, str]], name: str, exact: bool = False) -> DataFrame:
    """One value per repository; of several signals the last file's last rule counts.

    ``tree`` has ``repo_id, pos, path``; ``pos`` is the file's place in its listing.
    """
    p = scalar.base_name(F.col("path"))
    hits = F.array_compact(F.array(*[F.when((p == q) if exact else F.col("path").rlike(q), F.struct(F.lit(i).alias("rule"), F.lit(v).alias("value"))) for i, (q, v) in enumerate(rules)]))
    h = tree.select("repo_id", "pos", F.explode(hits).alias("h"))
    return h.groupBy("repo_id").agg(F.max_by("h.value", F.struct("pos", "h.rule")).alias(name))


def technologies(tree: DataFrame) -> DataFrame:
    """``repo_id, technology, example``: what the paths suggest, with the first path that does."""
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(q), F.lit(v)) for q, v in TECHNOLOGIES]))
    return tree.select("repo_id", "path", F.explode(hits).alias("technology")).groupBy("repo_id", "technology").agg(F.min("path").alias("example"))


#: Paths that a census takes for a lockfile, a secret and a declared dependency (fixed values).
_LOCKED = r"(?i)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|gemfile\.lock|composer\.lock)$"
_SECRET = r"(?i)(^|/)\.env(\.(local|prod|production|dev|development))?$|(^|/)id_rsa$|\.(pem|pfx|p12)$|credentials\.json[^/]*$|secrets\.[^/]*$"
_DECLARES = r"(?i)(^|/)(package\.json|requirements\.txt|go\.mod|cargo\.toml|gemfile|build\.gradle|pom\.xml|pyproject\.toml|pipfile|poetry\.lock|yarn\.lock|package-lock\.json|composer\.json|pubspec\.yaml)$"
#: Marks of a CI platform anywhere in a path (fixed values).
_CI = r"(?i)\.github/workflows|\.gitlab-ci\.yml|\.circleci/config\.yml|\.travis\.yml|jenkinsfile|azure-pipelines\.yml"


def code_health(tree: DataFrame) -> DataFrame:
    """One row per repository of the flags a tree shows: tests, CI, licence, README, lockfile, secret-shaped paths."""
    p = F.col("path")
    seen = lambda q: F.bool_or(p.rlike(q))
    return tree.groupBy("repo_id").agg(
        F.bool_or(scalar.language_of(p).isNotNull()).alias("has_code"), seen(r"(?i)test|spec").alias("has_tests"), seen(_CI).alias("has_ci"), seen(r"(?i)licen[cs]e|copying").alias("has_license"),
        seen(r"(?i)(^|/)readme[^/]*$").alias("has_readme"), seen(_LOCKED).alias("has_lockfile"), F.count_if(p.rlike(_SECRET)).alias("secrets"), F.min(F.when(p.rlike(_DECLARES), p)).alias("declares"),
        F.min(F.when(p.rlike(_SECRET), p)).alias("secret_at"),
    )


def tree_issues(tree: DataFrame) -> DataFrame:
    """``repo_id, severity, kind, issue, where``: six rules on what a tree lacks or should not hold."""
    c, no = F.col, lambda x: ~F.col(x)
    rules = [
        ("Medium", "SDLC", "no tests", c("has_code") & no("has_tests"), F.lit("")),
        ("Medium", "SDLC", "no CI", c("has_code") & no("has_ci"), F.lit("")),
        ("Medium", "SDLC", "no licence", no("has_license"), F.lit("")),
        ("Low", "SDLC", "no README", no("has_readme"), F.lit("")),
        ("Low", "Risk", "dependencies without lockfile", c("declares").isNotNull() & no("has_lockfile"), c("declares")),
        ("Low", "Security", "secret-shaped paths", c("secrets") > 0, c("secret_at")),
    ]
    hits = F.array_compact(F.array(*[F.when(fires, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), F.lit(i).alias("issue"), w.alias("where"))) for s, k, i, fires, w in rules]))
    return code_health(tree).select("repo_id", F.explode(hits).alias("h")).select("repo_id", "h.*")


def sub_projects(tree: DataFrame) -> DataFrame:
    """Top directories that hold code of their own, with their files."""
    p = F.col("path")
    t = tree.where(F.instr(p, "/") > 1).withColumn("name", F.substring_index(p, "/", 1)).where(~F.lower("name").isin(NO_PROJECT))
    return t.groupBy("repo_id", "name").agg(F.count("*").alias("files"), F.count_if(p.rlike(CODE_FILE)).alias("code"), F.count_if(p.rlike(r"(?i)\.ipynb$")).alias("notebooks")).where("code >= 1")


def collections(tree: DataFrame) -> DataFrame:
    """``repo_id, projects``: repositories of four sub-projects or more that hold half of all files."""
    total = tree.groupBy("repo_id").agg(F.count("*").alias("total"))
    subs = sub_projects(tree).groupBy("repo_id").agg(F.count("*").alias("projects"), F.sum("files").alias("inside"))
    return subs.join(total, "repo_id").where("projects >= 4 and inside >= total * 0.5").select("repo_id", "projects")


def dominant(counts: DataFrame, group: str, value: str, n: str, least_share: float = 0.0) -> DataFrame:
    """The most frequent value of each group and its share, if it reaches ``least_share``; ties by name."""
    best = counts.groupBy(group).agg(F.min_by(F.struct(value, n), F.struct(-F.col(n), F.col(value))).alias("b"), F.sum(n).alias("t"))
    return best.select(group, F.col(f"b.{value}").alias(value), (F.col(f"b.{n}") / F.col("t")).alias("share")).where(F.col("share") >= least_share)


def file_metrics(files: DataFrame) -> DataFrame:
    """Lines of code, depth, branches and open markers of each file that isn't minified."""
    t = F.col("text")
    own = files.where(t.isNotNull() & ~tx.minified(t))
    return own.select("repo_id", "path", tx.code_lines(t).alias("loc"), tx.max_indent(t).alias("depth"), tx.branches(t).alias("branches"), F.regexp_count(t, F.lit(r"\b(TODO|FIXME|HACK|XXX)\b")).alias("markers"))


#: Weight of a structure finding's severity (fixed values).
_WEIGHT = {"high": 3.0, "medium": 2.0, "low": 1.0}


def structure_findings(files: DataFrame, modules: DataFrame) -> DataFrame:
    """X2, G-16: ``repo_id, path, finding, severity, value, rank`` by measured facts only.

    ``modules``: ``repo_id, path, fan_in, in_cycle``; a file that no module row has counts as little used.
    The rank is severity by leverage (how widely a module is imported) by how removable the fault is.
    """
    lang = scalar.language_of(F.col("path"))
    m = file_metrics(files).join(modules, ["repo_id", "path"], "left").join(files.select("repo_id", "path", "text"), ["repo_id", "path"])
    t, fan = F.col("text"), F.coalesce("fan_in", F.lit(0))
    leverage = F.when(F.col("fan_in").isNull(), 1.2).otherwise(F.greatest(F.lit(1.0), 1 + fan / 3))
    high = lambda c: F.when(c, "high").otherwise("medium")
    medium, low = F.lit("medium"), F.lit("low")

    def rule(name: str, fires: Column, severity: Column, value: Column, lev: Column, removable: float) -> Column:
        weight = F.create_map(*[F.lit(x) for kv in _WEIGHT.items() for x in kv])[severity]
        return F.when(F.coalesce(fires, F.lit(False)), F.struct(F.lit(name).alias("finding"), severity.alias("severity"), value.cast("double").alias("value"), scalar.half_up(weight * lev * removable, 2).alias("rank")))

    python, script = lang == "Python", lang.isin("JavaScript", "TypeScript")
    density = F.col("branches") / F.col("loc")
    rules = [
        rule("oversized file", F.col("loc") > 600, high(F.col("loc") > 1200), F.col("loc"), leverage, 0.6),
        rule("deep nesting", F.col("depth") >= 6, high(F.col("depth") >= 8), F.col("depth"), leverage, 0.7),
        rule("dense branching", (F.col("loc") > 40) & (density > 0.28), medium, density, leverage, 0.5),
        rule("import cycle", F.col("in_cycle"), F.lit("high"), F.lit(1), F.greatest(leverage, F.lit(1.5)), 0.5),
        rule("hub module", fan >= 12, high(fan >= 25), fan, 1 + fan / 6, 0.4),
        rule("broad except", python & t.rlike(r"(?m)^\s*except(\s+Exception)?\s*:"), medium, F.lit(1), leverage, 0.8),
        rule("open without with", python & t.rlike(r"(?<!with\s)\bopen\s*\([^)]*\)(?!\s*as)") & ~t.rlike(r"\bwith\s+open"), medium, F.lit(1), leverage, 0.85),
        rule("empty catch", script & t.rlike(r"catch\s*\([^)]*\)\s*\{\s*\}"), medium, F.lit(1), leverage, 0.85),
        rule("open markers", F.col("markers") >= 3, low, F.col("markers"), F.lit(1.0), 0.9),
    ]
    return m.select("repo_id", "path", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("repo_id", "path", "f.*")


def duplicated_blocks(files: DataFrame, lines: int = 6, least: int = 60) -> DataFrame:
    """``repo_id, blocks, files``: runs of normalised lines that stand in two files or more of a repository."""
    norm = F.filter(F.transform(F.split("text", "\r?\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & ~x.rlike(r"^[)}\];,]+$"))
    d = files.where("text is not null").select("repo_id", "path", norm.alias("l")).where(F.size("l") >= lines)
    w = d.select("repo_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - lines + 1), lambda i: F.array_join(F.slice("l", i, lines), "\n"))).alias("w")).where(F.length("w") >= least)
    shared = w.select("repo_id", "path", F.md5("w").alias("w")).distinct()
    twice = shared.groupBy("repo_id", "w").agg(F.count("*").alias("n")).where("n >= 2")
    return shared.join(twice, ["repo_id", "w"]).groupBy("repo_id").agg(F.count_distinct("w").alias("blocks"), F.count_distinct("path").alias("files"))


def readiness(facts: DataFrame, flags: list[str]) -> DataFrame:
    """How many of the given flags hold; null counts as no."""
    return facts.withColumn("ready", sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0)))


def finding_groups(findings: DataFrame, k: int = 3) -> DataFrame:
    """Per repository and kind, number, worst severity, greatest rank and the first ``k`` files."""
    worst = F.min(F.struct(scalar.severity_rank(F.col("severity")).alias("r"), "severity"))
    first = Window.partitionBy("repo_id", "finding").orderBy(F.desc("rank"), "path")
    g = findings.withColumn("_k", F.row_number().over(first)).groupBy("repo_id", "finding")
    out = g.agg(F.count("*").alias("n"), worst.alias("w"), F.max("rank").alias("rank"), F.sort_array(F.collect_list(F.when(F.col("_k") <= k, F.struct("_k", "path")))).alias("p"))
    return out.select("repo_id", "finding", "n", F.col("w.severity").alias("severity"), "rank", F.col("p.path").alias("files"))


def fact_block(groups: DataFrame, k: int = 6, chars: int = 2000) -> DataFrame:
    """One text per repository from its ``k`` weightiest groups of findings, cut to ``chars``."""
    top = groups.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("rank"), "finding"))).where(F.col("_k") <= k)
    line = F.concat_ws("", F.lit("- "), "finding", F.lit(" x"), F.col("n").cast("string"), F.lit(" ("), "severity", F.lit("): "), F.array_join("files", ", "))
    lines = top.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("_k", line.alias("line")))).alias("l"))
    return lines.select("repo_id", F.left(F.array_join(F.col("l.line"), "\n"), F.lit(chars)).alias("facts"))


def mermaid(edges: DataFrame, group: str, src: str, dst: str, n: str, k: int = 12) -> DataFrame:
    """One flow chart text per group from its ``k`` heaviest edges; names become safe identifiers."""
    top = edges.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), src, dst))).where(F.col("_k") <= k)
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    label = lambda c: F.regexp_replace(c, "[\"\\[\\]]", "")
    line = F.concat(F.lit("  "), safe(src), F.lit('["'), label(src), F.lit('"] -->|'), F.col(n).cast("string"), F.lit("| "), safe(dst), F.lit('["'), label(dst), F.lit('"]'))
    lines = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_k", line.alias("line")))).alias("l"))
    return lines.select(group, F.concat(F.lit("flowchart LR\n"), F.array_join(F.col("l.line"), "\n")).alias("chart"))


def areas(modules: DataFrame, k: int = 7) -> DataFrame:
    """``repo_id, area, modules``: top directories of more than one module, the ``k`` largest of each repository, ties by name."""
    n = modules.groupBy("repo_id", scalar.top_dir(F.col("path")).alias("area")).agg(F.count("*").alias("modules")).where("modules > 1")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("modules"), "area"))
    return n.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def area_imports(imports: DataFrame, modules: DataFrame, k: int = 12) -> DataFrame:
    """``repo_id, src, dst, n``: imports between the areas of ``areas``, the ``k`` most frequent of each repository."""
    known = areas(modules).select("repo_id", "area")
    e = imports.select("repo_id", scalar.top_dir(F.col("src")).alias("src"), scalar.top_dir(F.col("dst")).alias("dst")).where("src <> dst").groupBy("repo_id", "src", "dst").agg(F.count("*").alias("n"))
    e = e.join(known.withColumnRenamed("area", "src"), ["repo_id", "src"], "left_semi").join(known.withColumnRenamed("area", "dst"), ["repo_id", "dst"], "left_semi")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "src", "dst"))
    return e.withColumn("_k", place).where(F.col("_k") <= k).select("repo_id", "src", "dst", "n")


def code_first(tree: DataFrame, budget: int) -> DataFrame:
    """Each repository's first ``budget`` files, code before the rest, the smaller first, ties by path."""
    code = F.when(F.col("path").rlike(CODE_FILE), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(code, "size", "path"))
    return tree.withColumn("place", place).where(F.col("place") <= budget)


def visible_findings(findings: DataFrame, k: int = 12) -> DataFrame:
    """Per repository and severity the ``k`` findings of greatest rank, and how many more there are."""
    by = Window.partitionBy("repo_id", "severity")
    ranked = findings.withColumn("place", F.row_number().over(by.orderBy(F.desc("rank"), "finding", "path"))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(by) - k))
    return ranked.where(F.col("place") <= k)


def originals_and_forks(repos: DataFrame, k: int, distinct: bool = True) -> DataFrame:
    """Every original and the ``k`` forks with most stars; with ``distinct`` an id counts once, its first row by name."""
    forks = repos.where("parent_id is not null").orderBy(F.desc("stars"), "id").limit(k)
    both = repos.where("parent_id is null").unionByName(forks)
    if not distinct:
        return both
    rest = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.min(F.struct("name", *[c for c in rest if c != "name"])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def report_totals(findings: DataFrame) -> DataFrame:
    """``repo_id, findings, high, place``: reports ranked by findings, then by severe ones, ties by id."""
    n = findings.groupBy("repo_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "high").alias("high"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("findings"), F.desc("high"), "repo_id")).cast("long"))


def changed_upstream(stored: DataFrame, upstream: DataFrame, key: str = "repo_id") -> DataFrame:
    """Keys whose upstream day of change differs from the stored one, or that were never described."""
    u = upstream.select(key, F.to_date("updated_at").alias("_now"))
    s = stored.select(key, F.to_date("updated_at").alias("_then"), F.col("topics").isNotNull().alias("_known"))
    return u.join(s, key, "left").where("_then is null or _then <> _now or not _known").select(key)


def article_state(articles: DataFrame, inputs: DataFrame, version: int, audit_version: int, symbol_version: int, wanted: DataFrame) -> DataFrame:
    """``repo_id, version, symbols, audit, current`` of every article with a text.

    ``articles``: ``repo_id, version, summary``; ``inputs``: ``repo_id, symbols, audit``, the versions of what
    a rewrite would read (null: none). A text is current if it is of this ``version``, or if it is
    behind but what a rewrite needs isn't there yet; one that is ``wanted`` (``repo_id``) never is.
    A missing version counts as the first.
    """
    state = lambda c, v: F.when(F.col(c).isNull(), "absent").when(F.col(c) >= v, "current").otherwise("stale")
    a = articles.where("summary is not null and summary <> ''").select("repo_id", F.coalesce("version", F.lit(1)).alias("version"))
    a = a.join(inputs, "repo_id", "left").join(wanted.select("repo_id", F.lit(True).alias("asked")).distinct(), "repo_id", "left")
    a = a.select("repo_id", "version", state("symbols", symbol_version).alias("symbols"), state("audit", audit_version).alias("audit"), F.coalesce("asked", F.lit(False)).alias("asked"))
    ready = (F.col("symbols") != "stale") & (F.col("audit") == "current")
    return a.withColumn("current", ~F.col("asked") & ((F.col("version") >= version) | ~ready)).drop("asked")


def fact_sections(sections: list[tuple[str, DataFrame, str]], chars: int = 6000) -> DataFrame:
    """``repo_id, facts``: the sections in their order, each under its heading, cut to ``chars``.

    A section is a heading, rows of ``repo_id, place`` and the name of the column with the line. A
    repository without rows in a section has no such heading; one without any has no row.
    """
    parts = [rows.select("repo_id", F.lit(i).alias("s"), F.lit(title).alias("title"), "place", F.col(line).alias("line")) for i, (title, rows, line) in enumerate(sections)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("repo_id", "s", "title").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    text = one.select("repo_id", "s", F.concat("title", F.lit(":\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("  "), x["line"])), "\n")).alias("t"))
    joined = text.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("t"))
    return joined.select("repo_id", F.left(F.array_join(F.col("t.t"), "\n\n"), F.lit(chars)).alias("facts"))
