"""What a repository is, from its tree: domain, kind with its evidence, capabilities, skill distributions.

Every signal is a count over the tree, so one aggregation per repository serves all rules; the rules
themselves are lists, and a caller may pass its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators.extract import technologies

#: Domain of a language, and of what has no code language (fixed values).
DOMAIN_OF = {
    "AI & Data": "Python|Jupyter Notebook|R|Julia|SQL",
    "Web & Interfaces": "TypeScript|JavaScript|Vue|Svelte|HTML|CSS|SCSS|Ruby|PHP|Elixir",
    "Systems & Infra": "Go|Rust|C|C++|Java|C#|Lua|Shell|HCL|Scala|YAML|TOML",
    "Mobile": "Swift|Kotlin|Dart",
    "Knowledge & Content": "Markdown|JSON",
}
#: Languages that hold no code (fixed values).
PROSE_OR_CONFIG = ["Markdown", "YAML", "JSON", "TOML"]
#: Directories of a published skill or plugin, and of mere use of such a tool (fixed values).
MANIFEST_DIR = r"^\.[a-z0-9][a-z0-9._-]*-plugin$"
PAYLOAD_DIR = rf"^(skills|plugins)$|{MANIFEST_DIR}"
TOOL_DIR = r"^\.(claude|agents?|cursor|codex|gemini|opencode|zed|windsurf|kiro|pi|continue|roo|kilocode|clinerules|junie|trae|amp|goose|aider|augment)$"
SKILL_NAME = r"(?i)(^|[-_ ])(skills?|plugins?|mcp|mcp-server|agent-skills?)([-_ ]|$)"
#: Files that a census lists as configuration, dependencies or entry points (fixed values).
LISTED = (
    r"(?i)(^|/)(package\.json|tsconfig\.json|webpack\.config|vite\.config|docker-compose|dockerfile|\.env\.example|makefile|cargo\.toml|go\.mod|pyproject\.toml|setup\.cfg|setup\.py|requirements\.txt|gemfile"
    r"|build\.gradle|pom\.xml|cmakelists\.txt|\.eslintrc|\.prettierrc|jest\.config|tailwind\.config|next\.config|nuxt\.config)[^/]*$"
    r"|(^|/)(pipfile|poetry\.lock|yarn\.lock|package-lock\.json|composer\.json|pubspec\.yaml|__main__\.py|manage\.py|lib\.rs)$|(^|/)cmd/"
    r"|(^|/)(main\.(js|ts|py|go|rs|c|cpp|java|kt|dart)|index\.(jsx?|tsx?|html)|app\.(jsx?|tsx?|py)|server\.(js|ts|py|go)|cli\.(js|ts|py))$"
)
#: Technologies that make a web application, and a service (fixed values).
WEB = ["React", "Next.js", "Vue", "Svelte", "Angular"]
SERVICE = ["FastAPI", "Flask", "Django", "Express", "NestJS", "Rails", "Spring"]
#: Capability -> technologies that evidence it, and languages that do (fixed values).
CAPABILITIES: dict[str, tuple[list[str], list[str]]] = {
    "Computer Vision": (["OpenCV", "YOLO"], []), "Deep Learning": (["PyTorch", "TensorFlow", "ONNX", "CUDA"], []), "LLM & Agents": (["Transformers", "LangChain"], []),
    "RAG & Vector Search": (["Vector store"], []), "Knowledge Graphs": (["Neo4j", "GraphQL"], []), "Data Engineering": (["pandas", "Spark", "Airflow", "dbt"], []),
    "MLOps": (["MLflow", "DVC", "Docker", "Kubernetes"], []), "Full-Stack Web": (["React", "Next.js", "Vue", "Svelte", "Angular", "Express", "NestJS", "Tailwind"], []),
    "Backend & APIs": (["FastAPI", "Flask", "Django", "Rails", "Spring", "Laravel"], ["Go", "Rust"]), "Cloud & Infra": (["Terraform", "Kubernetes"], []),
}


def traits(tree: DataFrame) -> DataFrame:
    """One row per repository with every count the rules ask for: one pass over the tree."""
    p = F.col("path")
    lang, top, listed = scalar.language_of(p), F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)), p.rlike(LISTED)
    n = F.count_if
    by_language = n(lang.isNotNull())
    return tree.groupBy("repo_id").agg(
        F.count("*").alias("files"), by_language.alias("known"), n(top.rlike(f"{PAYLOAD_DIR}|{TOOL_DIR}")).alias("skill_files"), n(lang == "Markdown").alias("prose"),
        n(top.rlike(MANIFEST_DIR)).alias("manifest_dir"), n(top.rlike(PAYLOAD_DIR)).alias("payload"), n(p.rlike(r"(?i)(^|/)skill\.md$")).alias("skill_md"),
        n(lang == "Jupyter Notebook").alias("notebooks"), F.greatest(n(lang == "Swift"), n(lang == "Dart"), n(lang == "Kotlin")).alias("mobile"),
        n(listed & p.rlike(r"(?i)(^|/)(pubspec\.yaml|build\.gradle(\.kts)?)$")).alias("mobile_build"),
        n(listed & p.rlike(r"(?i)(^|/)(vite|next|nuxt|astro|svelte|webpack|angular)\.config\.")).alias("web_build"),
        n(p.rlike(r"(?i)(^|/)(dockerfile$|docker-compose)")).alias("docker"), n(listed & p.rlike(r"(?i)(^|/)(docker-compose|k8s|helm)")).alias("orchestrated"),
        n(listed & p.rlike(r"(?i)(^|/)(cli|main|cmd)\.(py|js|ts|go|rs)$|(^|/)(cmd|bin)/")).alias("commands"),
        n(listed & p.rlike(r"(?i)(^|/)(setup\.py|pyproject\.toml|cargo\.toml|go\.mod|package\.json|gemfile)$")).alias("packages"),
        n(p.rlike("(?i)test|spec")).alias("tests"), n(listed & p.rlike(r"(?i)\.(tf|tfvars)$|(^|/)(ansible|terraform|helm)")).alias("infra"),
    )


def skill_distribution(name: Column | None = None) -> Column:
    """whether a repository is a distribution of skills: by share of its tree, or prose with a distribution's marks."""
    share = F.col("skill_files") / F.col("files")
    marked = (F.col("manifest_dir") > 0) | ((F.col("payload") > 0) & (share >= 0.15)) | (F.col("skill_md") > 0)
    if name is not None:
        marked = marked | F.coalesce(name.rlike(SKILL_NAME), F.lit(False))
    prose = F.coalesce(F.col("prose") / F.nullif(F.col("known"), F.lit(0)), F.lit(0.0))
    return (share >= 0.5) | ((prose >= 0.6) & marked)


def kind_rules() -> list[tuple[str, Column, Column]]:
    """E5: kind, test, evidence; the first that holds wins, so the most special stand first."""
    c, share = F.col, lambda x: F.col(x) / F.greatest(F.lit(1), F.col("files"))
    some = lambda names: F.arrays_overlap("technologies", F.array(*[F.lit(x) for x in names]))
    return [
        ("Notebook / research", share("notebooks") > 0.15, F.concat(c("notebooks").cast("string"), F.lit(" notebooks"))),
        ("Mobile app", (c("mobile_build") > 0) | (share("mobile") > 0.2), F.lit("built for phones")),
        ("Web app", some(WEB) | (c("web_build") > 0), F.coalesce(F.nullif(F.array_join(F.array_intersect("technologies", F.array(*[F.lit(x) for x in WEB])), ", "), F.lit("")), F.lit("a bundler's settings"))),
        ("Service / API", ((c("docker") > 0) & (c("orchestrated") > 0)) | some(SERVICE), F.when(c("docker") > 0, "containers").otherwise("a server framework")),
        ("CLI tool", c("commands") > 0, F.lit("a command to run")),
        ("Library / SDK", (c("packages") > 0) & (c("tests") > 0), F.lit("a package with tests")),
        ("Docs / content", share("prose") > 0.5, F.lit("prose for the most part")),
        ("Infrastructure", c("infra") > 0, F.lit("infrastructure written as code")),
    ]


def classified(tree: DataFrame, names: DataFrame | None = None, rules: Sequence[tuple[str, Column, Column]] | None = None) -> DataFrame:
    """``repo_id, language, domain, kind, confidence, evidence, capabilities`` of every repository in the tree.

    ``names``: ``repo_id, name``. Languages rank by files, ties by name. A repository with files in a
    language but under no rule is a ``Codebase`` of little confidence, one without any ``Unknown``.
    """
    lang = tree.select("repo_id", scalar.language_of(F.col("path")).alias("l")).where("l is not null").groupBy("repo_id", "l").agg(F.count("*").alias("n"))
    code = F.when(~F.col("l").isin(PROSE_OR_CONFIG), F.struct((-F.col("n")).alias("n"), "l"))
    best = lang.groupBy("repo_id").agg(F.min(code)["l"].alias("language"), F.min(F.struct((-F.col("n")).alias("n"), "l"))["l"].alias("most"))
    tech = technologies(tree).groupBy("repo_id").agg(F.sort_array(F.collect_set("technology")).alias("technologies"))
    t = traits(tree).join(best, "repo_id", "left").join(tech, "repo_id", "left").withColumn("technologies", F.coalesce("technologies", F.array().cast("array<string>")))
    if names is not None:
        t = t.join(names.select("repo_id", "name"), "repo_id", "left")
    domain_of = {x: d for d, xs in DOMAIN_OF.items() for x in xs.split("|")}
    domain = F.when(skill_distribution(F.col("name") if names is not None else None), "Agent Skills & Plugins").otherwise(
        F.coalesce(scalar.mapped(F.col("language"), domain_of), scalar.mapped(F.col("most"), domain_of), F.lit("Other"))
    )
    kind = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence")))
    for name, holds, why in rules if rules is not None else kind_rules():
        kind = kind.when(holds, F.struct(F.lit(name).alias("kind"), F.lit(0.7).alias("confidence"), why.alias("evidence")))
    kind = kind.when(F.col("language").isNotNull(), F.struct(F.lit("Codebase").alias("kind"), F.lit(0.3).alias("confidence"), F.concat("language", F.lit(" only")).alias("evidence")))
    kind = kind.otherwise(F.struct(F.lit("Unknown").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence")))
    able = []
    for name, (techs, langs) in CAPABILITIES.items():
        shown = F.arrays_overlap("technologies", F.array(*[F.lit(x) for x in techs]))
        able.append(F.when(shown | F.coalesce(F.col("language").isin(langs), F.lit(False)) if langs else shown, F.lit(name)))
    return t.select("repo_id", "language", domain.alias("domain"), kind.alias("k"), F.array_compact(F.array(*able)).alias("capabilities")).select("repo_id", "language", "domain", "k.*", "capabilities")
