"""Scalar column functions: rounding, classification, ladders, rendering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int) -> Column:
    """Round half up through floor, the same in every engine and for every magnitude."""
    p = float(10**places)
    return F.floor(c * p + F.lit(0.5)) / F.lit(p)


def round1(c: Column) -> Column:
    return half_up(c, 1)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


#: Grade steps: lowest score of each letter (fixed values).
LADDER = [(90, "A"), (85, "A-"), (80, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (60, "C"), (50, "C-"), (40, "D"), (0, "F")]


def letter(score: Column) -> Column:
    """The letter of a score; null for null."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for low, name in LADDER:
        out = out.when(score >= low, name)
    return out.otherwise("F")


def next_step(score: Column) -> Column:
    """``struct<letter, points>`` of the next better letter, null at the top."""
    out = F.when(score.isNull(), F.lit(None).cast("struct<letter:string,points:double>"))
    for low, name in reversed(LADDER):
        out = out.when(score < low, F.struct(F.lit(name).alias("letter"), round1(F.lit(float(low)) - score).alias("points")))
    return out


def band(value: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """The name of the first step (in falling order) that the value reaches."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for low, name in steps:
        out = out.when(value >= low, name)
    return out.otherwise(lowest)


def repeat_factor(n: Column) -> Column:
    """How much more n hits cost than one: by the logarithm, at most 1.6."""
    return F.least(F.lit(1.6), F.lit(1.0) + F.log2(F.greatest(F.lit(1.0), F.coalesce(n.cast("double"), F.lit(1.0)))) * 0.18)


# -- versions and ecosystems -------------------------------------------------

#: A declared constraint: operator, then a version.
VERSION = r"^([=<>~^!]*)\s*v?(\d+(?:\.\d+)*(?:[-+][0-9A-Za-z.-]+)?)"


def constraint(spec: Column) -> Column:
    """``struct<version, pinned>`` of a version constraint, null if it names none.

    Of a compound constraint the first clause counts and is never pinned; a pin has no operator or
    an equality.
    """
    s = F.trim(spec)
    asks_nothing = s.isin("", "*", "latest") | s.rlike(r"^(https?:|git\+|file:|workspace:|link:)")
    compound = s.rlike(r"[,|]")
    head = F.trim(F.split(s, r"\s*(?:,|\|\|)\s*")[0])
    version = F.regexp_extract(head, VERSION, 2)
    pinned = ~compound & F.regexp_extract(head, VERSION, 1).isin("", "=", "==")
    return F.when(~asks_nothing & (version != ""), F.struct(version.alias("version"), pinned.alias("pinned")))


def major(version: Column) -> Column:
    """The first run of digits as a number."""
    return F.try_to_number(F.nullif(F.regexp_extract(version, r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")


def go_version(version: Column) -> Column:
    return F.concat(F.lit("v"), F.regexp_replace(version, "^v", ""))


#: Manifest file to ecosystem; the first that matches (fixed values).
MANIFESTS = [
    (r"(?i)package\.json$", "npm"),
    (r"(?i)(requirements[^/]*\.txt|pyproject\.toml|setup\.py|Pipfile)$", "pypi"),
    (r"(?i)go\.mod$", "go"),
    (r"(?i)Cargo\.toml$", "cargo"),
    (r"(?i)(build\.gradle(\.kts)?|pom\.xml)$", "maven"),
    (r"(?i)composer\.json$", "packagist"),
    (r"(?i)pubspec\.yaml$", "pub"),
    (r"(?i)Gemfile$", "rubygems"),
]


def first_match(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern that is found in the text."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for pattern, name in rules:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def manifest_ecosystem(path: Column) -> Column:
    return first_match(path, MANIFESTS, "other")


#: Severities, worst first (fixed values).
SEVERITIES = ["critical", "high", "medium", "low"]


def severity(word: Column, vector: Column | None = None) -> Column:
    """A stated severity in lower case, else one derived from a CVSS 3 vector, else ``unknown``."""
    stated = F.regexp_extract(F.lower(word), r"(critical|high|moderate|medium|low)", 1)
    out = F.when(stated == "moderate", "medium").when(stated != "", stated)
    if vector is not None:
        remote, silent, open_ = vector.contains("AV:N"), vector.contains("UI:N"), vector.contains("PR:N")
        impact = F.regexp_count(vector, F.lit("[CIA]:H"))
        out = out.when(vector.rlike(r"CVSS:3\.\d/"), F.when(remote & silent & open_ & (impact >= 2), "critical").when(remote & (impact >= 1), "high").otherwise("medium"))
    return out.otherwise("unknown")


def severity_rank(name: Column) -> Column:
    """1 for the worst; unknown words come last."""
    out = F.when(name == SEVERITIES[0], 1)
    for i, s in enumerate(SEVERITIES[1:], 2):
        out = out.when(name == s, i)
    return out.otherwise(len(SEVERITIES) + 1)


# -- paths -------------------------------------------------------------------


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def module_id(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "(root)").otherwise(F.substring_index(path, "/", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Every directory above a path, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


#: Extension to language (fixed values).
LANGUAGE_OF = {
    "py": "Python", "ipynb": "Jupyter Notebook", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "rs": "Rust", "go": "Go", "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "rb": "Ruby", "php": "PHP", "cs": "C#", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++",
    "swift": "Swift", "scala": "Scala", "r": "R", "jl": "Julia", "lua": "Lua", "dart": "Dart", "ex": "Elixir", "exs": "Elixir", "sh": "Shell", "bash": "Shell", "ps1": "PowerShell",
    "html": "HTML", "css": "CSS", "scss": "SCSS", "vue": "Vue", "svelte": "Svelte", "sql": "SQL", "tf": "HCL", "md": "Markdown", "yml": "YAML", "yaml": "YAML", "json": "JSON", "toml": "TOML",
}


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """Lookup in a small fixed table, null where it has no entry."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def language_of(path: Column) -> Column:
    return mapped(extension(path), LANGUAGE_OF)


# -- rendering ---------------------------------------------------------------


def short_number(n: Column) -> Column:
    """Exact below 10,000, then thousands and millions with one decimal."""
    k, m = half_up(n / 1e3, 1), half_up(n / 1e6, 1)
    return F.when(n < 10_000, n.cast("long").cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", k), F.lit("K"))).otherwise(F.concat(F.format_string("%.1f", m), F.lit("M")))


def bits(*flags: Column) -> Column:
    """Flags as a string of 0 and 1; null counts as 0."""
    return F.concat(*[F.when(f, "1").otherwise("0") for f in flags])


def bit(c: Column, place: int) -> Column:
    """Whether the place-th (from 1) character of a bit string is set."""
    return F.substring(c, place, 1) == "1"


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def content_hash(model: Column, text: Column) -> Column:
    """16 hex digits that change when the model or the text does."""
    return F.left(F.sha1(F.concat(model, F.lit("\n"), text)), F.lit(16))


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out > 0, half_up(fan_out / (fan_in + fan_out), 2)).otherwise(0.0)


# -- calls -------------------------------------------------------------------

#: Receiver text to the effect of a call; first match wins (patterns are fixed values).
EFFECTS = [
    ("db", r"\b(cursor|conn|connection|session|db|database|tx|trx|transaction|pool|client)\.(execute|executemany|query|fetch|fetchall|fetchone|commit|rollback|prepare|exec)\b"
           r"|\b(sqlalchemy|psycopg2?|asyncpg|sqlite3|pymongo|mongoose|prisma|knex|drizzle|typeorm|sequelize|redis|aioredis)\b"
           r"|\.(objects|query)\.(all|filter|get|create|update|delete|first)\b|\bsupabase\.(from|rpc|table)\b"
           r"|\b(collection|table|model|repo|repository)\.(insert|insert_one|insert_many|find|find_one|update_one|update_many|delete_one|delete_many|aggregate|save|create|bulk_write)\b"
           r"|\b(queryrow|queryctx|execcontext)\b"),
    ("network", r"\b(requests|httpx|aiohttp|urllib|urllib2|urllib3|http|https|axios|fetch|got|superagent|node_fetch)\.(get|post|put|patch|delete|head|request|send|stream)\b"
                r"|\burlopen\b|\bfetch\s*$|\b(session|client|http|api)\.(get|post|put|patch|delete|request)\b|\b(socket|websocket|ws|grpc|channel)\.(connect|send|recv|dial|invoke)\b"
                r"|\b(boto3|botocore|s3|azure|gcs|storage)\.(client|resource|upload|download|put_object|get_object)\b"),
    ("filesystem", r"\b(fs|fsp|fse|path|os|shutil|pathlib|io)\.(open|read|write|readfile|writefile|readfilesync|writefilesync|appendfile|appendfilesync|mkdir|makedirs|rmtree|remove|unlink|rename|copy|copyfile|copytree|chmod|chown)\b"
                   r"|\.(write_text|read_text|write_bytes|read_bytes|touch|unlink|mkdir)\b|\b(ioutil|osfile)\.(readfile|writefile)\b|\bopen\s*$"),
    ("subprocess", r"\b(subprocess|child_process|os|exec|spawn)\.(run|call|check_output|check_call|popen|system|exec|execsync|spawn|spawnsync|fork)\b|\b(command|cmd)\.(output|status|spawn|run)\b|\bexeccommand\b"),
    ("model", r"\b(openai|anthropic|cohere|mistral|groq|ollama|together|replicate|huggingface|hf|transformers|llm|genai|bedrock|vertexai)\b"
              r"|\.(chat|completions|complete|generate|embed|embeddings|invoke|predict|infer|stream)\.(create|generate)?\b.*\b(client|api|model|llm)\b"
              r"|\b(model|pipeline|predictor|estimator|net)\.(predict|forward|generate|fit|train|evaluate|infer)\b|\bchat\.completions\.create\b"),
    ("crypto", r"\b(hashlib|hmac|bcrypt|argon2|scrypt|nacl|cryptography|crypto|jwt|jose|jsonwebtoken|fernet)\.(new|sign|verify|encode|decode|encrypt|decrypt|hash|hashpw|checkpw|digest|generate_private_key|sha\d+|md5|blake2[bs]|pbkdf2_hmac)\b"
               r"|\b(secrets|randombytes|token_urlsafe|token_hex|urandom)\b"),
]


def effect(receiver: Column) -> Column:
    """The kind of side effect of a call by its receiver text; null for none or for over 200 characters."""
    return F.when(F.length(receiver) <= 200, first_match(F.lower(receiver), [(p, n) for n, p in EFFECTS]))


def import_root(name: Column) -> Column:
    """The package an import names: scoped names keep two parts, paths and dotted names one."""
    return F.when(name.startswith("@"), F.array_join(F.slice(F.split(name, "/"), 1, 2), "/")).otherwise(F.split(name, r"[./]")[0])
