"""Text column functions: tokens, Markdown, quality gates, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about a text (fixed values).
STOP_WORDS = (
    "a an the and or but if then of for to in on at by with from as is are was were be been being it its this that these those you your we our i my me he she they "
    "them not no so such can will just very also more most other some any each which who whom what when where why how all both few own same than too s t don now"
).split()


def _parts(c: Column) -> Column:
    return F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9+#.]+"), lambda t: F.btrim(t, F.lit(".")))


def _is_token(t: Column) -> Column:
    return (F.length(t) > 1) & (F.length(t) < 24) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$")


def tokens(c: Column) -> Column:
    """Search tokens: lower case, dots trimmed, 2 to 23 characters, no stop words, not all digits."""
    return F.filter(_parts(c), _is_token)


def token_rows(df: DataFrame, ident: str, c: Column) -> DataFrame:
    """``ident, token``: the distinct tokens of each text as rows; what a token is, is asked of the rows, in compiled code."""
    rows = df.select(ident, F.explode(F.array_distinct(_parts(c))).alias("token"))
    return rows.where(_is_token(F.col("token")))


def refreshed_postings(postings: DataFrame, changed: DataFrame, ident: str, c: Column) -> DataFrame:
    """Postings brought up to date: those of ``changed`` texts go and come anew, all others stay; a null text only goes."""
    kept = postings.join(changed.select(ident).distinct(), ident, "left_anti")
    return kept.unionByName(token_rows(changed, ident, c))


SQL_TOKENS = (
    "list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9+#.]+'), lambda t : regexp_replace(t, '^[.]+|[.]+$', '', 'g')), "
    "lambda t : length(t) > 1 AND length(t) < 24 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], t) AND NOT regexp_matches(t, '^[0-9]+$'))"
)

#: Markdown taken off in this order (the order is a fixed value): pattern, what stays.
MARKDOWN = [
    (r"(?s)```\w*\n\s*(.*?)\s*```", "$1\n\n"),
    (r"(?s)```\s*(.*?)\s*```", "$1\n\n"),
    (r"(?m)^`{1,3}\w*\s*$", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"`", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"(?m)^>\s+", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"\n{3,}", "\n\n"),
]


def strip_markdown(c: Column) -> Column:
    """Plain text; links keep their words, and an image's mark stays as its link rule ran first."""
    for pattern, kept in MARKDOWN:
        c = F.regexp_replace(c, pattern, kept)
    return F.trim(c)


def clean_article(c: Column) -> Column:
    """Unix line ends, one outer fence taken off, an odd fence closed, no runs of blank lines."""
    t = F.trim(F.regexp_replace(c, r"\r\n?", "\n"))
    outer = r"(?is)^`{3,}\s*(?:markdown|md)?\s*\n(.*?)\n`{3,}\s*$"
    t = F.trim(F.when(t.rlike(outer), F.regexp_extract(t, outer, 1)).otherwise(t))
    t = F.when(F.regexp_count(t, F.lit(r"(?m)^\s*`{3,}")) % 2 == 1, F.concat(t, F.lit("\n```"))).otherwise(t)
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != ""))


def read_minutes(c: Column) -> Column:
    """At least two minutes, at 200 words a minute."""
    return F.greatest(F.lit(2), F.ceil(word_count(c) / 200)).cast("int")


def embedding_text(*parts: Column) -> Column:
    """The parts that say something, joined as sentences, 2,000 characters at most."""
    return F.left(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), ". "), F.lit(2000))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def looks_like_heading(c: Column) -> Column:
    t = F.trim(c)
    return (F.length(t) > 0) & (F.length(t) <= 60) & (word_count(t) <= 8) & ~t.rlike(r"[.!?,;]$")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


# -- gates -------------------------------------------------------------------

#: Phrases about the writing task rather than its subject (fixed values).
REASONING = [
    r"\b(let me|i'?ll|i will) (write|draft|outline|start|produce|structure)\b",
    r"\bunder \d{3} words\b",
    r"\bwe need to (parse|produce|be careful|keep|avoid|mention)\b",
    r"\bwe'?ll (phrase|say|mention|produce|write)\b",
    r"\bthe (instructions?|prompt) (say|says|asks?|require)\b",
    r"\bas an ai\b",
    r"\bstyle rules\b",
    r"\bneed to keep (it )?(under|within)\b",
    r"one paragraph about the specific pain point",
    r"\b2-3 short paragraphs\b",
]
#: Phrases that mark a text as filler (fixed values).
FILLER = [
    "demonstrates thoughtful software design", "caught my attention for its practical approach", "worth investigating if you're working with",
    "patterns and implementations that could accelerate", "in the rapidly evolving", "in the world of", "in today's landscape", "is paramount", "aims to streamline",
    "comprehensive solution", "it's worth noting", "leveraging the power", "game-changer", "cutting-edge",
]
#: How a finished text ends.
CLEAN_END = "[.!?:;)\\]}\"'”’`|*]$"
#: White space as JavaScript trims it.
_TRIM = r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$"


def reasoning_leak(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(REASONING)), F.lit(False))


def truncated(c: Column) -> Column:
    """Whether a text breaks off: it ends neither on punctuation nor on a fence."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), _TRIM, "")
    return (t != "") & ~t.rlike(CLEAN_END)


def fallback_article(c: Column, least: int = 400) -> Column:
    """Too short, broken off, or filler."""
    low = F.lower(c)
    filler = F.lit(False)
    for p in FILLER:
        filler = filler | low.contains(p)
    return c.isNull() | (F.length(c) < least) | truncated(c) | filler


def minified(c: Column) -> Column:
    """A line of 2,500 characters or more within the first 200,000; anchored, so the search is linear."""
    return F.left(c, F.lit(200_000)).rlike(r"(?m)^[^\n]{2500}")


def entropy(c: Column) -> Column:
    """Bits per character, in the JVM: one walk over the sorted characters, adding up the lengths of runs."""
    n = F.length(c).cast("double")
    close = lambda s: s["sum"] + s["run"] * F.log2(F.greatest(F.lit(1.0), s["run"]))
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("sum"))
    start = state(F.lit(""), F.lit(0.0), F.lit(0.0))
    walk = F.aggregate(F.array_sort(F.split(c, "")), start, lambda s, x: F.when(x == s["last"], state(x, s["run"] + 1, s["sum"])).otherwise(state(x, F.lit(1.0), close(s))), close)
    return F.when(n > 0, F.log2(n) - walk / n).otherwise(0.0)


#: Marks of a value that is no secret (fixed values).
PLACEHOLDER = (
    r"(?i)^(your|my|the|an?|xxx+|<|\{|\$|%|\.\.\.|todo|tbd|fixme|change[-_ ]?me|placeholder|example|sample|dummy|fake|test|dev|local|none|null|nil|undefined|redacted|removed|hidden|insert|"
    r"add[-_ ]?your|paste|abc|123|0000|foo|bar|baz|secret|password|apikey|api[-_]key|s3cr3t|hunter2)($|[^A-Za-z0-9])"
)
SAMPLE_MARK = r"(?i)(placeholder|redacted|changeme|change_me|your[-_]?(api|key|token|secret)|example|dummy|sample|not[-_]?real|fill[-_]?me|insert[-_]?here)"
COMMON_PASSWORDS = "password passwd pass secret changeme example yourpassword mysecretpassword postgres root admin guest test dev devkey mysql redis".split()


def looks_real(value: Column, shared_by: Column | None = None) -> Column:
    """Whether a configured value looks like a real secret: long and disordered, no sample, not shared.

    ``shared_by`` is the number of records that hold the same value, counted beforehand, so the
    answer never depends on the order of records; from three on it is sample data.
    """
    v = F.regexp_replace(F.trim(value), "^[\"']|[\"']$", "")
    h = entropy(v)
    out = (
        (F.length(v) >= 12) & ~v.rlike(PLACEHOLDER) & ~v.rlike(r"^[a-z]+([-_][a-z]+){1,6}$") & ~v.rlike(SAMPLE_MARK) & ~v.rlike(r"[<>{}]|\.\.\.|\*{3,}|X{6,}")
        & ~v.rlike(r"^(.)\1+$") & ~F.lower(v).isin(COMMON_PASSWORDS) & (h >= F.when(F.length(v) >= 20, 3.5).otherwise(3.2))
    )
    if shared_by is not None:
        out = out & (F.coalesce(shared_by, F.lit(1)) < 3)
    return F.coalesce(out, F.lit(False))


def value_key(value: Column) -> Column:
    """What makes two secret values count as the same: length and first 12 characters."""
    return F.concat(F.length(value).cast("string"), F.lit(":"), F.left(value, F.lit(12)))


# -- source code -------------------------------------------------------------

BRANCH = r"\b(if|elif|for|while|case|catch|except)\b|&&|\|\||\?\s*[^:]"


def code_lines(c: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#|//|\*)")))


def max_indent(c: Column) -> Column:
    """Deepest indentation in steps of four columns, a tab counting as one step."""
    depth = F.transform(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), lambda x: F.floor(F.length(F.regexp_replace(F.regexp_extract(x, r"^([ \t]*)", 1), "\t", "    ")) / 4).cast("int"))
    return F.coalesce(F.array_max(depth), F.lit(0))


def branches(c: Column) -> Column:
    return F.regexp_count(c, F.lit(BRANCH))


def strip_comments(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?m)^\s*#.*$", "")
    c = F.regexp_replace(c, r"(?m)^\s*//.*$", "")
    return F.regexp_replace(c, r"(?s)/\*.*?\*/", "")


# -- pages -------------------------------------------------------------------


def noindex(html: Column) -> Column:
    """Whether a page asks not to be indexed."""
    return F.coalesce(html.rlike(r"(?is)<meta[^>]+name=[\"']robots[\"'][^>]*content=[\"'][^\"']*noindex"), F.lit(False))


def parsed_time(c: Column) -> Column:
    """A time from the usual spellings (ISO, ``January 5, 2026``, mail dates), null where there is none; the clock is never asked."""
    mail = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("MMMM d, yyyy")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def accepts_language(stated: Column, name: str, aliases: list[str] | None = None) -> Column:
    """Whether a stated language is the one a reader is for, or an alias of it."""
    return F.coalesce(F.lower(stated).isin(name.lower(), *[a.lower() for a in aliases or []]), F.lit(False))
