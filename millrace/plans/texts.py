"""Documents: tokens, inverted index, gates, Markdown, metrics, duplicated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar, text
from millrace.operators import relational
from millrace.session import saved, spread, table


def _documents(spark: SparkSession, root: str, *more: str) -> DataFrame:
    return spread(table(spark, root, "documents", "doc_id", "text", *more))


def postings(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (token, document) of all texts."""
    return text.token_rows(_documents(spark, root), "doc_id", F.col("text"))


def inverted_index_df(spark: SparkSession, root: str, share: float = 0.4) -> DataFrame:
    """Tokens with their number of documents, those in over ``share`` of all documents left out."""
    n = table(spark, root, "documents", "doc_id").count()
    return postings(spark, root).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= share * n)


def token_search(spark: SparkSession, root: str) -> DataFrame:
    """F2 over texts: documents by how many of the query's tokens they have, of two or more."""
    wanted = ["lockfile", "parser", "workflow", "audit", "plugin"]
    hits = postings(spark, root).where(F.col("token").isin(wanted))
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits")).where("hits >= 2")


def posting_intersect(spark: SparkSession, root: str) -> DataFrame:
    """Documents with all of three tokens."""
    t = _documents(spark, root).select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    want = F.array(*[F.lit(x) for x in ("cache", "manifest", "nightly")])
    return t.where(F.size(F.array_intersect("t", want)) == 3).select("doc_id")


def token_totals(spark: SparkSession, root: str) -> DataFrame:
    """Tokens and distinct tokens of each document."""
    t = _documents(spark, root).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def truncated_text(spark: SparkSession, root: str) -> DataFrame:
    """documents that break off."""
    return _documents(spark, root).where(text.truncated(F.col("text"))).select("doc_id")


def reasoning_leak(spark: SparkSession, root: str) -> DataFrame:
    """documents that speak of the task of writing them."""
    return _documents(spark, root).where(text.reasoning_leak(F.col("text"))).select("doc_id")


def fallback_gate(spark: SparkSession, root: str) -> DataFrame:
    """Documents per source that pass the gate or don't."""
    return _documents(spark, root, "source").groupBy("source", text.fallback_article(F.col("text")).alias("fallback")).agg(F.count("*").alias("n"))


def text_entropy(spark: SparkSession, root: str) -> DataFrame:
    """Bits per character of titles."""
    return table(spark, root, "documents", "doc_id", "title").where("title is not null").select("doc_id", scalar.half_up(text.entropy(F.col("title")), 6).alias("bits"))


def plain_text(spark: SparkSession, root: str) -> DataFrame:
    """Length and hash of each text without its Markdown."""
    plain = text.strip_markdown(F.col("text"))
    return _documents(spark, root).where("text is not null").select("doc_id", F.length(plain).alias("plain_chars"), F.md5(plain).alias("plain"))


def cleaned_articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles with their fences closed and blank lines thinned."""
    d = _documents(spark, root, "source").where("source = 'article' and text is not null")
    return d.select("doc_id", F.md5(text.clean_article(F.col("text"))).alias("cleaned"))


def read_times(spark: SparkSession, root: str) -> DataFrame:
    """Minutes to read, and how many documents take them."""
    return _documents(spark, root).groupBy(text.read_minutes(F.col("text")).alias("minutes")).agg(F.count("*").alias("n"))


def embedding_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Length and hash of the text to embed; it ends at 2,000 characters, so a change behind them doesn't show."""
    d = _documents(spark, root, "title", "source")
    t = text.embedding_text(F.col("title"), F.col("source"), F.col("text"))
    return d.select("doc_id", F.length(t).alias("chars"), scalar.content_hash(F.lit("model-a"), t).alias("hash"))


def stale_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose text changed since an earlier fetch under the same title."""
    d = _documents(spark, root, "title", "fetched_at").where("title is not null").withColumn("h", scalar.content_hash(F.lit("model-a"), F.coalesce("text", F.lit(""))))
    d = saved(relational.numbered(d.select("doc_id", "title", "fetched_at", "h"), ["title"], [F.asc("fetched_at"), F.asc("doc_id")]), "fetches")
    before = d.select("title", (F.col("place") + 1).alias("place"), F.col("h").alias("before"))
    return d.join(before, ["title", "place"]).where("before <> h").select("doc_id")


def unique_slugs(spark: SparkSession, root: str) -> DataFrame:
    """A slug of every title, later ones of the same slug numbered -2, -3, ..."""
    d = table(spark, root, "documents", "doc_id", "title").where("title is not null").withColumn("base", text.slug(F.col("title")))
    k = F.col("k")
    return relational.numbered(d, ["base"], [F.asc("doc_id")], "k").select("doc_id", F.when(k > 1, F.concat("base", F.lit("-"), k)).otherwise(F.col("base")).alias("slug"))


def headings(spark: SparkSession, root: str) -> DataFrame:
    """Lines that look like headings, per document."""
    lines = _documents(spark, root).select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line"))
    return lines.where(text.looks_like_heading(F.regexp_replace("line", "^#+", ""))).groupBy("doc_id").agg(F.count("*").alias("n"))


def escaped_titles(spark: SparkSession, root: str) -> DataFrame:
    """Titles escaped for markup, tags stripped from the text."""
    d = _documents(spark, root, "title")
    return d.select("doc_id", scalar.escape_html(F.col("title")).alias("escaped"), F.length(text.strip_tags(F.col("text"))).alias("untagged"))


def line_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Lines, depth and branches of each text, and whether it is minified."""
    t = F.col("text")
    return _documents(spark, root).select("doc_id", text.code_lines(t).alias("loc"), text.max_indent(t).alias("depth"), text.branches(t).alias("branches"), text.minified(t).alias("minified"))


def duplicated_windows(spark: SparkSession, root: str, lines: int = 6, least: int = 60) -> DataFrame:
    """Runs of six lines that stand in two documents or more, with the number of documents.

    Windows are built inside each document's own array of lines, so no sort or shuffle is needed to
    see neighbouring lines; only their hashes are counted.
    """
    norm = F.filter(F.transform(F.split("text", "\r?\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & ~x.rlike(r"^[)}\];,]+$"))
    d = _documents(spark, root).select("doc_id", norm.alias("l")).where(F.size("l") >= lines)
    windows = F.transform(F.sequence(F.lit(1), F.size("l") - lines + 1), lambda i: F.array_join(F.slice("l", i, lines), "\n"))
    w = d.select("doc_id", F.explode(windows).alias("w")).where(F.length("w") >= least)
    return w.groupBy(F.md5("w").alias("window")).agg(F.count_distinct("doc_id").alias("documents")).where("documents >= 2")


def shared_value_suppression(spark: SparkSession, root: str) -> DataFrame:
    """F8, I8: configured values that look real and stand in fewer than three records, whatever the order.

    Values are hashes of what happened in an hour; the first pass counts the users that share a
    value, the second judges it.
    """
    e = table(spark, root, "events", "user_id", "event_type", "ts").select("user_id", F.sha1(F.concat("event_type", F.date_format("ts", "yyyy-MM-dd HH"))).alias("value"))
    shared = e.groupBy("value").agg(F.count_distinct("user_id").alias("shared"))
    return shared.where(text.looks_real(F.col("value"), F.col("shared")))


def links_of_titles(spark: SparkSession, root: str) -> DataFrame:
    """A Markdown list per repository of the titles of its first five documents; ``title_blocks`` lists all."""
    d = table(spark, root, "documents", "doc_id", "repo_id", "title").where("repo_id is not null and title is not null")
    firsts = d.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy("doc_id"))).where("k <= 5")
    lines = firsts.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "title"))).alias("t"))
    return lines.select("repo_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("markdown"))


def title_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Markdown lists of all titles of each repository's documents, in order, in numbered blocks of 100.

    Places are counted within ranges, so no repository's titles have to meet in one task.
    """
    d = table(spark, root, "documents", "doc_id", "repo_id", "title").where("repo_id is not null and title is not null")
    placed = relational.numbered(d, ["repo_id"], [F.asc("doc_id")], "k").withColumn("block", F.expr("(k - 1) div 100"))
    blocks = placed.groupBy("repo_id", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "title"))).alias("t"))
    return blocks.select("repo_id", "block", F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("markdown"))


def cached_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings written once and read for two lookups; here, tokens by their share of documents."""
    p = saved(postings(spark, root), "postings")
    n = table(spark, root, "documents", "doc_id").count()
    return p.groupBy("token").agg(F.count("*").alias("df")).groupBy(F.floor(F.col("df") * 10 / n).alias("tenth")).agg(F.count("*").alias("tokens"))


def refreshed_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings of which only the later half of the texts were read anew; before, those had their titles for text."""
    d = saved(_documents(spark, root, "title", "fetched_at"), "texts")
    cut = d.agg(F.percentile_approx("fetched_at", 0.5)).first()[0]
    later = F.coalesce(F.col("fetched_at") > F.lit(cut), F.lit(False))
    old = text.token_rows(d.select("doc_id", F.when(later, F.col("title")).otherwise(F.col("text")).alias("text")), "doc_id", F.col("text"))
    return text.refreshed_postings(old, d.where(later).select("doc_id", "text"), "doc_id", F.col("text")).groupBy("doc_id").agg(F.count("*").alias("tokens"))


_TOK = text.SQL_TOKENS.format(c="text")
_POST = f"post AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS token FROM documents)"
_PLAIN = "text"
for _p, _k in text.MARKDOWN:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', '{_k.replace('$1', chr(92) + '1')}', 'g')"
_CLEAN = "regexp_replace(coalesce(text, ''), '^[\\s\\x{A0}\\x{FEFF}]+|[\\s\\x{A0}\\x{FEFF}]+$', '', 'g')"
_END = text.CLEAN_END.replace("'", "''")
_TRUNC = f"({_CLEAN} <> '' AND NOT regexp_matches({_CLEAN}, '{_END}'))"
_REASON = "|".join(text.REASONING).replace("'", "''")
_FILL = " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in text.FILLER)
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w : w <> ''))"
_EMB = "left(array_to_string(list_filter([title, source, text], lambda p : p IS NOT NULL AND trim(p, ' ') <> ''), '. '), 2000)"
_SLUG = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_LINES = "regexp_split_to_array(text, '\\n')"

_FENCED = "regexp_extract(a, '(?is)^`{3,}\\s*(?:markdown|md)?\\s*\\n(.*?)\\n`{3,}\\s*$', 1)"
_ARTICLE = (
    "WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\\r\\n?', chr(10), 'g'), ' ') AS a FROM documents WHERE source = 'article' AND text IS NOT NULL), "
    f"b AS (SELECT doc_id, trim(CASE WHEN regexp_matches(a, '(?is)^`{{3,}}\\s*(?:markdown|md)?\\s*\\n(.*?)\\n`{{3,}}\\s*$') THEN {_FENCED} ELSE a END, ' ') AS b FROM a), "
    "c AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(b, '(?m)^\\s*`{3,}')) % 2 = 1 THEN b || chr(10) || '```' ELSE b END AS c FROM b) "
    "SELECT doc_id, md5(trim(regexp_replace(c, '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM c"
)

QUERIES = {
    f.__name__: f
    for f in (
        inverted_index_df, token_search, posting_intersect, token_totals, truncated_text, reasoning_leak, fallback_gate, text_entropy, plain_text, cleaned_articles, read_times, embedding_inputs,
        stale_embeddings, unique_slugs, headings, escaped_titles, line_metrics, duplicated_windows, shared_value_suppression, links_of_titles, title_blocks, cached_postings, refreshed_postings,
    )
}
SQL = {
    "shared_value_suppression": "WITH v AS (SELECT sha1(event_type || strftime(ts, '%Y-%m-%d %H')) AS value, count(DISTINCT user_id) AS shared FROM events GROUP BY 1), c AS (SELECT value, unnest(string_split(value, '')) AS c FROM v), e AS (SELECT value, -sum(n / 40.0 * log2(n / 40.0)) AS h FROM (SELECT value, c, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1) SELECT value, shared FROM v JOIN e USING (value) WHERE h >= 3.5 AND shared < 3",
    "inverted_index_df": f"WITH {_POST} SELECT token, count(*) AS df FROM post GROUP BY 1 HAVING count(*) <= 0.4 * (SELECT count(*) FROM documents)",
    "token_search": f"WITH {_POST} SELECT doc_id, count(*) AS hits FROM post WHERE token IN ('lockfile', 'parser', 'workflow', 'audit', 'plugin') GROUP BY 1 HAVING count(*) >= 2",
    "posting_intersect": f"WITH {_POST} SELECT doc_id FROM post WHERE token IN ('cache', 'manifest', 'nightly') GROUP BY 1 HAVING count(*) = 3",
    "token_totals": f"SELECT doc_id, len({_TOK}) AS tokens, len(list_distinct({_TOK})) AS distinct_tokens FROM documents",
    "truncated_text": f"SELECT doc_id FROM documents WHERE {_TRUNC}",
    "reasoning_leak": f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{_REASON}')",
    "fallback_gate": f"SELECT source, (text IS NULL OR length(text) < 400 OR {_TRUNC} OR {_FILL}) AS fallback, count(*) AS n FROM documents GROUP BY 1, 2",
    "text_entropy": "WITH c AS (SELECT doc_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, unnest(string_split(title, '')) AS c FROM documents WHERE title IS NOT NULL) GROUP BY 1, 2) SELECT doc_id, floor(-sum(n / t * log2(n / t)) * 1000000.0 + 0.5) / 1000000.0 AS bits FROM c GROUP BY 1",
    "plain_text": f"SELECT doc_id, length(p) AS plain_chars, md5(p) AS plain FROM (SELECT doc_id, trim({_PLAIN}, ' ') AS p FROM documents WHERE text IS NOT NULL)",
    "cleaned_articles": _ARTICLE,
    "read_times": f"SELECT greatest(2, CAST(ceil({_WORDS} / 200) AS INT)) AS minutes, count(*) AS n FROM documents GROUP BY 1",
    "embedding_inputs": f"SELECT doc_id, length({_EMB}) AS chars, left(sha1('model-a' || chr(10) || {_EMB}), 16) AS hash FROM documents",
    "stale_embeddings": "WITH h AS (SELECT doc_id, coalesce(text, '') AS t, lag(coalesce(text, '')) OVER (PARTITION BY title ORDER BY fetched_at, doc_id) AS b FROM documents WHERE title IS NOT NULL) SELECT doc_id FROM h WHERE b IS NOT NULL AND b <> t",
    "unique_slugs": f"WITH s AS (SELECT doc_id, {_SLUG} AS base FROM documents WHERE title IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS k FROM s) SELECT doc_id, CASE WHEN k > 1 THEN base || '-' || k ELSE base END AS slug FROM k",
    "headings": "WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '\\r?\\n')), '^#+', ''), ' ') AS t FROM documents) SELECT doc_id, count(*) AS n FROM l WHERE length(t) BETWEEN 1 AND 60 AND len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f]+'), lambda w : w <> '')) <= 8 AND NOT regexp_matches(t, '[.!?,;]$') GROUP BY 1",
    "escaped_titles": "SELECT doc_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, length(regexp_replace(text, '<[^>]*>', '', 'g')) AS untagged FROM documents",
    "line_metrics": f"SELECT doc_id, len(list_filter({_LINES}, lambda x : trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\\s*(#|//|\\*)'))) AS loc, coalesce(list_max(list_transform(list_filter({_LINES}, lambda x : trim(x, ' ') <> ''), lambda x : CAST(floor(length(replace(regexp_extract(x, '^([ \\t]*)', 1), chr(9), '    ')) / 4) AS INT))), 0) AS depth, len(regexp_extract_all(text, '{text.BRANCH}')) AS branches, NOT (list_max(list_transform(regexp_split_to_array(left(text, 200000), '\\n'), lambda x : length(x))) < 2500) AS minified FROM documents",
    "duplicated_windows": "WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x : trim(x, ' ')), lambda x : length(x) > 3 AND NOT regexp_matches(x, '^[)}\\];,]+$')) AS l FROM documents), w AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 4), lambda i : array_to_string(l[i : i + 5], chr(10)))) AS w FROM d WHERE len(l) >= 6) SELECT md5(w) AS \"window\", count(DISTINCT doc_id) AS documents FROM w WHERE length(w) >= 60 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2",
    "links_of_titles": "WITH f AS (SELECT repo_id, doc_id, title, row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) AS k FROM documents WHERE repo_id IS NOT NULL AND title IS NOT NULL) SELECT repo_id, string_agg('- ' || title, chr(10) ORDER BY doc_id) AS markdown FROM f WHERE k <= 5 GROUP BY 1",
    "title_blocks": "WITH f AS (SELECT repo_id, doc_id, title, (row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) - 1) // 100 AS block FROM documents WHERE repo_id IS NOT NULL AND title IS NOT NULL) SELECT repo_id, block, string_agg('- ' || title, chr(10) ORDER BY doc_id) AS markdown FROM f GROUP BY 1, 2",
    "refreshed_postings": f"WITH {_POST} SELECT doc_id, count(*) AS tokens FROM post GROUP BY 1",
    "cached_postings": f"WITH {_POST}, f AS (SELECT token, count(*) AS df FROM post GROUP BY 1) SELECT CAST(floor(df * 10 / (SELECT count(*) FROM documents)) AS BIGINT) AS tenth, count(*) AS tokens FROM f GROUP BY 1",
}
