import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar, text
from millrace.operators import extract, relational


def tree(spark, paths, repo=1):
    return spark.createDataFrame([(repo, i, p, 10) for i, p in enumerate(paths)], "repo_id long, pos int, path string, size long")


def test_census_and_signals(spark, rows):
    t = tree(spark, ["a.py", "src/b.py", "src/c.ts", "Dockerfile", ".travis.yml", ".github/workflows/x.yml", "yarn.lock", "package-lock.json"])
    r = extract.census(t).first()
    assert r["languages"]["Python"] == 2 and r["directorys"]["src"] == 2 and r["total_files"] == 8 and r["has_docker"]
    assert rows(extract.last_signal(t, extract.CI_FILES, "ci")) == [(1, "GitHub Actions")]
    assert rows(extract.last_signal(t, extract.MANAGER_FILES, "pm", True)) == [(1, "npm")]
    assert (1, "Docker", "Dockerfile") in rows(extract.technologies(t))


def test_collections(spark, rows):
    many = [f"p{i}/main.py" for i in range(4)] + ["README.md"]
    assert rows(extract.collections(tree(spark, many))) == [(1, 4)]
    assert rows(extract.collections(tree(spark, many + [f"docs/{i}.md" for i in range(9)]))) == []
    assert rows(extract.sub_projects(tree(spark, ["src/a.py", "x/readme.md"]))) == []


def test_structure_and_facts(spark, rows):
    deep = "\n".join(" " * 4 * i + "if x:" for i in range(9))
    body = "try:\n    pass\nexcept:\n    pass\nf = open('x')\n# TODO a\n# TODO b\n# FIXME c\n"
    files = spark.createDataFrame([(1, "a.py", deep), (1, "b.py", body), (1, "c.js", "try {} catch (e) { }"), (1, "min.js", "x" * 3000), (1, "n.py", None)], "repo_id long, path string, text string")
    modules = spark.createDataFrame([(1, "a.py", 30, True)], "repo_id long, path string, fan_in long, in_cycle boolean")
    f = extract.structure_findings(files, modules)
    got = {(r["path"], r["finding"]): (r["severity"], r["rank"]) for r in f.collect()}
    assert got["a.py", "deep nesting"] == ("high", scalar_rank(3, 11, 0.7)) and got["a.py", "hub module"] == ("high", 7.2) and ("a.py", "import cycle") in got
    assert {k for p, k in got if p == "b.py"} == {"broad except", "open without with", "open markers"} and ("c.js", "empty catch") in got and not any(p == "min.js" for p, _ in got)
    block = extract.fact_block(extract.finding_groups(f)).first()["facts"]
    assert block.startswith("- deep nesting x1 (high): a.py")


def scalar_rank(w, lev, rem):
    return math.floor(w * lev * rem * 100 + 0.5) / 100


def test_duplicated_blocks(spark, rows):
    same = "\n".join(f"the same long line number {i}" for i in range(7))
    files = spark.createDataFrame([(1, "a", same), (1, "b", "other\n" + same), (2, "a", same), (3, "a", None)], "repo_id long, path string, text string")
    assert rows(extract.duplicated_blocks(files)) == [(1, 2, 2)]


def test_dominant_and_readiness(spark, rows):
    c = spark.createDataFrame([(1, "x", 3), (1, "y", 3), (1, "z", 1), (2, "q", 1)], "g int, v string, n long")
    assert rows(extract.dominant(c, "g", "v", "n", 0.4)) == [(1, "x", 3 / 7), (2, "q", 1.0)]
    f = spark.createDataFrame([(True, None, True)], "a boolean, b boolean, c boolean")
    assert extract.readiness(f, ["a", "b", "c"]).first()["ready"] == 2


def value(spark, column, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "column, x, want",
    [
        (scalar.constraint, "1.2.3", ("1.2.3", True)), (scalar.constraint, "==1.0", ("1.0", True)), (scalar.constraint, "^2.1", ("2.1", False)), (scalar.constraint, ">=1,<2", ("1", False)),
        (scalar.constraint, "*", None), (scalar.constraint, "git+https://x", None), (scalar.constraint, None, None), (scalar.constraint, "v1.0-beta.1", ("1.0-beta.1", True)),
        (scalar.major, "v12.3", 12), (scalar.major, "x", None), (scalar.extension, "a/b.PY", "py"), (scalar.extension, "Makefile", ""), (scalar.top_dir, "a/b", "a"), (scalar.top_dir, "a", "(root)"),
        (scalar.ancestors, "a/b/c", ["", "a", "a/b"]), (scalar.parent_dir, "a/b/c", "a/b"), (scalar.parent_dir, "c", ""), (scalar.effect, "cursor.execute", "db"), (scalar.effect, "x.execute", None),
        (scalar.effect, "requests.get", "network"), (scalar.effect, "y" * 201 + " open", None), (scalar.import_root, "@a/b/c", "@a/b"), (scalar.import_root, "os.path", "os"), (scalar.severity, "MODERATE", "medium"),
        (text.truncated, "ends on a wor", True), (text.truncated, "It ends.", False), (text.truncated, "code\n```", False), (text.truncated, "| a |", False), (text.truncated, 'He said "x"', False), (text.truncated, "", False),
        (text.truncated, None, False), (text.reasoning_leak, "Let me draft the article", True), (text.reasoning_leak, "A parser.", False), (text.reasoning_leak, None, False), (text.fallback_article, "short.", True),
        (text.fallback_article, "x" * 500 + ".", False), (text.fallback_article, "x" * 500 + " a game-changer.", True), (text.slug, " Hello, World! ", "hello-world"), (text.read_minutes, "w " * 500, 3),
        (text.strip_markdown, "# T\n**b** [l](u) ![i](u)", "T\nb l !i"), (text.clean_article, "```markdown\nhello\n```", "hello"), (text.clean_article, "a\n```\ncode", "a\n```\ncode\n```"),
        (text.looks_real, "q9Zx7Lk2Pv8Rt4Wm6Yb1", True), (text.looks_real, "your-api-key-here", False), (text.looks_real, "aaaaaaaaaaaaaaaa", False), (text.looks_real, None, False),
        (text.tokens, "The C++ parser, v1.2 .net 42", ["c++", "parser", "v1.2", "net"]), (text.looks_like_heading, "How it works", True), (text.looks_like_heading, "It works.", False), (text.max_indent, "a\n\tb\n        c", 2),
    ],
)
def test_columns(spark, column, x, want):
    got = value(spark, column, x)
    assert (tuple(got) if isinstance(want, tuple) else got) == want


@pytest.mark.parametrize("score, letter, step", [(95.0, "A", None), (40.0, "D", ("C-", 10.0)), (39.9, "F", ("D", 0.1)), (39.8, "F", ("D", 0.2)), (None, None, None), (89.99, "A-", ("A", 0.0))])
def test_ladder(spark, score, letter, step):
    assert value(spark, scalar.letter, score, "double") == letter
    got = value(spark, scalar.next_step, score, "double")
    assert (tuple(got) if got else None) == step


def test_entropy_rounding_and_numbers(spark):
    assert value(spark, text.entropy, "aabb") == pytest.approx(1.0) and value(spark, text.entropy, "") == 0
    assert value(spark, lambda c: scalar.half_up(c, 2), 1.005, "double") == 1.0 and value(spark, scalar.round1, 0.25, "double") == 0.3
    assert [value(spark, scalar.short_number, n, "double") for n in (9999.0, 12345.0, 2.5e6)] == ["9999", "12.3K", "2.5M"]
    assert value(spark, scalar.repeat_factor, 10**9, "long") == 1.6 and value(spark, scalar.repeat_factor, None, "long") == 1.0


def test_ranked_shapes(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 9), (4, "b", 1)], "id int, g string, n long")
    assert [r["id"] for r in relational.interleave(df, "g", [F.desc("n")]).collect()] == [1, 3, 2, 4]
    assert rows(relational.within_budget(df, ["g"], [F.col("n"), F.col("id")], "n", 8), "id") == [(1,), (2,), (4,)]
    assert rows(relational.page(df, [F.asc("id")], 2, 3), "id") == [(4,)]
    assert relational.stratified(df, F.col("g"), {"a": 0.5, "b": 0.25}, 4, 1, "id").count() == 3
    assert rows(relational.nearest_rank(df, "n", [0.0, 0.5, 1.0])) == [(1, 3, 9)]
    assert rows(relational.min_max(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 2.0)], "a double, b double"), ["a", "b"])) == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_pages_reads_quota_and_charts(spark, rows):
    assert value(spark, text.noindex, '<meta name="robots" content="noindex, nofollow">') and not value(spark, text.noindex, None)
    assert value(spark, text.parsed_time, "January 5, 2026").day == 5 and value(spark, text.parsed_time, "soon") is None
    mail = [value(spark, text.parsed_time, x) for x in ("Mon, 05 Jan 2026 10:00:00 GMT", "5 Jan 2026 12:00:00 +0200", "2026-01-05T10:00:00Z")]
    assert len(set(mail)) == 1 and mail[0].hour == 10 and value(spark, text.parsed_time, None) is None
    assert value(spark, lambda c: text.accepts_language(c, "TypeScript", ["tsx"]), "TSX")
    t = tree(spark, [".github/workflows/a.yml", ".github/workflows/b.yml", "package.json", "x.txt"])
    assert rows(relational.ranked_reads(t, [(r"\.ya?ml$", 1), (r"package\.json$", 5)], 2), "path", "turn") == [(".github/workflows/a.yml", 1), ("package.json", 2)]
    a, b = spark.range(0, 10), spark.range(100, 200)
    assert [r["id"] for r in relational.quota(a, b, [F.asc("id")], 10).collect()] == [0, 1, 2, *range(100, 107)]
    e = spark.createDataFrame([(1, "a/b", "c", 3), (1, "c", "d", 1)], "g int, s string, d string, n int")
    assert extract.mermaid(e, "g", "s", "d", "n", 1).first()["chart"] == 'flowchart LR\n  a_b["a/b"] -->|3| c["c"]'
