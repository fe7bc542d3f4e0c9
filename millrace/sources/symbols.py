"""Symbols, calls and effects from source files.

Python is parsed; other languages have no parser here and are read by patterns of their declarations and
calls, marked ``partial``. A file that can't be parsed gives its pattern reading, also marked.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import effect, extension

#: Declarations by extension: pattern of functions, of classes (fixed values).
_JS = (r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)", r"\bclass\s+([A-Za-z_$][\w$]*)")
DECLARED = {
    "js": _JS, "jsx": _JS, "mjs": _JS, "cjs": _JS, "ts": _JS, "tsx": _JS,
    "go": (r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"(?m)^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"),
    "rs": (r"\bfn\s+([a-z_]\w*)", r"\b(?:struct|enum|trait)\s+([A-Z]\w*)"),
    "py": (r"(?m)^\s*(?:async\s+)?def\s+(\w+)", r"(?m)^\s*class\s+(\w+)"),
}
_CALL = re.compile(r"(?<![\w$])((?:[A-Za-z_$][\w$]*\s*\.\s*)*)([A-Za-z_$][\w$]*)\s*\(")
_KEYWORDS = set("if for while switch catch return function fn func match def class with assert print new await yield typeof in and or not elif except".split())

Row = tuple[str, str, str, str, int]  # what, name or caller, kind or callee, receiver text, line


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "?")
    return ".".join(reversed(parts))


def _python(text: str) -> Iterator[Row]:
    def walk(node: ast.AST, owner: str) -> Iterator[Row]:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = child.name
                yield "symbol", child.name, "function", "", child.lineno
            elif isinstance(child, ast.ClassDef):
                yield "symbol", child.name, "class", "", child.lineno
            elif isinstance(child, ast.Call):
                full = _dotted(child.func)
                yield "call", owner, full.rpartition(".")[2], full, child.lineno
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield "import", a.name, "", "", child.lineno
            elif isinstance(child, ast.ImportFrom) and child.module:
                yield "import", child.module, "", "", child.lineno
            yield from walk(child, inner)

    yield from walk(ast.parse(text), "<module>")


def _by_pattern(text: str, kind: str) -> Iterator[Row]:
    functions, classes = DECLARED[kind]
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    found = [(m.start(), m.end(), next(g for g in m.groups() if g)) for m in re.finditer(functions, text)]
    for at, _, name in found:
        yield "symbol", name, "function", "", line(at)
    for m in re.finditer(classes, text):
        yield "symbol", m[1], "class", "", line(m.start())
    declared = {end for _, end, _ in found}
    owner, rest = "<module>", iter([*found, (len(text) + 1, 0, "")])
    nxt = next(rest)
    for m in _CALL.finditer(text):
        while m.start() >= nxt[0]:
            owner, nxt = nxt[2], next(rest)
        if m[2] in _KEYWORDS or m.end(2) in declared:
            continue
        yield "call", owner, m[2], re.sub(r"\s", "", m[1]) + m[2], line(m.start())


def read_symbols(path: str, text: str | None) -> tuple[list[Row], bool]:
    """What a file declares, calls and imports, and whether it was read by patterns only."""
    kind = path.rpartition(".")[2].lower()
    if not text or kind not in DECLARED:
        return [], False
    if kind == "py":
        try:
            return list(_python(text)), False
        except (SyntaxError, ValueError, RecursionError):
            pass
    return list(_by_pattern(text, kind)), True


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, rows, partial = [], [], []
        for i, (p, t) in enumerate(zip(b.column("path").to_pylist(), b.column("text").to_pylist())):
            found, by_pattern = read_symbols(p or "", t)
            at += [i] * len(found)
            rows += found
            partial += [by_pattern] * len(found)
        take = pa.array(at, pa.int64())
        columns = [pa.array([r[i] for r in rows], pa.int32() if i == 4 else pa.string()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([b.column("repo_id").take(take), b.column("path").take(take), *columns, pa.array(partial, pa.bool_())], names=["repo_id", "path", "what", "a", "b", "text", "line", "partial"])


def source_facts(files: DataFrame) -> DataFrame:
    """``repo_id, path, what, a, b, text, line, partial`` of all readable source files, one pass."""
    wanted = files.where(extension(F.col("path")).isin(*DECLARED)).select("repo_id", "path", "text")
    return wanted.mapInArrow(_run, f"repo_id {dict(files.dtypes)['repo_id']}, path string, what string, a string, b string, text string, line int, partial boolean")


def symbols(facts: DataFrame) -> DataFrame:
    """``repo_id, n, k, f, l, partial``: declared functions and classes."""
    return facts.where("what = 'symbol'").select("repo_id", F.col("a").alias("n"), F.col("b").alias("k"), F.col("path").alias("f"), F.col("line").alias("l"), "partial")


def call_edges(facts: DataFrame, most: int = 6000) -> DataFrame:
    """``repo_id, src, dst, n``: calls of functions the repository declares, the busiest ``most`` of each."""
    from pyspark.sql import Window

    own = symbols(facts).select("repo_id", F.col("n").alias("b")).distinct()
    n = facts.where("what = 'call'").join(own, ["repo_id", "b"], "left_semi").groupBy("repo_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "src", "dst"))
    return n.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def effects(facts: DataFrame) -> DataFrame:
    """``repo_id, fn, kind, example``: effects of declared functions and of modules, the first example of each."""
    own = symbols(facts).select("repo_id", F.col("n").alias("a")).distinct()
    calls = facts.where("what = 'call'").withColumn("kind", effect(F.col("text"))).where("kind is not null")
    named = calls.join(own, ["repo_id", "a"], "left_semi").unionByName(calls.where("a = '<module>'").select("repo_id", "a", *[c for c in calls.columns if c not in ("repo_id", "a")]))
    return named.groupBy("repo_id", F.col("a").alias("fn"), "kind").agg(F.min_by("text", F.struct("path", "line")).alias("example"))


def fan_in(calls: DataFrame, most: int = 300) -> DataFrame:
    """Functions with more than one distinct caller, the ``most`` called of each repository."""
    from pyspark.sql import Window

    n = calls.groupBy("repo_id", F.col("dst").alias("name")).agg(F.count_distinct("src").alias("callers")).where("callers > 1")
    k = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("callers"), "name"))
    return n.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def effect_totals(found: DataFrame) -> DataFrame:
    """Functions by effect."""
    return found.groupBy("repo_id", "kind").agg(F.count("*").alias("n"))
