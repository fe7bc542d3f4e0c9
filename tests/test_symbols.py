import pytest

from millrace.sources import symbols as S


@pytest.mark.parametrize(
    "path, text, functions, classes, calls, partial",
    [
        ("a.py", "import os.path\nclass A:\n    def f(self):\n        self.db.execute(1)\ndef g():\n    f()\ng()\n", {"f", "g"}, {"A"}, {("f", "execute"), ("g", "f"), ("<module>", "g")}, False),
        ("a.py", "def broken(:\n  x()\n", {"broken"}, set(), {("broken", "x")}, True),
        ("a.ts", "class B {}\nfunction h(a) { return k(a); }\nconst k = (x) => x;\nh(1)", {"h", "k"}, {"B"}, {("h", "k"), ("k", "h")}, True),
        ("a.go", "type T struct {}\nfunc (t T) Run() {\n\tdb.Query(x)\n}\n", {"Run"}, {"T"}, {("Run", "Query")}, True),
        ("a.rs", "struct P;\nfn go_on() { if (x) { step(1) } }", {"go_on"}, {"P"}, {("go_on", "step")}, True),
        ("a.txt", "f()", set(), set(), set(), False), ("a.py", None, set(), set(), set(), False),
    ],
)
def test_languages(path, text, functions, classes, calls, partial):
    rows, by_pattern = S.read_symbols(path, text)
    assert {r[1] for r in rows if r[0] == "symbol" and r[2] == "function"} == functions
    assert {r[1] for r in rows if r[0] == "symbol" and r[2] == "class"} == classes
    assert {(r[1], r[2]) for r in rows if r[0] == "call"} == calls and by_pattern == partial


def test_tables(spark, rows):
    text = "import requests\ndef constructor():\n    requests.get('u')\ndef a():\n    constructor()\n    constructor()\ndef b():\n    constructor()\nopen('x')\n"
    facts = S.source_facts(spark.createDataFrame([(1, "m.py", text, 0), (1, "x.md", "f()", 0), (2, "e.py", None, 0)], "repo_id long, path string, text string, line int")).cache()
    calls = S.call_edges(facts)
    assert rows(calls) == [(1, "a", "constructor", 2), (1, "b", "constructor", 1)]
    assert rows(S.fan_in(calls)) == [(1, "constructor", 2)]
    assert rows(S.effects(facts), "fn", "kind", "example") == [("<module>", "filesystem", "open"), ("constructor", "network", "requests.get")]
    assert rows(S.effect_totals(S.effects(facts))) == [(1, "filesystem", 1), (1, "network", 1)]
