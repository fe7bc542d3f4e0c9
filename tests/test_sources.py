import json

import pytest

from millrace.operators.relational import latest_wins
from millrace.sources import readers, sinks
from millrace.sources.manifests import manifest_packages, parse_manifest
from millrace.streaming.incremental import file_stream, shared_values, upsert_stream


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("package.json", '{"dependencies": {"A": "^1", "b": "1"}, "devDependencies": {"b": "2", "c": {"x": 1}}}', [("a", "^1"), ("b", "2"), ("c", None)]),
        ("requirements-dev.txt", "# x\nFlask==2.0 # y\nuvicorn[standard] >=0.2,<1\n-r a.txt\ngit+https://x\nplain\n", [("flask", "==2.0"), ("uvicorn", ">=0.2,<1"), ("plain", None)]),
        ("a/pyproject.toml", '[build-system]\nbuild-backend = "x"\n[project]\ndependencies = ["pydantic[email]==2.6.1", "rich"]\n[project.optional-dependencies]\nt = ["pytest>=7"]\n[tool.poetry.dependencies]\npython = "^3"\nhttpx = {version = "0.2", extras = ["x"]}\n', [("pydantic", "==2.6.1"), ("rich", None), ("pytest", ">=7"), ("httpx", "0.2")]),
        ("go.mod", "module x\nrequire (\n\tgithub.com/Mast/Sem v3.2.0\n\t// github.com/no v1\n)\nrequire a.b/c v1.0.0\n", [("github.com/Mast/Sem", "v3.2.0"), ("a.b/c", "v1.0.0")]),
        ("Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1.36", features = ["full"] }\n[dev-dependencies]\nlocal = { path = "../x" }\n', [("serde", "1.0"), ("tokio", "1.36"), ("local", None)]),
        ("composer.json", '{"require": {"php": ">=8", "ext-json": "*", "a/b": "^2"}}', [("a/b", "^2")]),
        ("pubspec.yaml", "name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0.0\n  path:\ndev_dependencies:\n  lints: '2.0'\nother: 1\n", [("http", "^1.0.0"), ("path", None), ("lints", "2.0")]),
        ("Gemfile", "gem 'rails', '~> 7.0'\ngem \"pg\", require: false\n", [("rails", "~> 7.0"), ("pg", None)]),
        ("app/build.gradle.kts", 'implementation("com.a:Lib:1.2")\napi("g:x")', [("Lib", "1.2"), ("x", None)]),
        ("package.json", "{broken", []), ("package-lock.json", '{"dependencies": {"a": "1"}}', []), ("package.json", None, []), ("package.json", "[1]", []), ("requirements.txt", "3.11\n" + "x" * 70, []),
    ],
)
def test_manifests(path, text, want):
    assert parse_manifest(path, text) == want


def test_manifest_table(spark, rows):
    df = spark.createDataFrame([(1, "package.json", '{"dependencies": {"a": "1"}}', 0), (1, "x.py", "a", 0), (2, "go.mod", None, 0)], "repo_id long, path string, text string, name int")
    assert rows(manifest_packages(df)) == [(1, "package.json", "a", "1")]


def test_json_sources(spark, tmp_path):
    assert readers.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "12.deep.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "13.json").write_text(json.dumps({"a": 2}))
    assert [tuple(r) for r in readers.shards(spark, str(tmp_path), "a int", "*.deep.json").select("id", "a").collect()] == [(12, 1)]
    (tmp_path / "m.txt").write_text(json.dumps({"7": {"x": 1}, "8": {"x": None}}))
    assert sorted(tuple(r) for r in readers.keyed_json(spark, str(tmp_path / "m.txt"), "struct<x:int>").collect()) == [(7, 1), (8, None)]


def test_trees_and_fallbacks(spark, tmp_path, rows):
    for p in ("5/src/a.py", "5/node_modules/b.js", "6/c.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("xx")
    tree = readers.file_tree(spark, str(tmp_path), r"/(5|6)/")
    assert rows(readers.walkable(tree), "repo_id", "path", "size") == [(5, "src/a.py", 2), (6, "c.py", 2)]
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id int, v string")
    assert rows(readers.first_source([a, b], "id")) == [(1, "x"), (2, "z")]
    t = spark.createDataFrame([([[1.0, 2.0, 0.5]],)], "t array<array<double>>")
    assert rows(readers.decoded_edges(t, "t")) == [(1, 2, 0.5)]


def test_write_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, v string, generated int")
    assert sinks.write_if_changed(df, path, ["generated"])
    assert not sinks.write_if_changed(df.selectExpr("id", "v", "11 as generated").orderBy("v"), path, ["generated"])
    assert sinks.write_if_changed(df.where("id = 1"), path, ["generated"]) and sinks.committed(spark, path).count() == 1
    changed = sinks.changed_rows(spark.createDataFrame([(1, "a", 1), (2, "c", 1), (3, None, 1)], "id int, v string, generated int"), df, ["id"], ["generated"])
    assert sorted(r["id"] for r in changed.collect()) == [2, 3]


def test_buckets_checks_and_migrations(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(1000).withColumnRenamed("id", "k")
    sinks.write_by_bucket(df, path, "k", 8)
    assert sinks.read_key(spark, path, "k", 77, 8).count() == 1
    with pytest.raises(ValueError, match="orders"):
        sinks.assert_references([("orders", spark.range(5), ["id"], spark.range(4), ["id"])])
    sinks.assert_references([("ok", spark.range(5), ["id"], spark.range(9), ["id"])])
    with pytest.raises(ValueError):
        sinks.assert_counts({"t": 3}, {"t": spark.range(4)})
    log, ran = str(tmp_path / "m"), []
    assert sinks.migrate(spark, log, [(2, "b"), (1, "a")], ran.append) == [1, 2] and ran == ["a", "b"]
    assert sinks.migrate(spark, log, [(1, "a"), (2, "b"), (3, "c")], ran.append) == [3]
    with pytest.raises(ValueError):
        sinks.migrate(spark, log, [(0, "z")], ran.append)


def test_streamed_upsert_is_exact_over_runs(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ver int, v string")
    first.write.parquet(src)
    run = lambda: upsert_stream(file_stream(spark, src, first.schema), out, ["k"], ["ver"], check).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], "k int, ver int, v string").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(tuple(r) for r in sinks.committed(spark, out).collect()) == [(1, 2, "c"), (2, 1, "b")]


def test_shared_values_stream(spark, tmp_path):
    src = str(tmp_path / "v")
    spark.createDataFrame([("k", 1), ("k", 1), ("k", 2), ("k", 3), ("j", 1)], "key string, repo_id long").coalesce(1).write.parquet(src)
    q = shared_values(file_stream(spark, src, spark.read.parquet(src).schema)).writeStream.format("memory").queryName("shared").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select key, max(shared) from shared group by 1").collect()} == {("k", 3), ("j", 1)}


def test_latest_wins(spark, rows):
    a, b = spark.createDataFrame([(1, 1, "x")], "k int, v int, s string"), spark.createDataFrame([(1, 2, None), (2, 0, "y")], "k int, v int, s string")
    assert rows(latest_wins(a, b, ["k"], ["v"])) == [(1, 2, None), (2, 0, "y")]


def test_paged_source(spark, tmp_path, rows):
    from millrace.sources.paged import PagedReader, paged_json

    for n in (1, 2):
        (tmp_path / f"p{n}.json").write_text(json.dumps([{"id": 10 * n, "name": "a", "more": 1}, {"id": 10 * n + 1}]))
    got = paged_json(spark, f"file://{tmp_path}/p{{page}}.json", 2, "id long, name string")
    assert rows(got) == [(10, "a"), (11, None), (20, "a"), (21, None)] and got.rdd.getNumPartitions() == 2
    reader = PagedReader(got.schema, {"url": f"file://{tmp_path}/none{{page}}.json", "pages": "1", "tries": "2", "wait": "0.01"})
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))
