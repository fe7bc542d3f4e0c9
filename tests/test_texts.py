from millrace.plans import texts


def test_title_blocks_list_every_title(spark, tmp_path):
    ids = [i * 40_000 for i in range(250)]  # over many ranges of ids
    spark.createDataFrame([(i, 1, f"t{i}") for i in ids] + [(7, 2, "one"), (8, 2, None), (9, None, "none")], "doc_id long, repo_id long, title string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["repo_id"], r["block"]): r["markdown"] for r in texts.title_blocks(spark, str(tmp_path)).collect()}
    assert got == {(1, b): "\n".join(f"- t{i}" for i in ids[b * 100 : b * 100 + 100]) for b in range(3)} | {(2, 0): "- one"}
