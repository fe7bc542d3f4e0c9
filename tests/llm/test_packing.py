import os

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm.packing import VOCABULARIES, VOCABULARY, TokenCounter, fill_report, first_fit_decreasing, pack_texts, text_lengths

PATH = f"{VOCABULARIES}/{VOCABULARY}"
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


def plain_ffd(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return out


@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_is_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert first_fit_decreasing(np.array(sizes, np.int64), 50).tolist() == plain_ffd(sizes, 50)


@needs
def test_counts_equal_the_tokenizer(spark):
    c = TokenCounter(PATH, most=50)
    texts = ["", "It's 12  tests.\n\n\tDon't! ", "Größe – ｅｉｎ​Ｔext\xa0x", "a" * 5000, "速い 茶色 🙂🙂", "x y\u0085z  \n", "'s 'S ''ll"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts * 2:
        assert c.count(t) == len(c.encoding.encode_ordinary(t))


def lengths(spark, n, extra=()):
    return spark.createDataFrame([*enumerate(n), *extra], "doc long, n_tokens long")


def budgets(spark, *rows):
    return spark.createDataFrame(list(rows), "budget_id string, cap long, res long")


def test_every_token_is_in_one_context_and_nothing_overflows(spark):
    n = [0, 5, 99, 100, 101, 250, 1000, *range(1, 90)]
    out = pack_texts(lengths(spark, n, [(3, 100), (3, 100)]), budgets(spark, ("a", 110, 10), ("b", 64, None), ("c", 5, 5), ("d", None, None)), "budget_id", "cap", "res", group_items=30).collect()
    for budget, room in (("a", 100), ("b", 64)):
        mine = [r for r in out if r["budget"] == budget]
        assert all(r["room"] == room for r in mine)
        used = {}
        for r in mine:
            if r["context_no"] is None:
                assert r["token_start"] == r["token_end"] == 0
                continue
            assert r["token_end"] - r["token_start"] <= room
            k = (r["context_group"], r["context_no"])
            used[k] = used.get(k, 0) + r["token_end"] - r["token_start"]
        assert max(used.values()) <= room
        for i, x in enumerate(n):
            parts = sorted((r["token_start"], r["token_end"]) for r in mine if r["doc"] == i)
            if i == 3:
                assert sum(b - a for a, b in parts) == 300  # two more rows of the same document
                continue
            assert parts[0][0] == 0 and parts[-1][1] == x and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
            assert len(parts) == max(1, -(-x // room))
    assert {r["budget"] for r in out} == {"a", "b"}


def test_little_room_is_left_over(spark):
    rng = np.random.default_rng(1)
    packed = pack_texts(lengths(spark, rng.integers(1, 900, 4000).tolist()), budgets(spark, ("a", 1000, 0)), "budget_id", "cap", "res", group_items=1000)
    assert fill_report(packed).first()["filled"] > 0.97


@needs
def test_null_empty_long_and_no_texts(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "word " * 50_000, 9)], "id long, body string, doc int")
    got = {r["doc"]: r["n_tokens"] for r in text_lengths(docs, "id", "body").collect()}
    assert got[1] == got[2] == 0 and got[3] >= 50_000
    assert text_lengths(docs.limit(0), "id", "body").count() == 0
    assert pack_texts(lengths(spark, []), budgets(spark, ("a", 10, 0)), "budget_id", "cap", "res").count() == 0
    assert pack_texts(lengths(spark, [1]), budgets(spark), "budget_id", "cap", "res").count() == 0


def test_contexts_do_not_depend_on_the_split_of_the_table(spark, rows):
    n = [(i % 40, 10 + i % 90) for i in range(400)] + [(7, 500)] * 3
    pack = lambda parts: rows(pack_texts(spark.createDataFrame(n, "doc long, n_tokens long").repartition(parts), budgets(spark, ("a", 100, None)), "budget_id", "cap", group_items=50))
    assert pack(1) == pack(7)
