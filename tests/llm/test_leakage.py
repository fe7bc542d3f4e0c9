import random
import re
import unicodedata

import pytest

from millrace.llm.leakage import leaked_items


def plain_words(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", t)


def brute(docs, items, n=13):
    shingles = lambda t: {tuple(w[i : i + n]) for w in [plain_words(t or "")] for i in range(len(w) - n + 1)}
    of = [(i, shingles(p) | set(), shingles(q)) for i, p, q in items]
    out = set()
    for d, t in docs:
        s = shingles(t)
        out |= {(d, i) for i, p, q in of if s & p or s & q}
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "Delta", "eps", "zeta", "ＥＴＡ", "it­s", "x1"])
    text = lambda n: " ".join(word() + rng.choice(["", ",", ".\n", " –"]) for _ in range(n))
    items = [(100 + i, text(rng.randrange(5, 60)), rng.choice([None, "", text(rng.randrange(5, 30))])) for i in range(25)]
    docs = []
    for d in range(60):
        t = text(rng.randrange(0, 80))
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            k = rng.randrange(max(1, len(w) - 18))
            t += " ... " + "  ".join(w[k : k + rng.choice([11, 13, 15, 18, 40])]).upper() + " " + text(5)
        docs.append((d, t))
    return docs + [(900, None), (901, ""), (902, "alpha " * 20_000)], items + [(1, None, None), (2, "alpha " * 13, "too short"), (100, items[0][1], items[0][2])]


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_matches_brute_force(spark, rows, broadcast_words):
    docs, items = made(4)
    d = spark.createDataFrame([(*x, "t", 1) for x in docs], "doc_id long, text string, item string, doc int")
    i = spark.createDataFrame(items, "item_id long, passage string, question string")
    got = rows(leaked_items(d, i, "doc_id", "text", "item_id", ["passage", "question"], broadcast_words=broadcast_words), "doc_id", "item_id")
    want = brute(docs, items)
    assert sorted(got) == want and len(want) > 10


def test_guarantee_and_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, passage string, question string")
    assert leaked_items(d, i, "doc_id", "text", "item_id", ["passage", "question"]).count() == 0
    assert leaked_items(d.limit(0), i, "doc_id", "text", "item_id", ["passage"]).count() == 0
    with pytest.raises(ValueError):
        leaked_items(d, i, "doc_id", "text", "item_id", ["passage"], least=12)


def test_all_documents_of_the_smallest_tables(spark, rows):
    root = "/root/testdata/sf0.001"
    d, i = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/eval_item.parquet")
    got = rows(leaked_items(d, i, "doc_id", "text", "item_id", ["passage", "question"]), "doc_id", "item_id")
    docs = [tuple(r) for r in d.select("doc_id", "text").collect()]
    items = [tuple(r) for r in i.select("item_id", "passage", "question").collect()]
    assert sorted(got) == brute(docs, items)
