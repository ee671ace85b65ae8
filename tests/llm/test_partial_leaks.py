"""Passages copied from long benchmark items."""

from itertools import combinations

import numpy as np

from ringflow.llm import decontaminate as D


def text(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def test_passage_of_a_long_item_leaks(spark):
    item = text("i", 500)
    docs = [
        (1, text("a", 30) + item[100:390] + text("b", 30)),  # 58 % of the item, word for word
        (2, text("c", 30) + item[40:53] + text("d", 30)),
        (3, text("e", 30) + item[60:64] + ["x"] + item[65:69] + ["y"] + item[70:73] + text("f", 30)),
        (4, text("g", 30) + item[40:50] + text("h", 30)),  # too short
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["start"], r["end"], r["agreed"]) for r in D.find_leaks(docs, bench).collect()}
    assert got.keys() == {1, 2, 3}
    assert got[2] == (28, 45, 13) and got[3] == (30, 43, 11)  # two disagreeing tokens may stand at either end
    assert got[1] == (28, 322, 290)
    assert {r["doc_id"] for r in D.drop_leaks(docs, bench).collect()} == {4}


def test_some_seed_fits_every_passage():
    for gone in combinations(range(D.PASSAGE), D.PASSAGE - D.PASSAGE_AGREED):
        same = np.ones(D.PASSAGE, bool)
        same[list(gone)] = False
        assert any(all(same[p + k] for k, bit in enumerate(s) if bit == "1") for s in D.SEEDS for p in range(D.PASSAGE - len(s) + 1)), gone
