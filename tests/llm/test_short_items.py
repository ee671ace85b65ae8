"""Benchmark items of five to eight tokens, substitutions included, against brute force; common lead-ins."""

import random
import time

from ringflow.llm import decontaminate as D


def leaks(item, doc):
    """Whether 60 % of the item's tokens agree at one shift, five at least."""
    m = len(item)
    return any(sum(0 <= s + k < len(doc) and doc[s + k] == item[k] for k in range(m)) >= max(D.MIN_RUN, D.MIN_OVERLAP * m) for s in range(-m, len(doc)))


def test_short_items_with_substitutions():
    rng = random.Random(6)
    items = [[f"{k}t{i}" for i in range(rng.randrange(5, 9))] for k in range(60)]
    docs = []
    for _ in range(300):
        copy = list(rng.choice(items))
        for at in rng.sample(range(len(copy)), rng.randrange(0, 4)):
            copy[at] = "zz"
        docs.append(["aa"] * rng.randrange(4) + copy + ["bb"] * rng.randrange(4))
    index = D.SeedIndex([(k, " ".join(x)) for k, x in enumerate(items)])
    found = {(d, k) for d, k, *_ in index.scan([" ".join(x) for x in docs], D.MIN_OVERLAP)}
    assert found == {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) if leaks(item, doc)}
    assert 100 < len(found) < 300


def test_common_lead_ins_cost_little():
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    lead = "what is the best way to"
    items = [(i, f"{lead} {words(11)}") for i in range(4000)]
    docs = [f"{lead} {words(11)}" for _ in range(48)] + [items[7][1] + " x", "a b " + items[9][1]]
    index = D.SeedIndex(items)
    began = time.time()
    assert {(d, k) for d, k, *_ in index.scan(docs, D.MIN_OVERLAP)} == {(48, 7), (49, 9)}
    assert time.time() - began < 5


def test_chunks_are_bounded_in_tokens_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(D, "CHUNK_BYTES", 400)
    rows = [(i, "\n".join(f"t{k}" for k in range(20))) for i in range(10)] + [(20 + i, "漢" * 100) for i in range(4)] + [(30, "x " * 300)]
    chunks = list(D.benchmark_chunks(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id", "text"))
    assert sorted(x for c in chunks for x in c) == sorted(rows)
    assert all(len(c) == 1 or (sum(len(D.tokens(t)) for _, t in c) <= 50 and sum(len(t.encode()) for _, t in c) <= 400) for c in chunks)
