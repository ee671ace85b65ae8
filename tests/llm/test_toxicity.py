"""Gradient against differences, and the sample that a model learns from."""

import numpy as np

from ringflow.llm import toxicity


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)] + ["abusive", "abuse", "abusing"]
    texts = [". ".join(" ".join(rng.choice(words, 4)) for _ in range(rng.integers(1, 5))) for _ in range(60)]
    bags = toxicity.Bags(texts, [int("abus" in t) for t in texts])
    w, b = rng.normal(0, 0.5, len(bags.names)), -1.0
    loss, g, gb = bags.loss_and_gradient(w, b)
    assert len(w) > 10 and loss > 0
    h = 1e-6
    for k in range(len(w)):
        d = np.zeros(len(w))
        d[k] = h
        assert abs((bags.loss_and_gradient(w + d, b)[0] - bags.loss_and_gradient(w - d, b)[0]) / (2 * h) - g[k]) < 1e-6
    assert abs((bags.loss_and_gradient(w, b + h)[0] - bags.loss_and_gradient(w, b - h)[0]) / (2 * h) - gb) < 1e-6


def test_long_texts_leave_the_others_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 30_000)
    monkeypatch.setattr(toxicity, "TRAIN_TEXT_CHARS", 12_000)
    rows = [(i, "bad gromp. " * 5 if i % 3 == 0 else "good day. " * 5) for i in range(90)]
    rows += [(100, "bad " * 2_000), (101, "bad " * 400_000), (102, "good " * 1_900), (103, "good " * 400_000), (104, None), (None, "bad")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i in (100, 101) or (i < 90 and i % 3 == 0))) for i, _ in rows if i is not None] + [(None, 1), (5, None), (7, 1)], "doc_id bigint, toxic int")
    sample = toxicity.training_rows(docs, labels)
    of = lambda cls: [t for t, c in sample if c == cls]
    assert 20 < len(of(1)) and 20 < len(of(0)) and max(len(t) for t, _ in sample) <= 12_000
    assert "good day. " * 5 in of(1)  # 7 is labelled both ways
    assert toxicity.train(docs, labels).score("a bad gromp.")[0] > 0.3
