"""Phrases against the plain greedy parse, predictions against a plain classifier, and scripts of any size."""

import random

import pytest
from pyspark.sql import functions as F

from ringflow.llm import language_id

SF = "/root/testdata/sf0.01"


def needed(text, sample):
    """Longest matches, one after the other, by substring search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def parser_of(samples):
    return language_id.CrossParser({lang: language_id.transitions(t) for lang, t in samples.items()})


@pytest.mark.parametrize(("stretch", "passage", "lanes", "rounds"), [(1 << 22, 256, 1 << 14, 4), (700, 7, 5, 1), (64, 16, 1, 0), (1 << 20, 3, 1000, 2)])
def test_phrases_are_those_of_the_whole_text(monkeypatch, stretch, passage, lanes, rounds):
    for name, value in {"STRETCH": stretch, "PASSAGE": passage, "LANES": lanes, "ROUNDS": rounds}.items():
        monkeypatch.setattr(language_id, name, value)
    rng = random.Random(6)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": text("abc", 80), "y": "bca" * 9, "z": text("abc漢字😀", 300), "none": "", "long": "a" * 100}
    parser = parser_of(samples)
    texts = [text("abcd漢😀\x00", n) for n in (0, 1, 2, 5, 100, 257, 3000)] + ["aaaa" * 200, "bca" * 400, "", "q"]
    assert parser.phrases(texts).tolist() == [[needed(t, samples[lang]) for lang in parser.langs] for t in texts]
    assert parser.phrases([]).tolist() == []


def test_long_text():
    rng = random.Random(7)
    sample = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    t = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    runs = "a" * 999 + "b"  # never comes to a passage's own phrases
    assert parser_of({"x": sample, "y": runs}).phrases([t, runs * 50]).tolist() == [[needed(x, sample), needed(x, runs)] for x in (t, runs * 50)]


def test_predictions_are_those_of_fewest_phrases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = docs.where(~language_id.held_out(F.col("doc_id")))
    samples = language_id.training_samples(labelled)
    some = docs.where("doc_id % 25 = 0 AND length(text) < 3000")  # brute force takes long
    got = language_id.identify_languages(some, labelled).collect()
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    assert len(got) > 15
    for r in got:
        t = texts[r["doc_id"]]
        if t is None or not language_id.has_letter(t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            counts = sorted((needed(t.lower(), sample), lang) for lang, sample in samples.items())
            assert (r["lang_pred"], r["phrases"]) == (counts[0][1], counts[0][0])
            assert r["score"] == pytest.approx(1 - counts[0][0] / counts[1][0])


def test_eight_scripts(spark):
    """Alphabets of 25 to 1,500 letters, among them three that no common alphabet of 96 could hold."""
    rng = random.Random(8)
    blocks = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 25), "arabic": (0x627, 36), "devanagari": (0x905, 50), "han1": (0x4E00, 1500), "han2": (0x6000, 1500), "hangul": (0xAC00, 1500)}
    rows = []
    for lang, (first, n) in blocks.items():
        words = ["".join(chr(first + min(int(rng.expovariate(4 / n)), n - 1)) for _ in range(rng.randrange(1, 6))) for _ in range(800)]
        rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(60)), lang) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = language_id.identify_languages(docs, docs.where(~language_id.held_out(F.col("doc_id")))).where(language_id.held_out(F.col("doc_id"))).collect()
    truth = {i: lang for i, _, lang in rows}
    for lang in blocks:
        mine = [r["lang_pred"] == lang for r in got if truth[r["doc_id"]] == lang]
        assert len(mine) > 15 and sum(mine) > 0.95 * len(mine), lang


def test_samples_are_bounded(spark):
    rows = [(i, f"lang{i % 40} " * 400, f"l{i % 40:02}") for i in range(200)]
    samples = language_id.training_samples(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), all_chars=20_000)
    assert len(samples) == 40 and sum(map(len, samples.values())) <= 20_000 and min(map(len, samples.values())) > 300
