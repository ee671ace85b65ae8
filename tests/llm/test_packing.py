"""Token ids of every code point, one packing over all shards, and what the genetic search gains."""

import random

import numpy as np
from pyspark.sql import functions as F

from ringflow.llm import packing, registry

POINTS = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]


def different(texts):
    bpe = packing.WordBpe(packing.tokenizer_path())
    whole = bpe.whole.encode_batch(texts, add_special_tokens=False)
    return [t for t, w in zip(texts, whole, strict=True) if np.frombuffer(bpe.encode(t), "<u4").tolist() != w.ids]


def test_ids_of_every_code_point():
    assert different([f"ab{c}cd {c} x{c}'s" for c in POINTS]) == []


def test_ids_of_random_texts():
    rng = random.Random(3)
    plain = [c for c in POINTS if packing._PLAIN.fullmatch(c)]
    part = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    assert different([part(plain, 12) for _ in range(20_000)]) == []
    assert different([" ".join(part(rng.choice([plain, POINTS, "abet'sd1.- "]), 8) for _ in range(3)) for _ in range(20_000)]) == []
    assert different(["a" * 50_000, "ab" * 200 + " " + "é" * 300]) == []


def test_shards_lose_no_sequence(spark):
    """As many sequences as tokens need, though the pieces lie in several shards."""
    packed = registry.op5_packing(spark, "/root/testdata/sf0.1")
    r = packed.agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens"), F.count("*").alias("pieces")).first()
    assert r["pieces"] > packing.SHARD_PIECES
    assert r["n"] == -(-r["tokens"] // packing.CAPACITY)


def test_levels_pack_every_item_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 40, 700, 1500, 4096])) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "uid long, length int"), shard_pieces=200, generations=2).join(spark.createDataFrame(rows, "uid long, length int"), "uid").collect()
    assert sorted(r["uid"] for r in got) == [i for i, _ in rows]
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_genetic_search_saves_sequences():
    """About three documents a sequence, where best fit alone does badly."""
    rng = random.Random(5)
    sizes = [rng.randrange(1000, 1900) for _ in range(1500)]
    packer = packing.Packer(sizes, packing.CAPACITY, 1)
    alone = packer.first(0.0)
    herd = packer.evolve([], 20, packing.POPULATION)
    assert len(herd[0]) < 0.96 * len(alone)
    assert packer.fitness(herd[0]) > packer.fitness(alone)
