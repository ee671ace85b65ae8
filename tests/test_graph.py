import random
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringflow.functions import ordered, tables
from ringflow.functions.ordered import lead_over, numbered, running_total
from ringflow.functions.scalars import amount_text, cents
from ringflow.operators import graph as G
from ringflow.operators import kernels as K
from ringflow.sources import edges as S
from ringflow.sources.export import write_lines
from tests import oracles


def table(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")


def random_edges(seed, n=60, m=90):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), 1) for _ in range(m)]


@pytest.mark.parametrize("kernel", [G.KERNEL_EDGES, 0])
def test_components(spark, kernel):
    edges = random_edges(1)
    found = {r["id"]: r["scc"] for r in G.scc_labels(table(spark, edges), kernel).collect()}
    assert found == oracles.scc(edges)
    assert len(set(found.values())) < len(found)


@pytest.mark.parametrize("kernel", [G.KERNEL_EDGES, 40, 0])
def test_chain_peel(spark, kernel):
    edges = random_edges(2, 60, 55)
    found = sorted((r["id"], r["parent"], r["size"]) for r in G.chain_peel(table(spark, edges), kernel).collect())
    assert found == oracles.peel(edges)
    assert max(s for *_, s in found) > 1
    assert G.chain_peel(table(spark, []), kernel).count() == 0


def test_kernels_on_random_graphs():
    for seed in range(60):
        edges = [e for e in random_edges(seed, 5 + seed % 25, 3 + seed) if e[0] != e[1]]
        if edges:
            s, d = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
            found = K.strong_components(s, d)
            assert dict(zip(found["id"].tolist(), found["scc"].tolist(), strict=True)) == oracles.scc(edges)
            found = K.peeled(s, d, np.zeros(len(s), np.int64))
            assert sorted(zip(*(found[c].tolist() for c in ("id", "parent", "size")), strict=True)) == oracles.peel(edges)
            rng = np.random.default_rng(seed)
            w = rng.integers(1, 4, len(s))
            paths = K.ShortestPaths(s, d, w)
            paths.PAIRS = [1, 50, 1 << 20][seed % 3]
            scores, _ = paths.scores(np.arange(len(paths.ids)), np.ones(len(paths.ids), np.int64))
            assert dict(zip(paths.ids.tolist(), scores.tolist(), strict=True)) == pytest.approx(oracles.betweenness(list(zip(s.tolist(), d.tolist(), w.tolist(), strict=True))))


def test_a_million_vertices_take_seconds():
    n = 1_000_000
    s = np.arange(n)
    began = time.time()
    assert set(K.strong_components(s, (s + 1) % n)["scc"].tolist()) == {0}
    assert len(K.trimmed(s[:-1], s[1:])["id"]) == 0
    assert K.peeled(s[:-1], s[1:], np.zeros(n - 1, np.int64))["size"].max() == n - 2
    assert time.time() - began < 60


def test_tree_places(spark):
    rng = random.Random(9)
    parents = {i: rng.randrange(max(0, i - 4), i) for i in range(1, 60)} | {i: i - 1 for i in range(101, 170)}
    size, expected = dict.fromkeys([*parents, 0, 100], 0), {}
    for v in size:
        depth, x = 0, v
        while x in parents:
            x, depth = parents[x], depth + 1
            size[x] += 1
        expected[v] = (x, depth)
    df = spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")
    assert {r["id"]: (r["root"], r["depth"], r["size"]) for r in G.tree_places(df).collect()} == {v: (*expected[v], size[v]) for v in size}
    assert G.tree_places(df.where("false")).count() == 0


def test_breadth_first_order(spark):
    found = {r["id"]: (r["level"], r["place"]) for r in G.breadth_first_order(table(spark, [(5, 2, 1), (2, 9, 1), (9, 7, 1), (4, 4, 1), (11, 10, 1), (7, 5, 1)])).collect()}
    assert found == {2: (0, 0), 5: (1, 1), 9: (1, 2), 7: (2, 3), 4: (0, 4), 10: (0, 5), 11: (1, 6)}


def test_columns_of_any_name_may_stand_beside(spark):
    names = ["_s", "_d", "head", "tail", "id", "last", "after", "range", "before", "amount", "bucket"]
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (7, 1)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "src bigint, dst bigint, " + ", ".join(f"{c} bigint" for c in names))
    for out in (G.trim(df), G.trim(df, 0)):
        assert out.columns == df.columns
        assert sorted(tuple(r) for r in out.collect()) == [(*r, *range(len(names))) for r in rows[:3]]
    assert G.with_onward_edges(df).columns == df.columns
    assert G.with_onward_edges(df).count() == 4
    keyed = df.withColumn("key", F.col("src") * 10 + F.col("dst"))
    led = lead_over(keyed, "key", "dst", "next")
    assert led.columns == [*keyed.columns, "next"] or set(led.columns) == {*keyed.columns, "next"}
    assert sorted((r["key"], r["next"], r["last"], r["range"]) for r in led.collect())[:2] == [(12, 3, 5, 7), (23, 1, 5, 7)]
    total = {r["key"]: r["t"] for r in running_total(keyed, "key", F.col("src"), "t").collect()}
    assert total == {12: 0, 23: 1, 31: 3, 34: 6, 71: 9}
    assert {r["key"]: r["pos"] for r in numbered(keyed, ["key"]).collect()} == {12: 1, 23: 2, 31: 3, 34: 4, 71: 5}


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 20)
    keys = [k * k * k for k in range(300)] + list(range(30_000_000, 30_000_200))  # gaps and a dense stretch
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(6)
    keys.sort()
    assert {r["k"]: r["nxt"] for r in lead_over(df, "k", "k", "nxt").collect()} == dict(zip(keys, [*keys[1:], None], strict=True))
    assert {r["k"]: r["n"] for r in running_total(df, "k", F.lit(1), "n").collect()} == {k: i for i, k in enumerate(keys)}


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(RuntimeError, match="share"):
        tables.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs:///work/"), sparkContext=SimpleNamespace(master="yarn"))
    assert tables.shared_dir(named) == "hdfs:///work"


@pytest.mark.parametrize("kernel", [G.KERNEL_EDGES, 0])
def test_trim(spark, kernel):
    live = [(a, b) for a, b, _ in random_edges(4) if a != b]
    expected = live
    while True:
        s, d = {a for a, _ in expected}, {b for _, b in expected}
        nxt = [(a, b) for a, b in expected if b in s and a in d]
        if nxt == expected:
            break
        expected = nxt
    found = sorted(tuple(r) for r in G.trim(spark.createDataFrame(live, "src bigint, dst bigint"), kernel).collect())
    assert found == sorted(expected)
    assert 0 < len(found) < len(live)
    assert G.trim(table(spark, [(1, 2, 1), (2, 3, 1)]), kernel).count() == 0


def test_order_over_ranges(spark):
    rng = random.Random(7)
    keys = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(k, k % 13) for k in keys], "k bigint, x bigint").repartition(5)
    ordered = sorted(keys)
    led = {r["k"]: r["nxt"] for r in lead_over(df, "k", "x", "nxt").collect()}
    assert led == {k: (ordered[i + 1] % 13 if i + 1 < len(ordered) else None) for i, k in enumerate(ordered)}
    total = {r["k"]: r["t"] for r in running_total(df, "k", F.col("x"), "t").collect()}
    assert total == {k: sum(j % 13 for j in ordered[:i]) for i, k in enumerate(ordered)}
    pos = {r["pos"]: (r["x"], r["k"]) for r in numbered(df, ["x", "k"]).collect()}
    assert [pos[i + 1] for i in range(len(keys))] == sorted((k % 13, k) for k in keys)
    assert running_total(df.where("k < 0"), "k", F.col("x"), "t").count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"1,2,12\r\n2,3,12.5\r\n3,1,12.34")
    got = sorted(tuple(r) for r in S.read_transfers(spark, str(tmp_path / "t.txt")).collect())
    assert got == [(1, 2, 1200), (2, 3, 1250), (3, 1, 1234)]
    assert sorted(tuple(r) for r in S.read_topology(spark, str(tmp_path / "t.txt")).collect()) == [(1, 2), (2, 3), (3, 1)]
    amounts = spark.createDataFrame([(1200,), (1250,), (1234,), (5,), (0,)], "c bigint")
    assert [r[0] for r in amounts.select(amount_text(F.col("c"))).collect()] == ["12", "12.5", "12.34", "0.05", "0"]
    (tmp_path / "w.txt").write_text("1,2,3\n2,3,0\n4294967295,1,5\n")
    assert sorted(tuple(r) for r in S.read_weighted(spark, str(tmp_path / "w.txt")).collect()) == [(1, 2, 3), (4294967295, 1, 5)]
    (tmp_path / "bad.txt").write_text("1,x,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_weighted(spark, str(tmp_path / "bad.txt")).collect()
    assert spark.createDataFrame([("12.34",)], "a string").select(cents(F.col("a"))).first()[0] == 1234
    write_lines(spark.createDataFrame([(i, str(i * i)) for i in range(20)], "line_no bigint, line string"), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [str(i * i) for i in range(20)]
