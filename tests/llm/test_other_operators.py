import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ringflow.llm import ann, chat, components, registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(str, (r[c] for c in names))) for r in got.collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())


# --- nearest neighbours


def test_recall_and_scores(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in registry.op8_ann(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    recall = []
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))].tolist() if i != q][:20]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert all(s == pytest.approx(score[ids == v][0], abs=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        recall.append(len(set(best) & {v for _, v, _ in found}) / 20)
    assert np.mean(recall) >= 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [None, 1.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (9, [], 1), (10, [1.0, 1.0, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "0 AS shard", "1 AS vector")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(v, v.where("vec_id % 2 = 0"), k=2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0)]
    assert ann.search(v.where("false"), v, k=2).count() == 0
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(200)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(same, same.where("vec_id % 50 = 0"), k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {0: [1, 2, 3], 50: [0, 1, 2], 100: [0, 1, 2], 150: [0, 1, 2]}


def test_repeated_query_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, -1.0]), (1, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(v, v.where("vec_id = 0"), k=3).collect())
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 2.0), (0, 3, 1, 0.0)]


def test_probes_come_by_expected_success():
    sets = ann.perturbations(4, 30)
    assert sets[0] == [] and sets[1] == [0] and len({tuple(s) for s in sets}) == len(sets)
    assert all(7 - j not in s for s in sets for j in s)


# --- chat


def test_chat_awkward(spark):
    rows = [(1, 0, "system", "S", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", "yo", 0), (1, 2, "bob", "yo", 0), (1, None, None, None, 0), (2, 0, "system", "alone", 0), (None, 0, "ann", "", 0), (None, 0, "ann", "", 0), (None, 1, "system", "x", 0), (3, 600, "ann", "late", 0), (3, 1, "ann", "soon", 0)]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int").withColumn("count", F.lit(1)).withColumn("start", F.lit(2)).withColumn("perspective", F.lit("x"))
    out = chat.rotate_perspectives(t).collect()
    got = {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["text"], r["mask"]) for r in out}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "ann", 0), (3, "ann", 0)}
    assert len(out) == len(got) + 1  # every turn without conversation for itself
    assert got[None, "ann", 0] == (1, "<|assistant|>\n<|end|>\n", "14:22")
    n, text, mask = got[1, "bob", 0]
    assert n == 5
    assert text == "<|user name=unknown|>\n<|end|>\n<|system|>\nS<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert [text[slice(*map(int, s.split(":")))] for s in mask.split(",")] == ["yo<|end|>\n"] * 2
    assert chat.rotate_perspectives(t.where("false")).count() == 0


def rendered(turns, who):
    """Text and mask of one whole dialogue."""
    text, mask = "", []
    for role, words in turns:
        text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        start = len(text)
        text += words + "<|end|>\n"
        if role == who:
            mask.append(f"{start}:{len(text)}")
    return text, ",".join(mask)


@pytest.mark.parametrize("gathered", [10**6, 500])
def test_long_dialogues_are_rendered_whole(spark, gathered):
    """Thousands of turns, null and repeated numbers in bulk: parts bounded by turns give the whole rendering."""
    rng = random.Random(3)
    rows = [(7, rng.choice([None, 5, *range(900)]), rng.choice(["ann", "bob", "bob", "system"]), f"{rng.randrange(10**6)} 漢😀"[: rng.randrange(9)]) for _ in range(2500)]
    rows += [(8, i, "ann" if i % 2 else "cid", f"t{i}") for i in range(30)]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    parts = chat.rotate_perspectives(t, part_turns=100, gathered_turns=gathered).cache()
    assert max(r["n_turns"] for r in parts.collect()) == 100
    got = {(r["conv_id"], r["perspective"]): (r["n_turns"], r["text"], r["mask"]) for r in chat.whole_dialogues(parts).collect()}
    for conv, people in ((7, ["ann", "bob"]), (8, ["ann", "cid"])):
        turns = sorted(((-1 if n is None else n, r, hashlib.md5(x.encode()).hexdigest(), x) for c, n, r, x in rows if c == conv))
        for who in people:
            text, mask = rendered([(r, x) for _, r, _, x in turns], who)
            assert got[conv, who] == (len(turns), text, mask)
            for r in parts.where((F.col("conv_id") == conv) & (F.col("perspective") == who)).collect():
                assert text[r["start"] :].startswith(r["text"])
    assert set(got) == {(7, "ann"), (7, "bob"), (8, "ann"), (8, "cid")}


# --- components


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    sets = components.UnionFind()
    for a, b in links:
        sets.union(a, b)
    nodes = {x for e in links for x in e if e[0] != e[1]}
    df = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint").repartition(4)
    assert {r["node"]: r["comp"] for r in components.components(df).collect()} == {n: sets.find(n) for n in nodes}
    assert components.components(df.where("false")).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    from tests.llm import cases

    base = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 300").fetchall()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    odd = [(9001, None), (9002, ""), (9003, f"before it {item} after it"), (9004, "token = abcdefghijklmnopqrstu here"), (None, "no id at all")]
    docs = spark.createDataFrame([*base, *[(i, t, None, None, None) for i, t in odd]], schema)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = lambda rows: {r["doc_id"] for r in rows}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    gone = {d for d, *_ in base} - ids(kept["toxicity"])
    assert gone and np.mean([labels.get(d, 0) for d in gone if d in labels] or [1]) > 0.5
    groups = cases.groups([(r["doc_id"], r["text"]) for r in kept["toxicity"]])
    assert {i for i in ids(kept["near_dedup"]) if i is not None} == {d for d, c in groups.items() if d == c}
    assert 9003 not in ids(kept["decontamination"]) and {9001, 9002, 9004, None} <= ids(kept["decontamination"])
    assert ids(kept["secrets"]) == ids(kept["decontamination"])
    assert {r["doc_id"]: r["text"] for r in kept["secrets"]}[9004] == "[REDACTED] here"
    assert ids(kept["packing"]) == ids(kept["secrets"])
