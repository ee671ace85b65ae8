"""Path and centrality queries against brute force; edge weights run to 97, so the orders make the graph."""

import pandas as pd
import pytest

from ringflow.plans import registry
from tests import oracles

# one order for each vertex in turn: the edges are consecutive pairs, the weight is 1 + key % 97
WALK = [1, 2, 13, 4, 15, 1, 13, 2, 4, 7, 15, 13, 7, 1, 4, 2, 15, 7, 21, 9, 33]
EDGES = [(a, b, 1 + k % 97) for k, (a, b) in enumerate(zip(WALK, WALK[1:]), 1)]
IDS = sorted(set(WALK))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("orders"))
    rows = pd.DataFrame({"o_orderkey": range(1, len(WALK) + 1), "o_custkey": WALK, "o_totalprice": 1.0, "o_orderpriority": "1-URGENT"})
    spark.createDataFrame(rows).write.parquet(f"{d}/orders.parquet")
    return d


def paths():
    """(s, v) -> distance and number of shortest paths, by relaxing all edges until nothing changes."""
    dist = {(s, s): 0 for s in IDS}
    for _ in IDS:
        for a, b, w in EDGES:
            for s in IDS:
                if (s, a) in dist:
                    dist[s, b] = min(dist.get((s, b), 1 << 60), dist[s, a] + w)
    dag = [(s, a, b) for s in IDS for a, b, w in EDGES if (s, a) in dist and dist[s, a] + w == dist[s, b]]
    sigma = {(s, s): 1 for s in IDS}
    for (s, v), _ in sorted(dist.items(), key=lambda x: x[1]):
        if s != v:
            sigma[s, v] = sum(sigma[s, a] for t, a, b in dag if (t, b) == (s, v))
    return dist, dag, sigma


def found(spark, sf_dir, name, *cols):
    return sorted(tuple(r[c] for c in cols) for r in registry.QUERIES[name](spark, sf_dir).collect())


def test_paths_start_at_every_vertex(spark, sf_dir):
    dist, dag, sigma = paths()
    assert {s for s, _ in dist} == set(IDS) and not any(s % 10 == 0 for s in IDS)
    assert found(spark, sf_dir, "sssp_distances", "s", "v", "d") == sorted((s, v, d) for (s, v), d in dist.items())
    assert found(spark, sf_dir, "shortest_path_dag", "s", "u", "v") == sorted(dag)
    assert found(spark, sf_dir, "shortest_path_counts", "s", "v", "sigma") == sorted((s, v, n) for (s, v), n in sigma.items())


def test_scores_count_every_source(spark, sf_dir):
    expected = oracles.betweenness(EDGES)
    assert max(expected.values()) > 5
    assert {i: s for i, s in found(spark, sf_dir, "betweenness_by_joins", "id", "score")} == pytest.approx({i: s for i, s in expected.items() if s}, abs=1e-3)
    lines = found(spark, sf_dir, "betweenness_lines_text", "line_no", "line")
    assert [n for n, _ in lines] == list(range(1, len(IDS) + 1))
    assert {int(x.split(",")[0]): float(x.split(",")[1]) for _, x in lines} == pytest.approx(expected, abs=1e-3)
