"""Shortest paths of bounded graphs: all widths and blocks of the kernel, and how queries deal them out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringflow.operators import centrality as C
from ringflow.operators.kernels import Searched, ShortestPaths, Trees, same_search
from tests import oracles


def graph(seed, n, m, weights):
    rng = random.Random(seed)
    return [(a, b, rng.choice(weights)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b]


def table(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")


def plain_distances(edges):
    ids = {x for a, b, _ in edges for x in (a, b)}
    dist = {(s, s): 0 for s in ids}
    for _ in ids:
        for a, b, w in edges:
            for s in ids:
                if (s, a) in dist:
                    dist[s, b] = min(dist.get((s, b), 1 << 62), dist[s, a] + w)
    return dist


@pytest.fixture
def as_many_partitions_as_tasks(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2 * spark.sparkContext.defaultParallelism)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("weights", [(1, 2, 3), (6000, 9000, 16000), (16383, 16384), (2**29, 2**30 + 1), (2**40, 3 * 2**40)])
def test_kernel_in_blocks(weights):
    # two parts of a graph and a few pairs
    edges = graph(1, 20, 45, weights) + [(a + 100, b + 100, w) for a, b, w in graph(2, 15, 30, weights)] + [(200 + 2 * k, 201 + 2 * k, weights[0]) for k in range(6)]
    for pairs, columns in ((1 << 21, 512), (40, 4), (1, 1)):
        found = ShortestPaths(*(np.array(c, np.int64) for c in zip(*edges, strict=True)))
        found.PAIRS, found.COLUMNS = pairs, columns
        every = np.arange(len(found.ids))
        near = {(s, v): d for columns in found.distances(every) for s, v, d in zip(*(c.tolist() for c in columns), strict=True)}
        assert near == plain_distances(edges)
        score, reached = found.scores(every[::-1], np.ones(len(every), np.int64))
        assert dict(zip(found.ids.tolist(), score.tolist(), strict=True)) == pytest.approx(oracles.betweenness(edges))
        assert reached.tolist() == [sum(s == v for s, _ in near) - 1 for v in found.ids[::-1].tolist()]


def test_distances_are_dealt_out(spark, as_many_partitions_as_tasks):
    e = table(spark, graph(3, 60, 150, (1, 2, 3)))
    sources = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    assert C.shortest_distances(e, sources).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("kernel", [C.KERNEL_EDGES, 0])
def test_path_edges(spark, kernel):
    edges = graph(4, 15, 30, (1, 2, 3)) + [(3, 4, 1), (3, 4, 1), (3, 4, 0)]
    near = plain_distances([e for e in edges if e[2]])
    sources = sorted({s for s, _ in near})[::2]
    expected = [(s, a, b) for s in sources for a, b, w in edges if w and (s, a) in near and near[s, a] + w == near[s, b]]
    found = C.all_shortest_path_edges(table(spark, edges), spark.createDataFrame([(s,) for s in [*sources, 99]], "id bigint"), kernel)
    assert found.columns == ["s", "u", "v"] and sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("kernel", [C.KERNEL_EDGES, 0])
def test_path_counts(spark, kernel):
    edges = graph(5, 15, 40, (1, 2)) + [(3, 4, 1), (3, 4, 1), (3, 4, 0)]
    near = plain_distances([e for e in edges if e[2]])
    sources = sorted({s for s, _ in near})[::2]
    ways = {(s, s): 1 for s in sources}
    for s, v in sorted(near, key=near.get):
        if s in sources and s != v:
            ways[s, v] = sum(ways[s, a] for a, b, w in edges if w and b == v and (s, a) in near and near[s, a] + w == near[s, v])
    found = C.all_shortest_path_counts(table(spark, edges), spark.createDataFrame([(s,) for s in [*sources, 99]], "id bigint"), kernel).collect()
    assert len(found) == len(ways) + 1 and {(r["s"], r["v"]): r["sigma"] for r in found} == ways | {(99, 99): 1}


def test_scores_are_dealt_out(spark, as_many_partitions_as_tasks):
    e = table(spark, graph(6, 60, 150, (1, 2, 3)))
    starts = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("times", F.lit(1))
    assert C._in_tasks(e, starts)[1].select(F.input_file_name()).distinct().count() > 1


def arrays(edges):
    return [np.array(c, np.int64) for c in zip(*edges, strict=True)]


@pytest.mark.parametrize("seed", range(40))
def test_scores_of_some_sources(seed):
    # rings, tails and loops by way of what hangs: few edges for a vertex
    rng = random.Random(seed)
    n = rng.choice((4, 8, 15, 25))
    edges = graph(seed, n, int(n * rng.choice((0.7, 1, 1.3, 2, 3))), rng.choice(((1,), (1, 2, 3)))) + [(100, 101, 1), (101, 102, 1), (102, 100, 1), (100, 103, 2)]
    found = ShortestPaths(*arrays(edges))
    found.PAIRS, found.COLUMNS = rng.choice(((1 << 21, 512), (40, 4), (1, 1)))
    near = plain_distances(edges)
    some = sorted(rng.sample(sorted({s for s, _ in near}), rng.randrange(1, n // 2 + 2)))
    score, reached = found.scores(np.searchsorted(found.ids, some), np.full(len(some), 3))
    assert dict(zip(found.ids.tolist(), (score / 3).tolist(), strict=True)) == pytest.approx(oracles.betweenness(edges, some))
    assert reached.tolist() == [sum(s == v for s, _ in near) - 1 for v in some]


def test_scores_take_fewer_searches_and_rows(monkeypatch):
    searched, search = [], ShortestPaths._search

    def counted(self, sources):
        found = search(self, sources)
        searched.append((len(sources), len(found.v)))
        return found

    monkeypatch.setattr(ShortestPaths, "_search", counted)
    edges = graph(8, 200, 400, (1, 2, 3))
    found = ShortestPaths(*arrays(edges))
    found.COLUMNS = 8
    n = len(found.ids)
    score, _ = found.scores(np.arange(n), np.ones(n, np.int64))
    assert dict(zip(found.ids.tolist(), score.tolist(), strict=True)) == pytest.approx(oracles.betweenness(edges))
    assert sum(sources for sources, _ in searched) < 0.7 * n and max(rows for _, rows in searched) < 0.7 * n


def test_same_search():
    # 1 -> 2 -> 3 by vertices with two ways in; 3 has two ways on
    found = same_search(*arrays([(1, 2, 1), (9, 2, 1), (2, 3, 1), (8, 3, 1), (3, 1, 1), (7, 1, 1), (3, 9, 1), (3, 8, 1), (3, 7, 1)]))
    assert dict(zip(found["id"].tolist(), found["search"].tolist(), strict=True)) == {1: 3, 2: 3, 9: 3, 8: 3, 7: 3}


def test_trees_keep_no_lists():
    # a ring with what hangs from it, and a path: workers hold arrays of them alone
    found = Trees(np.array([1, 2, 0, 5, 11, 12]), np.array([0, 1, 2, 1, 10, 11]), 14)
    assert found.top[[10, 11, 12, 13]].tolist() == [10, 10, 10, 13] and len(set(found.top[[0, 1, 2, 5]].tolist())) == 1
    assert found.gathered(np.ones(14))[[10, 11, 12, 13]].tolist() == [3, 2, 1, 1] and found.carried(np.ones(14))[[10, 11, 12]].tolist() == [1, 2, 3]
    assert found.below(np.array([12, 5, 10]), np.array([11, 10, 12])).tolist() == [True, False, False]
    assert all(isinstance(x, np.ndarray) for x in vars(found).values())


@pytest.mark.parametrize("kernel", [C.KERNEL_EDGES, 40])
def test_joins_by_component(spark, monkeypatch, kernel):
    # two parts of a graph and some pairs; at 40 edges one of them is joined row by row
    edges = graph(9, 30, 70, (1, 2, 3)) + [(a + 100, b + 100, w) for a, b, w in graph(10, 15, 25, (1, 2))] + [(200 + k, 300 + k, 1) for k in range(9)]
    sources = table(spark, edges).select(F.explode(F.array("src", "dst")).alias("id")).where("id % 3 > 0")
    asked, by_joins = [], C._by_joins
    monkeypatch.setattr(C, "_by_joins", lambda e, s, n: asked.append(e.count()) or by_joins(e, s, n))
    monkeypatch.setattr(C, "BUNDLE_EDGES", 20)
    found = C.betweenness_by_joins(table(spark, edges), sources, kernel_edges=kernel)
    expected = oracles.betweenness(edges, sorted({x for a, b, _ in edges for x in (a, b) if x % 3}))
    assert {r["id"]: r["score"] for r in found.collect()} == pytest.approx({v: s for v, s in expected.items() if s})
    assert asked == ([] if kernel > 40 else [len(graph(9, 30, 70, (1, 2, 3)))])
    every = C.betweenness(table(spark, edges), kernel_edges=kernel).collect()
    assert {r["id"]: r["score"] for r in every} == pytest.approx(oracles.betweenness(edges))


@pytest.mark.parametrize("seed", range(10))
def test_scores_by_rows_are_zero_only_where_nothing_passes(seed):
    rng = random.Random(seed)
    edges = graph(seed, 30, rng.choice((40, 70, 120)), rng.choice(((1,), (1, 2, 3)))) + [(100, k, 1) for k in range(101, 150)] + [(k, 150, 1) for k in range(101, 150)] + [(150, 151, 1)]
    found = ShortestPaths(*arrays(edges))
    found.PAIRS, found.COLUMNS = rng.choice(((1 << 21, 512), (40, 4)))
    near = plain_distances(edges)
    some = sorted(rng.sample(sorted({s for s, _ in near}), 40))
    score, reached = found.scores_by_rows(np.searchsorted(found.ids, some), np.full(len(some), 2))
    expected = oracles.betweenness(edges, some)
    assert dict(zip(found.ids.tolist(), (score / 2).tolist(), strict=True)) == pytest.approx(expected)
    assert [x > 0 for x in score.tolist()] == [expected[v] > 0 for v in found.ids.tolist()]
    assert reached.tolist() == [sum(s == v for s, _ in near) - 1 for v in some]


def test_paths_are_followed_in_few_layers(monkeypatch):
    # nearly as many distances as pairs, but paths of a few steps
    sizes, steps = [], Searched.steps

    def counted(self, tight):
        layers = steps(self, tight)
        sizes.append((len(layers), self.dist.size))
        return layers

    monkeypatch.setattr(Searched, "steps", counted)
    edges = graph(11, 60, 200, range(1000, 9000))
    found = ShortestPaths(*arrays(edges))
    found.FOLLOWED = 1 << 10
    n = len(found.ids)
    assert dict(zip(found.ids.tolist(), found.scores_by_rows(np.arange(n), np.ones(n, np.int64))[0].tolist(), strict=True)) == pytest.approx(oracles.betweenness(edges))
    assert len(sizes) > 1 and max(layers for layers, _ in sizes) < 100 and max(size for _, size in sizes) <= 1 << 10


@pytest.mark.parametrize("weights", [(1,), (1, 2, 3), (2**29, 2**30 + 1)])
def test_layers_hold_all_ways_into_a_pair(weights):
    edges = graph(12, 40, 130, weights) + [(1, 2, weights[0])] * 2 + [(100 + k, 101 + k, weights[0]) for k in range(30)]
    found = ShortestPaths(*arrays(edges))
    for _, near in found._followed(np.arange(len(found.ids))):
        came, tight, layers = set(near.at * near.dist.shape[1] + np.arange(len(near.at))), near.tight(), near.steps(near.tight())
        assert sum(len(to) for _, to in layers) == np.count_nonzero(tight)
        for source, to in layers:
            assert came.issuperset(source.tolist()) and came.isdisjoint(to.tolist())
            came.update(to.tolist())


def test_scores_broadcast_no_graph(spark, monkeypatch):
    monkeypatch.setattr(C, "_broadcast_graph", None)
    edges = graph(13, 20, 40, (1, 2))
    assert {r["id"]: r["score"] for r in C.betweenness(table(spark, edges)).collect()} == pytest.approx(oracles.betweenness(edges))


def test_batches_row_by_row(spark):
    edges = graph(14, 12, 24, (1, 2, 3))
    sources = table(spark, edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = C.betweenness_by_joins(table(spark, edges), sources, batch_pairs=80, kernel_edges=0).collect()
    assert {r["id"]: r["score"] for r in found} == pytest.approx({v: x for v, x in oracles.betweenness(edges).items() if x})


def _runs(column):
    return 1 + np.count_nonzero(np.diff(column))


def test_pairs_come_by_vertex():
    # by source, a vertex would change with every row, and files take all its bits each time
    edges = graph(15, 60, 200, (1, 2, 3))
    found = ShortestPaths(*arrays(edges))
    found.PAIRS, found.COLUMNS = 60 * 16, 16
    for rows in (found.distances, found.counts):
        blocks = list(rows(np.arange(len(found.ids))))
        assert len(blocks) > 1 and all(_runs(v) == len(set(v.tolist())) for _, v, _ in blocks)


def test_path_edges_come_by_edge():
    edges = graph(15, 60, 200, (1, 2, 3))
    found = ShortestPaths(*arrays(edges))
    found.PAIRS, found.COLUMNS = 60 * 16, 16
    blocks = list(found.path_edges(np.arange(len(found.ids))))
    assert len(blocks) > 1 and all(_runs(v) == len(set(v.tolist())) and _runs(u) <= len(edges) for _, u, v in blocks)


def parallel(seed):
    """A graph whose edges stand there once or twice at their least weight, and often at heavier ones."""
    least = {(a, b): w for a, b, w in graph(seed, 20, 45, (1, 2, 3))}
    return [(a, b, w + k) for (a, b), w in least.items() for k in [0] * (1 + (a + b) % 2) + list(range(1, 8))], len(least)


def _none_by_rows(monkeypatch):
    def refused(*_):
        raise AssertionError("joined row by row")

    monkeypatch.setattr(C, "_by_joins", refused)


def test_by_joins_takes_lightest_edges_alone(spark, monkeypatch):
    _none_by_rows(monkeypatch)
    edges, many = parallel(16)
    sources = table(spark, edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = C.betweenness_by_joins(table(spark, edges), sources, kernel_edges=2 * many).collect()
    assert len(edges) > 2 * many and {r["id"]: r["score"] for r in found} == pytest.approx({v: x for v, x in oracles.betweenness(edges).items() if x})


def test_top_scores_take_lightest_edges_alone(spark, monkeypatch):
    _none_by_rows(monkeypatch)
    edges, many = parallel(17)
    top = C.top_scores(C.betweenness(table(spark, edges), kernel_edges=2 * many)).collect()
    expected = sorted(((round(x + 1e-7, 3), v) for v, x in oracles.betweenness(edges).items()), key=lambda x: (-x[0], x[1]))
    assert [(r["score"], r["id"]) for r in top] == [(pytest.approx(x), v) for x, v in expected]


@pytest.fixture
def in_tasks(monkeypatch):
    asked, rows = [], C._rows_in_tasks
    monkeypatch.setattr(C, "_rows_in_tasks", lambda *a: asked.append(a[0].count()) or rows(*a))
    return asked


def test_counts_take_lightest_edges_alone(spark, in_tasks):
    edges, many = parallel(20)
    sources = table(spark, edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found, plain = ({(r["s"], r["v"]): r["sigma"] for r in C.all_shortest_path_counts(table(spark, edges), sources, n).collect()} for n in (2 * many, len(edges)))
    near = plain_distances(edges)
    expected = {(s, s): 1 for s, _ in near}
    for s, v in sorted(near, key=near.get):
        if s != v:
            expected[s, v] = sum(expected[s, a] for a, b, w in edges if b == v and (s, a) in near and near[s, a] + w == near[s, v])
    assert found == plain == expected and len(in_tasks) == 2 and max(in_tasks) <= 2 * many


def test_compressed_scores_take_lightest_edges_alone(spark, monkeypatch):
    # 50 and 51 have several ways on, all to the same vertex: with the lightest one alone they are of an in-tree
    _none_by_rows(monkeypatch)
    edges, many = parallel(19)
    edges += [(50, 51, 2), (50, 51, 3), (51, 1, 1), (51, 1, 4)]
    found = C.betweenness_compressed(table(spark, edges), kernel_edges=2 * many + 4).collect()
    assert {r["id"]: r["score"] for r in found} == pytest.approx(oracles.betweenness(edges))


def test_scores_of_some_sources_take_lightest_edges_alone(spark, monkeypatch):
    _none_by_rows(monkeypatch)
    edges, many = parallel(18)
    some = sorted({a for a, _, _ in edges if a % 3})
    found = C.betweenness(table(spark, edges), spark.createDataFrame([(s,) for s in some], "id bigint"), kernel_edges=2 * many).collect()
    assert {r["id"]: r["score"] for r in found} == pytest.approx(oracles.betweenness(edges, some))


def test_distances_take_lightest_edges_alone(spark, in_tasks):
    edges, many = parallel(21)
    sources = table(spark, edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = {(r["s"], r["v"]): r["d"] for r in C.shortest_distances(table(spark, edges), sources, 2 * many).collect()}
    assert found == plain_distances(edges) and len(in_tasks) == 1


def test_path_edges_take_lightest_edges_alone(spark, in_tasks):
    edges, many = parallel(22)
    near = plain_distances(edges)
    sources = table(spark, edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = C.all_shortest_path_edges(table(spark, edges), sources, 2 * many).collect()
    assert sorted(map(tuple, found)) == sorted((s, a, b) for s in {s for s, _ in near} for a, b, w in edges if (s, a) in near and near[s, a] + w == near[s, b]) and len(in_tasks) == 1
