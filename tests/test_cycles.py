import random

import pytest

from ringflow.functions.tables import write_table
from ringflow.operators import cycles as C
from ringflow.sources.export import cycle_lines
from tests import oracles

RING = [(1, 2, 100), (2, 3, 100), (3, 1, 100)]
# name: edges, plain 3..7, ratio 3..8
MICRO = {
    "C1": (RING, ["1-2-3"], ["1-2-3"]),
    "C2": ([(1, 2, 100), (2, 1, 100)], [], []),
    "C3a": ([(1, 2, 10000), (2, 3, 2000), (3, 1, 6000)], ["1-2-3"], ["1-2-3"]),
    "C3b": ([(1, 2, 10000), (2, 3, 1999), (3, 1, 5997)], ["1-2-3"], []),
    "C3c": ([(1, 2, 10000), (2, 3, 2000), (3, 1, 6001)], ["1-2-3"], []),
    "C4": ([(1, 2, 100), (2, 3, 30), (3, 1, 10)], ["1-2-3"], []),
    "C5": ([(i, i % 8 + 1, 50) for i in range(1, 9)], [], ["1-2-3-4-5-6-7-8"]),
    "C5b": ([(i, i % 7 + 1, 50) for i in range(1, 8)], ["1-2-3-4-5-6-7"], ["1-2-3-4-5-6-7"]),
    "C5c": ([(i, i % 9 + 1, 50) for i in range(1, 10)], [], []),
    "C6": ([*RING, (1, 2, 100)], ["1-2-3"] * 2, ["1-2-3"] * 2),
    "C6b": ([*RING, (1, 2, 1)], ["1-2-3"] * 2, ["1-2-3"]),
    "C7": ([*RING, (1, 1, 100), (2, 2, 7)], ["1-2-3"], ["1-2-3"]),
    "C8": ([(10, 9, 5), (9, 100, 5), (100, 10, 5), (2, 10, 5), (10, 2, 5), (9, 2, 5), (100, 9, 5)], ["2-10-9", "9-100-10"], ["2-10-9", "9-100-10"]),
    "C9": ([(1, 2, 9), (2, 3, 9), (3, 1, 9), (3, 4, 9), (4, 1, 9), (7, 1, 9), (4, 8, 9)], ["1-2-3", "1-2-3-4"], ["1-2-3", "1-2-3-4"]),
}
# all fixtures as one graph of components that lie 1000 apart: one plan serves them all
ALL = [(1000 * k + a, 1000 * k + b, c) for k, (edges, *_) in enumerate(MICRO.values()) for a, b, c in edges]


def table(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint, cents bigint")


def rows(df):
    return sorted(tuple(x for x in r if x is not None) for r in df.collect())


@pytest.mark.parametrize(("ratio", "most"), [(False, 7), (True, 8)])
def test_micro_fixtures(spark, ratio, most):
    found = {}
    for r in rows(C.all_cycles(table(spark, ALL), most, ratio)):
        found.setdefault(r[1] // 1000, []).append("-".join(str(v % 1000) for v in r[1:]))
    for k, (name, case) in enumerate(MICRO.items()):
        assert found.get(k, []) == case[1 + ratio], name


@pytest.mark.parametrize("ratio", [False, True])
def test_against_depth_first_search(spark, ratio):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 60)) for _ in range(75)]
    most = 8 if ratio else 7
    expected = oracles.cycles(edges, most, ratio)
    assert rows(C.all_cycles(table(spark, edges), most, ratio)) == expected
    assert len(expected) > 20
    # neither trimming, nor the unit of amounts, nor an order-preserving change of names matters
    assert rows(C.all_cycles(table(spark, edges), most, ratio, trimmed=False)) == expected
    other = [(3 * a + 7, 3 * b + 7, 10 * c) for a, b, c in edges]
    assert rows(C.all_cycles(table(spark, other), most, ratio)) == [(n, *[3 * v + 7 for v in p]) for n, *p in expected]


def test_text_lines(spark):
    found = write_table(C.all_cycles(table(spark, MICRO["C9"][0]), 7, False), "cycles")
    assert [r["line"] for r in cycle_lines(found).orderBy("line_no").collect()] == ["2", "1,2,3", "1,2,3,4"]


def test_empty(spark):
    assert rows(C.all_cycles(table(spark, []), 8, True)) == []
