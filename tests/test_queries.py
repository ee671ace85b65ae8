"""Every registered graph query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from ringflow.plans import registry

SF = Path("/root/testdata/sf0.001")
#: Joins from many sources take minutes in all; test_centrality covers them on small graphs.
SLOW = {"sssp_distances", "shortest_path_dag", "shortest_path_counts", "betweenness_by_joins", "betweenness_scores", "betweenness_lines_text"}
# cycles of one length are parts of the queries over all lengths
PARTS = {f"cycles{n}_{kind}" for n in (4, 5, 7) for kind in ("plain", "ratio")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def text(x):
    return None if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL and n not in SLOW | PARTS])
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, str(SF))
    cols = sorted(got.columns)
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    expected = [[text(dict(zip(names, r, strict=True))[c]) for c in cols] for r in cur.fetchall()]
    found = [[text(r[c]) for c in cols] for r in got.collect()]
    key = lambda r: [(x is None, x or "") for x in r]
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_entry_imports_without_the_other_folder(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["v1", "v2", "v3"]
