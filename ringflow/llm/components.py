"""Connected components of a table of links: union-find inside tasks, label propagation between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, write_table


class UnionFind:
    """Disjoint sets of integers; each set's root is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while (p := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = p
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


#: Links a task holds before it gives its forest out and starts anew.
FOREST_LINKS = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star forest of each task's links: same components, at most one link for each node."""

    def stars(sets: UnionFind) -> pa.RecordBatch:
        nodes = [x for x in sets.parent if sets.find(x) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array([sets.find(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > FOREST_LINKS:
            yield stars(sets)
            sets = UnionFind()
    yield stars(sets)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b: longs); comp is the component's smallest node.

    Rounds of neighbour-minimum and pointer jumping, each written to the shared
    folder, until nothing changes; labels and links stay distributed. Hot nodes
    are pre-aggregated: a minimum is taken in every task before the shuffle. Null
    ends are ignored; an empty table gives an empty result.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = links.mapInArrow(_forest, "a long, b long")
    edges = write_table(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        # the smallest label among neighbours, then the label of that label
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        joined = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        up = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        nxt = write_table(joined.join(up, joined["comp"] == up["n"], "left").select("node", "was", F.least("comp", F.coalesce("c", "comp")).alias("comp")), "labels")
        changed = nxt.where("was <> comp").limit(1).count()
        drop_table(labels)
        if not changed:
            return nxt.select("node", "comp")
        labels = _carry(nxt)


def _carry(table: DataFrame) -> DataFrame:
    out = table.select("node", "comp")
    out._ringflow_path = table._ringflow_path
    return out
