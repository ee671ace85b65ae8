"""Simple directed cycles of bounded length, with or without the ratio rule.

Every cycle is reported once, from its smallest id. Open paths grow forward from
that id up to half of the longest cycle; cycles of that many vertices or fewer are
closed by a join on both ends. Longer ones are met in the middle: an open path of
that many vertices joins a way back from its last vertex to its first. Open paths of that
length are kept only where their last vertex can return to the first in the steps
that are left. Parallel edges stay separate rows, so each edge sequence is a result
of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio_ok
from ..functions.tables import drop_table, write_table
from .graph import trim, without_loops

MIN_LEN = 3


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def consecutive_pairs(edges: DataFrame) -> DataFrame:
    """a, b, c, x, y: two edges a -> b -> c in succession whose amounts pass the ratio rule."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("cents").alias("x"))
    two = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("cents").alias("y"))
    return one.join(two, "b").where(ratio_ok(F.col("x"), F.col("y"))).select("a", "b", "c", "x", "y")


class CyclePlan:
    """Intermediate tables of one graph, each written once and shared by all lengths from ``least`` to ``most``."""

    def __init__(self, edges: DataFrame, ratio: bool, most: int = 8, least: int = MIN_LEN, trimmed: bool = True):
        self.ratio, self.most, self.least = ratio, most, least
        self.half = max(MIN_LEN, (most + 2) // 2)  # vertices of an open path; its edges and those of the way back are as many, or one more
        e = without_loops(edges.select("src", "dst", "cents" if ratio else F.lit(0).cast("bigint").alias("cents")))
        # short cycles are found in fewer joins than trimming takes
        self.e = trim(e) if trimmed and most > 4 else write_table(e, "edges")
        self._open: dict[int, DataFrame] = {}
        self._back: dict[int, DataFrame] = {}

    def _ratio(self, x: str, y: str) -> list[Column]:
        return [ratio_ok(F.col(x), F.col(y))] if self.ratio else []

    def open_paths(self, k: int) -> DataFrame:
        """v1..vk, first, last: paths of k vertices whose smallest is v1."""
        if k not in self._open:
            if k == 2:
                df = self.e.where("dst > src").select(F.col("src").alias("v1"), F.col("dst").alias("v2"), F.col("cents").alias("first"), F.col("cents").alias("last"))
            else:
                p = self.open_paths(k - 1)
                n = self.e.select(F.col("src").alias(f"v{k - 1}"), F.col("dst").alias(f"v{k}"), F.col("cents").alias("amount"))
                new = F.col(f"v{k}")
                rule = _all([new > F.col("v1"), *[new != F.col(f"v{i}") for i in range(2, k - 1)], *self._ratio("last", "amount")])
                df = p.join(n, f"v{k - 1}").where(rule).select(*[f"v{i}" for i in range(1, k + 1)], "first", F.col("amount").alias("last"))
                if k == self.half and self.most > self.half:
                    df = df.join(self._pairs_back(max(0, self.least - self.half), self.most - self.half).withColumnRenamed("h", f"v{k}"), ["v1", f"v{k}"], "left_semi").select(*df.columns)
            # single edges are at hand, and the last step of a search is read once
            self._open[k] = write_table(df, f"open{k}") if 2 < k < self.most else df
        return self._open[k]

    def returning(self, least: int, most: int) -> DataFrame:
        """v1, h: from h a way of ``least`` to ``most`` vertices between leads back to v1, all of them above v1."""
        return self._pairs_back(least, most).distinct()

    def _pairs_back(self, least: int, most: int) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [self.ways_back(m).select("v1", "h") for m in range(least, most + 1)])

    def ways_back(self, m: int) -> DataFrame:
        """v1, h, b1..bm, first_back, last_back: ways h -> b1 -> ... -> bm -> v1, all of them above v1."""
        if m not in self._back:
            if m == 0:
                df = self.e.where("src > dst").select(F.col("dst").alias("v1"), F.col("src").alias("h"), F.col("cents").alias("first_back"), F.col("cents").alias("last_back"))
            else:
                b = self.ways_back(m - 1).select("v1", F.col("h").alias("b1"), *[F.col(f"b{i}").alias(f"b{i + 1}") for i in range(1, m)], "first_back", "last_back")
                n = self.e.select(F.col("src").alias("h"), F.col("dst").alias("b1"), F.col("cents").alias("amount"))
                new = F.col("h")
                rule = _all([new > F.col("v1"), *[new != F.col(f"b{i}") for i in range(2, m + 1)], *self._ratio("amount", "first_back")])
                df = b.join(n, "b1").where(rule).select("v1", "h", *[f"b{i}" for i in range(1, m + 1)], F.col("amount").alias("first_back"), "last_back")
            self._back[m] = write_table(df, f"back{m}") if m else df
        return self._back[m]

    def of_length(self, n: int) -> DataFrame:
        """v1..vn of every cycle of n vertices."""
        ids = [f"v{i}" for i in range(1, n + 1)]
        if n <= self.half:
            p = self.open_paths(n)
            close = self.e.select(F.col("src").alias(f"v{n}"), F.col("dst").alias("v1"), F.col("cents").alias("amount"))
            found = p.join(close, [f"v{n}", "v1"])
            rules = [*self._ratio("last", "amount"), *self._ratio("amount", "first")]
        else:
            m = n - self.half
            back = self.ways_back(m).withColumnRenamed("h", f"v{self.half}")
            for i in range(1, m + 1):
                back = back.withColumnRenamed(f"b{i}", f"v{self.half + i}")
            found = self.open_paths(self.half).join(back, ["v1", f"v{self.half}"])
            apart = [F.col(f"v{i}") != F.col(f"v{j}") for i in range(2, self.half) for j in range(self.half + 1, n + 1)]
            rules = [*apart, *self._ratio("last", "first_back"), *self._ratio("last_back", "first")]
        return (found.where(_all(rules)) if rules else found).select(*ids)


    def close(self) -> None:
        """Delete the intermediate tables; what was found must be written by then."""
        drop_table(self.e, *[t for tables in (self._open, self._back) for t in tables.values() if hasattr(t, "_ringflow_path")])


def cycles_of_length(edges: DataFrame, n: int, ratio: bool) -> DataFrame:
    return CyclePlan(edges, ratio, n, n).of_length(n)


def all_cycles(edges: DataFrame, max_len: int, ratio: bool, min_len: int = MIN_LEN, trimmed: bool = True) -> DataFrame:
    """len, v1..v(max_len): all cycles of min_len to max_len vertices; ids beyond a cycle's length are null."""
    return _union(CyclePlan(edges, ratio, max_len, min_len, trimmed))


def written_cycles(edges: DataFrame, max_len: int, ratio: bool, min_len: int = MIN_LEN) -> DataFrame:
    """The same as a table, for several uses; nothing else is left on disk."""
    plan = CyclePlan(edges, ratio, max_len, min_len)
    found = write_table(_union(plan), "cycles")
    plan.close()
    return found


def _union(plan: CyclePlan) -> DataFrame:
    min_len, max_len = plan.least, plan.most
    parts = []
    for n in range(min_len, max_len + 1):
        c = plan.of_length(n)
        pad = [F.lit(None).cast("bigint").alias(f"v{i}") for i in range(n + 1, max_len + 1)]
        parts.append(c.select(F.lit(n).cast("int").alias("len"), *[f"v{i}" for i in range(1, n + 1)], *pad))
    return reduce(lambda a, b: a.unionByName(b), parts)


def counts_by_length(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("len").agg(F.count("*").alias("n"))
