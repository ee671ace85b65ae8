"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are dealt at random into shards of bounded size. In each shard L tables
hash a vector by k Gaussian (2-stable) projections, floor((a.x + b) / w). A query
visits its own bucket of every table and then perturbed buckets in the order of
their estimated success, judged by how near the query lies to the borders that
the perturbations cross. Candidates of all tables and shards are merged and
ranked by exact inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a block, about.
SHARD_VECTORS = 8192
BLOCK_QUERIES = 4096
#: Tables, projections of a table, cell width in standard deviations of a projection, buckets visited in a table.
TABLES = 4
PROJECTIONS = 5
WIDTH = 1.5
PROBES = 100
SEED = 20


def perturbations(k: int, probes: int) -> list[list[int]]:
    """Sets of border crossings in order of expected score (Lv et al. 2007), worked out once.

    Crossings are numbered 0..2k-1 by rising expected distance; j and 2k-1-j are the
    two sides of one projection and never come together.
    """
    m = 2 * k
    expect = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) if j < k else 1 - (m - j) / (k + 1) + (m - j) * (m - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(m)]
    heap, out = [(expect[0], [0])], [[]]
    valid = lambda s: not any(m - 1 - j in s for j in s)
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if valid(s):
            out.append(s)
        if (top := s[-1]) + 1 < m:
            heapq.heappush(heap, (score - expect[top] + expect[top + 1], [*s[:-1], top + 1]))
            heapq.heappush(heap, (score + expect[top + 1], [*s, top + 1]))
    return out


class PStableTables:
    """L tables over one shard's vectors (rows of unit length or any other scale)."""

    def __init__(self, vectors: np.ndarray, tables: int = TABLES, k: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = vectors.shape[1]
        scale = float(np.sqrt((vectors**2).sum(axis=1).mean())) or 1.0
        self.a = rng.standard_normal((tables, d, k)) / scale
        self.b = rng.uniform(0, width, (tables, k))
        self.k, self.width, self.vectors = k, width, vectors
        self.mix = rng.integers(1, 1 << 62, k, dtype=np.int64) | 1
        self.index = []
        for t in range(tables):
            keys = self._keys(np.floor((vectors @ self.a[t] + self.b[t]) / width).astype(np.int64))
            order = np.argsort(keys, kind="stable")
            self.index.append((keys[order], order))
        self.sets = perturbations(k, PROBES)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (cells * self.mix).sum(axis=-1)
        return h ^ (h >> 29)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Boolean [query, vector]: the vector lies in a bucket the query visits."""
        n = len(queries)
        hit = np.zeros((n, len(self.vectors)), bool)
        for t, (keys, order) in enumerate(self.index):
            at = (queries @ self.a[t] + self.b[t]) / self.width
            cell = np.floor(at).astype(np.int64)
            below = at - cell  # distance to the lower border; 1 - below to the upper
            dist = np.concatenate([below, 1 - below], axis=1)
            rank = np.argsort(dist, axis=1, kind="stable")  # crossings of this query, nearest border first
            proj, side = rank % self.k, np.where(rank < self.k, -1, 1)
            for s in self.sets:
                probe = cell.copy()
                for j in s:
                    np.add.at(probe, (np.arange(n), proj[:, j]), side[:, j])
                key = self._keys(probe)
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for q in np.flatnonzero(hi > lo):
                    hit[q, order[lo[q] : hi[q]]] = True
        return hit


def nearest_in_shard(vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(query_id, vec_id, score): per query the k best candidates of this shard."""
    # equal vectors share one place in the index; only the k + 1 smallest ids of each can be among k nearest
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    owner = owner.ravel()
    by = np.lexsort((vec_ids, owner))
    first = np.searchsorted(owner[by], np.arange(len(distinct)))
    place = np.arange(len(by)) - first[owner[by]]
    by = by[place <= k]
    starts = np.searchsorted(owner[by], np.arange(len(distinct) + 1))
    ids = vec_ids[by]
    # augmented by a last component, inner products and distances order alike whatever the lengths
    norm2 = (distinct**2).sum(axis=1)
    top = norm2.max()
    index = PStableTables(np.hstack([distinct, np.sqrt(np.maximum(top - norm2, 0))[:, None]]))
    lengths = np.sqrt((queries**2).sum(axis=1, keepdims=True))
    probes = np.hstack([queries / lengths * np.sqrt(top), np.zeros((len(queries), 1))])
    for at in range(0, len(queries), 512):
        hit = index.candidates(probes[at : at + 512])
        hit[hit.sum(axis=1) <= k] = True  # too few to answer: such a query goes on through all buckets
        score = queries[at : at + 512] @ distinct.T
        score[~hit] = -np.inf
        out_q, out_v, out_s = [], [], []
        keep = min(k + 1, score.shape[1])
        bound = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
        for r in range(len(score)):
            near = np.flatnonzero((score[r] >= bound[r] - 1e-9 * abs(bound[r])) & hit[r])
            if not len(near):
                continue
            # the score of record: a plain sum in order of components, the same in every shard and for equal vectors
            exact = np.array([float(np.dot(queries[at + r], distinct[c])) for c in near])
            rows = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in near])
            s = np.repeat(exact, starts[near + 1] - starts[near])
            v = ids[rows]
            other = v != query_ids[at + r]
            best = np.lexsort((v[other], -s[other]))[:k]
            out_q.append(np.full(len(best), query_ids[at + r]))
            out_v.append(v[other][best])
            out_s.append(s[other][best])
        if out_q:
            yield pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector as doubles; without null ids or vectors, null or non-finite components, zero or empty vectors."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by inner product, ties to the smaller vec_id.

    Every usable row is indexed. Vectors that are null, zero, empty or hold a
    null or non-finite component take no part, nor do rows without id; a query is
    compared with candidates of its own length only. Repeated ids are candidates
    once each per distinct vector. A query id with several vectors asks with each,
    and its rows are the nearest to any of them, a pair of score and vec_id once. Every query meets every shard in blocks, so no
    hot bucket gathers in one task; a task holds SHARD_VECTORS vectors and
    BLOCK_QUERIES queries. Empty tables give an empty result; other columns are
    ignored.
    """
    v, q = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    n_vectors, n_queries = v.count(), q.count()
    shards, blocks = max(1, -(-n_vectors // SHARD_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))
    h = F.xxhash64("vec_id")
    side = lambda df, own, n_own, other, n_other, is_query: df.select(
        F.pmod(h, F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), "vec_id", "vector", F.lit(is_query).alias("is_query")
    ).select("shard", "block", "vec_id", "vector", "is_query")
    both = side(v, "shard", shards, "block", blocks, False).unionByName(side(q, "block", blocks, "shard", shards, True))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        out = [none]
        for _, same in pdf.groupby(pdf["vector"].map(len)):
            mine, theirs = same[~same["is_query"]], same[same["is_query"]]
            if len(mine) and len(theirs):
                out.extend(nearest_in_shard(mine["vec_id"].to_numpy(), np.vstack(mine["vector"].to_list()), theirs["vec_id"].to_numpy(), np.vstack(theirs["vector"].to_list()), k))
        return pd.concat(out) if len(out) > 1 else none

    found = both.groupBy("shard", "block").applyInPandas(one, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
