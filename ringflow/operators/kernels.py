"""Plain algorithms over a graph of bounded size, given as arrays, for one task each.

Plans of joins call them once what is left of a graph is small; how small is
checked there. Vertices are numbered by rising id, so a smallest number is a
smallest id.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def in_one_task(df: DataFrame, work: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``work`` over all rows of a small table of longs: its columns as arrays give the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in work(*(c.to_numpy() for c in table.columns)).items()})

    return df.repartition(1).mapInArrow(run, schema)


def numbers(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids, and both ends as places in them."""
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return ids, place[: len(src)], place[len(src) :]


def neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Where each vertex's neighbours begin (one more entry at the end), and all neighbours."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()


def trimmed(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """Vertices left when those without a way in or without a way out are taken away, over and over."""
    ids, a, b = numbers(src, dst)
    n = len(ids)
    (out_at, out_to), (in_at, in_to) = neighbours(a, b, n), neighbours(b, a, n)
    n_out, n_in = np.bincount(a, minlength=n).tolist(), np.bincount(b, minlength=n).tolist()
    gone = [not (i and o) for i, o in zip(n_in, n_out, strict=True)]
    todo = [v for v in range(n) if gone[v]]
    while todo:
        v = todo.pop()
        for at, to, degree in ((out_at, out_to, n_in), (in_at, in_to, n_out)):
            for u in to[at[v] : at[v + 1]]:
                degree[u] -= 1
                if not degree[u] and not gone[u]:
                    gone[u] = True
                    todo.append(u)
    return {"id": ids[~np.array(gone, bool)]}


def peeled(src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Vertices taken away while they have no way in and one way out, what that leads to, and how many lie behind; ``size`` belongs to src."""
    ids, a, b = numbers(src, dst)
    n = len(ids)
    at, to = neighbours(a, b, n)
    n_in = np.bincount(b, minlength=n).tolist()
    held = np.zeros(n, np.int64)
    held[a] = size
    held = held.tolist()
    todo = [v for v in range(n) if not n_in[v] and at[v + 1] - at[v] == 1]
    out: tuple[list[int], list[int], list[int]] = [], [], []
    while todo:
        v = todo.pop()
        u = to[at[v]]
        for column, x in zip(out, (v, u, held[v]), strict=True):
            column.append(x)
        held[u] += held[v] + 1
        n_in[u] -= 1
        if not n_in[u] and at[u + 1] - at[u] == 1:
            todo.append(u)
    v, u, size = (np.array(x, np.int64) for x in out)
    return {"id": ids[v], "parent": ids[u], "size": size}


def strong_components(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """The smallest id of each vertex's component, by one depth-first pass with a stack of its own."""
    ids, a, b = numbers(src, dst)
    n = len(ids)
    at, to = neighbours(a, b, n)
    todo = at[:-1]
    number, low, label, place = [-1] * n, [0] * n, [-1] * n, [0] * n
    waiting: list[int] = []
    count = 0
    for root in range(n):
        path = [root] if number[root] < 0 else []
        while path:
            v = path[-1]
            if number[v] < 0:
                number[v] = low[v] = count
                count += 1
                place[v] = len(waiting)
                waiting.append(v)
            if todo[v] < at[v + 1]:
                u = to[todo[v]]
                todo[v] += 1
                if number[u] < 0:
                    path.append(u)
                elif label[u] < 0 and number[u] < low[v]:
                    low[v] = number[u]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                members = waiting[place[v] :]
                del waiting[place[v] :]
                least = min(members)
                for u in members:
                    label[u] = least
    return {"id": ids, "scc": ids[np.array(label, np.int64)]}


def weak_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's component, directions ignored; roots hook onto smaller ones, so rounds are logarithmic."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def weak_parts(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """The smallest id of each vertex's component, directions ignored."""
    ids, a, b = numbers(src, dst)
    return {"id": ids, "part": ids[weak_components(a, b, len(ids))]}


class ShortestPaths:
    """Shortest paths from many sources at once, over the vertices that they reach.

    Distances are a table of vertices and sources, lowered a row of sources at a time
    until no edge lowers any; edges that then are tight, taken by rising distance of
    their ends, carry path counts forth and dependencies back.
    """

    #: Pairs of a source and a vertex that are kept at once, about 100 bytes each, and sources at once.
    PAIRS, COLUMNS = 1 << 21, 1 << 9
    #: Pairs whose paths are followed at once for scores, and how many times PAIRS their distances alone may be.
    FOLLOWED, WIDER = 1 << 18, 4
    #: Pairs whose distances are lowered together, so that they stay in a core's cache.
    NEAR = 1 << 17
    #: Types of distances, and from where on each can't tell them from what isn't reached; the next type is taken then.
    WIDTHS = ((np.int16, 1 << 14), (np.int32, 1 << 30), (np.int64, 1 << 62))

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.ids, a, b = numbers(src, dst)
        n = len(self.ids)
        order = np.argsort(a, kind="stable")
        begin = np.searchsorted(a[order], np.arange(n + 1))
        # a vertex's ways on are edges begin to end, each shorter by what the vertex is deep
        self.begin, self.end, self.deep = begin[:-1], begin[1:], np.zeros(n, np.int64)
        self.tail, self.to, self.weight = a[order].astype(np.int32), b[order].astype(np.int32), weight[order].astype(np.int64)
        self.part = weak_components(a, b, n)
        # at a component's smallest vertex: its vertices, or edges if these are more than two a vertex
        self.size = np.maximum(np.bincount(self.part, minlength=n), np.bincount(self.part[a], minlength=n) // 2)
        self.place = np.zeros(n, np.int64)  # scratch

    def _edges(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges on from vertices: the vertex's place in ``v``, the edge's place."""
        many = self.end[v] - self.begin[v]
        which = np.repeat(np.arange(len(v)), many)
        return which, np.arange(len(which)) + (self.begin[v] - np.cumsum(many) + many)[which]

    def _blocks(self, sources: np.ndarray, wider: int = 1) -> Iterator[np.ndarray]:
        """Places in ``sources``, by component, as many at once as PAIRS allows, ``wider`` times; only small components stand together."""
        pairs = self.PAIRS * wider
        order = np.argsort(self.part[sources], kind="stable")
        parts = self.part[sources[order]]
        cuts = np.r_[np.flatnonzero(np.diff(parts, prepend=-1)), len(parts)].tolist()
        lo, span = 0, 0
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            size = int(self.size[parts[begin]])
            if begin > lo and (end - lo > self.COLUMNS or (end - lo) * (span + size) > pairs or max(span, size) > pairs // self.COLUMNS):
                yield order[lo:begin]
                lo, span = begin, 0
            span += size
            step = 1 << max(1, min(self.COLUMNS, pairs // span)).bit_length() - 1
            while end - lo > step:
                yield order[lo : lo + step]
                lo, span = lo + step, size
        if lo < len(order):
            yield order[lo:]

    def _followed(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, "Searched"]]:
        """Places in ``sources``, some at a time, and their searches."""
        for block in self._blocks(sources, self.WIDER):
            found = self._search(sources[block])
            step = max(1, self.FOLLOWED // len(found.v))
            for lo in range(0, len(block), step):
                yield block[lo : lo + step], found.of(lo, min(lo + step, len(block)))

    def _search(self, sources: np.ndarray) -> "Searched":
        front, found = np.unique(sources), []
        self.place[front] = 1
        while len(front):
            found.append(front)
            to = self.to[self._edges(front)[1]]
            front = np.unique(to[self.place[to] == 0])
            self.place[front] = 1
        v = np.concatenate(found)
        which, edge = self._edges(v)
        # rows by falling number of ways in, so that the k-th way into each is a run of rows
        n_in = np.bincount(self._placed(v, self.to[edge]), minlength=len(v))
        by = np.argsort(-n_in, kind="stable")
        row = np.empty(len(v), np.int64)
        row[by] = np.arange(len(v))
        b = row[self.place[self.to[edge]]]
        order = np.argsort(b, kind="stable")
        a, b, w = row[which][order], b[order], (self.weight[edge] - self.deep[v[which]])[order]
        at = row[self.place[sources]]
        self.place[v] = 0
        for kind, far in self.WIDTHS:
            if not len(w) or w.max() < far:
                dist = self._lowered(a, w.astype(kind), n_in[by], at, kind, far)
                if not ((dist[a] < far) & (dist[b] == far)).any():
                    return Searched(v[by], a, b, w.astype(kind), at, dist, far, self.tail[edge[order]])
        raise OverflowError("distances of 2^62 and more")

    def _placed(self, v: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.place[v] = np.arange(len(v))
        return self.place[to]

    def _lowered(self, a: np.ndarray, w: np.ndarray, n_in: np.ndarray, at: np.ndarray, kind: type, far: int) -> np.ndarray:
        """Distances of (row, source); edges (a, w) lie by the row they lead to, of which row i has ``n_in[i]``, at most those of the row before."""
        n = len(n_in)
        width = 1 << (len(at) - 1).bit_length()
        dist = np.full((n, width), far, kind)
        dist[at, np.arange(len(at))] = 0
        begin = np.cumsum(n_in) - n_in
        layers = []
        step = max(64, self.NEAR // width)
        for lo in range(0, n, step):
            for k in range(n_in[lo]):
                edge = begin[lo : lo + step][n_in[lo : lo + step] > k] + k
                layers.append((slice(lo, lo + len(edge)), a[edge], w[edge][:, None]))
        lowered = True
        while lowered:
            lowered = False
            for rows, came_from, by in layers:
                come = dist[came_from]
                come += by
                lowered = lowered or bool((come < dist[rows]).any())
                np.minimum(dist[rows], come, out=dist[rows])
        return dist

    def scores(self, sources: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Betweenness of all vertices over paths from ``sources`` (places), each counted ``times``; and how many vertices each source reaches."""
        return HungPaths(self).scores(sources, times)

    def scores_by_rows(self, sources: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``scores``, with a row for every vertex and a search for every source; a score is 0 only where no path passes, as nothing is taken off again."""
        score, reached = np.zeros(len(self.ids)), np.zeros(len(sources), np.int64)
        for block, found in self._followed(sources):
            near = found.dist < found.far
            reached[block] = np.count_nonzero(near, axis=0) - 1
            steps = found.steps(found.tight())
            ways = found.ways(steps)
            total = found.dependencies(near, ways, steps)
            total -= np.divide(near, ways, out=np.zeros(ways.shape), where=near)  # its own share: what leads nowhere is left with 0
            total *= ways
            total[found.at, np.arange(len(block))] = 0.0
            score[found.v] += total @ times[block]
        return score, reached

    def distances(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(source, vertex, distance) of all pairs that ``sources`` (places) reach, themselves included, some sources at a time, by vertex."""
        for block in self._blocks(sources):
            found = self._search(sources[block])
            row, column = found.pairs()
            yield self.ids[sources[block]][column], self.ids[found.v][row], found.dist[row, column].astype(np.int64)

    def path_edges(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(source, u, v) of all edges on shortest paths from ``sources`` (places), by edge; parallel ones repeat."""
        for block in self._blocks(sources):
            found = self._search(sources[block])
            edge, column = np.nonzero(found.tight())
            ids = self.ids[found.v]
            yield self.ids[sources[block]][column], ids[found.a][edge], ids[found.b][edge]

    def counts(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(source, vertex, number of shortest paths) of the pairs of ``distances``."""
        for block in self._blocks(sources):
            found = self._search(sources[block])
            row, column = found.pairs()
            yield self.ids[sources[block]][column], self.ids[found.v][row], found.ways(found.steps(found.tight()))[row, column]


class Searched:
    """Distances from some sources (columns) of the vertices ``v`` (rows) that they reach, and the edges (a, b, w) between those."""

    def __init__(self, v: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, at: np.ndarray, dist: np.ndarray, far: int, tail: np.ndarray):
        self.v, self.a, self.b, self.w, self.at, self.dist, self.far, self.tail = v, a, b, w, at, dist, far, tail

    def of(self, lo: int, hi: int) -> "Searched":
        """The search of some columns alone."""
        return Searched(self.v, self.a, self.b, self.w, self.at[lo:hi], np.ascontiguousarray(self.dist[:, lo:hi]), self.far, self.tail)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all pairs that are reached, by row: a file then holds a vertex once for a run of sources, and the same sources over and over."""
        return np.nonzero(self.dist < self.far)

    def tight(self) -> np.ndarray:
        """Whether an edge lies on a shortest path, for edges and columns."""
        come, best = self.dist[self.a], self.dist[self.b]
        come += self.w[:, None]
        return (come == best) & (best < self.far)

    def steps(self, tight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tight edges as places of pairs, from and to, in layers that don't lead on within themselves, sources first; all ways into a pair share a layer."""
        width, edge, many = self.dist.shape[1], np.arange(len(self.w)), np.count_nonzero(tight, axis=1)
        to = np.flatnonzero(tight)
        source = to + np.repeat((self.a - edge) * width, many)
        to += np.repeat((self.b - edge) * width, many)
        # pairs that lead nowhere are taken off as long as many go at once
        ends = []
        while len(to):
            leads = np.zeros(self.dist.size, bool)
            leads[source] = True
            on = leads.take(to)  # places and take, here and below: masks cost several times that
            if 4 * np.count_nonzero(on) > 3 * len(on):
                break
            off, on = np.flatnonzero(~on), np.flatnonzero(on)
            ends.append((source.take(off), to.take(off)))
            source, to = source.take(on), to.take(on)
        # the rest by rising distance
        far = self.dist.ravel().take(to)
        order = np.argsort(far, kind="stable")
        source, to, far = source[order], to[order], far[order]
        cuts = [0, *(np.flatnonzero(far[1:] != far[:-1]) + 1).tolist(), len(far)] if len(far) else [0]
        return [(source[lo:hi], to[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)] + ends[::-1]

    def ways(self, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of shortest paths of all pairs, 0 where there is none."""
        near = self.dist < self.far
        ways = near.astype(float)
        if sum(len(to) for _, to in steps) == np.count_nonzero(near) - len(self.at):
            return ways  # one way into each
        flat, several, last = ways.ravel(), np.zeros(ways.size, bool), np.empty(ways.size, np.int32)
        for source, to in steps:
            # pairs with several ways in, and what lies behind such pairs
            number = np.arange(len(to), dtype=np.int32)
            last[to] = number
            more = last.take(to) != number
            more |= several.take(source)
            more = to.take(np.flatnonzero(more))
            if len(more):
                several[more] = True
                some = np.flatnonzero(several.take(to))
                source, to = source.take(some), to.take(some)
                flat[to] = 0.0
                np.add.at(flat, to, flat.take(source))
        return ways

    def dependencies(self, ends: np.ndarray, ways: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For every path to a pair, the sum of ``ends`` of the pairs on from there, its own included, each counted once for every way on."""
        # a share of paths is ways(vertex) / ways(end) for every path on, so ends / ways(end) add up along all of them
        total = np.divide(ends, ways, out=np.zeros(ways.shape), where=ways > 0)
        flat = total.ravel()
        for source, to in reversed(steps):
            np.add.at(flat, source, flat.take(to))
        return total


class Trees:
    """Vertices ``below`` that each hang from one of ``above``, of n; rings are cut at a vertex that then hangs from nothing."""

    def __init__(self, below: np.ndarray, above: np.ndarray, n: int):
        self.some, a, b = numbers(above, below)  # vertices of trees; what follows is over these alone
        m = len(self.some)
        order = np.argsort(a, kind="stable")
        # arrays, not lists: their numbers are no objects that a worker keeps memory for
        kids, at, top, walk = (array("i", x.astype(np.int32).tobytes()) for x in (b[order], np.searchsorted(a[order], np.arange(m + 1)), np.arange(m), a[:0]))
        hangs = np.zeros(m, bool)
        hangs[b] = True
        seen = bytearray((~hangs).tobytes())
        for tops, ring in ((np.flatnonzero(~hangs), False), (b, True)):
            for v in array("i", tops.astype(np.int32).tobytes()):
                if ring and seen[v]:
                    continue
                seen[v] = True
                todo = [v]
                while todo:
                    x = todo.pop()
                    walk.append(x)
                    for u in kids[at[x] : at[x + 1]]:
                        if not seen[u]:
                            seen[u], top[u] = True, v
                            todo.append(u)
        self.top = np.arange(n, dtype=np.int32)
        self.top[self.some] = self.some[np.frombuffer(top, np.int32)]
        before = np.arange(m)
        before[b] = a
        order = np.frombuffer(walk, np.int32)
        #: All that hang, from above, and what each hangs from.
        self.walk = order[self.top[self.some[order]] != self.some[order]]
        self.before = before[self.walk].astype(np.int32)
        # a vertex and all below it are one run of places
        self.place = np.full(n, -1, np.int32)
        self.place[self.some[order]] = np.arange(m)
        self.place[self.place < 0] = np.arange(m, n)
        self.size = self.gathered(np.ones(n)).astype(np.int32)

    def gathered(self, x: np.ndarray) -> np.ndarray:
        """Sums of ``x`` over each vertex and all that hang below it."""
        return self._summed(x, self.walk[::-1], self.before[::-1])

    def carried(self, x: np.ndarray) -> np.ndarray:
        """Sums of ``x`` over each vertex and all that it hangs from."""
        return self._summed(x, self.before, self.walk)

    def _summed(self, x: np.ndarray, come: np.ndarray, go: np.ndarray) -> np.ndarray:
        total = array("d" if x.dtype.kind == "f" else "q", x[self.some].tobytes())
        for v, u in zip(*(array("i", c.tobytes()) for c in (come, go)), strict=True):
            total[u] += total[v]
        out = x.copy()
        out[self.some] = np.frombuffer(total, x.dtype)
        return out

    def below(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Whether v is u or hangs below it."""
        return (self.place[u] <= self.place[v]) & (self.place[v] < self.place[u] + self.size[u])


class HungPaths(ShortestPaths):
    """Shortest paths over the vertices that have more than one way in; the others hang from what leads to them.

    A vertex with one way in is reached through the vertex before alone, so it needs
    no row: it is one more end at the root of its tree, and its ways on are ways on of
    all that it hangs below, longer by the path down to it. Only as a source has it a
    row of its own.

    A source with one way on then needs no search either: it hangs from what that way
    leads to, whose search stands for it, over and over, up to a vertex with more ways on.
    """

    def __init__(self, whole: ShortestPaths):
        self.ids, self.part, self.place, self.PAIRS, self.COLUMNS = whole.ids, whole.part, whole.place, whole.PAIRS, whole.COLUMNS
        n, tail, to = len(whole.ids), whole.tail, whole.to
        only = np.flatnonzero(np.bincount(to, minlength=n)[to] == 1)
        self.ends = ends = Trees(to[only], tail[only], n)
        length = np.zeros(n, np.int64)
        length[to[only]] = whole.weight[only]
        length[ends.top == np.arange(n)] = 0
        self.deep = ends.carried(length)
        kept = np.flatnonzero(ends.top[to] == to)
        kept = kept[np.argsort(ends.place[tail[kept]], kind="stable")]
        self.tail, self.to, self.weight = tail[kept], to[kept], whole.weight[kept] + self.deep[tail[kept]]
        first = ends.place[self.tail]
        self.begin, self.end = (np.searchsorted(first, x).astype(np.int32) for x in (ends.place, ends.place + ends.size))
        one = np.flatnonzero(self.end - self.begin == 1)
        one = one[self.to[self.begin[one]] != one]
        self.starts = Trees(one, self.to[self.begin[one]], n)
        rows = np.bincount(self.part[np.unique(self.to)], minlength=n) + np.minimum(np.bincount(self.part, minlength=n), self.COLUMNS)
        self.size = np.maximum(rows, np.bincount(self.part[self.tail], minlength=n) // 2)

    def scores(self, sources: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, starts = len(self.ids), self.starts
        members, hangs = self.ends.size.astype(float), self.ends.top != np.arange(n)
        many = np.bincount(sources, times, minlength=n)
        lots = starts.gathered(many)  # of sources below a vertex, itself included, that all take its ways on
        # sources and what they hang from, by the search that stands for them
        group = np.flatnonzero(lots)
        group = group[np.argsort(starts.top[group], kind="stable")]
        search, at = np.unique(starts.top[group], return_index=True)
        upto = np.r_[at[1:], len(group)]
        root = self.ends.top[group]
        # a source that hangs below what it is a source for: all that hangs there is left out for that already
        twice = hangs[group] & starts.below(group, root)
        # paths through a vertex, and through edges that leave one that hangs; sources that reach a root; ends of a search
        score, flow, come, full = (np.zeros(n) for _ in range(4))
        hit = group == search[np.repeat(np.arange(len(search)), upto - at)]  # whether the search reaches the root, here of itself
        hit &= ~hangs[group]
        come[search] = lots[search]
        full[search] = np.where(hangs[search], 0.0, members[search])
        busy = np.flatnonzero(self.end[search] > self.begin[search])
        come[search[busy]] = 0.0
        for block, found in self._followed(search[busy]):
            block = busy[block]
            s, column = search[block], np.arange(len(block))
            v, at_row = found.v, found.at
            near = found.dist < found.far
            sizes = np.where(hangs[v], 0.0, members[v])
            ends = near.astype(float)
            full[s] = sizes @ ends
            come[v] += ends @ lots[s]
            long = upto[block] - at[block]
            which = np.repeat(column, long)
            place = np.arange(len(which)) + (at[block] - np.cumsum(long) + long)[which]
            self.place[v] = np.arange(1, len(v) + 1)
            row = self.place[root[place]] - 1
            self.place[v] = 0
            hit[place] = (row >= 0) & near[row, which]
            # what hangs below a source, or below what it hangs from, is reached from there
            some = np.flatnonzero(hit[place] & ~twice[place])
            x = group[place[some]]
            ends *= lots[s]
            ends *= sizes[:, None]
            np.subtract.at(ends, (row[some], which[some]), members[x] * np.where(hangs[x], many[x], lots[x]))
            tight = found.tight()
            steps = found.steps(tight)
            ways = found.ways(steps)
            total = found.dependencies(ends, ways, steps)
            some = np.flatnonzero(hangs[found.tail])
            through = ways[found.a[some]] * total[found.b[some]]
            through *= tight[some]
            np.add.at(flow, found.tail[some], through.sum(axis=1))
            total *= ways
            total -= ends
            total[at_row, column] = 0.0
            score[v] += total.sum(axis=1)
        # ends beyond the search's source, for each source that hangs from it
        core = ~hangs
        reach, far = np.zeros(n), np.zeros(n)
        reach[group] = hit
        on = members * core
        past = starts.carried(on) - on  # what hangs from the vertices between a source and its search's, that one included
        far[group] = full[starts.top[group]] - (starts.carried(on * reach))[group] - np.where(hangs[group] & ~twice & hit, members[group], 0.0)
        # what hangs below a source that itself hangs below a vertex between is no end on the way to that vertex
        back = np.zeros(n)
        back[group[twice]] = members[group[twice]]
        leave = many * (far - back)
        np.add.at(leave, root[twice], (many * back)[group[twice]])
        ahead = starts.gathered(leave) + lots * past  # paths that leave a vertex, from all sources below it
        ahead[lots == 0] = 0.0
        score[core] += (ahead - many * (far + past))[core]
        below = group[starts.top[group] != group]
        np.add.at(flow, self.tail[self.begin[below]], ahead[below])
        flow[hangs] -= ahead[hangs]
        come[core] += (lots * (1 - reach))[core]
        own = np.zeros(n, bool)
        own[group] = hit | twice | ~hangs[group]
        held, lost = np.where(own, many, 0.0), np.where(own, 0.0, many)
        # to what hangs below: from all that reach the root or stand between, but from below only to what does not hang from the source
        under = self.ends.gathered(held * members) - held * members
        score += (members - 1) * (come[self.ends.top] - held + self.ends.carried(lost) - lost) - under
        score[hangs] += self.ends.gathered(flow)[hangs]
        return score, (members + past + far - back)[sources].astype(np.int64) - 1


def same_search(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Vertices whose search another's stands for in ``scores``, and that vertex."""
    graph = HungPaths(ShortestPaths(src, dst, weight))
    hung = np.flatnonzero(graph.starts.top != np.arange(len(graph.ids)))
    return {"id": graph.ids[hung], "search": graph.ids[graph.starts.top[hung]]}
