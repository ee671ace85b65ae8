"""Plain Python versions of the graph queries."""

from heapq import heappop, heappush


def cycles(edges, max_len, ratio, min_len=3):
    """All cycles as sorted (len, ids...) tuples by depth-first search."""
    out = {}
    for a, b, c in edges:
        if a != b:
            out.setdefault(a, []).append((b, c))
    found = []

    def walk(path, first, last):
        for n, c in out.get(path[-1], ()):
            if ratio and last is not None and not (last <= 5 * c and c <= 3 * last):
                continue
            if n == path[0]:
                if min_len <= len(path) <= max_len and (not ratio or (c <= 5 * first and first <= 3 * c)):
                    found.append((len(path), *path))
            elif n > path[0] and n not in path and len(path) < max_len:
                walk([*path, n], c if first is None else first, c)

    for s in out:
        walk([s], None, None)
    return sorted(found)


def betweenness(edges, sources=None):
    """Brandes with parallel edges as paths of their own."""
    out, ids = {}, set()
    for a, b, w in edges:
        ids |= {a, b}
        if a != b and w > 0:
            out.setdefault(a, []).append((b, w))
    score = dict.fromkeys(ids, 0.0)
    for s in sources if sources is not None else ids:
        dist, done, heap = {s: 0}, [], [(0, s)]
        while heap:
            d, u = heappop(heap)
            if d > dist[u] or u in done:
                continue
            done.append(u)
            for v, w in out.get(u, ()):
                if d + w < dist.get(v, 1 << 60):
                    dist[v] = d + w
                    heappush(heap, (d + w, v))
        sigma = dict.fromkeys(done, 0.0)
        sigma[s] = 1.0
        for u in done:
            for v, w in out.get(u, ()):
                if dist[u] + w == dist[v]:
                    sigma[v] += sigma[u]
        delta = dict.fromkeys(done, 0.0)
        for u in reversed(done):
            for v, w in out.get(u, ()):
                if dist[u] + w == dist[v]:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if u != s:
                score[u] += delta[u]
    return score


def peel(edges):
    """(id, parent, size) of chain peeling."""
    live = [(a, b) for a, b, *_ in edges]
    size = {x: 0 for e in live for x in e}
    out = []
    while True:
        ins, outs = {}, {}
        for a, b in live:
            outs.setdefault(a, []).append(b)
            ins[b] = ins.get(b, 0) + 1
        leaf = [a for a, bs in outs.items() if len(bs) == 1 and not ins.get(a)]
        if not leaf:
            return sorted(out)
        for a in leaf:
            out.append((a, outs[a][0], size[a]))
            size[outs[a][0]] += size[a] + 1
        live = [(a, b) for a, b in live if a not in leaf]


def scc(edges):
    reach = {}
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    for s in out:
        seen, todo = set(), [s]
        while todo:
            for n in out[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[s] = seen
    return {s: min([s, *[t for t in reach[s] if s in reach[t]]]) for s in out}
