"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of tokens: 1 takes a token, 0 ignores it. All
masks are hashed at every position of benchmark items and of documents; equal
hashes are joined, and around every hit the item is laid over the document at
that shift and compared token by token, so substituted tokens, wherever they
fall, do not hide a copy. An item counts as leaked if at least MIN_OVERLAP of
its tokens agree, summed over shifts, each token once, or if a passage of it
does: PASSAGE tokens in a row, PASSAGE_AGREED of which agree at one shift.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import WordHashes, filter_rows, id_text, map_rows, mix, utf8

# Spaced seeds of weight 5. For every pair of near substitutions one of them fits between.
SEEDS = ("11111", "1101101", "11001011", "101100101", "1010011001")
#: Items of up to SHORT tokens are met by every mask of as many ones: wherever five of their tokens agree, one of them fits.
SHORT = 8
SHORT_SEEDS = tuple(m for span in range(6, SHORT + 1) for ones in combinations(range(1, span - 1), 3) if (m := "".join("1" if k in (0, *ones, span - 1) else "0" for k in range(span))) not in SEEDS)
#: Share of an item's tokens that must stand in the document, in order at one shift or over several.
MIN_OVERLAP = 0.6
#: Tokens of a passage, and how many of them must agree; a passage leaks its item however long that is.
PASSAGE, PASSAGE_AGREED = 13, 11
#: Shifts compared for an item end where fewer tokens than this agree in a stretch of the item's length.
MIN_RUN = 5
#: Benchmark items handled in one pass over the documents: items, their tokens and their bytes at most; more of them take further passes.
CHUNK_ITEMS = 20_000
CHUNK_TOKENS = 4_000_000
CHUNK_BYTES = 32 << 20
#: Tokens of documents hashed together.
TOGETHER = 1 << 17
#: Hits of an item and a place that are weighed together (those of one document at least), and tokens compared at once.
HITS, COMPARED = 1 << 20, 1 << 22

# ASCII letters and digits and all non-ASCII bytes belong to tokens; everything else parts them.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def seed_hashes(h: np.ndarray, seed: str) -> np.ndarray:
    """One hash for each position where the mask fits."""
    n = len(h) - len(seed) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(seed), np.uint64)
    for k, bit in enumerate(seed):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


def passages(same: np.ndarray) -> list[tuple[int, int]]:
    """First and last passage (start, end) of one shift's agreement that reach PASSAGE_AGREED."""
    if len(same) < PASSAGE:
        return []
    total = np.concatenate([[0], np.cumsum(same)])
    at = np.flatnonzero(total[PASSAGE:] - total[:-PASSAGE] >= PASSAGE_AGREED)
    return [(int(p), int(p) + PASSAGE) for p in (at[0], at[-1])] if len(at) else []


def _distinct(doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows once each, in order."""
    order = np.lexsort((shift, item, doc))
    doc, item, shift = doc[order], item[order], shift[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], item[new], shift[new]


class SeedIndex:
    """Seed hashes of a bounded chunk of benchmark items, sorted, with a bitmap in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]]):
        self.hashes = WordHashes()
        self.items = [(i, h) for i, t in items if len(h := self.hashes.of(tokens(t)))]
        self.by_seed = []
        every = range(len(self.items))
        few = [n for n in every if min(map(len, SHORT_SEEDS)) <= len(self.items[n][1]) <= SHORT]
        for seed, numbers in [(s, every) for s in SEEDS] + [(s, few) for s in SHORT_SEEDS if few]:
            keys, owner, at = [], [], []
            for n in numbers:
                k = seed_hashes(self.items[n][1], seed)
                keys.append(k)
                owner.append(np.full(len(k), n))
                at.append(np.arange(len(k)))
            keys, owner, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, owner, at))
            order = np.argsort(keys, kind="stable")
            keys = keys[order].astype(np.uint64)
            bitmap = np.zeros(1 << self.BITS, bool)
            bitmap[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.by_seed.append((seed, bitmap, keys, owner[order].astype(np.int64), at[order].astype(np.int64)))
        self.size = np.array([len(h) for _, h in self.items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([h for _, h in self.items]) if self.items else np.empty(0, np.uint64)
        # items shorter than any seed can only be met whole
        self.short = {h.tobytes(): [] for _, h in self.items if len(h) < min(map(len, SEEDS))}
        for n, (_, h) in enumerate(self.items):
            if h.tobytes() in self.short:
                self.short[h.tobytes()].append(n)
        self.short_sizes = sorted({len(k) // 8 for k in self.short})

    def hits(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """document, place in it, seed, and range of equal keys of that seed, for all hits in documents laid end to end, by document."""
        found = []
        for number, (seed, bitmap, keys, *_) in enumerate(self.by_seed):
            own = seed_hashes(h, seed)
            near = np.flatnonzero(bitmap[(own >> np.uint64(64 - self.BITS)).view(np.int64)])
            lo, hi = np.searchsorted(keys, own[near], "left"), np.searchsorted(keys, own[near], "right")
            near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(ends, near, "right")
            inside = near + len(seed) <= ends[doc]  # a hit across two documents is none
            near, doc, lo, hi = near[inside], doc[inside], lo[inside], hi[inside]
            found.append((doc, near - starts[doc], np.full(len(doc), number), lo, hi))
        doc, place, seed, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(doc, kind="stable")
        return doc[order], place[order], seed[order], lo[order], hi[order]

    def shifts(self, doc: np.ndarray, place: np.ndarray, seed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, item and shift (document position minus item position) of all hits, each once."""
        parts = []
        total = np.cumsum(hi - lo)
        cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(HITS, total[-1], HITS)) + 1, len(total)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for number, (*_, owner, at) in enumerate(self.by_seed):
                mine = a + np.flatnonzero(seed[a:b] == number)
                n = hi[mine] - lo[mine]
                which = np.repeat(mine, n)
                key = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
                parts.append(_distinct(doc[which], owner[key], place[which] - at[key]))
        return _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def agreeing(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many tokens agree with each item laid over its document at its shift."""
        size = self.size[item]
        a, b = np.maximum(0, -shift), np.minimum(size, ends[doc] - starts[doc] - shift)
        n = b - a
        out = np.zeros(len(doc), np.int64)
        total = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, "right")))
            which = np.repeat(np.arange(at, to), n[at:to])
            k = np.arange(len(which)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to]) + a[which]
            same = self.flat[self.first[item[which]] + k] == h[starts[doc[which]] + shift[which] + k]
            out[at:to] = np.bincount(which - at, weights=same, minlength=to - at).astype(np.int64)
            at = to
        return out

    def candidates(self, docs: list[np.ndarray], min_overlap: float) -> Iterator[tuple[int, dict[int, list[int]]]]:
        """document, and the shifts of each item of which enough tokens agree, over all shifts or at one, to be looked at closely."""
        sizes = np.array([len(x) for x in docs], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        h = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        found = self.hits(h, starts, ends)
        doc, weight = found[0], found[4] - found[3]
        rows = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64), len(doc)]
        before = np.r_[0, np.cumsum(weight)][rows]
        lo = 0
        while lo < len(rows) - 1:
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + HITS, "right")) - 1)  # whole documents up to HITS hits, one at least
            part = slice(rows[lo], rows[hi])
            d, n, s = self.shifts(*(x[part] for x in found))
            same = self.agreeing(h, starts, ends, d, n, s)
            pair = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (n[1:] != n[:-1])])
            stop = np.r_[pair[1:], len(d)]
            enough = (np.add.reduceat(same, pair) >= min_overlap * self.size[n[pair]] - 1e-9) | (np.maximum.reduceat(same, pair) >= PASSAGE_AGREED)
            by_doc: dict[int, dict[int, list[int]]] = defaultdict(dict)
            for a, b in zip(pair[enough].tolist(), stop[enough].tolist(), strict=True):
                by_doc[int(d[a])][int(n[a])] = s[a:b].tolist()
            yield from by_doc.items()
            lo = hi

    def scan(self, texts: list[str | None], min_overlap: float) -> list[tuple[int, int, int, int, int, float]]:
        """(text's index, item_id, start, end, tokens agreed, share) of the items leaked into the texts."""
        found, docs, first = [], [], 0
        held = 0
        for k, text in enumerate(texts):
            docs.append(self.hashes.of(tokens(text)))
            held += len(docs[-1])
            if held >= TOGETHER or k == len(texts) - 1:
                for d, by_item in self.candidates(docs, min_overlap):
                    found.extend((first + d, *x) for x in self.overlaps(docs[d], by_item, min_overlap))
                for d, h in enumerate(docs if self.short_sizes else []):
                    found.extend((first + d, *x) for x in self.whole_short(h))
                docs, first, held = [], k + 1, 0
        return found

    def overlaps(self, h: np.ndarray, by_item: dict[int, list[int]], min_overlap: float) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, end, tokens agreed, share) of the items leaked into one document."""
        found = []
        for n, shifts in by_item.items():
            item_id, item = self.items[n]
            m = len(item)
            # copies of an item stand apart; shifts within half its length belong to one copy
            runs: list[list[int]] = []
            for s in sorted(shifts):
                if runs and s - runs[-1][-1] <= m // 2:
                    runs[-1].append(s)
                else:
                    runs.append([s])
            best = None
            for run in runs:
                agreed, lo, hi = np.zeros(m, bool), None, 0
                first, last = None, 0  # of the passages
                for s in run:
                    a, b = max(0, -s), min(m, len(h) - s)
                    same = item[a:b] == h[a + s : b + s]
                    if same.sum() >= min(MIN_RUN, m):
                        agreed[a:b] |= same
                        lo, hi = min(a + s, lo if lo is not None else a + s), max(hi, b + s)
                        for p, q in passages(same):
                            first, last = min(a + s + p, first if first is not None else a + s + p), max(last, a + s + q)
                share = agreed.mean()
                if share >= min_overlap:
                    leak = (item_id, lo, hi, int(agreed.sum()), float(share))
                elif first is not None:
                    leak = (item_id, first, last, int(agreed.sum()), float(share))
                else:
                    continue
                if best is None or share > best[4]:
                    best = leak
            if best:
                found.append(best)
        return found

    def whole_short(self, h: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """The same for items shorter than any seed, which must stand in the document whole."""
        found = []
        for size in self.short_sizes:
            seen = set()
            for p in range(len(h) - size + 1):
                key = h[p : p + size].tobytes()
                if key in self.short and key not in seen:
                    seen.add(key)
                    found.extend((self.items[n][0], p, p + size, size, 1.0) for n in self.short[key])
        return found


def benchmark_chunks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (item_id, text), each bounded by CHUNK_ITEMS items, CHUNK_TOKENS tokens and CHUNK_BYTES bytes (or one item)."""
    chunk, held, size = [], 0, 0
    rows = benchmark.select(benchmark[id_col].cast("long").alias("i"), benchmark[text_col].cast("string").alias("t")).where(F.col("t").isNotNull()).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        n, b = len(tokens(r["t"])), len(utf8(r["t"]))
        if chunk and (len(chunk) >= CHUNK_ITEMS or held + n > CHUNK_TOKENS or size + b > CHUNK_BYTES):
            yield chunk
            chunk, held, size = [], 0, 0
        chunk.append((r["i"], r["t"]))
        held, size = held + n, size + b
    if chunk:
        yield chunk


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, agreed, share: one row for each document row and item leaked into it.

    start and end are token positions of the best copy, or of the passages where
    less than ``min_overlap`` of the item agrees; agreed and share count the whole
    item. The benchmark is taken in
    chunks of proven size, each broadcast for one pass over the documents; no
    document leaves its task. Null, empty or token-less texts and items match
    nothing; items of fewer tokens than a seed are met whole, and of any other item
    five tokens at least must agree. Null ids stay null;
    repeated document rows give repeated results, repeated items one. Empty
    tables give an empty result; other columns are ignored.
    """
    d = id_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, start long, end long, agreed long, share double"
    out = None
    for chunk in benchmark_chunks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(chunk)

        def make(shared=shared):
            index = SeedIndex(shared.value)

            def work(rows: dict) -> dict:
                cols: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
                for k, *found in index.scan(rows["text"], min_overlap):
                    for c, v in zip(cols, (rows["doc_id"][k], *found), strict=True):
                        cols[c].append(v)
                return cols

            return work

        part = map_rows(d, make, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` (with a column text and any others) without the rows that hold an item, as ``find_leaks`` finds them.

    All columns stay; null, empty and token-less texts stay; repeated rows share one
    fate; empty tables give an empty result or all of ``docs``. Nothing is shuffled.
    """
    for chunk in benchmark_chunks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(chunk)

        def make(shared=shared):
            index = SeedIndex(shared.value)

            def keep(texts: list) -> list[bool]:
                leaked = {k for k, *_ in index.scan(texts, min_overlap)}
                return [k not in leaked for k in range(len(texts))]

            return keep

        docs = filter_rows(docs, make)
    return docs
