"""Exact substring dedup by level-wise doubling.

A window of WINDOW words that occurs twice consists of shorter windows that occur
twice. So windows of about half the length (and half of that, down to BASE) are
counted first; only where they repeat are windows of twice that length counted,
until the full length is reached or no candidate survives. Below the full length
it is enough to count one shorter window inside each full one, and it is chosen
by content (the smallest hash), so equal windows choose alike and a fraction of
all positions is sent.

Hashes travel as compressed arrays, one row for each slice of text and bucket;
what repeats comes back as positions, grouped as the texts are. Rows that repeat
very often, id and text, are not grouped: all their windows are known to repeat, so
each answers for itself, and one of them stands for all towards other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, write_table
from ._text import WordHashes, id_text, slices, utf8, window_hashes

WINDOW = 35
#: Windows of this length or less are not halved further.
BASE = 18
#: Text bytes of a group, and of the texts behind a bucket, about.
GROUP_BYTES = 24 << 20
#: Repetitions of a row beyond which its copies aren't grouped, and how many such rows there may be (16 bytes each are broadcast).
HOT_ROWS = 1000
HOT_KEYS = 100_000

CANDIDATES = "bucket int, keys binary, data binary"
REPEATS = "part int, data binary"
TEXTS = "part int, keys binary, data binary"


def levels(window: int, base: int = BASE) -> list[int]:
    """Window lengths, each at most twice the one before, the last being ``window``."""
    out = [window]
    while out[0] > base:
        out.insert(0, -(-out[0] // 2))
    return out


def choose(h: np.ndarray, count: int) -> np.ndarray:
    """For each run of ``count`` hashes the position of its smallest, the leftmost of equals."""
    at, span = np.arange(len(h)), 1
    while span * 2 <= count:
        a, b = at[:-span], at[span:]
        at, span = np.where(h[a] <= h[b], a, b), span * 2
    n = len(h) - count + 1
    a, b = at[:n], at[count - span : count - span + n]
    return np.where(h[a] <= h[b], a, b)


def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a.tobytes()) for a in arrays]], "<u8")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, "<u8", 1 + len(kinds))
    out, at = [], head.nbytes
    for size, kind in zip(head[1:].tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def row_key(doc_id: int | None, text: bytes) -> int:
    """Rows of one key repeat each other in id and text, so what holds for one holds for all."""
    return xxhash.xxh3_64_intdigest(text, seed=(hash(doc_id) if doc_id is not None else 0x5EED) & 0xFFFFFFFFFFFFFFFF)


class Level:
    """Candidates of one level: which positions of a document are to be counted, and their hashes."""

    def __init__(self, window: int, length: int, before: int | None, buckets: int):
        self.window, self.length, self.before, self.buckets = window, length, before, buckets
        self.last = length == window

    def positions(self, words: np.ndarray, repeated: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions to count and the hashes of all windows of this length; ``repeated``: positions that repeat one level below."""
        h = window_hashes(words, self.length)
        if len(words) < self.window:
            return np.empty(0, np.int64), h
        if repeated is None:
            alive = np.ones(len(words) - self.window + 1, bool)
        else:
            below = window_hashes(words, self.before)
            again = np.zeros(len(below), bool)
            again[repeated] = True
            alive = again[choose(below, self.window - self.before + 1)]
        if self.last:
            return np.flatnonzero(alive), h
        return np.unique(choose(h, self.window - self.length + 1)[alive]), h

    def rows(self, docs: list[tuple[int, np.ndarray, np.ndarray | None]]) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, keys, data) for documents given as key, word hashes, repeated positions.

        data: hashes (two arrays), then document and position of each, followed by
        those of windows that are already known to repeat.
        """
        hashes, second, owner, at, keys = [], [], [], [], []
        for key, words, repeated in docs:
            pos, h = self.positions(words, repeated)
            if len(pos):
                hashes.append(h[pos])
                if self.last:  # 32 more bits, so that chance equality stays out at any size
                    second.append((window_hashes(words ^ np.uint64(0xA5A5A5A5A5A5A5A5), self.length, 0xD6E8FEB86659FD93)[pos] >> np.uint64(32)).astype("<u4"))
                owner.append(np.full(len(pos), len(keys), "<u4"))
                at.append(pos.astype("<u4"))
                keys.append(key)
        if not keys:
            return
        h, own, pos, keys = np.concatenate(hashes), np.concatenate(owner), np.concatenate(at), np.array(keys, "<u8")
        more = np.concatenate(second) if self.last else None
        # equal windows of one slice: all of them are known to repeat, and one goes on to meet other slices
        order = np.lexsort((more, h)) if self.last else np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if self.last:
            same &= more[order][1:] == more[order][:-1]
        sent = np.sort(order[np.r_[True, ~same]])
        known = np.sort(order[np.r_[False, same] | np.r_[same, False]])
        bucket = (((h[sent] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        present, cuts = np.unique(bucket[by], return_index=True)
        cuts = np.r_[cuts, len(by)]
        shares = np.linspace(0, len(known), len(present) + 1).astype(int)  # they need no bucket of their own
        for k, b in enumerate(present.tolist()):
            pick, told = sent[by[cuts[k] : cuts[k + 1]]], known[shares[k] : shares[k + 1]]
            every = np.concatenate([pick, told])
            used, local = np.unique(own[every], return_inverse=True)
            yield b, keys[used].tobytes(), _squeeze(h[pick].astype("<u8"), more[pick] if self.last else np.empty(0, "<u4"), local.astype("<u4"), pos[every])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_CANDIDATE_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])
_REPEAT_SCHEMA = pa.schema([("part", pa.int32()), ("data", pa.binary())])
_TEXT_SCHEMA = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])


def first_candidates(docs: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [(i, utf8(t)) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                yield _batch(list(level.rows([(row_key(i, t), hashes.of(t.split()), None) for i, t in raw])), _CANDIDATE_SCHEMA)

    return docs.mapInArrow(run, CANDIDATES)


def repeats(candidates: DataFrame, last: bool, parts: int) -> DataFrame:
    """Positions whose window occurs more than once, by part (key modulo ``parts``)."""

    def run(table: pa.Table) -> pa.Table:
        h, more, key, pos, told = [], [], [], [], []
        for keys, data in zip(table.column("keys").to_pylist(), table.column("data").to_pylist(), strict=True):
            a, b, own, at = _unsqueeze(data, "<u8", "<u4", "<u4", "<u4")
            own = np.frombuffer(keys, "<u8")[own]
            h.append(a)
            more.append(b)
            key.append(own[: len(a)])
            pos.append(at[: len(a)])
            told.append((own[len(a) :], at[len(a) :]))
        h, key, pos = np.concatenate(h), np.concatenate(key), np.concatenate(pos)
        if last:
            more = np.concatenate(more)
            order = np.lexsort((more, h))
            same = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
        else:
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
        again = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        key, pos = np.concatenate([key[again], *[k for k, _ in told]]), np.concatenate([pos[again], *[p for _, p in told]])
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((pos, key, part))
        key, pos, part = key[order], pos[order], part[order]
        present, cuts = np.unique(part, return_index=True)
        out = []
        for p, lo, hi in zip(present.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            k, n = np.unique(key[lo:hi], return_counts=True)
            out.append((p, _squeeze(k, n.astype("<u4"), pos[lo:hi].astype("<u4"))))
        return pa.Table.from_batches([_batch(out, _REPEAT_SCHEMA)])

    return candidates.groupBy("bucket").applyInArrow(run, REPEATS)


#: Kinds of rows: without id, with one, and one that stands for many copies.
BARE, NAMED, PROXY = 0, 1, 2


def texts_by_part(docs: DataFrame, parts: int) -> DataFrame:
    """Compressed texts with their keys and ids, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                by: dict[int, list[tuple[int, int | None, bool, bytes]]] = {}
                for i, proxy, t in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "proxy", "text")), strict=True):
                    t = utf8(t)
                    k = row_key(i, t)
                    by.setdefault(k % parts, []).append((k, i, proxy, t))
                out = []
                for p, rows in by.items():
                    kind = np.array([PROXY if proxy else i is not None for _, i, proxy, _ in rows], "u1")
                    ids = np.array([i or 0 for _, i, *_ in rows], "<i8")
                    sizes = np.array([len(t) for *_, t in rows], "<u8")
                    text = np.frombuffer(b"".join(t for *_, t in rows), "u1")
                    out.append((p, np.array([k for k, *_ in rows], "<u8").tobytes(), _squeeze(kind, ids, sizes, text)))
                yield _batch(out, _TEXT_SCHEMA)

    return docs.mapInArrow(run, TEXTS)


def _documents(texts: pa.Table, found: pa.Table) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
    """key, kind, id, text and repeated positions of each document of a part."""
    positions: dict[int, list[np.ndarray]] = {}
    for data in found.column("data").to_pylist():
        keys, n, pos = _unsqueeze(data, "<u8", "<u4", "<u4")
        for k, x in zip(keys.tolist(), np.split(pos, np.cumsum(n)[:-1]), strict=True):
            positions.setdefault(k, []).append(x)
    none = np.empty(0, "<u4")
    for keys, data in zip(texts.column("keys").to_pylist(), texts.column("data").to_pylist(), strict=True):
        kinds, ids, sizes, text = _unsqueeze(data, "u1", "<i8", "<u8", "u1")
        at = 0
        for k, kind, i, size in zip(np.frombuffer(keys, "<u8").tolist(), kinds.tolist(), ids.tolist(), sizes.tolist(), strict=True):
            x = positions.get(k)
            yield k, kind, i, text[at : at + size].tobytes(), np.unique(np.concatenate(x)) if x else none
            at += size


def next_candidates(texts: DataFrame, found: DataFrame, level: Level) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = WordHashes()
        rows, held, docs = [], 0, []
        for k, _, _, text, repeated in _documents(left, right):
            if len(repeated):
                docs.append((k, hashes.of(text.split()), repeated))
                held += len(docs[-1][1])
            if held > 1 << 21:
                rows.extend(level.rows(docs))
                docs, held = [], 0
        rows.extend(level.rows(docs))
        return pa.Table.from_batches([_batch(rows, _CANDIDATE_SCHEMA)])

    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, CANDIDATES)


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(doc_id: int | None, words: list[bytes], spans: list[dict[str, int]]) -> tuple:
    """A row of the result: the words outside of ``spans``."""
    kept, at = [], 0
    for s in spans:
        kept += words[at : s["start"]]
        at = s["end"]
    kept += words[at:]
    return doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans


def _result(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for _, kind, doc_id, text, repeated in _documents(left, right):
            if kind == PROXY:
                continue
            spans: list[dict[str, int]] = []
            if len(repeated):
                gap = np.flatnonzero(np.diff(repeated.astype(np.int64)) > window)
                starts, stops = repeated[np.r_[0, gap + 1]].tolist(), (repeated[np.r_[gap, len(repeated) - 1]] + window).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(starts, stops, strict=True)]
            rows.append(_cut(doc_id if kind == NAMED else None, text.split(), spans))
        return pa.Table.from_batches([_batch(rows, _RESULT_SCHEMA)])

    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, RESULT)


def _copies(docs: DataFrame, window: int) -> DataFrame:
    """The result's rows for texts that other rows repeat as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = utf8(t).split()
                    rows.append(_cut(i, words, [{"start": 0, "end": len(words)}] if len(words) >= window else []))
                yield _batch(rows, _RESULT_SCHEMA)

    return docs.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed.

    A word is a run of characters other than ASCII space and \\t to \\r. Words are
    removed that lie in a window of ``window`` words which also starts at another
    place of the table, repeated rows included; ``removed`` holds their ranges,
    in words. All windows are judged on the input. Null and empty texts have no
    words. Null and repeated ids are kept, each row by its own text; an empty
    table gives an empty result; other columns are ignored.
    """
    d = id_text(docs, id_col, text_col).withColumn("proxy", F.lit(False))
    spark = docs.sparkSession
    total, n = d.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // GROUP_BYTES))
    # one key of both hashes tells rows of equal id and text from all others
    keyed = d.withColumn("a", F.xxhash64("doc_id", "text")).withColumn("b", F.xxhash64("text", F.lit("copy"), "doc_id"))
    hot = write_table(keyed.groupBy("a", "b").count().where(F.col("count") > max(hot_rows, n // HOT_KEYS)).select("a", "b"), "hot")
    copies = None
    if hot.limit(1).count():
        often = keyed.join(F.broadcast(hot), ["a", "b"], "left_semi")
        proxies = often.groupBy("a", "b").agg(F.first(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "x.text", F.lit(True).alias("proxy"))
        d = keyed.join(F.broadcast(hot), ["a", "b"], "left_anti").select("doc_id", "text", "proxy").unionByName(proxies)
        copies = _copies(often.select("doc_id", "text"), window)
    texts = texts_by_part(d, parts)
    found, before = None, None
    for length in levels(window, base):
        level = Level(window, length, before, parts)
        candidates = first_candidates(d, level) if found is None else next_candidates(texts, found, level)
        below, found = found, write_table(repeats(candidates, level.last, parts), "repeats")
        if below is not None:
            drop_table(below)
        before = length
        if not found.limit(1).count():
            break  # no candidate survives
    out = _result(texts, found, window)
    return out if copies is None else out.unionByName(copies)


def oracle_sql(window: int = WINDOW) -> str:
    """The same over all windows as lists of words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT rid, unnest(range(1, len(ws) - {window - 2})) AS i, ws FROM d WHERE len(ws) >= {window}),
h AS MATERIALIZED (SELECT rid, i, md5(array_to_string(ws[i : i + {window - 1}], ' ')) AS h FROM k),
again AS (SELECT rid, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING COUNT(*) > 1)),
c AS (SELECT x.rid, x.i, x.word, COUNT(again.i) OVER (PARTITION BY x.rid ORDER BY x.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM x LEFT JOIN again ON x.rid = again.rid AND x.i = again.i),
g AS (SELECT rid, COUNT(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(COALESCE(g.n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(g.kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.rid = g.rid
"""
