"""Packing of token pieces into sequences by a grouping genetic algorithm on islands.

A solution is a set of bins (sequences). Crossover injects whole well-filled bins
of one parent into the other, removes the bins that now hold duplicates, and
best-fits the documents this displaces. Pieces are dealt into shards of bounded
size; each shard is solved by several islands, separate tasks with populations of
their own, whose elites migrate to the next island between epochs. Sequences that a
shard has filled are final; what lies in its other sequences goes to the next level
and is dealt anew, until one shard holds the rest. So room isn't lost shard by shard.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, write_table
from ._text import id_text, map_rows

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, about; islands a shard; epochs between which elites migrate; generations of an epoch.
SHARD_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 10
POPULATION = 4
ELITES = 2
#: Share of a shard's pieces that may go on to the next level, those of the emptiest sequences first; so levels shrink.
OPEN_SHARE = 0.25
#: Longest white-space part that the fast path takes and that is remembered, and how many are.
FAST_PART = 256
CACHE_PARTS = 1 << 19


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose lower case, composition and class are the same in Python's tables and the tokenizer's (a test tries all).
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u024f]+")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _u32(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


class WordBpe(dict):
    """The tokenizer's ids of texts, white-space part by white-space part, each part's remembered as bytes (little-endian u32).

    The file's normalizer (NFC, lower case) and pattern never reach across white
    space, so parts can be encoded alone, and the tokenizer does so. Parts of ASCII
    and precomposed Latin letters alone take a shorter way: merges of this file come
    in the order of their ids, so merging the adjacent pair of lowest id gives the
    same result, which a byte-pair core does fast. Texts with special tokens or
    control separators go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.core = None
        suffix = model.get("end_of_word_suffix")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if suffix and ids == sorted(ids):
            import tiktoken

            byte = {c: b for b, c in self._byte_letters().items()}
            mark = b"\xff"  # stands for the end of a word; UTF-8 has no such byte
            ranks = {}
            for token, i in model["vocab"].items():
                if token not in self.special:
                    body, end = (token[: -len(suffix)], mark) if token.endswith(suffix) and token != suffix else (token, b"")
                    ranks[bytes(byte[c] for c in body) + end] = i
            self.core = tiktoken.Encoding("word_bpe", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable letter that byte-level files write for each byte."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def by_tokenizer(self, text: str) -> bytes:
        return _u32(self.whole.encode(text, add_special_tokens=False).ids)

    def __missing__(self, part: str) -> bytes:
        if len(part) > FAST_PART:
            return self.by_tokenizer(part)
        if len(self) >= CACHE_PARTS:
            self.clear()
        if self.core is not None and (part.isascii() and part.isalpha() or _PLAIN.fullmatch(part)):
            low, encode = part.lower(), self.core.encode_single_piece
            if low.isalpha():  # one word of the pattern
                out = _u32(encode(low.encode() + b"\xff"))
            else:
                out = b"".join([_u32(encode(w.encode() + b"\xff")) for w in self.pattern.findall(low)])
        else:
            out = self.by_tokenizer(part)
        self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.by_tokenizer(text)
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a handle ``uid`` that no two rows share, repeated ones neither; to be written once and read from there."""
    path = path or tokenizer_path()

    def make():
        bpe = WordBpe(path)
        end = np.array([END_ID], "<u4").tobytes()
        first, seen = TaskContext.get().partitionId() << 33, 0

        def work(rows: dict) -> dict:
            nonlocal seen
            out: dict[str, list] = {c: [] for c in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = bpe.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at : at + 4 * CAPACITY]
                    seen += 1
                    out["uid"].append(first + seen)
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
            return out

        return work

    return map_rows(id_text(docs, id_col, text_col), make, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Genetic search over one shard. A solution is a list of bins, each a list of item numbers."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        self.least = -(-sum(sizes) // capacity)  # no solution has fewer bins

    def load(self, b: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, b))

    def wasted(self, bins: list[list[int]]) -> int:
        """Room in all bins but the emptiest; 0 is best, as then no other solution leaves less."""
        room = [self.capacity - self.load(b) for b in bins]
        return sum(room) - max(room)

    def fitness(self, bins: list[list[int]]) -> tuple[int, int]:
        """Fewer bins first; among equals, all room in one bin."""
        return -len(bins), -self.wasted(bins)

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Put each item where it leaves the least room; a new bin if it fits nowhere."""
        bins = [list(b) for b in bins]
        room = sorted((self.capacity - self.load(b), k) for k, b in enumerate(bins))
        for i in items:
            need = self.sizes[i]
            at = bisect_left(room, (need, -1))
            if at < len(room):
                left, k = room.pop(at)
                bins[k].append(i)
            else:
                left, k = self.capacity, len(bins)
                bins.append([i])
            if left > need:
                insort(room, (left - need, k))
        return bins

    def first(self, spread: float) -> list[list[int]]:
        """Best fit over sizes falling, disturbed by ``spread``."""
        key = {i: s * (1 + spread * (self.rng.random() - 0.5)) for i, s in enumerate(self.sizes)}
        return self.best_fit([], sorted(key, key=lambda i: (-key[i], i)))

    def exchange(self, bins: list[list[int]], items: list[int]) -> tuple[list[list[int]], list[int]]:
        """Swap displaced items for smaller ones (or pairs) that leave a bin fuller; what is displaced gets smaller and fits more easily."""
        sizes = self.sizes
        out, waiting = [], sorted(items, key=sizes.__getitem__)
        keys = [sizes[i] for i in waiting]
        for b in bins:
            room = self.capacity - self.load(b)
            if room and waiting:
                swaps = [(j,) for j in b] + [(j, k) for x, j in enumerate(b) for k in b[x + 1 :]]
                begin = self.rng.randrange(len(swaps))
                for swap in swaps[begin:] + swaps[:begin]:
                    freed = sum(sizes[j] for j in swap)
                    at = bisect_left(keys, freed + room + 1) - 1  # the largest that fits in place of ``swap``
                    if at >= 0 and keys[at] > freed:
                        b = [j for j in b if j not in swap] + [waiting.pop(at)]
                        keys.pop(at)
                        for j in swap:
                            k = bisect_left(keys, sizes[j])
                            keys.insert(k, sizes[j])
                            waiting.insert(k, j)
                        break
            out.append(b)
        return out, sorted(waiting, key=lambda i: (-sizes[i], i))

    def crossover(self, one: list[list[int]], two: list[list[int]]) -> list[list[int]]:
        """Well-filled bins of ``two`` go into ``one`` whole; bins of ``one`` that share an item with them are dissolved."""
        own = set(map(frozenset, one))
        full = [b for b in sorted(two, key=self.load, reverse=True)[: max(1, len(two) // 2)] if frozenset(b) not in own]
        injected = [b for b in full if self.rng.random() < 0.3] or full[:1]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in one:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in taken]
        return self.best_fit(*self.exchange(kept + injected, displaced))

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Dissolve the emptiest bins and a few others, and refit what they held."""
        order = sorted(range(len(bins)), key=lambda k: self.load(bins[k]))
        gone = set(order[: max(1, len(bins) // 50)]) | {self.rng.randrange(len(bins)) for _ in range(max(1, len(bins) // 50))}
        items = [i for k in gone for i in bins[k]]
        return self.best_fit(*self.exchange([b for k, b in enumerate(bins) if k not in gone], items))

    def evolve(self, elites: list[list[list[int]]], generations: int, population: int) -> list[list[list[int]]]:
        if not self.sizes:
            return [[]]
        scored = lambda bins: (self.fitness(bins), bins)
        best = (-self.least, 0)  # no solution has fewer sequences or less room in all but one of them
        herd = [scored(bins) for bins in elites or [self.first(0.0)]]
        while len(herd) < population and herd[0][0] < best:
            herd.append(scored(self.first(0.1 * len(herd))))
        herd.sort(key=lambda x: x[0], reverse=True)
        for _ in range(generations):
            if herd[0][0] >= best:
                break
            one, two = self.rng.sample(herd, 2) if len(herd) > 1 else (herd[0], herd[0])
            herd += [scored(self.crossover(one[1], two[1])), scored(self.mutate(herd[0][1]))]
            herd = sorted(herd, key=lambda x: x[0], reverse=True)[:population]
        return [bins for _, bins in herd]

    def unfinished(self, bins: list[list[int]], share: float) -> list[int]:
        """Numbers of the bins with room, the emptiest first, as far as they hold at most ``share`` of all items."""
        out, held = [], 0
        for room, k in sorted(((self.capacity - self.load(b), k) for k, b in enumerate(bins)), key=lambda x: (-x[0], x[1])):
            held += len(bins[k])
            if not room or held > share * len(self.sizes):
                break
            out.append(k)
        return out


def _encode(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<u4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _decode(solution: bytes) -> list[list[int]]:
    owner = np.frombuffer(solution, "<u4")
    if not len(owner):
        return []
    order = np.argsort(owner, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)]


def _level(items: DataFrame, shards: int, level: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """uid, length, sequence_id, offset, open: one level's solution; ``open`` rows are to be dealt anew."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64(F.col("uid"), F.lit(level)), F.lit(shards)).alias("shard"))
    problem = write_table(
        dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x")).select("shard", F.col("x.uid").alias("uid"), F.col("x.length").alias("length"), F.explode(F.array(*map(F.lit, range(islands)))).alias("island")),
        "shards",
    )
    schema = "shard long, island int, bins int, wasted long, elites array<binary>"

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    packer = Packer(r["length"], capacity, hash((level, r["shard"], r["island"], number)))
                    herd = packer.evolve([_decode(e) for e in r["elites"] or []], generations, POPULATION)
                    bins, wasted = packer.fitness(herd[0])
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([r["shard"]], pa.int64()), "island": pa.array([r["island"]], pa.int32()), "bins": pa.array([-bins], pa.int32()), "wasted": pa.array([-wasted], pa.int64()), "elites": pa.array([[_encode(h, len(r["length"])) for h in herd[:ELITES]]], pa.list_(pa.binary()))}
                    )

        return run

    # searches take long for their few bytes, so small shuffles must not be merged into one task
    tasks = min(shards * islands, max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * islands // 16))
    spread = lambda df: df.repartition(tasks, "shard", "island")
    state = write_table(spread(problem).select("shard", "island", "length", F.lit(None).cast("array<binary>").alias("elites")).mapInArrow(epoch(0), schema), "islands")
    for number in range(1, epochs):
        # each island keeps its elites and gets those of the island before it
        own = state.select("shard", "island", F.col("elites").alias("own"))
        come = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elites").alias("come"))
        ready = problem.select("shard", "island", "length").join(own, ["shard", "island"]).join(come, ["shard", "island"])
        nxt = write_table(spread(ready.select("shard", "island", "length", F.array_distinct(F.concat("own", "come")).alias("elites"))).mapInArrow(epoch(number), schema), "islands")
        drop_table(state)
        state = nxt
    best = state.groupBy("shard").agg(F.min(F.struct("bins", "wasted", "island", "elites")).alias("b")).select("shard", F.col("b.elites")[0].alias("solution"))
    share = OPEN_SHARE if shards > 1 else 0.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins = _decode(r["solution"])
                unfinished = set(Packer(r["length"], capacity, 0).unfinished(bins, share))
                uid, size, seq, off, again = [], [], [], [], []
                for k, b in enumerate(bins):
                    at = 0
                    for i in b:
                        uid.append(r["uid"][i])
                        size.append(r["length"][i])
                        seq.append((level << 56) + (r["shard"] << 24) + k)
                        off.append(at)
                        again.append(k in unfinished)
                        at += r["length"][i]
                yield pa.RecordBatch.from_pydict({"uid": pa.array(uid, pa.int64()), "length": pa.array(size, pa.int32()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(off, pa.int64()), "open": pa.array(again, pa.bool_())})

    placed = problem.where("island = 0").select("shard", "uid", "length").join(best, "shard").mapInArrow(place, "uid long, length int, sequence_id long, offset long, open boolean")
    placed = write_table(placed, "placed")
    drop_table(problem, state)
    return placed


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """uid, sequence_id, offset for a table (uid, length); no length is above ``capacity``.

    A shard is chosen by hash of uid, so it is of bounded size whatever ids or
    texts repeat. Each level passes at most OPEN_SHARE of its pieces on, so there
    are logarithmically many. ``uid`` repeats nowhere; lengths are from 1 to
    ``capacity``; an empty table gives an empty result.
    """
    out, level, rest = None, 0, items
    while True:
        shards = max(1, -(-rest.count() // shard_pieces))
        placed = _level(rest, shards, level, capacity, islands, epochs, generations)
        final = placed.where("NOT open").select("uid", "sequence_id", "offset")
        out = final if out is None else out.unionByName(final)
        if shards == 1:
            return out
        rest, level = placed.where("open").select("uid", "length"), level + 1


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Null and repeated ids
    and repeated rows are packed each for itself; an empty table gives an empty
    result; other columns are ignored. Texts are tokenized whole; only documents
    above CAPACITY tokens are cut.
    """
    cut = write_table(pieces(docs, path, id_col, text_col), "pieces")
    placed = pack(cut.select("uid", F.col("length").cast("int").alias("length")))
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
