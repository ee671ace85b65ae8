"""Helpers shared by the operators that work on whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once inside a task.
SLICE_BYTES = 8 << 20
#: Distinct words a worker remembers before it starts anew.
CACHE_WORDS = 1 << 18


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands batches of about SLICE_BYTES to Python, unless a lower bound is set.

    A batch stands several times in a task at once: in buffers that double as they grow,
    in what is sent, and in the worker. Rows come in the same order, whatever the bound.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < held <= SLICE_BYTES:
        conf.set(key, str(SLICE_BYTES))
    return df


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives back what its allocators hold: it lives on for later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()  # what Python's objects have left in malloc

    return wrapped


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about SLICE_BYTES of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over slices: ``make()`` runs once a task and returns the function dict of lists -> dict of columns."""
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                out = work(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return bounded_batches(df).mapInArrow(releasing(run), struct)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text") -> DataFrame:
    """The rows whose text the function keeps, all their columns as they are; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(keep(part.column(text).to_pylist()), pa.bool_()))

    return bounded_batches(df).mapInArrow(releasing(run), df.schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; whatever else the table has can't clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the text of a null id is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for CACHE_WORDS distinct words at most."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, a bijection on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` consecutive word hashes; log2(length) passes, by doubling."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    # run[i] covers `have` words from i; powers of two are joined to reach `length`
    out, got = None, 0
    run, have = words, 1
    left = length
    while left:
        if left & 1:
            if out is None:
                out, got = run, have
            else:
                n = min(len(out), len(run) - got)
                out = out[:n] * np.uint64(pow(base, have, 1 << 64)) + run[got : got + n]
                got += have
        left >>= 1
        if left:
            n = len(run) - have
            run = run[:n] * np.uint64(pow(base, have, 1 << 64)) + run[have:]
            have *= 2
    return mix(out[: len(words) - length + 1])
