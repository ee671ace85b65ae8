"""What a task holds at once, and what its worker keeps afterwards."""

import pyarrow as pa
from pyspark.sql import functions as F

from ringflow.llm import _text, toxicity

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})


def test_python_gets_batches_of_a_slice(spark):
    spark.conf.unset(KEY)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 10000)").alias("text"))
    try:
        kept = _text.filter_rows(docs, lambda: lambda texts: [True] * len(texts))
        sizes = docs.mapInArrow(_sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in sizes) == 3000 and max(r["bytes"] for r in sizes) < _text.SLICE_BYTES + 100_000
        assert [r["doc_id"] for r in kept.select("doc_id").collect()] == list(range(3000))
        spark.conf.set(KEY, "1m")  # a lower bound stays
        _text.bounded_batches(docs)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.unset(KEY)


def test_sample_needs_no_python_on_executors(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))

    def refuse(*args, **kwargs):
        raise AssertionError("rows of Python start workers of their own on the executors")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    assert sorted(toxicity.training_rows(docs, labels)) == sorted((f"text {i}", i % 2) for i in range(40))


def test_worker_gives_back_what_allocators_hold(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(_text, "pa", type("pa", (), {"default_memory_pool": Pool, "system_memory_pool": Pool}))
    assert list(_text.releasing(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4] and len(calls) == 2
    stopped = _text.releasing(lambda batches: iter(batches))([1, 2])
    next(stopped)
    stopped.close()
    assert len(calls) == 4
