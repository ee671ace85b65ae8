"""Columns of any name beside those an operator reads, and tables without rows, through every stage of the pipeline."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from ringflow.llm import near_dedup, secrets, substring_dedup
from tests.llm import cases
from tests.llm.test_text_operators import digests, order

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
NAMES = "_id _name _spans _mark again mark name key row chunk chunks spans start stop kind n bytes id comp node bin a b part uid length shard island elites sequence_id proxy word df".split()


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)]).repartition(3)


def rows():
    base = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    return base + [(901, "x token=abcdefghijklmnopq y", None, None, 3), (902, None, None, None, None), (None, "", None, None, None), (901, "x token=abcdefghijklmnopq y", None, None, 3)]


def test_pipeline_with_clashing_columns(spark, tmp_path):
    docs = clashing(spark, rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "secrets":
            kept = [r for r in docs.collect() if r["doc_id"] == 901]
            assert [r["text"] for r in kept] == ["x [REDACTED] y"]
            assert all(r[c] == i for r in kept for i, c in enumerate(NAMES))
    assert docs.count() > 40


def test_pipeline_without_documents(spark, tmp_path):
    docs = clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / name))


def test_operators_with_clashing_columns(spark):
    docs = clashing(spark, rows())
    plain = docs.select("doc_id", "text")
    text = lambda df: sorted(map(str, df.collect()))
    for run in (secrets.scan_secrets, near_dedup.group_near_duplicates, substring_dedup.remove_repeats):
        assert text(run(docs)) == text(run(plain))


def test_copies_of_hot_rows(spark):
    """Rows that repeat often answer for themselves and still stand against other texts."""
    long, short = " ".join(f"p{i}" for i in range(50)), "a b c"
    docs = [(1, long)] * 30 + [(2, short)] * 30 + [(None, long + " x")] * 30 + [(3, "q " + long), (4, " ".join(f"p{i}" for i in range(20, 60))), (5, " ".join(f"z{i}" for i in range(90))), (6, None), (7, "")] + [(None, None)] * 25
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = digests(substring_dedup.remove_repeats(df, hot_rows=10))
    assert got == order(cases.removed(docs))
