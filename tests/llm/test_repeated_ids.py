"""Near-duplicates where ids repeat, with the same text and with others."""

import collections

from ringflow.llm import near_dedup


def words(prefix, n=40):
    return " ".join(f"{prefix}{i}" for i in range(n))


T, U = words("t"), words("u")
NEAR_U = U.replace("u39", "other")
ROWS = [
    (1, T, "a"), (5, T, "b"), (5, U, "c"), (7, NEAR_U, "d"),
    (8, words("r"), "e"), (8, words("r"), "f"), (9, words("s"), "g"), (9, words("s").replace("s39", "other"), "h"),
    (11, "", "i"), (11, "", "j"), (11, None, "k"), (None, T, "l"), (None, T, "m"),
]


def test_each_text_of_an_id_follows_its_own(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(3)
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.group_near_duplicates(docs).collect())
    assert got == collections.Counter({
        (1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 1, (7, 5, False): 1, (8, 8, True): 1, (8, 8, False): 1, (9, 9, True): 1, (9, 9, False): 1,
        (11, 11, True): 2, (11, 11, False): 1, (None, None, True): 2,
    })


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(3)
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    nines = [t for i, t in left if i == 9]
    assert len(nines) == 1
    assert left == collections.Counter({(1, T): 1, (5, U): 1, (8, words("r")): 1, (9, nines[0]): 1, (11, ""): 1, (11, None): 1, (None, T): 2})
