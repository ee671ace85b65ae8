"""Account names of a few characters link as others do."""

from ringflow.llm import secrets


def test_short_identifiers_link(spark):
    rows = [(1, "username=admin password=hunter2"), (2, "user_id: 42 then token=abc123"), (3, "login=bob alone"), (4, "login=root password=x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["linked"] for r in secrets.scan_secrets(docs).collect()}
    assert got == {1: "identifier:0:14,weak_secret:15:31", 2: "identifier:0:11,weak_secret:17:29", 3: "", 4: ""}
    left = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert left == {1: "[REDACTED] [REDACTED]", 2: "[REDACTED] then [REDACTED]", 3: rows[2][1], 4: rows[3][1]}
