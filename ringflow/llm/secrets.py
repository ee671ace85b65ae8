"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong findings are reported as they stand. Parts that prove little alone - a
short value assigned to a secret's name, an account name, an address - are weak
candidates: all parts of a document meet in an interval join over scopes of SCOPE
code points, and a weak candidate is reported only where parts that complement
it co-occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import write_table

# The base kinds, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
# the runs of [0-9a-f]+ that are long enough, without listing all others
HEX = f"[0-9a-f]{{{MIN_HEX},}}"

#: Weak parts. A weak secret is an assigned value of MIN_WEAK or more but fewer than MIN_ASSIGN characters; an identifier may be of any length.
IDENTIFIER = r"""(?i)(user_?name|user_?id|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
ENDPOINT = r"""(?i)(https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://([A-Za-z0-9+/_.@:?&=%-]+)"""
MIN_WEAK = 6
#: Code points between the starts of two parts of one credential.
SCOPE = 200

KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")

SPAN = "array<struct<start:int,kind:int,stop:int,size:int>>"


#: Findings whose places are added up together; lists of more are cut, so that no long list is copied at every finding.
BLOCK = 256
#: Marks around findings; those of the text give way to a third one, which has the same length and fits no pattern either.
START, PART, OTHER = "\x01", "\x02", "\x03"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Matches of ``pattern``, leftmost and not overlapping, with the length of ``group``.

    One pass marks them, then lengths add up to places: first over blocks of
    findings, then inside each.
    """
    clean = F.when(text.contains(START) | text.contains(PART), F.translate(text, START + PART, OTHER + OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, pattern, f"{START}$0{PART}${group}{PART}"), START, -1)
    empty = F.array().cast(SPAN)

    def hits(p: Column) -> Column:
        cut = F.transform(F.slice(p, 2, F.size(p)), lambda x: F.split(x, PART, -1))
        return F.transform(cut, lambda x: F.struct(F.length(x[0]).alias("long"), F.length(x[1]).alias("size"), F.length(x[2]).alias("gap")))

    def begins(blocks: Column, first: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["long"] + x["gap"])
        step = lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(blocks, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def places(block: Column, begin: Column) -> Column:
        one = lambda acc, x: F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["long"]).alias("stop"), x["size"].alias("size"))
        step = lambda acc, x: F.struct((acc["at"] + x["long"] + x["gap"]).alias("at"), F.concat(acc["out"], F.array(one(acc, x))).alias("out"))
        return F.aggregate(block, F.struct(begin.alias("at"), empty.alias("out")), step)["out"]

    def whole(p: Column) -> Column:
        cut = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / BLOCK).cast("int")), lambda i: F.slice(h, i * BLOCK + 1, F.lit(BLOCK)))
        placed = lambda blocks: F.flatten(F.zip_with(blocks, begins(blocks, F.length(p[0])), places))
        return F.when(F.size(p) > 1, _let(hits(p), lambda h: _let(cut(h), placed))).otherwise(empty)

    return _let(pieces, whole)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def _scan(docs: DataFrame, scope: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, name (the text's hash), the lists assign, access and hex, and ``linked``, those that linking has added."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = d.select(
        "doc_id",
        F.xxhash64("text").alias("name"),
        F.length("text").alias("long"),
        _spans(F.col("text"), ASSIGN, 0, 2).alias("assigned"),
        _spans(F.col("text"), ACCESS, 1, 0).alias("access"),
        _spans(F.col("text"), HEX, 2, 0).alias("hex"),
        _spans(F.col("text"), IDENTIFIER, 3, 2).alias("identifier"),
        _spans(F.col("text"), ENDPOINT, 5, 2).alias("endpoint"),
    ).select(
        "doc_id",
        "name",
        "long",
        F.filter("assigned", lambda s: s["size"] >= MIN_ASSIGN).alias("assign"),
        F.filter("access", lambda s: s["size"] >= MIN_ACCESS).alias("access"),
        "hex",
        "identifier",
        F.transform(F.filter("assigned", lambda s: (s["size"] >= MIN_WEAK) & (s["size"] < MIN_ASSIGN)), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["stop"].alias("stop"), s["size"].alias("size"))).alias("weak_secret"),
        "endpoint",
    )
    found = write_table(found, "secrets")
    weak = F.concat("identifier", "weak_secret", "endpoint")
    # only texts that hold a weak part and something to complement it go into the join; texts that repeat go once
    parts = (
        found.where((F.size(weak) > 0) & (F.size(weak) + F.size("assign") + F.size("access") > 1))
        .select("doc_id", "name", "long", F.explode(F.concat(weak, "assign", "access")).alias("s"))
        .select("doc_id", "name", "long", "s.start", "s.kind", "s.stop", "s.size")
        .distinct()
        .withColumn("bin", F.floor(F.col("start") / scope))
    )
    is_id, is_secret, is_endpoint = F.col("o_kind").isin(1, 3), F.col("o_kind").isin(0, 4), F.col("o_kind") == 5
    other = parts.select(
        F.col("doc_id").alias("o_id"), F.col("name").alias("o_name"), F.col("long").alias("o_long"), F.col("start").alias("o_start"), F.col("kind").alias("o_kind"),
        F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("o_bin"),
    )
    met = (
        parts.where("kind >= 3")
        .join(other, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("name") == F.col("o_name")) & (F.col("long") == F.col("o_long")) & (F.col("bin") == F.col("o_bin")) & (F.abs(F.col("start") - F.col("o_start")) <= scope))
        .groupBy("doc_id", "name", "long", "start", "kind", "stop", "size")
        .agg(F.max(is_id).alias("id"), F.max(is_secret).alias("secret"), F.max(is_endpoint).alias("place"))
        .where(F.when(F.col("kind") == 3, F.col("secret")).when(F.col("kind") == 4, F.col("id") | F.col("place")).otherwise(F.col("id") & F.col("secret")))
    )
    linked = met.groupBy("doc_id", "name", "long").agg(F.collect_list(F.struct("start", "kind", "stop", "size")).alias("linked"))
    a, b = found.alias("a"), linked.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.long") == F.col("b.long")), "left").select("a.*", F.coalesce("b.linked", F.array().cast(SPAN)).alias("linked"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, linked.

    ``spans`` lists kind:start:end of all findings by start, then kind; ``linked``
    those that linking has added. A weak identifier needs a secret within
    ``scope``; a weak secret an identifier or an endpoint; an endpoint both an
    identifier and a secret. Strong findings count as identifiers (access) and
    secrets (assign). A null text counts as empty. Null ids and repeated ids or
    rows are kept, each by its own text; an empty table gives an empty result;
    other columns are ignored. Parts meet in bins of ``scope`` code points of one
    text, so no text, however long, is compared part by part.
    """
    every = _scan(docs, scope, id_col, text_col)
    base = F.concat("assign", "access", "hex")
    return every.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "linked")).alias("spans"),
        _joined(F.col("linked")).alias("linked"),
    )


MARK = "[REDACTED]"
#: Code points of a text that are redacted at once.
CHUNK = 4096


def redact_chunk(chunk: Column, begin: Column, spans: Column) -> Column:
    """The part of a text that starts at ``begin``, with ``spans`` (start, stop; those that reach into it) replaced by MARK where they start. Overlapping spans merge."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substr(chunk, acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(MARK))).alias("out"),
    )
    end = lambda e: F.concat(e["out"], F.substr(chunk, e["at"] - begin + 1, F.lit(CHUNK)))
    return F.when(spans.isNull(), chunk).otherwise(_let(F.aggregate(F.array_sort(spans), F.struct(begin.alias("at"), F.lit("").alias("out")), step), end))


#: Findings that may be broadcast, in bytes; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` (columns doc_id, text and any others, whatever their names) with all findings replaced by MARK.

    Rows without findings, null and empty texts among them, stay as they were, and
    so do all other columns. Rows of null or repeated ids are redacted each by its
    own text. A text is redacted in chunks, each with the findings that reach into
    it, so the work grows with the text's length. An empty table gives an empty result.
    """
    spans = _scan(docs, scope, "doc_id", "text").select("doc_id", "name", F.explode(F.concat("assign", "access", "hex", "linked")).alias("s")).select("doc_id", "name", "s.start", "s.stop").distinct()
    chunks = F.sequence(F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("stop") - 1) / CHUNK).cast("int"))
    by_chunk = spans.withColumn("chunk", F.explode(chunks)).groupBy("doc_id", "name", "chunk").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    found = write_table(by_chunk.groupBy("doc_id", "name").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "spans"))).alias("chunks"), F.sum(F.size("spans") * 8 + 32).alias("bytes")), "findings")
    size = found.agg(F.sum("bytes")).first()[0] or 0
    same = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["name"])
    joined = docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, same, "left")
    parts = F.regexp_extract_all(docs["text"], F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    clean = F.concat_ws("", F.transform(parts, lambda c, i: redact_chunk(c, i * CHUNK, F.try_element_at(found["chunks"], i))))
    return joined.select(*[F.when(found["chunks"].isNull(), docs["text"]).otherwise(clean).alias("text") if c == "text" else docs[c] for c in docs.columns])


def oracle_sql(scope: int = SCOPE) -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def kind(name: str, pattern: str, group: int, number: int) -> str:
        return f"""
{name}_m AS (SELECT rid, regexp_extract_all(text, {q(pattern)}, 0) AS hits, regexp_extract_all(text, {q(pattern)}, {group}) AS held, string_split_regex(text, {q(pattern)}) AS gaps FROM d),
{name}_u AS (SELECT rid, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(held) AS g, unnest(gaps[1:len(hits)]) AS gap FROM {name}_m WHERE len(hits) > 0),
{name}_s AS (SELECT rid, {number} AS kind, length(g) AS size, CAST(SUM(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop, length(hit) AS n FROM {name}_u)"""

    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
{kind("a", ASSIGN, 2, 0)}, {kind("k", ACCESS, 0, 1)}, {kind("h", HEX, 0, 2)}, {kind("i", IDENTIFIER, 2, 3)}, {kind("e", ENDPOINT, 2, 5)},
p AS (
  SELECT rid, CASE WHEN kind = 0 AND size < {MIN_ASSIGN} THEN 4 ELSE kind END AS kind, stop - n AS start, stop FROM (
    SELECT * FROM a_s WHERE size >= {MIN_WEAK} UNION ALL SELECT * FROM k_s WHERE size >= {MIN_ACCESS} UNION ALL SELECT * FROM h_s UNION ALL
    SELECT * FROM i_s UNION ALL SELECT * FROM e_s)),
l AS (
  SELECT w.rid, w.kind, w.start, w.stop FROM p w JOIN p o ON w.rid = o.rid AND w.kind >= 3 AND o.kind <> 2 AND abs(w.start - o.start) <= {scope}
  GROUP BY w.rid, w.kind, w.start, w.stop
  HAVING CASE WHEN w.kind = 3 THEN bool_or(o.kind IN (0, 4)) WHEN w.kind = 4 THEN bool_or(o.kind IN (1, 3, 5)) ELSE bool_or(o.kind IN (1, 3)) AND bool_or(o.kind IN (0, 4)) END),
s AS (SELECT rid, kind, start, {names}[kind + 1] || ':' || start || ':' || stop AS t FROM (SELECT * FROM p WHERE kind < 3 UNION ALL SELECT rid, kind, start, stop FROM l))
SELECT d.doc_id, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex,
  sha256(COALESCE(string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  COALESCE(string_agg(t, ',' ORDER BY start, kind), '') AS spans, COALESCE(string_agg(t, ',' ORDER BY start, kind) FILTER (kind >= 3), '') AS linked
FROM d LEFT JOIN s ON d.rid = s.rid GROUP BY d.rid, d.doc_id
"""
