"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered once with
that speaker as the assistant and the others as named users; the mask holds the
spans of the assistant's own words, the only ones to be trained on. A rendering is
one text with one count of places; that of a very long dialogue comes in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ._store import write_table

#: Turns in one rendered row; the rendering of a longer dialogue goes on in the next.
PART_TURNS = 512
#: Conversations of more turns are never gathered; their turns are numbered over ranges.
GATHERED_TURNS = 4096
#: Rows of a side table that may be broadcast.
BROADCAST_ROWS = 500_000
SYSTEM = "system"
UNNAMED = "unknown"
ASSISTANT_HEAD, SYSTEM_HEAD, TAIL = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def _head(role: Column, perspective: Column) -> Column:
    """What stands before a message's own words."""
    return F.when(role == perspective, F.lit(ASSISTANT_HEAD)).when(role == SYSTEM, F.lit(SYSTEM_HEAD)).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _hinted(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


TURN = ("turn", "role", "mark", "text")


def _gathered(t: DataFrame, part_turns: int) -> DataFrame:
    """conv_id, part, parts, turns, speakers of conversations that fit a row."""
    all_turns = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / part_turns).cast("int")), lambda i: F.slice("turns", i * part_turns + 1, F.lit(part_turns)))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda x: x["role"]), lambda r: r != SYSTEM))
    rows = all_turns.select("conv_id", cut.alias("cut"), speakers.alias("speakers"))
    return rows.select("conv_id", F.size("cut").alias("parts"), "speakers", F.posexplode("cut").alias("part", "turns")).select("conv_id", "part", "parts", "turns", F.explode("speakers").alias("perspective"))


def _ranged(t: DataFrame, part_turns: int) -> DataFrame:
    """The same for very long conversations: turns get their places by ranges, and only the turns of one part come together."""
    placed = numbered(t, ["conv_id", "turn", "role", "mark"], "pos")
    firsts = placed.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    placed = placed.join(_hinted(write_table(firsts, "firsts")), "conv_id")
    placed = placed.withColumn("part", F.floor((F.col("pos") - F.col("first")) / part_turns).cast("int")).withColumn("parts", F.ceil(F.col("n") / part_turns).cast("int"))
    parts = placed.groupBy("conv_id", "part", "parts").agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns"))
    speakers = write_table(t.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct(), "speakers")
    return parts.join(_hinted(speakers), "conv_id").select("conv_id", "part", "parts", "turns", "perspective")


def _message_length(x: Column) -> Column:
    return F.length(_head(x["role"], F.col("perspective"))) + F.length(x["text"]) + len(TAIL)


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS, gathered_turns: int = GATHERED_TURNS) -> DataFrame:
    """One row per conversation, participant and part of ``part_turns`` turns: conv_id, perspective, part, start, n_turns, text, mask.

    The texts of a conversation's parts, put together, are the rendering of the
    whole dialogue from one perspective (``whole_dialogues`` does so); ``start`` is
    the part's place in it, in code points. ``mask`` lists the spans start:end
    (places in the whole rendering, end exclusive, comma-joined) of the
    perspective's messages, end marker included. Each distinct role but ``system``
    is a participant; a conversation with system turns alone gives no row. Turns
    are ordered by number, then role, then the text's md5, so ties and repeated
    rows give one defined text and all are kept. A null role is ``unknown``, a null
    text is empty, a null turn sorts first. A turn without conv_id belongs to no
    other turn and is a dialogue of its own. Parts are bounded by turns, however
    numbers repeat, and a conversation above ``gathered_turns`` is never gathered.
    Empty tables give an empty result; other columns are ignored.
    """
    t = turns.select(
        turns["conv_id"].alias("conv_id"),
        F.coalesce(turns["turn"].cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(turns["role"], F.lit(UNNAMED)).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    ).withColumn("mark", F.md5(F.col("text").cast("binary")))
    known = t.where("conv_id IS NOT NULL")
    long = write_table(known.groupBy("conv_id").count().where(F.col("count") > gathered_turns).select("conv_id"), "long")
    alone = t.where(F.col("conv_id").isNull() & (F.col("role") != SYSTEM)).select("conv_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.array(F.struct(*TURN)).alias("turns"), F.col("role").alias("perspective"))
    if long.limit(1).count():
        few = _hinted(long)
        rows = _gathered(known.join(few, "conv_id", "left_anti"), part_turns).unionByName(_ranged(known.join(few, "conv_id", "left_semi"), part_turns))
    else:
        rows = _gathered(known, part_turns)
    rows = rows.unionByName(alone)
    short, longer = rows.where("parts = 1").withColumn("start", F.lit(0).cast("long")), rows.where("parts > 1")
    # where a part begins: the lengths of those before it, added up without their texts
    length = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + _message_length(x)).alias("length")
    before = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = longer.select("conv_id", "perspective", "part", length).select("conv_id", "perspective", "part", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"))
    rows = short.unionByName(longer.join(starts, ["conv_id", "perspective", "part"]), allowMissingColumns=False)
    step = lambda acc, x: F.struct(
        (acc["at"] + _message_length(x)).alias("at"),
        F.when(x["role"] == F.col("perspective"), F.concat(acc["mask"], F.array(F.concat_ws(":", (acc["at"] + len(ASSISTANT_HEAD)).cast("string"), (acc["at"] + _message_length(x)).cast("string")))))
        .otherwise(acc["mask"])
        .alias("mask"),
    )
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("mask"))
    return rows.select(
        "conv_id",
        "perspective",
        "part",
        "start",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda x: F.concat(_head(x["role"], F.col("perspective")), x["text"], F.lit(TAIL)))).alias("text"),
        F.concat_ws(",", F.aggregate("turns", first, step)["mask"]).alias("mask"),
    )


def whole_dialogues(rendered: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, text, mask: the parts of ``rotate_perspectives`` put together, one row for each whole rendering.

    A row is as large as its dialogue. Turns without conv_id stay rows of their own.
    """
    parts = rendered.where("conv_id IS NOT NULL").groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("part", "n_turns", "text", "mask"))).alias("p"))
    joined = parts.select(
        "conv_id",
        "perspective",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["n_turns"]).alias("n_turns"),
        F.concat_ws("", F.transform("p", lambda x: x["text"])).alias("text"),
        F.concat_ws(",", F.filter(F.transform("p", lambda x: x["mask"]), lambda m: m != "")).alias("mask"),
    )
    return joined.unionByName(rendered.where("conv_id IS NULL").select(*joined.columns))


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, COALESCE(CAST(turn AS BIGINT), -1) AS turn, COALESCE(role, '{UNNAMED}') AS role, COALESCE(text, '') AS text FROM conversations),
u AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn, role, md5(text)) - 1) AS BIGINT) AS pos FROM t),
s AS (SELECT DISTINCT conv_id, alone, role AS perspective FROM u WHERE role <> '{SYSTEM}'),
m AS (
  SELECT u.conv_id, u.alone, s.perspective, u.pos, u.role, u.text,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM u JOIN s ON u.conv_id IS NOT DISTINCT FROM s.conv_id AND u.alone IS NOT DISTINCT FROM s.alone),
r AS (SELECT *, CAST(SUM(length(head) + length(text) + {len(TAIL)}) OVER (PARTITION BY conv_id, alone, perspective ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM m)
SELECT conv_id, perspective, CAST(pos // {PART_TURNS} AS INT) AS part, CAST(MIN(stop - length(head) - length(text) - {len(TAIL)}) AS BIGINT) AS start, COUNT(*) AS n_turns,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text,
  COALESCE(string_agg(CASE WHEN role = perspective THEN CAST(stop - length(text) - {len(TAIL)} AS BIGINT) || ':' || stop END, ',' ORDER BY pos), '') AS mask
FROM r GROUP BY conv_id, alone, perspective, pos // {PART_TURNS}
"""
