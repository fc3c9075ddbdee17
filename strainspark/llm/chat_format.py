"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A conversation that was logged several times as it grew leaves snapshots, each a
prefix of a longer one.  Every turn gets the rolling hash of all turns up to it;
a conversation whose last rolling hash is met inside a longer conversation is a
snapshot and goes, by an anti-join; equal conversations leave the smallest id.
The rest are rendered.

The rolling hash is the XOR of 128-bit hashes of (position, role, text), a sum that
can be had in two levels: within pieces of PIECE turns, and over the pieces of a
conversation.  So no conversation, however long, has its turns in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a piece, the unit of hashing and rendering.
PIECE = 256

TURN_HEAD, TURN_TAIL = "<|im_start|>", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, place): distinct turns with their place in the conversation.

    Places count the conversation's turns from 0 in order of (turn, role, text).
    They are the place within the piece of turn numbers plus the pieces before.
    """
    rows = conversations.select(F.col("conv_id").alias("conv"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv IS NOT NULL").distinct()
    rows = rows.withColumn("piece", F.floor(F.col("turn") / PIECE))
    inside = Window.partitionBy("conv", "piece").orderBy("turn", "role", "text")
    sizes = rows.groupBy("conv", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("piece")) - F.col("n")
    offsets = sizes.select("conv", "piece", before.alias("before"))
    return rows.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["conv", "piece"]).select("conv", "turn", "role", "text", "piece", (F.col("before") + F.col("k")).alias("place"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, place, a, b): the rolling hash of the turns up to each place."""
    each = turns.select("conv", "piece", "place", F.xxhash64("place", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "place").alias("b"))
    whole = each.groupBy("conv", "piece").agg(F.bit_xor("a").alias("pa"), F.bit_xor("b").alias("pb"))
    running = Window.partitionBy("conv").orderBy("piece")
    # A running XOR without the current piece is the one with it, XORed by the piece once more.
    offsets = whole.select("conv", "piece", F.bit_xor("pa").over(running).bitwiseXOR(F.col("pa")).alias("oa"), F.bit_xor("pb").over(running).bitwiseXOR(F.col("pb")).alias("ob"))
    inside = Window.partitionBy("conv", "piece").orderBy("place")
    rolled = each.select("conv", "piece", "place", F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b"))
    return rolled.join(offsets, ["conv", "piece"]).select("conv", "place", F.col("a").bitwiseXOR(F.col("oa")).alias("a"), F.col("b").bitwiseXOR(F.col("ob")).alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that are no other's proper prefix, one of each group of copies."""
    prefixes = prefix_hashes(turns)
    ends = prefixes.groupBy("conv").agg(F.max_by(F.struct("a", "b"), "place").alias("h"), (F.max("place") + 1).alias("n_turns"))
    wholes = ends.groupBy("h", "n_turns").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    # What conversations that stand for their copies hold before their last turn.
    inner = (prefixes.join(wholes.select("conv", "n_turns"), "conv").filter(F.col("place") < F.col("n_turns") - 1)
             .select("a", "b", (F.col("place") + 1).alias("n_turns")).distinct())
    whole = wholes.select("conv", "n_turns", "n_copies", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    return whole.join(inner, ["a", "b", "n_turns"], "left_anti").select("conv", "n_turns", "n_copies")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_HEAD), role, F.lit("\n"), text, F.lit(TURN_TAIL))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, n_copies, text): the rendered maximal conversations.

    A conversation is rendered in pieces of PIECE turns, which joined in order of
    ``piece`` are its text; nearly all have one piece, 0.  Columns read are
    conv_id, turn, role and text.  Turns are ordered by (turn, role, text);
    repeated rows count once; a null turn comes first, a null role or text is
    empty; rows of a null conv_id are left out; an empty table gives none.
    """
    turns = _turns(conversations)
    kept = maximal(turns)
    piece = F.floor(F.col("place") / PIECE).cast("long")
    lines = turns.join(kept, "conv").select("conv", piece.alias("piece"), "n_turns", "n_copies", F.struct("place", _rendered(F.col("role"), F.col("text")).alias("line")).alias("one"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["line"]), "")
    return lines.groupBy("conv", "piece", "n_turns", "n_copies").agg(whole.alias("text")).select(F.col("conv").alias("conv_id"), "piece", "n_turns", "n_copies", "text")


REPORT_SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM rows),
p AS (SELECT conv_id, place, md5(string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY place)) AS h FROM t),
e AS (SELECT conv_id, arg_max(h, place) AS h, max(place) + 1 AS n_turns FROM p GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, h, n_turns, count(*) AS n_copies FROM e GROUP BY h, n_turns),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p JOIN e USING (conv_id) WHERE p.h = w.h AND p.place + 1 = w.n_turns AND e.n_turns > w.n_turns))
SELECT conv_id, CAST(place // {PIECE} AS BIGINT) AS piece, n_turns, n_copies,
       string_agg('{TURN_HEAD}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN k USING (conv_id) GROUP BY conv_id, place // {PIECE}, n_turns, n_copies
"""
