"""Chat formatting after collapsing cumulative snapshots. DataFrame functions only.

Logs often hold a conversation again each time it grew. A rolling hash of a conversation's turns names each of
its prefixes: the hashes of the turns with their places, XORed up to there, 128 bits in two columns. A conversation
whose whole hash is the hash of a shorter prefix of another is a snapshot of it; an anti-join drops it. Of equal
conversations the one with the smallest conv_id stays. What is left is rendered.

Cases: turns are ordered by (turn, role, text), nulls first; a repeated row counts once; null role or text is
empty; rows without conv_id are one conversation, which yields to an equal one with an id; an empty table gives no rows; extra columns are
ignored. Turns are hashed by a running window, which spills; a conversation is in memory once, when rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: What stands before the role, between role and text, and after the text.
CHATML = ("<|im_start|>", "\n", "<|im_end|>\n")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and pos, the turn's place from 1. One shuffle, by conv_id."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = F.col("turn").eqNullSafe(F.lag("turn").over(w)) & (F.col("role") == F.lag("role").over(w)) & (F.col("text") == F.lag("text").over(w))
    first = rows.withColumn("new", ~F.coalesce(same & (F.row_number().over(w) > 1), F.lit(False)))
    return first.where("new").withColumn("pos", F.row_number().over(w)).drop("new", "turn")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, the rolling hashes h1 and h2 of the turns up to pos, and n_turns."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.select("conv_id", "pos", F.xxhash64(F.lit(1), "pos", "role", "text").alias("a"), F.xxhash64(F.lit(2), "pos", "role", "text").alias("b"))
    return hashed.select("conv_id", "pos", F.bit_xor("a").over(upto).alias("h1"), F.bit_xor("b").over(upto).alias("h2"), F.lead("pos").over(w).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one continues."""
    p = prefixes(turns)
    whole = p.where("last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = p.where("NOT last").groupBy("pos", "h1", "h2").agg(F.lit(1).alias("one"))
    return whole.join(begun, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, template: tuple[str, str, str] = CHATML) -> DataFrame:
    """kept with `text`, its turns in the template."""
    before, between, after = map(F.lit, template)
    parts = turns.select(F.col("conv_id").alias("_id"), F.struct("pos", F.concat(before, "role", between, "text", after).alias("s")).alias("t"))
    joined = parts.join(kept, parts["_id"].eqNullSafe(kept["conv_id"]))
    grouped = joined.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("t", lambda t: t["s"]), "").alias("text"))


def format_conversations(conversations: DataFrame, template: tuple[str, str, str] = CHATML) -> DataFrame:
    turns = numbered_turns(conversations)
    return render(turns, maximal(turns), template)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(C.table(spark, sf_dir, "conversations"))


#: DuckDB SQL for op8.
SQL8 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, count(*) AS n_turns,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
      FROM t GROUP BY conv_id),
g AS (SELECT text, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM r GROUP BY text, n_turns)
SELECT conv_id, n_turns, n_copies, text FROM g a
WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.n_turns > a.n_turns AND starts_with(b.text, a.text))
"""
