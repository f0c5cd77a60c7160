"""Multi-party perspective rotation: each dialogue once for every participant, who is the assistant there.

The others become named users, and masks cover what the assistant says: its text and the end marker, not the header. The
result has a row for each message of each perspective, with the place of the message and of its mask in the rendered
dialogue; the dialogue is the concatenation of its rows by `place`. So a dialogue of any length stays spread over rows and
is never gathered. Places are running sums in two levels: sums of blocks of turns run over the blocks, then messages
run within their block, so that no task holds a whole dialogue. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns in a block of the running sums.
BLOCK_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def perspectives(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows (conversation, perspective, turn, speaker, role, rendered, place, mask_begin, mask_end).

    A row is a message as rendered when `perspective` is the assistant. role is assistant or user; rendered is
    `<|im_start|>assistant\\n...<|im_end|>\\n` or `<|im_start|>user name=SPEAKER\\n...<|im_end|>\\n`; place is where it begins in
    the dialogue, in characters; [mask_begin, mask_end) is trained on, empty for users. Messages go by turn, nulls first, ties by
    speaker and text; repeated rows are messages of their own. A null text is empty, a null speaker named `unknown`, and a
    null conversation is a conversation. Other columns are left out; no messages give no rows.
    """
    m = messages.select(
        F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("x"),
        F.coalesce(F.floor(F.col(turn) / F.lit(block_turns)), F.lit(-(1 << 62))).cast("long").alias("b"),
    )
    speakers = m.select("c", F.col("s").alias("p")).distinct()
    head = F.when(F.col("s") == F.col("p"), F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), F.col("s"), F.lit("\n")))
    rows = m.join(speakers.withColumnRenamed("c", "c2"), F.col("c").eqNullSafe(F.col("c2"))).drop("c2").withColumn("h", head)
    rows = rows.withColumn("n", (F.length("h") + F.length("x") + F.lit(len(END))).cast("long"))
    blocks = rows.groupBy("c", "p", "b").agg(F.sum("n").alias("of_block"))
    over = Window.partitionBy("c", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("b").alias("b2"), F.coalesce(F.sum("of_block").over(over), F.lit(0)).alias("before"))
    rows = rows.join(blocks, F.col("c").eqNullSafe(F.col("c2")) & (F.col("p") == F.col("p2")) & (F.col("b") == F.col("b2"))).drop("c2", "p2", "b2")
    within = Window.partitionBy("c", "p", "b").orderBy(F.col("t").asc_nulls_first(), "s", "x").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    mine = F.col("s") == F.col("p")
    begin = F.col("place") + F.length("h")
    return rows.select(
        F.col("c").alias(conversation), F.col("p").alias("perspective"), F.col("t").alias(turn), F.col("s").alias("speaker"), F.when(mine, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.concat("h", "x", F.lit(END)).alias("rendered"), "place", begin.alias("mask_begin"), F.when(mine, F.col("place") + F.col("n") - 1).otherwise(begin).alias("mask_end"),
    )


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, rendered once for each participant."""
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH m AS (SELECT conv_id AS c, turn AS t, coalesce(role, 'unknown') AS s, coalesce(text, '') AS x FROM conversations),
v AS (
  SELECT m.c, m.t, m.s, m.x, q.s AS p, '<|im_start|>' || CASE WHEN m.s = q.s THEN 'assistant' ELSE 'user name=' || m.s END || chr(10) AS h
  FROM m JOIN (SELECT DISTINCT c, s FROM m) q ON m.c IS NOT DISTINCT FROM q.c),
r AS (
  SELECT *, h || x || '<|im_end|>' || chr(10) AS rendered FROM v),
w AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY c, p ORDER BY t NULLS FIRST, s, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM r)
SELECT c AS conv_id, p AS perspective, t AS turn, s AS speaker, CASE WHEN s = p THEN 'assistant' ELSE 'user' END AS role, rendered, place,
       place + length(h) AS mask_begin, CASE WHEN s = p THEN place + length(rendered) - 1 ELSE place + length(h) END AS mask_end
FROM w
"""
