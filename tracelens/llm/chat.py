"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as
the assistant and all others as named users; system turns are context for all and are no
participant. A rendered dialogue is the concatenation of its turns' segments in order:

    <|im_start|>assistant\\n{text}<|im_end|>\\n          turns of the perspective's speaker
    <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n   turns of others
    <|im_start|>system\\n{text}<|im_end|>\\n             system turns

One row per conversation, perspective and turn: the segment, its place in the dialogue, and the
span of it that is trained on (text and end mark of assistant turns). So no conversation, however
long, is gathered into one row or task: places come from sums of chunks of `CHUNK` turn numbers,
then within a chunk. A chunk of `HEAVY` rows or more (turns of one number, or without one) is cut again, in the order of its rows: by turn, speaker
and the text's first `PREFIX` characters; only turns that are the same in all of these are ranked in one task. The text is shuffled once, by (conversation, chunk).

Nulls: a null text is empty, a null speaker is named "unknown", null turns come first, a null
conversation id is one conversation. Empty texts keep their markers. Ties of turn are ordered by speaker and text; repeated rows are
turns of their own. A conversation of system turns alone has no perspective and no row. Empty table: empty result.
Extra columns are ignored. Very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, quoted

CHUNK, HEAVY, PREFIX = 256, 2048, 32
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, pos (from 0 in the dialogue), turn, speaker, start, end, mask_start, mask_end, segment."""
    t = turns.select(
        quoted(conv).alias("conv"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(speaker), F.lit("unknown")).alias("who"), F.coalesce(quoted(text), F.lit("")).alias("body")
    )
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))).cast("long"))
    # a chunk is a struct of its turn numbers' part and, in heavy parts, of what cuts them; nulls are replaced, so that it can be a key
    sizes = t.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= HEAVY)
    heavy = checkpointed(sizes.select(F.col("conv").alias("conv3"), F.col("part").alias("part3"), F.lit(True).alias("cut")))
    small = heavy.limit(10_001).count() <= 10_000
    t = t.join(F.broadcast(heavy) if small else heavy, F.col("conv").eqNullSafe(F.col("conv3")) & (F.col("part") == F.col("part3")), "left").drop("conv3", "part3")
    cut = F.coalesce("cut", F.lit(False))
    sub = [F.when(cut, c).otherwise(none).alias(n) for n, c, none in (("turn", F.coalesce("turn", F.lit(-(1 << 63))), F.lit(0)), ("who", F.col("who"), F.lit("")), ("start", F.substring("body", 1, PREFIX), F.lit("")))]
    t = t.withColumn("chunk", F.struct("part", *sub)).drop("part", "cut")
    fixed = len(OPEN) + 1 + len(CLOSE)
    as_user = F.when(F.col("who") == system, F.lit(fixed + len(system))).otherwise(F.length("who") + fixed + len("user name="))
    t = t.withColumn("n_user", (as_user + F.length("body")).cast("long"))
    # as an assistant a segment is longer by this, for the speaker's own perspective
    own = F.lit(len("assistant") - len("user name=")) - F.length("who")

    by_role = t.groupBy("conv", "chunk", "who").agg(F.sum("n_user").alias("n"), F.count(F.lit(1)).alias("m"))
    chunks = by_role.groupBy("conv", "chunk").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("who", (F.col("m") * own).alias("d")))).alias("own"))
    people = by_role.where(F.col("who") != system).groupBy("conv").agg(F.sort_array(F.collect_set("who")).alias("people"))
    grid = chunks.join(people.withColumnRenamed("conv", "conv2"), F.col("conv").eqNullSafe(F.col("conv2"))).select("conv", "chunk", "n", "m", "own", F.explode("people").alias("p"))
    before = Window.partitionBy("conv", "p").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("n") + F.coalesce(F.try_element_at("own", F.col("p")), F.lit(0))
    grid = grid.select("conv", "chunk", F.struct(F.col("p"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("pos")).alias("x"))
    places = grid.groupBy(F.col("conv").alias("conv2"), F.col("chunk").alias("chunk2")).agg(F.collect_list("x").alias("xs"))

    rows = t.join(places, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("chunk") == F.col("chunk2"))).select("conv", "chunk", "turn", "who", "body", "n_user", F.explode("xs").alias("x"))
    mine = (F.col("who") == F.col("x.p")) & (F.col("who") != system)
    n = F.col("n_user") + F.when(mine, own).otherwise(F.lit(0))
    inside = Window.partitionBy("conv", "chunk", "x.p").orderBy("turn", "who", "body").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("x.base") + F.sum(n).over(inside)
    rows = rows.select("*", mine.alias("mine"), n.alias("n"), end.alias("end"), (F.col("x.pos") + F.row_number().over(Window.partitionBy("conv", "chunk", "x.p").orderBy("turn", "who", "body")) - 1).alias("pos"))
    head = F.when(F.col("mine"), F.lit("assistant")).when(F.col("who") == system, F.lit(system)).otherwise(F.concat(F.lit("user name="), F.col("who")))
    return rows.select(
        F.col("conv").alias(conv), F.col("x.p").alias("perspective"), F.col("pos").cast("long").alias("pos"), "turn", F.col("who").alias("speaker"),
        (F.col("end") - F.col("n")).alias("start"), "end",
        F.when(F.col("mine"), F.col("end") - F.length("body") - len(CLOSE)).alias("mask_start"), F.when(F.col("mine"), F.col("end") - 1).alias("mask_end"),
        F.concat(F.lit(OPEN), head, F.lit("\n"), F.col("body"), F.lit(CLOSE)).alias("segment"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.*, p.perspective, speaker = perspective AS mine,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END
    || chr(10) || body || '<|im_end|>' || chr(10) AS segment
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c
), w AS (
  SELECT *, (row_number() OVER o - 1)::BIGINT AS pos, (sum(length(segment)) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS e
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body)
)
SELECT conv_id, perspective, pos, turn, speaker, (e - length(segment))::BIGINT AS "start", e AS "end",
  CASE WHEN mine THEN e - length(body) - 11 END AS mask_start, CASE WHEN mine THEN e - 1 END AS mask_end, segment
FROM w
"""
