"""Dialogues seen from each speaker in turn, with DataFrame functions only.

Every participant becomes the assistant once: that speaker's turns are the assistant's and are
trained on, the others' turns are a named user's, system turns stay the system's. Rows are
turns, not whole dialogues: a dialogue of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
#: Turns of one dialogue (by number) that form a block; offsets are summed by block first.
BLOCK_TURNS = 64


def perspectives(conversations: DataFrame) -> DataFrame:
    """One row per turn and speaker whose view it is rendered for.

    Columns: conv_id, speaker (the one played by the assistant), turn, place (order in the
    dialogue, from 0), role (system, user or assistant), name (the original speaker, for users),
    rendered, n_chars, start (first character in the rendered dialogue), mask_start and mask_end
    (the characters to train on; equal where there are none), trained (1 or 0).

    Speakers are the distinct roles but ``system``. Order: turn (null last), then role, then
    text; repeated rows stay as turns of their own. A null text is empty; a null role is the
    speaker ``unknown``. Rows without a conv_id belong to no dialogue: each is a dialogue of one
    turn. A dialogue of system turns alone has no view and no rows. Other columns are not read.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("_who"),
        F.coalesce("text", F.lit("")).alias("_text"))
    whole = rows.where(F.col("conv_id").isNotNull())
    speakers = whole.where(F.col("_who") != SYSTEM).select("conv_id", F.col("_who").alias("speaker")).distinct()
    seen = whole.join(speakers, "conv_id")
    alone = rows.where(F.col("conv_id").isNull() & (F.col("_who") != SYSTEM)).select(
        "conv_id", "turn", "_who", "_text", F.col("_who").alias("speaker"))
    ours = F.col("_who") == F.col("speaker")
    header = F.when(F.col("_who") == SYSTEM, F.lit("<|im_start|>system\n")).when(
        ours, F.lit("<|im_start|>assistant\n")).otherwise(
        F.concat(F.lit("<|im_start|>user name="), F.regexp_replace("_who", "[\\s<>|]+", "_"), F.lit("\n")))

    def rendered(frame: DataFrame) -> DataFrame:
        return frame.select(
            "conv_id", "speaker", "turn", "_who", "_text",
            F.when(F.col("_who") == SYSTEM, "system").when(ours, "assistant").otherwise("user").alias("role"),
            F.when((F.col("_who") != SYSTEM) & ~ours, F.col("_who")).alias("name"),
            F.concat(header, F.col("_text"), F.lit("<|im_end|>\n")).alias("rendered"),
            F.length(header).alias("_head"),
            F.when(ours & (F.col("_who") != SYSTEM), F.length("_text") + F.length(F.lit("<|im_end|>"))).otherwise(0).alias("_mask"),
        ).withColumn("n_chars", F.length("rendered"))

    # offsets: within a block of turns, plus the sums of the blocks before
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(1 << 40))
    told = rendered(seen).withColumn("_block", block)
    key = ["conv_id", "speaker", "_block"]
    order = [F.col("turn").asc_nulls_last(), F.col("_who"), F.col("_text")]
    inside = Window.partitionBy(*key).orderBy(*order)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = told.groupBy(*key).agg(F.sum("n_chars").alias("_chars"), F.count(F.lit(1)).alias("_turns"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *key, F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_chars0"),
        F.coalesce(F.sum("_turns").over(before), F.lit(0)).alias("_turns0"))
    told = told.withColumn("_c", F.coalesce(F.sum("n_chars").over(past), F.lit(0))).withColumn(
        "_t", F.row_number().over(inside) - 1)
    told = told.join(sums, key).withColumn("place", F.col("_turns0") + F.col("_t")).withColumn(
        "start", F.col("_chars0") + F.col("_c"))
    single = rendered(alone).withColumn("place", F.lit(0).cast("long")).withColumn("start", F.lit(0).cast("long"))
    columns = ["conv_id", "speaker", "turn", "place", "role", "name", "rendered",
               F.col("n_chars").cast("long").alias("n_chars"), "start",
               (F.col("start") + F.col("_head")).alias("mask_start"),
               (F.col("start") + F.col("_head") + F.col("_mask")).alias("mask_end"),
               (F.col("_mask") > 0).cast("int").alias("trained")]
    return told.select(*columns).unionByName(single.select(*columns))


def dialogues(turns: DataFrame) -> DataFrame:
    """Whole rendered dialogues from ``perspectives``: conv_id, speaker, text, masks.

    For dialogues that fit in a row; ``masks`` lists the character spans to train on.
    """
    grouped = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(
        F.struct("place", "rendered", "mask_start", "mask_end", "trained"))).alias("_turns"))
    return grouped.select(
        "conv_id", "speaker", F.array_join(F.transform("_turns", lambda x: x["rendered"]), "").alias("text"),
        F.transform(F.filter("_turns", lambda x: x["trained"] == 1),
                    lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"))


ORACLE = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS body
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, who AS speaker FROM rows WHERE who <> 'system' AND conv_id IS NOT NULL
), views AS (
  SELECT r.rid, r.conv_id, s.speaker, r.turn, r.who, r.body, 0 AS single
  FROM rows r JOIN speakers s ON r.conv_id = s.conv_id
  UNION ALL
  SELECT rid, conv_id, who, turn, who, body, 1 FROM rows WHERE conv_id IS NULL AND who <> 'system'
), headed AS (
  SELECT *, CASE WHEN who = 'system' THEN '<|im_start|>system' || chr(10)
                 WHEN who = speaker THEN '<|im_start|>assistant' || chr(10)
                 ELSE '<|im_start|>user name=' || regexp_replace(who, '[\\s<>|]+', '_', 'g') || chr(10) END AS header
  FROM views
), told AS (
  SELECT *, header || body || '<|im_end|>' || chr(10) AS rendered,
         CASE WHEN who = speaker THEN length(body) + 10 ELSE 0 END AS mask
  FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(length(rendered)) OVER w - length(rendered) AS start
  FROM told
  WINDOW w AS (PARTITION BY conv_id, speaker, CASE WHEN single = 1 THEN rid ELSE -1 END
               ORDER BY turn NULLS LAST, who, body, rid ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, turn, CAST(place AS BIGINT) AS place,
       CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN who <> 'system' AND who <> speaker THEN who END AS name,
       rendered, CAST(length(rendered) AS BIGINT) AS n_chars, CAST(start AS BIGINT) AS start,
       CAST(start + length(header) AS BIGINT) AS mask_start,
       CAST(start + length(header) + mask AS BIGINT) AS mask_end,
       CAST(mask > 0 AS INTEGER) AS trained
FROM placed
"""
