"""Multi-party perspective rotation: one rendering of a dialogue per participant, in DataFrame operations only.

Seen by a participant, their own turns are the assistant's, all other speakers are users with a name, and only the
assistant's words count for the loss. System turns belong to no participant and are rendered as such in each view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import arrays as A

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _clean(text: Column) -> Column:
    """Marks of the template inside a text are broken up, so that a turn cannot open another one."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    system: Sequence[str] = ("system",), part_turns: int = 256,
) -> DataFrame:
    """Rows ``(conv, perspective, part, n_turns, text, mask)`` per participant.

    ``mask`` lists ``(start, end)`` in characters of ``text``: the assistant's words with their closing mark.
    Turns ``part_turns * i`` to ``part_turns * (i + 1) - 1`` are part ``i``; the parts in order are the dialogue,
    so that no row or task holds a dialogue of any length. Turns of one number follow by speaker, then text, and
    repeated rows stay. A null speaker is ``unknown``, a null text empty, a null turn number comes first (part -1).
    A dialogue of system turns alone has no participant and gives no row. Extra columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("_who"),
        _clean(F.col(text_col)).alias("_text"),
    ).withColumn("_part", F.coalesce(F.floor(F.col("_turn") / part_turns), F.lit(-1)))
    people = rows.where(~F.col("_who").isin(*system)).select("_conv", F.col("_who").alias("_self")).distinct()
    parts = rows.groupBy("_conv", "_part").agg(F.sort_array(F.collect_list(F.struct("_turn", "_who", "_text"))).alias("_turns"))
    views = parts.join(people, parts["_conv"].eqNullSafe(people["_conv"])).drop(people["_conv"])

    def piece(t: Column) -> Column:
        own = t["_who"] == F.col("_self")
        role = F.when(own, F.lit("assistant")).when(t["_who"].isin(*system), F.lit("system")).otherwise(F.concat(F.lit("user name="), _clean(t["_who"])))
        return F.struct(F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), F.concat(t["_text"], F.lit(CLOSE)).alias("body"), own.alias("own"))

    def spans(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + F.length(p["head"])
            end = begin + F.length(p["body"])
            found = F.when(p["own"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], found).alias("spans"))

        return F.aggregate(pieces, start, step, lambda acc: acc["spans"])

    seen = views.withColumn("_view", A.let(F.transform("_turns", piece), lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), "").alias("text"), spans(ps).alias("mask"))))
    return seen.select(
        F.col("_conv").alias(conv_col), F.col("_self").alias("perspective"), F.col("_part").alias("part"),
        F.size("_turns").cast("long").alias("n_turns"), F.col("_view.text").alias("text"), F.col("_view.mask").alias("mask"),
    )


def digest(views: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The same with the mask as text (``start-end`` joined by blanks) and its length, for comparison."""
    return views.select(
        conv_col, "perspective", "part", "n_turns", "text",
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), " ").alias("mask"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]).alias("n_learned"),
    )


SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '<\\|') AS body,
    coalesce(floor(turn / 256.0)::BIGINT, -1) AS part FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS me FROM rows WHERE who <> 'system'),
pieces AS (
  SELECT r.*, p.me, '<|im_start|>' || CASE WHEN who = me THEN 'assistant' WHEN who = 'system' THEN 'system'
    ELSE 'user name=' || replace(who, '<|', '<\\|') END || chr(10) AS head, body || '<|im_end|>' || chr(10) AS tail
  FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(tail)) OVER w AS stop,
    row_number() OVER w AS k
  FROM pieces WINDOW w AS (PARTITION BY conv_id, me, part ORDER BY turn NULLS FIRST, who, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, me AS perspective, part, count(*) AS n_turns, string_agg(head || tail, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN who = me THEN (stop - length(tail)) || '-' || stop END, ' ' ORDER BY k), '') AS mask,
  sum(CASE WHEN who = me THEN length(tail) ELSE 0 END)::BIGINT AS n_learned
FROM placed GROUP BY conv_id, me, part"""
