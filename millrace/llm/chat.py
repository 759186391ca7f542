"""Chat formatting by multi-party perspective rotation (DataFrame functions only).

Every participant of a conversation gets a rendering of it in which that speaker
is the assistant, system turns stay system turns, and everybody else is a named
user; only the assistant's own words and their end mark carry loss.

A rendering is kept as one row per message, with the message's place and offset
in the rendered dialogue, so a dialogue of any length is never gathered into one
row: joining `rendered` by `position` gives the text, and `mask_start` to
`mask_end` are the spans with loss. Offsets are running sums over three levels
(blocks of turns, turns, rows of one turn), so no task holds a whole hot
conversation, and texts cross the network once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table

# The delimiters of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"
TURNS_IN_BLOCK = 1024


def escaped(text: Column) -> Column:
    """Delimiters inside a text are spaced out, so that no text can end its own message."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))


def header(role: Column, speaker: Column, perspective: Column) -> Column:
    named = F.concat(F.lit(OPEN + "user name="), speaker, F.lit("\n"))
    return F.when(role == "system", F.lit(OPEN + "system\n")).when(speaker.eqNullSafe(perspective), F.lit(OPEN + "assistant\n")).otherwise(named)


def same(a: str, b: str, columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return condition


def rotate_perspectives(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_roles: tuple[str, ...] = SYSTEM_ROLES) -> DataFrame:
    """One row per conversation, perspective and message.

    Messages are ordered by turn (null last) and, in one turn, by the md5 of role
    and text; repeated rows are messages of their own. A null or empty role is
    the speaker `unknown`, line ends in names become spaces, a null text is
    empty, and rows with a null id form one conversation. A conversation with
    system turns only has no participant and gives no row. Extra columns are
    ignored; an empty table gives an empty result.
    """
    speaker = F.regexp_replace(F.coalesce(F.when(F.col(role_col) != "", F.col(role_col)), F.lit(UNKNOWN)), r"[\r\n]", " ")
    told = turns.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        escaped(speaker).alias("speaker"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    ).withColumn("_role", F.when(F.col("speaker").isin(list(system_roles)), "system").otherwise("user"))
    told = told.withColumn("_h", F.md5(F.concat(F.col("speaker"), F.lit("\n"), F.col("_text"))))
    told = materialize(told, "chat-turns")

    slim = told.select("_row", "conv_id", "turn", "speaker", "_role", "_h", F.length("_text").cast("long").alias("_chars"))
    views = slim.filter("_role <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = slim.alias("a").join(views.alias("b"), same("a", "b", ["conv_id"])).select("a.*", "b.perspective")
    length = F.length(header(F.col("_role"), F.col("speaker"), F.col("perspective"))) + F.col("_chars") + len(CLOSE) + 1
    seen = materialize(
        seen.select("_row", "conv_id", "perspective", "turn", "_h", F.expr(f"turn div {TURNS_IN_BLOCK}").alias("_block"), F.substring("_h", 1, 2).alias("_tie"), length.cast("long").alias("n_chars")),
        "chat-views",
    )

    top, mid = ["conv_id", "perspective", "_block"], ["conv_id", "perspective", "_block", "turn", "_tie"]
    ties = materialize(seen.groupBy(*mid).agg(F.sum("n_chars").alias("_l"), F.count(F.lit(1)).alias("_n")), "chat-ties")
    blocks = ties.groupBy(*top).agg(F.sum("_l").alias("_l"), F.sum("_n").alias("_n"))
    in_order = Window.partitionBy("conv_id", "perspective").orderBy(F.col("_block").asc_nulls_last())
    blocks = blocks.select(*top, (F.sum("_l").over(in_order) - F.col("_l")).alias("_start"), (F.sum("_n").over(in_order) - F.col("_n")).alias("_place"))
    in_block = Window.partitionBy(*top).orderBy(F.col("turn").asc_nulls_last(), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = ties.withColumn("_lb", F.sum("_l").over(in_block) - F.col("_l")).withColumn("_nb", F.sum("_n").over(in_block) - F.col("_n"))
    ties = ties.alias("a").join(blocks.alias("b"), same("a", "b", top)).select(*[f"a.{c}" for c in mid], (F.col("_start") + F.col("_lb")).alias("_start"), (F.col("_place") + F.col("_nb")).alias("_place"))
    in_tie = Window.partitionBy(*mid).orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = seen.withColumn("_lt", F.sum("n_chars").over(in_tie) - F.col("n_chars")).withColumn("_nt", F.row_number().over(in_tie) - 1)
    placed = rows.alias("a").join(ties.alias("b"), same("a", "b", mid)).select(
        "a._row", "a.perspective", (F.col("_place") + F.col("_nt")).cast("long").alias("position"), (F.col("_start") + F.col("_lt")).cast("long").alias("start"), "n_chars"
    )

    head = header(F.col("_role"), F.col("speaker"), F.col("perspective"))
    own = (F.col("_role") != "system") & (F.col("speaker") == F.col("perspective"))
    return placed.join(told, "_row").select(
        "conv_id",
        "perspective",
        "position",
        "turn",
        F.when(own, "assistant").otherwise(F.col("_role")).alias("chat_role"),
        F.when((F.col("_role") != "system") & ~own, F.col("speaker")).alias("name"),
        F.concat(head, F.col("_text"), F.lit(CLOSE + "\n")).alias("rendered"),
        "start",
        "n_chars",
        F.when(own, F.col("start") + F.length(head)).alias("mask_start"),
        F.when(own, F.col("start") + F.col("n_chars") - 1).alias("mask_end"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(read_table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn,
         replace(replace(regexp_replace(coalesce(nullif(role, ''), 'unknown'), '[\r\n]', ' ', 'g'), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') AS t
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
v AS (
  SELECT m.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || t || '<|im_end|>' || chr(10) AS rendered FROM v),
o AS (
  SELECT *, row_number() OVER w - 1 AS position, (coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, length(rendered) AS n_chars
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, md5(speaker || chr(10) || t), rid))
SELECT conv_id, perspective, position, turn, chat_role, CASE WHEN chat_role = 'user' THEN speaker END AS name, rendered, start, n_chars,
       CASE WHEN chat_role = 'assistant' THEN start + length(head) END AS mask_start, CASE WHEN chat_role = 'assistant' THEN start + n_chars - 1 END AS mask_end
FROM o
"""
