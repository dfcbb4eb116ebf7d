"""Chat formatting by perspective rotation: each participant of a dialogue in turn is the assistant.

For every participant the whole dialogue is rendered with that speaker's turns as the assistant's and the others' as turns
of named users; only the assistant's content and end marks are to be trained on. A rendering is given as its segments, a
row for each turn, with character offsets in the rendering and the span to train on, so a dialogue of any length never
has to meet in one task; the segments in the order of seq, joined, are the rendering. DataFrame functions only.

Offsets are running sums in two levels: within ranges of `run` turn numbers, and over the ranges' totals.

Handled cases: turns of system_roles are system turns in every rendering and no participants; a null role is an unnamed
user and no participant; in a name white space, "%" and "<" are written as % and two hex digits, so that different
names stay different; null text is empty; null conv_id is a dialogue of its own; turns are ordered by turn (null
first), role and text, and equal rows are turns of their own; control marks within a text are broken up; a
dialogue without participants has no rendering; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import prepare

START, END = "<|im_start|>", "<|im_end|>"
#: What a name can't hold as it is; the sign of the escapes comes first.
ESCAPED = "%< \t\n\v\f\r"


def named(speaker: Column) -> Column:
    """A speaker's name on one line, without control marks; different names give different texts."""
    for c in ESCAPED:
        speaker = F.replace(speaker, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return speaker


def rotate(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system_roles: tuple[str, ...] = ("system",), run: int = 64) -> DataFrame:
    """conv_id, perspective, seq (from 0), turn, speaker, segment, start_char, end_char, train_start, train_end.

    train_start and train_end are null where nothing is to be trained on.
    """
    prepare(turns.sparkSession)
    broken = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    m = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    m = m.withColumn("content", F.concat(broken(F.col("raw")), F.lit(END + "\n"))).withColumn("run", F.floor(F.col("turn") / run))
    who = m.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system_roles)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    m = m.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    other = F.concat(F.lit(f"{START}user"), F.coalesce(F.concat(F.lit(" name="), named(F.col("speaker"))), F.lit("")), F.lit("\n"))
    head = F.when(mine, F.lit(f"{START}assistant\n")).when(F.col("speaker").isin(*system_roles), F.lit(f"{START}system\n")).otherwise(other)
    m = m.withColumn("head", head).withColumn("mine", mine).withColumn("size", F.length("head") + F.length("content"))
    keys = ["conv_id", "perspective"]
    totals = m.groupBy(*keys, "run").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("run").alias("r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    m = m.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("run").eqNullSafe(F.col("r")))
    order = Window.partitionBy(*keys, "run").orderBy(F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), "raw")
    start = F.col("size_before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("seq", F.col("n_before") + F.row_number().over(order) - 1).withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.col("size"))
    return m.select("conv_id", "perspective", "seq", "turn", "speaker", F.concat("head", "content").alias("segment"), "start_char", "end_char", F.when(F.col("mine"), F.col("start_char") + F.length("head")).alias("train_start"), F.when(F.col("mine"), F.col("end_char") - 1).alias("train_end"))


_NAME = "speaker"
for _c in ESCAPED:
    _NAME = f"replace({_NAME}, chr({ord(_c)}), '%{ord(_c):02X}')"
ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS content FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT m.*, who.perspective, coalesce(speaker = perspective, false) AS mine,
    CASE WHEN coalesce(speaker = perspective, false) THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user' || coalesce(' name=' || """ + _NAME + r""", '') || chr(10) END AS head
  FROM m JOIN who ON m.conv_id IS NOT DISTINCT FROM who.conv_id
), s AS (
  SELECT *, length(head) + length(content) AS size,
    row_number() OVER w - 1 AS seq, coalesce(sum(length(head) + length(content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, raw)
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, head || content AS segment, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + size AS BIGINT) AS end_char,
  CAST(CASE WHEN mine THEN start_char + length(head) END AS BIGINT) AS train_start, CAST(CASE WHEN mine THEN start_char + size - 1 END AS BIGINT) AS train_end
FROM s
"""
