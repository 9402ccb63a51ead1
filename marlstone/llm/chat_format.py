"""Chat formatting of multi-party dialogues from every participant's perspective.

For each participant of a conversation the whole dialogue is rendered once: that participant
speaks as the assistant, all others as named users, system messages stay as they are.  A
training mask goes with it: only the assistant's own words (and their end mark) are learned.

The result has one row per conversation, perspective and message, with the rendered piece,
its mask and its character span in the rendered dialogue, so no dialogue is ever gathered in
one row; the spans come from running sums in two steps, over stretches of turns and within
them.  A stretch of more than ``CROWD`` messages (null or equal turns, say) is dealt by ranges of
its order into parts of bounded size, which are written once and summed like stretches.  All of
it is DataFrame operations.

Messages are ordered by turn, ties by speaker and text; null turns come first.  A null text is
empty, a null role speaks as ``unknown``, and rows without a conversation id are one
conversation.  Repeated rows are messages of their own.  A conversation of system messages
alone has no perspective and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the marks of the chat template and the role that isn't a participant
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
STRETCH = 256  # turns in which a running sum is taken at once
CROWD, PART_ROWS = 100_000, 50_000  # messages of a stretch beyond which it is dealt, and those of a part, about


def _plain(text: Column) -> Column:
    """A text that can't be taken for a mark of the template."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _name(role: Column) -> Column:
    """A role as a name of one line."""
    return F.regexp_replace(_plain(role), r"[\x00-\x20=]+", "_")


def _parts(said: DataFrame, scratch) -> DataFrame:
    """Add ``stretch`` and, within it, ``part``: 0, or the ranges of a crowded stretch in their order."""
    said = said.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    calm = said.withColumn("part", F.lit(0))
    if scratch is None:
        return calm
    crowds = said.groupBy("conv", "stretch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowds = scratch.keep(crowds.select(F.col("conv").alias("c"), F.col("stretch").alias("s"), "n"), "crowds")
    rows = crowds.agg(F.sum("n")).first()[0]
    if not rows:
        return calm
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s"))
    # equal messages may be dealt to several ranges: which of them comes first makes no difference
    dealt = said.join(crowds, same, "left_semi").withColumn("draw", F.rand(7)).repartitionByRange(-(-rows // PART_ROWS), "conv", "stretch", "turn", "speaker", "body", "draw")
    dealt = scratch.keep(dealt.drop("draw").withColumn("part", F.spark_partition_id()), "dealt")
    return calm.join(crowds, same, "left_anti").unionByName(dealt)


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", scratch=None) -> DataFrame:
    """``conv, perspective, turn, seq, speaker, piece, learned, start, end, learned_from`` for every perspective and message.

    ``start`` and ``end`` are character offsets (from 0) of the piece; the mask covers ``learned_from``
    to ``end``: the words of a learned piece, and nothing of the others.  ``seq`` counts messages from 1.
    Without ``scratch`` a crowded stretch stays in one task.
    """
    said = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    said = _parts(said, scratch)
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("conv_of"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(people, F.col("conv").eqNullSafe(F.col("conv_of"))).drop("conv_of")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(f"{START}assistant\n")).when(F.col("speaker") == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), _name(F.col("speaker")), F.lit("\n")))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", _plain(F.col("body")), F.lit(f"{END}\n")))
    rows = rows.withColumn("length", F.char_length("piece").cast("long"))

    sums = rows.groupBy("conv", "perspective", "stretch", "part").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("messages"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("stretch", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), F.col("part").alias("t"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("messages").over(earlier), F.lit(0)).alias("messages_before"),
    )
    within = Window.partitionBy("conv", "perspective", "stretch", "part").orderBy("turn", "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end_within", F.sum("length").over(within)).withColumn("seq_within", F.count(F.lit(1)).over(within))
    rows = rows.join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("stretch").eqNullSafe(F.col("s")) & (F.col("part") == F.col("t")))
    end = F.col("chars_before") + F.col("end_within")
    start = end - F.col("length")
    return rows.select(
        F.col("conv").alias(conv), "perspective", F.col("turn").alias(turn), (F.col("messages_before") + F.col("seq_within")).alias("seq"), "speaker", "piece",
        own.alias("learned"), start.alias("start"), end.alias("end"), F.when(own, start + F.char_length("head")).otherwise(end).alias("learned_from"),
    )
