"""Multi-party perspective rotation: every dialogue rendered once for each of its participants.

In the rendering for a participant, that speaker's turns are the assistant's, all other speakers are users
under their names, and system turns stay system turns.  Only the assistant's contents are trained on.

A rendering is a series of segments, one row per turn, with the place of each segment and of its content in
the whole rendering.  The places are running sums, taken over slices of SLICE turn numbers first, so a long
dialogue is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import staged

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SLICE = 1024


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", slice_turns: int = SLICE) -> DataFrame:
    """(conv_id, speaker, position, turn, role, name, segment, start, content_start, content_end, trained).

    Positions count from 0 and offsets are characters in the rendering, the concatenation of the segments by
    position.  Turns are ordered by turn number, role and text, a null number first; repeated turns stay.  A null
    role is a participant with the empty name, a null text is empty, and the turns of a null conversation id are
    one conversation.  A dialogue of system turns alone has no participant and gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("speaks"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("slice", F.coalesce(F.floor(F.col("turn") / slice_turns), F.lit(-(1 << 62))))
    speakers = rows.filter(F.col("speaks") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaks").alias("speaker")).distinct()
    seen = rows.join(speakers, rows.conv_id.eqNullSafe(speakers.of)).drop("of")
    own, system = F.col("speaks") == F.col("speaker"), F.col("speaks") == SYSTEM
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~own & ~system, F.col("speaks"))
    header = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    seen = seen.withColumns({"role": role, "name": name, "header": F.length(header), "segment": F.concat(header, "text", F.lit(CLOSE)), "trained": own})
    seen = staged(seen.withColumn("size", F.length("segment").cast("long")), "segments")
    keys = ["conv_id", "speaker", "slice"]
    sums = seen.groupBy(*keys).agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias("_" + k) for k in keys), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"))
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("speaker") == F.col("_speaker")) & (F.col("slice") == F.col("_slice"))
    inside = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "speaks", "text")
    placed = seen.withColumn("n", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("chars_before") + F.col("upto") - F.col("size")
    content = start + F.col("header")
    return placed.join(sums, on).select(
        "conv_id", "speaker", (F.col("turns_before") + F.col("n") - 1).alias("position"), "turn", "role", "name", "segment",
        start.alias("start"), content.alias("content_start"), (content + F.length("text")).alias("content_end"), "trained",
    )
