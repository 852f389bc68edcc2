"""Chat formatting for dialogues of several parties: every participant's perspective.

For each participant the whole dialogue is rendered once, with that speaker as the assistant,
the others as named users, and only the assistant's words left unmasked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.common import picked, running_totals
from gavelspark.operators.ranges import PART, in_ranges

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNKNOWN = "unknown"


def perspectives(
    turns: DataFrame,
    system: str = SYSTEM,
    key: str = "conv_id",
    order: str = "turn",
    speaker: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row for each turn of each perspective: ``key``, ``perspective``, ``position`` (from
    0), ``order``, ``role``, ``name`` (the speaker), ``segment``, ``start``, ``trained``,
    ``mask_start``, ``mask_end``.

    A perspective's segments, joined in the order of ``position``, are the rendered dialogue.
    ``start`` is a segment's place in it and the mask the span that is trained on, in code
    points: the assistant's words with the mark that ends them; empty elsewhere. Turns of the
    speaker ``system`` stay the system's in every perspective and have none of their own, so a
    dialogue of system turns only gives no rows. A null speaker is ``unknown``, a null text is
    empty, null keys are one dialogue, null order values come first; ties go by speaker, digest
    of the text and text. Repeated rows are turns of their own.

    Dialogues are dealt by ranges of their turns, so one of any length is spread over tasks;
    lengths are summed range by range. The participants meet the turns by range and dialogue.
    """
    said = picked(turns, conv=key, turn=order, speaker=speaker, text=text).select(
        "conv",
        "turn",
        F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said = said.withColumn("digest", F.md5(F.col("text").cast("binary")))
    by = [F.col("turn"), F.col("speaker"), F.col("digest"), F.col("text")]
    ranged = in_ranges(
        said.withColumn("tie", F.monotonically_increasing_id()), F.col("conv"), *by, F.col("tie")
    )
    parties = ranged.where(F.col("speaker") != system).select(
        F.col("conv").alias("c"), F.col("speaker").alias("perspective")
    )
    places = ranged.select("conv", F.col(PART).alias("p")).distinct()
    views = (
        places.join(parties.distinct(), F.col("conv").eqNullSafe(F.col("c")))
        .select("c", "p", "perspective")
    )
    rows = ranged.join(views, F.col("conv").eqNullSafe(F.col("c")) & (F.col(PART) == F.col("p")))
    role = (
        F.when(F.col("speaker") == F.col("perspective"), "assistant")
        .when(F.col("speaker") == system, "system")
        .otherwise("user")
    )
    rows = rows.drop("c", "p").withColumn("role", role)
    name = F.when(F.col("role") == "user", F.concat(F.lit(" name="), "speaker")).otherwise("")
    rows = rows.withColumn("head", F.concat(F.lit(START), "role", name, F.lit("\n")))
    length = F.length("head") + F.length("text") + len(END)
    totals = running_totals(
        rows, ["conv", "perspective"], [*by, F.col("tie")], {"start": length, "position": F.lit(1)}
    )
    mine = F.col("role") == "assistant"
    return totals.select(
        F.col("conv").alias(key),
        "perspective",
        F.col("position").cast("long").alias("position"),
        F.col("turn").alias(order),
        "role",
        F.col("speaker").alias("name"),
        F.concat("head", "text", F.lit(END)).alias("segment"),
        F.col("start").cast("long").alias("start"),
        mine.alias("trained"),
        (F.col("start") + F.when(mine, F.length("head")).otherwise(0)).cast("long").alias("mask_start"),
        (F.col("start") + F.when(mine, length).otherwise(0)).cast("long").alias("mask_end"),
    )
