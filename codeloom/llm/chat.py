"""Chat formatting by perspective rotation.

A dialogue is rendered once for each of its participants: that speaker's turns
as ``assistant``, all others' as users with their names, narrators' as
``system``.  Training shall learn the speaker's turns only, so their ranges are
the mask.  Rows are examples: a dialogue of more than ``SEGMENT`` turns gives
several, and the place of a turn is found without a task per dialogue.

Turns without a conversation belong to no dialogue and are left out.  A null
role is ``unknown``, a null text is empty, a null turn comes first; equal turn
numbers are ordered by role and text.  Repeated rows are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import distributed_rank
from . import common as C

NARRATORS = ("system",)
SEGMENT = 256
END = "<|end|>\n"


def escape(text: Column) -> Column:
    """Text in which no marker can begin; reversible."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def rotate(conversations: DataFrame, narrators: tuple[str, ...] = NARRATORS, segment: int = SEGMENT) -> DataFrame:
    """conv_id, speaker, segment, n_turns, n_masked_turns, text, mask (``start:end`` code points, comma-joined)."""
    turns = C.only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    ranked = distributed_rank(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")], "rank").select(
        "conv_id", "role", "said", (F.col("rank") - 1).alias("pos"), ((F.col("rank") - 1) / segment).cast("long").alias("segment"))
    speakers = turns.where(~F.col("role").isin(*narrators)).select("conv_id", F.col("role").alias("speaker")).distinct()
    mine = F.col("role") == F.col("speaker")
    head = (F.when(mine, "<|assistant|>\n").when(F.col("role").isin(*narrators), F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user:"), escape(F.col("role")), F.lit("|>\n"))))
    lines = ranked.join(speakers, "conv_id").select(
        "conv_id", "speaker", "segment", F.struct("pos", mine.alias("mine"), head.alias("head"), F.concat(escape(F.col("said")), F.lit(END)).alias("body")).alias("x"))
    rows = lines.groupBy("conv_id", "speaker", "segment").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most ``segment`` turns
    marked = F.aggregate(
        "xs", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("mask")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["mine"], F.concat(a["mask"], F.array(F.concat_ws(
                ":", (a["at"] + F.length(x["head"])).cast("string"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).cast("string")))))
            .otherwise(a["mask"]).alias("mask")),
        lambda a: F.array_join(a["mask"], ","))
    return rows.select(
        "conv_id", "speaker", "segment", F.size("xs").cast("long").alias("n_turns"),
        F.size(F.filter("xs", lambda x: x["mine"])).cast("long").alias("n_masked_turns"),
        F.array_join(F.transform("xs", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), marked.alias("mask"))
