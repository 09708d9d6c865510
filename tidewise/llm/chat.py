"""Multi-party perspective rotation of dialogues (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant,
the other speakers as named users, and system turns as they are; the mask lists the spans (code points,
end exclusive) of the assistant's words and end marks, on which a model would be trained.

A rendering may be longer than a row can be, so it is laid out in rows of ``max_turns`` turns by a running number. Every participant
of the whole conversation gets every part; the parts of a speaker, joined in order, are the whole dialogue. ``begin`` is the place of a
part in the whole rendering, and spans count from the start of the whole, so neither depends on where it was cut. These places come from
lengths, summed over narrow rows.

Defined results: a null role is the speaker "unknown"; a null text is empty; null turns come first; equal turns are ordered by
speaker, then text; conversations of system turns alone give no rows; repeated rows are turns of their own; a null conversation
id is a conversation; "<|" in a text is written "< |", so a text cannot forge a mark; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch

MAX_TURNS = 512
END = "<|end|>"


def _numbered(base: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``at``, the running number of a turn in its conversation: places within sorted ranges, and the ranges' sizes before."""
    # A last key splits ranges of equal turns; equal rows may change places.
    ranged = base.repartitionByRange("conv_id", "t", F.rand(42)).sortWithinPartitions("conv_id", "t")
    laid = scratch.write(ranged.withColumns({"range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "turns")
    sizes = laid.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("conv_id").alias("conv"), F.col("range").alias("of"), (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    found = laid.join(shift, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("of")))
    return found.select("conv_id", "t", (F.col("row") + F.col("shift")).alias("at"))


def _shares(numbered: DataFrame) -> DataFrame:
    """(c, p, s, n, size): turns of each speaker in each part, and how long they are as a user's or the system's."""
    who = F.col("t.speaker")
    head = F.when(who == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), who, F.lit("|>\n")))
    size = F.length(head) + F.length("t.text") + F.length(F.lit(END)) + 1
    return numbered.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p"), who.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("size"))


def _begins(shares: DataFrame, speakers: DataFrame) -> DataFrame:
    """(c, p, s, begin): where each part begins in the rendering of each speaker, from lengths alone."""
    own = shares.select(F.col("c").alias("oc"), F.col("p").alias("op"), F.col("s").alias("os"), "n")
    each = shares.groupBy("c", "p").agg(F.sum("size").alias("size")).join(speakers, F.col("c").eqNullSafe(F.col("conv")))
    each = each.join(own, F.col("c").eqNullSafe(F.col("oc")) & (F.col("p") == F.col("op")) & (F.col("speaker") == F.col("os")), "left")
    # An own turn differs by the length of its head.
    change = F.length(F.lit("<|assistant|>\n")) - F.length(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")))
    before = Window.partitionBy("c", "speaker").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.col("size") + F.coalesce("n", F.lit(0)) * change).over(before), F.lit(0))
    return each.select("c", "p", F.col("speaker").alias("s"), begin.cast("long").alias("begin"))


def rotate(turns: DataFrame, max_turns: int = MAX_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, participant and part: conv_id, part, speaker, n_turns, n_own, begin, rendered, mask."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    base = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            clean(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("speaker"),
            clean(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    scratch = Scratch(turns.sparkSession, "chat")
    numbered = _numbered(base, scratch).withColumn("part", F.floor(F.col("at") / max_turns).cast("long"))
    dialogue = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shares = scratch.write(_shares(numbered), "shares")
    speakers = shares.select(F.col("c").alias("conv"), F.col("s").alias("speaker")).filter("speaker <> 'system'").distinct()
    each = dialogue.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", "part", "turns", "speaker")
    begins = _begins(shares, speakers)
    each = each.join(begins, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("speaker") == F.col("s"))).drop("c", "p", "s")

    me = F.col("speaker")
    head = lambda t: (
        F.when(t["speaker"] == me, F.lit("<|assistant|>\n")).when(t["speaker"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), t["speaker"], F.lit("|>\n")))
    )
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["speaker"] == me).alias("own")))
    laid = each.select("conv_id", "part", "speaker", "begin", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    # Prefix lengths are folded along the pieces; own pieces leave a span.
    start = F.struct(F.col("begin").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", start, step, lambda acc: acc["spans"])
    return laid.select(
        "conv_id",
        "part",
        "speaker",
        "n_turns",
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        "begin",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )
