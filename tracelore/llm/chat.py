"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time some turns longer. A rolling hash of the turns identifies
every prefix: the running exclusive or of two 64-bit hashes of (place, role, text). A conversation whose full
hash is the hash of a proper prefix of a longer one goes (anti-join); of equal ones the smallest conv_id stays. What
is left is rendered, at most ``PART_TURNS`` turns to a row, so that no conversation has to fit one row.

Turns are ordered by (turn, role, text), nulls first; place is that rank. Null roles and texts are rendered as empty, but differ from
empty ones in the hash. Rows with a null conv_id form one conversation; repeated rows are turns of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.base import publish

PART_TURNS = 64
#: A conversation is numbered in pieces of so many turn numbers.
SEGMENT = 256
ORDER = ("turn", "role", "text")


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ORDER]


def placed(turns: DataFrame) -> DataFrame:
    """conv, conv_id, place (0, 1, ...), role, text: rows are numbered inside segments of turn numbers, segments by their counts.
    ``conv`` is the conversation's id as a text that is never null, so that windows, joins and sums share one
    partitioning and a turn's text is dealt once."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("none"))
    base = turns.select(conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**62))))
    inside = F.row_number().over(Window.partitionBy("conv", "seg").orderBy(*_order())) - 1
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy("conv", "seg").agg(F.count("*").alias("n")).select("conv", "seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return base.withColumn("at", inside).join(carry, ["conv", "seg"]).select("conv", "conv_id", (F.col("at") + F.col("before")).cast("long").alias("place"), "role", "text")


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """conv, conv_id, n, a, b: length and hash of every prefix, each conversation's whole included; local running hashes of
    ``SEGMENT`` places, combined with the segments before."""
    of = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = numbered.select("conv", "conv_id", "place", F.floor(F.col("place") / SEGMENT).alias("seg"), F.xxhash64(*of).alias("x"), F.xxhash64(F.lit("other"), *of).alias("y"))
    local = Window.partitionBy("conv", "seg").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = hashed.groupBy("conv", "seg").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carry = carry.select("conv", "seg", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("p"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("q"))
    rolling = hashed.select("conv", "conv_id", "seg", "place", F.bit_xor("x").over(local).alias("x"), F.bit_xor("y").over(local).alias("y"))
    return rolling.join(carry, ["conv", "seg"]).select(
        "conv", "conv_id", (F.col("place") + 1).alias("n"), F.col("x").bitwiseXOR(F.col("p")).alias("a"), F.col("y").bitwiseXOR(F.col("q")).alias("b")
    )


def maximal(numbered: DataFrame) -> DataFrame:
    """conv, turns of the conversations that are neither a proper prefix of another nor equal to one with a smaller id."""
    prefixes = publish(prefix_hashes(numbered), "prefixes")
    longest = prefixes.groupBy("conv").agg(F.max("n").alias("turns"))
    ends = publish(prefixes.join(longest, "conv"), "prefix-ends")
    proper = ends.filter("n < turns").select("n", "a", "b").distinct()
    whole = ends.filter("n = turns").groupBy("n", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv")).alias("first"))
    return publish(whole.join(proper, ["n", "a", "b"], "left_anti").select(F.col("first.conv").alias("conv"), F.col("n").alias("turns")), "maximal")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, turns, part, n_turns, text of the maximal conversations; a turn is ``<|role|>``, a line break, its text
    and ``<|end|>``, turns are joined by line breaks."""
    numbered = publish(placed(turns), "turns")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))
    rows = numbered.join(maximal(numbered), "conv").select("conv", "conv_id", "turns", "place", F.floor(F.col("place") / PART_TURNS).alias("part"), line.alias("line"))
    return rows.groupBy("conv", "part").agg(
        F.first("conv_id").alias("conv_id"), F.first("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines")
    ).select(
        "conv_id", "turns", "part", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")
    )
