"""JSON arrays in files of any size, read by byte ranges.

A file is read in pieces that end at closing braces, as a text source reads lines, so Spark splits it like any text file and no task holds more of it
than its range.  Where a member of the array ends depends on all that came before: on whether a brace stands in a string, and how deep.  Both follow from a scan
over the pieces that is associative: a piece turns "in a string" over or leaves it, and adds to the depth what it adds when it begins
outside of a string, or what it adds when it begins inside.  So ranges are scanned side by side for both beginnings, one row for each range says how
it changes either, and what came before a range is a running sum over these rows.

Escaped characters are left out first; as JSON knows no escaped brace, no piece ends within an escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize


def _depth(outside: Column) -> Column:
    """What brackets outside of strings add to the depth; closing braces are between pieces."""
    return F.length(F.translate(outside, "]", "")) - F.length(F.translate(outside, "{[", ""))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, at, value, turns, even, odd`` of each piece: its place, and what it does to the state."""
    read = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    quoted = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    even = _depth(F.array_join(F.filter(quoted, lambda x, i: i % 2 == 0), ""))
    odd = _depth(F.array_join(F.filter(quoted, lambda x, i: i % 2 == 1), ""))
    return read.select("*", (F.size(quoted) - 1).alias("turns"), even.alias("even"), odd.alias("odd"))


def array_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, idx, item``: the objects in the arrays that files hold, as JSON, in their order from 0.

    Members that are no objects are left out, and don't count.  What is no array of valid JSON fails.
    """
    inside = Window.partitionBy("file", "block").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    pieces = _pieces(spark, path)
    # as if the range began outside of a string: where each piece begins and ends
    after = F.sum("turns").over(so_far) % 2
    pieces = pieces.withColumn("ends_in", after).withColumn("begins_in", (F.col("ends_in") + F.col("turns")) % 2)
    # the depth that a piece and the brace behind it add, for a range that begins outside of a string and for one that begins inside
    out = F.when(F.col("begins_in") == 0, F.col("even")).otherwise(F.col("odd")) - (1 - F.col("ends_in"))
    within = F.when(F.col("begins_in") == 0, F.col("odd")).otherwise(F.col("even")) - F.col("ends_in")
    pieces = pieces.select("file", "block", "at", "value", "turns", "ends_in", F.sum(out).over(so_far).alias("out"), F.sum(within).over(so_far).alias("within"))
    pieces = materialize(pieces, "array-pieces")

    last = F.struct("at", "out", "within")
    blocks = pieces.groupBy("file", "block").agg((F.sum("turns") % 2).alias("turned"), F.max(last).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_string", F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2)
    adds = F.when(F.col("in_string") == 0, F.col("last.out")).otherwise(F.col("last.within"))
    # an array that is closed ends at depth 0, and the last piece counts a brace that isn't there
    closed = F.sum(adds).over(Window.partitionBy("file")) == -1
    blocks = blocks.select("file", "block", "in_string", F.coalesce(F.sum(adds).over(before), F.lit(0)).alias("deep"), closed.alias("closed"))
    placed = pieces.join(blocks, ["file", "block"])
    depth = F.col("deep") + F.when(F.col("in_string") == 0, F.col("out")).otherwise(F.col("within"))
    ends = ((F.col("ends_in") + F.col("in_string")) % 2 == 0) & (depth == 1)
    placed = materialize(placed.select("file", "block", "at", "value", "closed", ends.cast("long").alias("ends")), "array-ends")

    earlier = placed.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    earlier = earlier.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counted = placed.withColumn("n", F.coalesce(F.sum("ends").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(earlier, ["file", "block"])
    members = counted.groupBy("file", (F.col("earlier") + F.col("n")).alias("idx")).agg(F.max("ends").alias("ends"), F.bool_and("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["value"]), "}"), "^\ufeff", "")
    first = F.col("idx") == 0
    comma = F.when(first, F.lit(r"^\s*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    wrong = F.raise_error(F.concat(F.lit("no array of JSON objects: "), "file")).cast("string")
    listed = lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    member = F.when(~F.col("closed") | ~F.regexp_like(text, comma), wrong).otherwise(F.element_at(listed(F.concat(F.regexp_replace(text, comma, F.lit("")), F.lit("}"))), -1))
    # what is left behind the last member closes the array
    rest = F.when(F.size(listed(F.when(first, text).otherwise(F.concat(F.lit("[0"), text)))) != 1, wrong)
    rest = F.when(~text.rlike(r"\]\s*$"), wrong).otherwise(rest)
    return members.select("file", "idx", F.when(F.col("ends") == 1, member).otherwise(rest).alias("item")).where("item is not null")
