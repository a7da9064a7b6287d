"""Differences of revisions, erasure, and integrity of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The parts that every pack's manifest must list.
REQUIRED = ("identity.json", "episodes.json", "threads.json", "style.md")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``part, id, change, line``: nodes added, removed, rewritten or newly superseded from ``a`` to ``b``."""
    x = a.select("part", "id", F.col("text").alias("a_text"), F.col("superseded_by").alias("a_by"), F.lit(True).alias("in_a"))
    y = b.select("part", "id", F.col("text").alias("b_text"), F.col("superseded_by").alias("b_by"), F.lit(True).alias("in_b"))
    both = x.join(y, ["part", "id"], "full_outer")
    change = (
        F.when(F.col("in_a").isNull(), "added")
        .when(F.col("in_b").isNull(), "removed")
        .when(~F.col("a_text").eqNullSafe(F.col("b_text")), "rewritten")
        .when(~F.col("a_by").eqNullSafe(F.col("b_by")), "superseded")
    )
    head = F.concat(F.lit(" ["), "part", F.lit("] "))
    line = (
        F.when(F.col("change") == "added", F.concat(F.lit("+"), head, "b_text"))
        .when(F.col("change") == "removed", F.concat(F.lit("-"), head, "a_text"))
        .when(F.col("change") == "rewritten", F.concat(F.lit("~"), head, F.lit("'"), "a_text", F.lit("' -> '"), "b_text", F.lit("'")))
        .otherwise(F.concat(F.lit("~"), head, F.lit("superseded: "), "a_text"))
    )
    return both.withColumn("change", change).where("change is not null").select("part", "id", "change", line.alias("line"))


def remove_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without those of ``gone`` (``id``), and without references to these."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    kept = nodes.join(ids, nodes["id"] == ids["__gone"], "left_anti")
    for column in ("superseded_by", "parent_id"):
        flag = ids.select(F.col("__gone").alias("__ref"), F.lit(True).alias("__hit"))
        kept = kept.join(flag, kept[column] == flag["__ref"], "left")
        kept = kept.withColumn(column, F.when(F.col("__hit"), F.lit(None).cast("string")).otherwise(F.col(column))).drop("__ref", "__hit")
    return kept.select(*nodes.columns)


def purge_turns(turns: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Turns that no removed node came from; turns without an id stay."""
    refs = nodes.join(gone.select("id").distinct(), "id", "left_semi").select(F.explode("source_refs").alias("turn_id")).distinct()
    return turns.join(refs, "turn_id", "left_anti").select(*turns.columns)


def dangling(nodes: DataFrame) -> DataFrame:
    """``id, column, target``: references to nodes that don't exist."""
    refs = nodes.select("id", F.explode(F.create_map(F.lit("superseded_by"), "superseded_by", F.lit("parent_id"), "parent_id")).alias("column", "target"))
    refs = refs.where("coalesce(target, '') != ''")
    return refs.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("id", "column", "target")


def verify(hashes: DataFrame, files: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``path, error`` of a manifest: listed files that are missing or differ, and required ones that aren't listed.

    Listed paths that leave the pack are errors too.  ``hashes`` has ``path, sha256``; ``files`` has ``path, sha256`` as found.
    """
    met = hashes.join(files.select("path", F.col("sha256").alias("found")), "path", "left")
    outside = F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")
    error = F.when(outside, "outside the pack").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "hash mismatch")
    listed = met.select("path", error.alias("error")).where("error is not null")
    spark = hashes.sparkSession
    need = spark.createDataFrame([(p,) for p in required], "path string")
    unlisted = need.join(hashes, "path", "left_anti").select("path", F.lit("not in manifest").alias("error"))
    return listed.unionByName(unlisted)
