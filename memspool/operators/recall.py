"""Recall of the memory: judged answers, by category and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import judged, strip
from .merge import placed


def judge(answers: DataFrame) -> DataFrame:
    """``answers`` (with ``answer, expected``) and ``passed``."""
    return answers.withColumn("passed", judged("answer", "expected"))


def by_category(results: DataFrame) -> DataFrame:
    """``category, passed, total`` of all questions with a category."""
    return results.where("coalesce(category, '') != ''").groupBy("category").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def recall(results: DataFrame) -> DataFrame:
    """One row: ``passed, total, percent`` (rounded down; null without questions)."""
    n = F.count_if("passed")
    return results.agg(n.alias("passed"), F.count("*").alias("total"), F.when(F.count("*") > 0, F.floor(100 * n / F.count("*"))).cast("long").alias("percent"))


def report(results: DataFrame, budget: int, verbose: bool = False) -> DataFrame:
    """``n, line``: each question and whether it passed, in order, the answer where it didn't (or ``verbose``), recall, and categories by name."""
    line = lambda group, a, b, text: F.struct(F.lit(group).alias("g"), a.alias("a"), F.lit(b).alias("b"), text.alias("line"))
    order = F.format_string("%020d", F.col("q_ord").cast("long"))
    asked = line(0, order, 0, F.concat(F.when(F.col("passed"), "PASS  ").otherwise("FAIL  "), "question"))
    answer = line(0, order, 1, F.concat(F.lit("      -> "), strip(F.substring("answer", 1, 200))))
    said = F.array_compact(F.array(asked, F.when(F.lit(verbose) | ~F.col("passed"), answer)))
    rows = results.select(F.inline(said))
    whole = F.concat(F.lit("\nrecall "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), F.coalesce(F.col("percent").cast("string"), F.lit("None")), F.lit(f"%) @ budget {budget}"))
    rows = rows.unionByName(recall(results).select(F.inline(F.array(line(1, F.lit(""), 0, whole)))))
    each = F.concat(F.lit("  "), "category", F.lit(": "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"))
    rows = rows.unionByName(by_category(results).select(F.inline(F.array(line(2, F.col("category"), 0, each)))))
    return placed(rows.withColumn("__all", F.lit(0)), ("__all",), ("g", "a", "b")).select(F.col("pos").alias("n"), "line")
