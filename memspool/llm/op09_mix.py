"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words.  A document of a source is taken
``rate = target / source_size`` times: the integral part as whole copies, and the
fractional part by chance.  Fractional copies are rounded in pairs: mass moves from
one document to the other, in words, until one of the two probabilities is 0 or 1; the
direction is drawn so that each probability keeps its expectation.  The words that
are expected stay the same at each step, so what a source takes differs from its target
by less than the size of one document.

A source is dealt into groups of bounded size, each group leaves one document
with a fraction, and these residuals meet in a reduction tree of bounded fan-in.
Random draws come from hashes of ids and sizes, so reruns agree.

Defined cases: a null text has size 0; a document of size 0 is taken 0 words (and,
since its copies cost nothing, ``copies`` is the integral part); a null source is a source
of its own, last in order; rows with equal ids are separate documents.  Rows equal in id, text and source are one
unit: of ``rows`` copies with the fraction ``p`` each, ``floor(p * rows)`` are taken and one takes part in the pairing with what is left, so each row is rounded by itself;
which of them are taken goes by a hash of their other columns.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import placed
from .common import WORD_REGEX, materialize

#: Weights of the sources in order, repeating; share of all words; most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents dealt to one group, and residuals that meet in one task.
GROUP_ROWS, FAN_IN = 8192, 64
#: Rows of a unit that are made at once.
EQUAL_ROWS = 4096


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, n_docs, target`` from rows of ``source, size``.

    Targets share ``share`` of all words by weight; what exceeds ``most`` times a source's
    size is shared again among the others.  That is the level L for which the sum of
    min(cap, L * weight) is the total: sources are filled in ascending order of cap over
    weight, so one ordered prefix sum over one row per source finds it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = per.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most)
    caps = caps.withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = caps.select(
        "source", "source_size", "n_docs", "w", "cap", "ratio",
        (F.sum("source_size").over(everything).cast("double") * share).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.sum("w").over(rest).alias("w_rest"),
    )
    # the level if all sources before this one are full
    leveled = leveled.withColumn("level", (F.col("total") - F.col("full")) / F.col("w_rest"))
    # the first source that stays under its cap fixes the level of all that follow
    own = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    leveled = leveled.withColumn("fixed", F.first(own, ignorenulls=True).over(everything))
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fixed") * F.col("w")))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def _round_pairs(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Round the fractions of one group; rows come in a fixed order.

    Returns the rows with ``p`` rounded to 0 or 1, but one at most that keeps a fraction.
    ``last`` rounds that one too.
    """
    pdf = pdf.sort_values(["u", "doc_id", "size"], kind="stable")
    size, p, u = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float).copy(), pdf["u"].to_numpy(float)
    draw = np.modf(u * 1048573.0)[0]  # the low bits: the order above uses the high ones
    held = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if size[i] == 0:
            p[i] = 0.0
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        ma, mb = p[a] * size[a], p[b] * size[b]
        up = min(size[a] - ma, mb)  # words that can move from b to a
        down = min(ma, size[b] - mb)  # and from a to b
        if draw[i] * (up + down) < down:  # the draw keeps both expectations
            to_a = size[a] - ma <= mb
            full, empty = to_a, not to_a or size[a] - ma == mb
            p[a], p[b] = (1.0 if full else (ma + up) / size[a]), (0.0 if empty else (mb - up) / size[b])
        else:
            to_b = size[b] - mb <= ma
            full, empty = to_b, not to_b or size[b] - mb == ma
            p[b], p[a] = (1.0 if full else (mb + down) / size[b]), (0.0 if empty else (ma - down) / size[a])
        held = next((x for x in (a, b) if 0.0 < p[x] < 1.0), -1)
    if last and held >= 0:
        p[held] = 1.0 if np.modf(u[held] * 1009.0)[0] < p[held] else 0.0
    return pdf.assign(p=p)


_ROUNDED = "key long, doc_id long, source string, size long, u double, p double, g long"


def _round(groups: DataFrame, last: bool) -> DataFrame:
    return groups.groupBy("source", "g").applyInPandas(lambda pdf: _round_pairs(pdf, last), _ROUNDED)


def take_copies(units: DataFrame, seed: int = 7, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN, **targets) -> DataFrame:
    """``key, doc_id, source, size, rows, source_size, target, copies, more`` of each unit.

    ``units`` has ``key``, ``doc_id``, ``source``, ``size`` and ``rows``, the number of equal rows: each is taken ``copies`` times, and ``more`` of them
    once more.
    """
    weighed = units.select("source", (F.col("size") * F.col("rows")).alias("size"))
    goal = materialize(source_targets(weighed, **targets), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.join(goal, units["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rows = rows.withColumn("p", _each(rate) - F.floor(_each(rate)))
    # 53 bits of a hash as a draw
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("key")), 11) * F.lit(2.0**-53)
    g = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("key")), F.ceil(F.col("n_docs") / group_rows))
    rows = rows.withColumn("u", u).withColumn("g", g.cast("long"))
    columns = [x.split()[0] for x in _ROUNDED.split(", ")]
    state = materialize(_round(rows.select(columns), False), "mix-rounded")
    open_rows = (F.col("p") > 0) & (F.col("p") < 1)
    rounded, left = state.where(~open_rows), state.where(open_rows)
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    groups = -(-most // group_rows)  # of the largest source: bounds the depth of the tree
    while True:
        groups = -(-groups // fan_in)
        left = left.withColumn("g", F.floor(F.col("g") / fan_in).cast("long"))
        if groups <= 1:
            rounded = rounded.unionByName(_round(left, True))
            break
        step = materialize(_round(left, False), "mix-rounded")
        rounded, left = rounded.unionByName(step.where(~open_rows)), step.where(open_rows)
    rounded = rounded.select("key", "doc_id", "source", F.col("p").alias("extra"))
    same = (units["key"] == rounded["key"]) & units["doc_id"].eqNullSafe(rounded["doc_id"]) & units["source"].eqNullSafe(rounded["source"])
    out = units.join(rounded, same).drop(rounded["key"]).drop(rounded["doc_id"]).drop(rounded["source"])
    out = out.join(goal, out["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    more = F.when(F.col("size") > 0, F.floor(_each(rate)) + F.col("extra")).otherwise(F.lit(0))
    return out.select("key", "doc_id", "source", "size", "rows", "source_size", "target", F.floor(rate).cast("long").alias("copies"), more.cast("long").alias("more"))


def _each(rate: Column) -> Column:
    """The fractions of a unit's rows together."""
    return (rate - F.floor(rate)) * F.col("rows")


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A row for each id, text and source, with the number of equal rows, written to the shared folder."""
    text = F.col(text_col)
    rows = docs.select(
        F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"),
    )
    return materialize(rows.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-units")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per document: its size, its source's size and target, its copies and the words taken."""
    taken = take_copies(_units(docs, id_col, text_col, source_col), **options)
    # in pieces, so that no array grows with the rows of a unit
    parts = taken.withColumn("__from", F.explode(F.sequence(F.lit(1), F.col("rows"), F.lit(EQUAL_ROWS))))
    each = parts.withColumn("__row", F.explode(F.sequence("__from", F.least(F.col("rows"), F.col("__from") + EQUAL_ROWS - 1))))
    each = each.withColumn("copies", F.col("copies") + (F.col("__row") <= F.col("more")).cast("long"))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as it is taken, with its own columns."""
    taken = materialize(take_copies(_units(docs, id_col, text_col, source_col), **options).where("copies > 0 or more > 0"), "mix-copies")
    names = {"key": "__mix_key", "doc_id": "__mix_id", "source": "__mix_source", "copies": "__mix_copies", "more": "__mix_more"}
    once, equal = (taken.where(w).select(*[F.col(a).alias(b) for a, b in names.items()]).hint("merge") for w in ("rows = 1", "rows > 1"))
    key = F.xxhash64(docs[id_col], docs[text_col])

    def joined(copies: DataFrame) -> DataFrame:
        same = (key == copies["__mix_key"]) & docs[id_col].cast("long").eqNullSafe(copies["__mix_id"]) & docs[source_col].cast("string").eqNullSafe(copies["__mix_source"])
        return docs.join(copies, same)

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)

    out = repeated(joined(once), F.col("__mix_copies") + F.col("__mix_more"))
    if taken.where("rows > 1").isEmpty():
        return out
    # equal rows, perhaps a third of all, are numbered by ranges
    unit = F.xxhash64("__mix_key", "__mix_id", "__mix_source").alias("__mix_unit")
    rows = placed(joined(equal).select("*", unit, F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns]))).alias("__mix_order")), ("__mix_unit",), ("__mix_order",))
    times = F.col("__mix_copies") + (F.col("pos") < F.col("__mix_more")).cast("long")
    return out.unionByName(repeated(rows.withColumn("__mix_times", times).where("__mix_times > 0"), F.col("__mix_times")))
