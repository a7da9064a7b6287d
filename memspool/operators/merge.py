"""De-duplication and merging of memory nodes, from tables of proposed pairs.

All of these work on node tables with an explicit order ``ord``; ``keys`` are the columns
within which nodes meet, as ``part`` or ``profile, part``.  Every step is an aggregation or an
equi-join; no group is ever collected but the lists of references and tags of one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_key
from ..schema import absent, present
from ..sources.scratch import materialize

KEYS = ("part",)


def ordered_union(order: Column, values: Column) -> Column:
    """Aggregate: the distinct values of all arrays, in the order of first occurrence."""
    lists = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(values, F.array().cast("array<string>")).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["v"])))


def _fold(order: Column) -> dict[str, Column]:
    """What the repeats of a node add to it, besides what the first one has."""

    def first_present(name: str) -> Column:
        return F.min_by(F.when(~absent(F.col(name)), F.col(name)), F.when(~absent(F.col(name)), order))

    def last_present(name: str) -> Column:
        return F.max_by(F.when(~absent(F.col(name)), F.col(name)), F.when(~absent(F.col(name)), order))

    return {
        "salience": F.max("salience"),
        "source_refs": ordered_union(order, F.col("source_refs")),
        "tags": ordered_union(order, F.col("tags")),
        "last_confirmed_at": F.max("last_confirmed_at"),
        "valid_from": first_present("valid_from"),
        "valid_until": last_present("valid_until"),
        "quote": first_present("quote"),
    }


def dedup_exact(nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One node for each normalized text: the first one, with what its repeats add.

    The highest salience, stated before inferred, references and tags in order of first occurrence, the
    first start and quote, the last end.  ``ord`` is that of the first.
    """
    order = F.col("ord")
    folded = _fold(order)
    rest = [c for c in nodes.columns if c not in (*keys, *folded, "ord", "confidence")]
    out = nodes.withColumn("__key", normalized_key("text")).groupBy(*keys, "__key").agg(
        F.min("ord").alias("ord"),
        F.min_by(F.struct(*rest), order).alias("__first"),
        F.when(F.bool_or(F.col("confidence") == "stated"), F.lit("stated")).otherwise(F.min_by("confidence", order)).alias("confidence"),
        *[c.alias(n) for n, c in folded.items()],
    )
    return out.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in nodes.columns])


def number(nodes: DataFrame, chunk: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Positions of nodes within their keys, by ``ord``: ``pos``, or ``chunk`` and ``pos`` within it."""
    out = placed(nodes, keys, ("ord",), WHOLE)
    if chunk is not None:
        out = out.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long")).withColumn("pos", F.pmod("pos", F.lit(chunk)).cast("long"))
    return out.select(*nodes.columns, *(["chunk"] if chunk is not None else []), "pos")


#: Rows of a key that one task may number.
WHOLE = 100_000


def placed(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], whole: int = 0) -> DataFrame:
    """Rows with ``pos``, their position within ``keys`` in the order of the columns ``order``.

    Rows are dealt by ranges of keys and order and numbered in each range; then the counts of the ranges before, one row for
    each key and range, are added.  So no task holds all rows of a key.  Keys of at most ``whole`` rows are numbered by a window instead, which needs no table
    between; both ways give the same positions.  Keys aren't null.
    """
    if whole:
        large = materialize(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > whole).select(*keys), "large-keys")
        within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        if large.isEmpty():
            return rows.withColumn("pos", within.cast("long"))
        small = rows.join(large, list(keys), "left_anti").withColumn("pos", within.cast("long"))
        return small.unionByName(placed(rows.join(large, list(keys), "left_semi"), keys, order)).select(*rows.columns, "pos")
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    numbered = numbered.withColumn("__range", F.shiftright("__at", 33))
    counts = numbered.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    out = numbered.join(counts, [*keys, "__range"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.select(*rows.columns, "pos")


def apply_resolution(nodes: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("part", "chunk")) -> DataFrame:
    """Apply pairs within numbered chunks: drop duplicates, mark contradicted nodes as superseded.

    ``nodes`` has ``pos`` within ``keys``; ``pairs`` has ``keys, kind, pair_ord, i, j``.  A duplicate pair drops its
    second node if that exists; of a contradiction both must exist and differ, and the last pair of a node counts.
    """
    at = [*keys, "pos"]
    where = nodes.select(*at, "id")
    drops = pairs.where("kind = 'duplicate'").select(*keys, F.col("j").alias("pos")).distinct()
    newer = where.select(*keys, F.col("pos").alias("j"), F.col("id").alias("__newer"))
    by = pairs.where("kind = 'contradiction' and i != j").join(newer, [*keys, "j"])
    by = by.groupBy(*keys, F.col("i").alias("pos")).agg(F.max_by("__newer", "pair_ord").alias("__newer"))
    out = nodes.join(drops, at, "left_anti").join(by, at, "left")
    return out.withColumn("superseded_by", F.coalesce("__newer", "superseded_by")).drop("__newer").select(*nodes.columns)


def apply_merge(base: DataFrame, new: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Merge new nodes into existing ones by proposed pairs of positions (existing ``i``, new ``j``).

    A duplicate folds the new node into the existing one, which takes the longest text; the first pair
    of a new node counts.  A contradiction marks the existing node as superseded by the new
    one, whose start is its end; the first pair of an existing node counts, and folded nodes none.
    ``base`` and ``new`` have ``pos`` within ``keys``; new nodes follow the existing ones in ``ord``.
    """
    merged, added = merged_and_added(base, new, pairs, keys)
    return merged.unionByName(added)


def merged_and_added(base: DataFrame, new: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The same in two tables: what stands, and the new nodes that aren't folded.

    Pairs of several chunks may come at once, with ``pair_ord`` in the order of chunks: what one chunk after the other would make of a node is the same.
    """
    rest = [c for c in base.columns if c not in keys]
    old_at = base.select(*keys, F.col("pos").alias("i"))
    new_at = new.select(*keys, F.col("pos").alias("j"), F.struct(*[c for c in rest if c != "pos"]).alias("__new"))
    both = pairs.join(old_at, [*keys, "i"], "left_semi").join(new_at, [*keys, "j"])
    first = Window.partitionBy(*keys, "j").orderBy("pair_ord")
    folds = both.where("kind = 'duplicate'").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    taken = folds.select(*keys, "j")

    # the existing node and what is folded into it, in the order of the pairs
    seq = F.lit(-1).cast("long")
    rows = base.withColumn("__seq", seq).unionByName(
        folds.select(*keys, F.col("i").alias("pos"), F.col("pair_ord").cast("long").alias("__seq"), "__new.*"), allowMissingColumns=True
    )
    order = F.col("__seq")
    folded = _fold(order)
    kept = [c for c in rest if c not in (*folded, "pos", "confidence", "text")]
    own = F.struct(*kept)
    merged = rows.groupBy(*keys, "pos").agg(
        F.min_by(own, order).alias("__own"),
        # the longest text; of equal lengths the earlier one
        F.max_by("text", F.struct(F.length("text"), -order)).alias("text"),
        F.when(F.bool_or(F.col("confidence") == "stated"), F.lit("stated")).otherwise(F.min_by("confidence", order)).alias("confidence"),
        *[c.alias(n) for n, c in folded.items()],
    )
    merged = merged.select(*[F.col(f"__own.{c}").alias(c) if c in kept else F.col(c) for c in base.columns])

    against = both.where("kind = 'contradiction'").join(taken, [*keys, "j"], "left_anti")
    against = against.groupBy(*keys, F.col("i").alias("pos")).agg(F.min_by(F.struct("__new.id", "__new.valid_from"), "pair_ord").alias("__by"))
    open_node = absent(F.col("superseded_by")) & F.col("__by").isNotNull()
    merged = merged.join(against, [*keys, "pos"], "left").withColumns(
        {
            "superseded_by": F.when(open_node, F.col("__by.id")).otherwise(F.col("superseded_by")),
            "valid_until": F.when(open_node, F.coalesce(present(F.col("valid_until")), F.col("__by.valid_from"))).otherwise(F.col("valid_until")),
        }
    )
    added = new.join(taken.withColumnRenamed("j", "pos"), [*keys, "pos"], "left_anti")
    return merged.select(*base.columns), added.select(*base.columns)


def groupable() -> Column:
    """Episodes that a group may take: no summary, and in no group yet."""
    return (F.col("part") == "episodes") & (F.col("granularity") != "summary") & absent(F.col("parent_id"))


def merge_packs(nodes: DataFrame, styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of packs: of each exact text the first node over all parts, and the distinct styles.

    ``nodes`` has ``pack_ord`` (order of the packs), ``styles`` has ``pack_ord, text``.
    """
    from ..functions.text import strip

    part = F.array_position(F.array(*map(F.lit, ("identity", "episodes", "threads"))), F.col("part"))
    order = F.struct("pack_ord", part.alias("part_ord"), "ord")
    rest = [c for c in nodes.columns if c != "text"]
    kept = nodes.groupBy("text").agg(F.min_by(F.struct(*rest), order).alias("__first"))
    kept = kept.select(*[F.col(c) if c == "text" else F.col(f"__first.{c}").alias(c) for c in nodes.columns])
    lines = F.array_sort(F.collect_list(F.struct("pack_ord", strip("text").alias("s"))))
    style = F.array_join(F.array_distinct(F.filter(F.transform(lines, lambda x: x["s"]), lambda s: s != "")), "\n")
    return kept, styles.agg(style.alias("text"))


def attach_groups(nodes: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Parents of proposed groups, and the nodes with their parents.

    ``nodes`` has ``pos``, ``groups`` has ``group_ord, summary, members`` (positions), and ``id`` for the parent.  Members that
    don't exist are ignored; a group with fewer than two members or without a summary makes no parent; a node
    in several groups belongs to the last.  A parent has the highest salience and all references of its members.
    """
    members = groups.where(~absent(F.col("summary"))).select(*keys, "group_ord", "summary", F.col("id").alias("__parent"), F.posexplode("members").alias("__m", "pos"))
    met = members.join(nodes.select(*keys, "pos", "salience", "source_refs"), [*keys, "pos"])
    parents = met.groupBy(*keys, "group_ord", "__parent").agg(
        F.count("*").alias("n"), F.first("summary").alias("text"), F.max("salience").alias("salience"), ordered_union(F.col("__m"), F.col("source_refs")).alias("source_refs")
    ).where("n >= 2").drop("n")
    used = met.join(parents.select(*keys, "group_ord"), [*keys, "group_ord"], "left_semi")
    chosen = used.groupBy(*keys, "pos").agg(F.max_by("__parent", "group_ord").alias("__parent"))
    out = nodes.join(chosen, [*keys, "pos"], "left").withColumn("parent_id", F.coalesce("__parent", "parent_id"))
    return parents.withColumnRenamed("__parent", "id"), out.select(*nodes.columns)
