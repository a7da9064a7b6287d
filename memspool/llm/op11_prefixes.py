"""Prefix trie of conversations from chained cryptographic digests.

Each conversation's turns become a chain of SHA-256 digests, one for each prefix.  Every prefix is a row; rows are grouped by
(depth, digest) to nodes; each node is exploded to its ancestors, which sums what lies in their subtrees.

Chains and paths are cut into blocks of ``BLOCK`` turns, so that a conversation that holds a third of all turns neither becomes
one row or task nor, exploded to all ancestors of all its nodes, the square of its length.  A full block has a digest of its
own; the digest of a prefix that ends with a full block is that of the sequence of block digests so far, found in the same way one level up, and
inside of a block the chain goes on from there, turn by turn.  So the digest of a prefix depends on its turns alone.  A node is exploded to the
ancestors in its own block, and what lies below a block's last node arrives from the level above, where only these nodes are left.
There is one level for each power of ``BLOCK`` in the longest conversation.

Defined cases: null roles and texts are empty; turns order by number, null first, and of equal numbers by the digest of
role and text; rows without a conv_id belong to no conversation and make none; repeated rows are separate turns; an empty table has no conversation, so no node,
and gives an empty result.  Only the four columns named are read, so that others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import placed
from .common import materialize

#: Turns of a block, and conversations whose ids are hashed as one piece of text.
BLOCK, IDS = 16, 512
#: The contract's rebuild rule: conversations that share a start, and the bound of shared turns.
FAMILY, SHARED = 5, 9


def _root() -> Column:
    """The digest of the empty prefix."""
    return F.lit(b"")


def _sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def hashed_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, item, size``: turns in order from 0, with the digest of role and text and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    item = _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), item.alias("item"), F.octet_length(text).cast("long").alias("size"))
    turns = materialize(turns.where("conv_id is not null"), "prefix-turns")
    return placed(turns, ("conv_id",), ("turn", "item")).select("conv_id", "pos", "item", "size")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of their family's first one.

    Returns ``conv_id, n`` of each (turnless ones too), and its turns ``conv_id, depth, item, size, n`` from depth 1.
    """
    turns = materialize(turns, "prefix-placed")
    counts = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "prefix-counts")
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared))
    convs = counts.select("conv_id", "own", cut.alias("cut"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("had")), "base", "left")
    convs = convs.withColumn("start", F.least("cut", F.coalesce("had", F.lit(0))))
    convs = materialize(convs.withColumn("n", F.col("start") + F.greatest(F.col("own") - F.col("cut"), F.lit(0))), "prefix-convs")
    # of a first conversation some turns only, each for its family
    firsts = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < shared - 1)).withColumnRenamed("conv_id", "base")
    taken = firsts.join(convs.select("conv_id", "base", "cut", "n"), "base").where("pos < cut").select("conv_id", (F.col("pos") + 1).alias("depth"), "item", "size", "n")
    # (tables on both sides of a join let Spark split a hot key's rows)
    own = turns.join(convs.select("conv_id", "cut", "start", "n"), "conv_id").where("pos >= cut")
    own = own.select("conv_id", (F.col("start") + F.col("pos") - F.col("cut") + 1).alias("depth"), "item", "size", "n")
    return convs.select("conv_id", "n"), taken.unionByName(own)


def chained(items: DataFrame, longest: int, block: int = BLOCK) -> list[DataFrame]:
    """For each level a table of blocks: ``conv_id, block, above, prefixes`` and the columns ``sizes``, ``n`` on the lowest one.

    ``items`` has ``conv_id, depth, item, size, n``; ``prefixes`` has the digests of the prefixes that end in the block, and ``above`` is that of the
    prefix before it.
    """
    at = F.floor((F.col("depth") - 1) / block).cast("long")
    got = F.array_sort(F.collect_list(F.struct("depth", "item", "size")))
    blocks = items.groupBy("conv_id", at.alias("block")).agg(got.alias("got"), F.first("n").alias("n"))
    blocks = blocks.select("conv_id", "block", "n", F.transform("got", lambda x: x["item"]).alias("items"), F.transform("got", lambda x: x["size"]).alias("sizes"))
    if longest < block:
        return [materialize(_prefixes(blocks, _root(), F.lit(None).cast("binary")), "prefix-blocks")]
    blocks = materialize(blocks, "prefix-cut")
    full = F.size("items") == block
    whole = F.sha2(F.array_join(F.transform("items", lambda x: F.hex(x)), "").cast("binary"), 256)
    ends = blocks.where(full).select("conv_id", (F.col("block") + 1).alias("depth"), F.unhex(whole).alias("item"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n"))
    upper = chained(ends, longest // block, block)
    # of each full block: the prefix that ends with it, and the one before
    marks = upper[0].select("conv_id", "above", "block", F.posexplode("prefixes").alias("j", "upto"), "prefixes")
    before = F.when(F.col("j") == 0, F.col("above")).otherwise(F.try_element_at("prefixes", F.greatest("j", F.lit(1))))
    marks = marks.select("conv_id", (F.col("block") * block + F.col("j") + 1).alias("mark"), "upto", before.alias("before"))
    both = blocks.withColumn("mark", F.col("block") + F.when(full, 1).otherwise(0)).join(marks, ["conv_id", "mark"], "left")
    full = F.size("items") == block
    start = F.coalesce(F.when(full, F.col("before")).otherwise(F.col("upto")), _root())
    return [materialize(_prefixes(both, start, F.when(full, F.col("upto"))), "prefix-blocks"), *upper]


def _prefixes(blocks: DataFrame, above: Column, end: Column) -> DataFrame:
    """The chain inside of blocks, from the prefix ``above``; a full block's last prefix is ``end``."""
    blocks = blocks.select("conv_id", "block", "n", "sizes", "items", above.alias("above"), end.alias("end"))
    zero = F.struct(F.col("above").alias("last"), F.array().cast("array<binary>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        new = _sha(F.concat(acc["last"], x))
        return F.struct(new.alias("last"), F.concat(acc["all"], F.array(new)).alias("all"))

    links = F.aggregate("items", zero, step, lambda acc: acc["all"])
    links = F.when(F.col("end").isNull(), links).otherwise(F.concat(F.slice(links, 1, F.size("items") - 1), F.array("end")))
    return blocks.select("conv_id", "block", "n", "sizes", "above", links.alias("prefixes"))


def trie_nodes(convs: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``digest, depth, conv_id, n_convs, size, above, path`` of each node; ``path`` leads through its block to the node itself."""
    each = blocks.select("conv_id", "block", F.posexplode(F.arrays_zip("prefixes", "sizes")).alias("j", "x"))
    depth = F.col("block") * block + F.col("j") + 1
    each = each.select(F.col("x.prefixes").alias("digest"), depth.alias("depth"), "conv_id", F.col("x.sizes").alias("size"))
    nodes = each.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    nodes = nodes.withColumn("block", F.floor((F.col("depth") - 1) / block).cast("long")).join(blocks.select("conv_id", "block", "above", "prefixes"), ["conv_id", "block"])
    path = F.slice("prefixes", F.lit(1), (F.col("depth") - F.col("block") * block).cast("int"))
    nodes = nodes.select("digest", "depth", "conv_id", "n_convs", "size", "above", path.alias("path"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        _root().alias("digest"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("binary").alias("above"), F.array(_root()).alias("path"),
    )
    return nodes.unionByName(root)


def subtree_sums(nodes: DataFrame, levels: list[DataFrame], block: int = BLOCK) -> DataFrame:
    """``digest, leaves, saved`` summed over the subtrees of ``nodes`` (``digest, depth, conv_id, above, path, leaves, saved``)."""
    nodes = materialize(nodes, "prefix-weights")
    # what lies in the block below each last node of a block
    below = nodes.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("digest")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    below = materialize(below, "prefix-below")
    if len(levels) > 1:
        ends = nodes.where(F.col("depth") % block == 0).select("digest", (F.col("depth") / block).cast("long").alias("depth"), "conv_id")
        ends = ends.join(below, "digest", "left").withColumn("block", F.floor((F.col("depth") - 1) / block).cast("long"))
        ends = ends.join(levels[1].select("conv_id", "block", F.col("above").alias("up"), "prefixes"), ["conv_id", "block"], "left")
        path = F.when(F.col("depth") == 0, F.array(_root())).otherwise(F.slice("prefixes", F.lit(1), F.greatest(F.col("depth") - F.col("block") * block, F.lit(0)).cast("int")))
        zero = F.lit(0).cast("long")
        ends = ends.select(
            "digest", "depth", "conv_id", F.when(F.col("depth") > 0, F.col("up")).alias("above"), path.alias("path"),
            F.coalesce("more_leaves", zero).alias("leaves"), F.coalesce("more_saved", zero).alias("saved"),
        )
        below = subtree_sums(ends, levels[1:], block).select("digest", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    whole = nodes.join(below, "digest", "left").select(
        F.explode("path").alias("digest"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
    )
    return materialize(whole.groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "prefix-sums")


def ends_hashes(convs: DataFrame, blocks: DataFrame, block: int = BLOCK, ids: int = IDS) -> DataFrame:
    """``digest, ends_sha256`` of nodes at which conversations end: the hash of their ids in order, joined by commas.

    Ids are joined in pieces of a bounded range first, and one task reads a node's pieces in order, batch by batch: a hash of a
    text can't be divided further, and no list of ids is ever held.
    """
    last = blocks.where(F.col("n") == F.col("block") * block + F.size("prefixes")).select(F.element_at("prefixes", -1).alias("digest"), "conv_id")
    last = last.unionByName(convs.where("n = 0").select(_root().alias("digest"), "conv_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = last.groupBy("digest", F.floor(F.col("conv_id") / ids).cast("long").alias("part")).agg(text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for digest, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest == now:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256()
                state.update(t.encode())
            yield _pairs(out)
        if state is not None:
            yield _pairs([(now, state.hexdigest())])

    def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["digest", "ends_sha256"])

    return parts.repartition("digest").sortWithinPartitions("digest", "part").select("digest", "t").mapInArrow(run, "digest binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, block: int = BLOCK, family: int = FAMILY, shared: int = SHARED, **columns: str) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest``."""
    convs, items = rebuilt(hashed_turns(rows, **columns), family, shared)
    longest = convs.agg(F.max("n")).first()[0] or 0
    levels = chained(items, longest, block)
    nodes = materialize(trie_nodes(convs, levels[0], block), "prefix-nodes")
    parent = F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))).otherwise(F.col("above"))
    linked = nodes.withColumn("parent", parent)
    children = materialize(linked.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children")), "prefix-children")
    known = materialize(linked.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "prefix-known")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    sums = subtree_sums(known.select("digest", "depth", "conv_id", "above", "path", leaf.alias("leaves"), saved.alias("saved")), levels, block)
    ends = materialize(ends_hashes(convs, levels[0], block), "prefix-ends")
    # children of the root, perhaps most nodes, need no join: the root's smallest member is one number
    top = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    first = known.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top).cast("long")))
    deeper = known.where("depth > 1").join(nodes.where("depth > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out = first.unionByName(deeper).join(sums, "digest").join(ends, "digest", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "digest",
    )


#: DuckDB: nodes are the running concatenations of turn digests, and every node meets all of its ancestors.
ORACLE = """
with recursive numbered as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as t,
         sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as item,
         row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 5 as base,
         xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::ubigint)),
             lambda a, b: list_reduce([xor(a, b), 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint],
                                   lambda c, z: xor(c >> 1, (c & 1::ubigint) * 3988292384::ubigint))), 4294967295::ubigint) % 9 as cut
  from (select distinct conv_id from numbered)),
turns as (
  select c.conv_id, n.item, strlen(n.t) as size, 0 as own, n.pos from convs c join numbered n on n.conv_id = c.base and n.pos < c.cut
  union all
  select c.conv_id, n.item, strlen(n.t), 1, n.pos from convs c join numbered n on n.conv_id = c.conv_id and n.pos >= c.cut),
prefixes as (
  select conv_id, size, row_number() over w as depth, string_agg(item, '') over w as path, count(*) over (partition by conv_id) as n
  from turns window w as (partition by conv_id order by own, pos rows unbounded preceding)
  union all select c.conv_id, 0, 0, '', (select count(*) from turns t where t.conv_id = c.conv_id) from convs c),
nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, min(size) as size,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from prefixes group by depth, path),
known as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and left(c.path, 64 * n.depth) = n.path) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = left(n.path, 64 * (n.depth - 1))),
ancestors as (
  select unnest(range(depth + 1)) as depth, path, (n_children = 0)::bigint as leaf, (n_convs - 1) * size as saved from known),
sums as (
  select depth, left(path, 64 * depth) as path, sum(leaf) as n_leaves, sum(saved) as saved_tokens from ancestors group by all)
select k.conv_id::bigint as conv_id, k.depth::bigint as depth, k.parent_conv_id::bigint as parent_conv_id, k.n_convs::bigint as n_convs, k.n_children::bigint as n_children,
       s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, k.ends_sha256
from known k join sums s on s.depth = k.depth and s.path = k.path
"""
