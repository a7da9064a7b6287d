"""Line dedup by a log-template tree of fixed depth.

A line's tokens are masked where they hold digits (not in lines of one or two tokens, which would be nothing but
wildcards), and the line goes down a tree: by its number
of tokens, then by its leading tokens.  In a leaf, lines that agree in most positions are
variants of one template, whose differing tokens are variable fields (He et al., 2017).  Templates
that recur in ``min_docs`` documents are dropped: their lines go from every document but the
first that has them (``keep_first``), so that no content is lost.

Only hashes are shuffled for counting.  Texts of lines are gathered for those leaves alone that
hold several lines and enough documents; a bitmap of bounded size tells most of these before any
shuffle.  A leaf of up to ``block`` distinct lines is grouped in one task.  A larger one is divided without changing
the result: two variants differ in a share of their positions, so of one block of positions more than that, both have
one in common (pigeonhole), and lines that no chain of common blocks connects are grouped apart.  A part that
is still larger is grouped in rounds: the first ``block`` lines that are left give their leaders, all lines that are left are dealt into
groups of about ``block`` and matched with these, and what matches none goes into the next round.  So no task gets
an unbounded group, and every line is compared with all leaders before it that it could be a variant of.

Defined cases: a null text stays null and has no lines; blank lines always stay;
a text may become empty; equal rows (id and text) count once and have the same result; an empty
table gives an empty result.  ``drop_recurring`` returns all columns of ``docs``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, map_batches, materialize, new_table_path, release, text_bytes
from .op07_simhash import connected_components

_DIGIT = re.compile(rb"[0-9]")
WILDCARD = b"<*>"


@dataclass(frozen=True)
class TemplateParams:
    min_docs: int = 2
    min_tokens: int = 1
    #: Lines of up to so many tokens are templates as they are, digits and all.
    exact_tokens: int = 2
    keep_first: bool = True
    #: Leading tokens in the tree.
    depth: int = 3
    #: Share of positions that agree in one template.
    similarity: float = 0.8
    #: Distinct lines of a leaf that a task groups at once.
    block: int = 512
    #: Bits of the bitmap for each leaf in it, and of the whole bitmap at most (as a power of two: 16 MB); where it is full, more texts are shuffled.
    leaf_bits: int = 16
    bitmap_bits: int = 27


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked_tokens(line: bytes, digits: bool = True, exact: int = 0) -> list[bytes]:
    """The tokens of a line, those with digits as wildcards; ``digits`` False: it has none; up to ``exact`` tokens stay."""
    tokens, search = line.split(), _DIGIT.search
    return [WILDCARD if search(t) else t for t in tokens] if digits and len(tokens) > exact and search(line) else tokens


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """Hash of the path down the tree."""
    return _signed(xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth])))


def _identity(tokens: list[bytes]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(b" ".join(tokens))
    return _signed(h >> 64), _signed(h & ((1 << 64) - 1))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("t"))


def _lines(docs: DataFrame, p: TemplateParams, id_col: str, text_col: str) -> DataFrame:
    """``key, doc_id, line, leaf, h1, h2`` of each line with enough tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for key, doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
            digits = raw is not None and _DIGIT.search(raw) is not None
            for n, line in enumerate((raw or b"").split(b"\n")):
                tokens = masked_tokens(line, digits, p.exact_tokens)
                if len(tokens) >= p.min_tokens:
                    for column, value in zip(out, (key, doc_id, n, leaf_of(tokens, p.depth), *_identity(tokens))):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "doc_id", "line", "leaf", "h1", "h2"])

    return map_batches(_keyed(docs, id_col, text_col), run, "key long, doc_id long, line int, leaf long, h1 long, h2 long")


def leaf_bitmap(leaves: DataFrame, p: TemplateParams) -> tuple[bytes, int]:
    """Bits that are set for the leaves, by the lower bits of their hashes, and the mask of these."""
    n = leaves.count()
    bits = min(max(15, (p.leaf_bits * n - 1).bit_length()), p.bitmap_bits) if n else 15
    mask = (1 << bits) - 1
    word = F.col("leaf").bitwiseAND(F.lit(mask)) + 1  # buckets are counted from 1
    parts = leaves.groupBy(F.bitmap_bucket_number(word).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(word)).alias("m"))
    out = bytearray((mask + 1) // 8)
    for r in parts.toLocalIterator():  # 4 KB each
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(out), mask


def _texts_of(docs: DataFrame, bitmap: bytes, mask: int, p: TemplateParams, id_col: str, text_col: str) -> DataFrame:
    """``leaf, h1, h2, s`` of the lines whose leaves may be among those of the bitmap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(4)]
        seen: set[tuple[int, int]] = set()
        for raw in text_bytes(batch.column(2)):
            digits = raw is not None and _DIGIT.search(raw) is not None
            for line in (raw or b"").split(b"\n"):
                tokens = masked_tokens(line, digits, p.exact_tokens)
                if len(tokens) < p.min_tokens or len(tokens) <= p.depth:
                    continue
                leaf = leaf_of(tokens, p.depth)
                w = leaf & mask
                if bitmap[w >> 3] >> (w & 7) & 1 and (h := _identity(tokens)) not in seen:
                    seen.add(h)
                    for column, value in zip(out, (leaf, *h, b" ".join(tokens).decode("utf-8", "replace"))):
                        column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["leaf", "h1", "h2", "s"])

    return map_batches(_keyed(docs, id_col, text_col), run, "leaf long, h1 long, h2 long, s string")


def group_variants(lines: list[str], similarity: float) -> list[int]:
    """For each line of one leaf, the index of the line that leads its template."""
    tokens = [x.split(" ") for x in lines]
    codes: dict[str, int] = {}
    matrix = np.array([[codes.setdefault(t, len(codes)) for t in row] for row in tokens], np.int32)
    leader, left = np.full(len(lines), -1), np.arange(len(lines))
    while len(left):
        same = (matrix[left] == matrix[left[0]]).mean(1) >= similarity
        same[0] = True
        leader[left[same]] = left[0]
        left = left[~same]
    return leader.tolist()


def match_leaders(leaders: list[str], lines: list[str], similarity: float) -> list[int]:
    """For each line the index of the first leader that it is a variant of, or -1."""
    codes: dict[str, int] = {}
    heads, rows = (np.array([[codes.setdefault(t, len(codes)) for t in x.split(" ")] for x in part], np.int32) for part in (leaders, lines))
    found, left = np.full(len(lines), -1), np.arange(len(lines))
    for i, head in enumerate(heads):
        if not len(left):
            break
        # a leader is its own, at any similarity
        share = (rows[left] == head).mean(1)
        same = (share >= similarity) | (share == 1)
        found[left[same]] = i
        left = left[~same]
    return found.tolist()


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of sorted rows that are equal in their first ``n_keys`` columns."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[:n_keys] != rows[0][:n_keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def divided(large: DataFrame, p: TemplateParams) -> DataFrame:
    """``g, k, s, h1, h2``: lines of large leaves (``leaf, s, h1, h2``) by parts that hold all variants of each other, and the parts' sizes."""
    tokens, n = F.split("s", " "), F.size(F.split("s", " "))
    # so many positions of two variants may differ: of one block more than that, one is equal in both
    blocks = F.floor(n * (1 - p.similarity) + 1e-9).cast("int") + 1
    cut = lambda i: F.lit(p.depth) + F.floor((n - p.depth) * i / blocks).cast("int")
    cell = lambda i: F.xxhash64("leaf", i, F.array_join(F.slice(tokens, cut(i) + 1, cut(i + 1) - cut(i)), " "))
    cells = materialize(large.select(F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), cell)).alias("cell"), "h1"), "line-cells")
    least = materialize(cells.groupBy("cell").agg(F.min("h1").alias("least")), "line-cells")
    # a node is half of a line's hash: equal halves can only join parts
    parts = connected_components(cells.join(least, "cell").select(F.col("h1").alias("a"), F.col("least").alias("b")))
    named = large.join(parts, large["h1"] == parts["node"], "left").select(F.coalesce("component", "h1").alias("g"), "s", "h1", "h2")
    named = materialize(named, "line-parts")
    return named.join(materialize(named.groupBy("g").agg(F.count("*").alias("k")), "line-parts"), "g")


def large_templates(found: DataFrame, p: TemplateParams) -> DataFrame:
    """``h1, h2, t1, t2`` as of ``group_variants``, for groups of any size; ``found`` has ``g, k, s, h1, h2``."""
    spark = found.sparkSession
    out = spark.createDataFrame([], "h1 long, h2 long, t1 long, t2 long")
    left = materialize(found.select("g", "k", "s", "h1", "h2"), "line-left")
    order = Window.partitionBy("g").orderBy("s", "h1", "h2")
    n_parts = F.ceil(F.col("k") / p.block).cast("int")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            at = group_variants([r[2] for r in rows], p.similarity)
            yield pa.RecordBatch.from_pylist([dict(zip(("g", "k", "s", "h1", "h2"), rows[i])) for i in sorted(set(at))], lead_schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            leaders, lines = [r for r in rows if r[2] == 0], [r for r in rows if r[2] == 1]
            if lines:
                columns = [list(c) for c in zip(*(r[3:] for r in lines))]
                at = match_leaders([r[4] for r in leaders], columns[1], p.similarity)
                t = [pa.array([leaders[i][c] if i >= 0 else None for i in at], pa.int64()) for c in (5, 6)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
                group = pa.array([r[0] for r in lines], pa.int64())
                yield pa.RecordBatch.from_arrays([group, *map(pa.array, columns, kinds), *t], names=["g", "k", "s", "h1", "h2", "t1", "t2"])

    lead_schema = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("s", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())])
    while not left.isEmpty():
        heads = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= p.block).select("g", "k", "s", "h1", "h2")
        heads = heads.repartition("g").sortWithinPartitions("g", "s", "h1", "h2")
        leaders = materialize(heads.mapInArrow(lead, "g long, k long, s string, h1 long, h2 long"), "line-leaders")
        every = F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part")
        dealt = leaders.select("g", every, F.lit(0).alias("kind"), "k", "s", "h1", "h2")
        part = F.pmod(F.xxhash64("h1", "h2"), n_parts).cast("int").alias("part")
        dealt = dealt.unionByName(left.select("g", part, F.lit(1).alias("kind"), "k", "s", "h1", "h2"))
        dealt = dealt.repartition("g", "part").sortWithinPartitions("g", "part", "kind", "s", "h1", "h2")
        named = materialize(dealt.mapInArrow(match, "g long, k long, s string, h1 long, h2 long, t1 long, t2 long"), "line-matched")
        out = out.unionByName(named.where("t1 is not null and (h1 != t1 or h2 != t2)").select("h1", "h2", "t1", "t2"))
        left = materialize(named.where("t1 is null").select("g", "k", "s", "h1", "h2"), "line-left")
        release(leaders)
    return out


def busy_leaves(lines: DataFrame, p: TemplateParams) -> DataFrame:
    """``leaf, k``: leaves that enough lines reach for a template to recur, and their numbers of distinct lines."""
    distinct = lines.groupBy("leaf", "h1", "h2").agg(F.count("*").alias("n"))
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return leaves.where(F.col("n") >= p.min_docs).select("leaf", "k")


def templates(docs: DataFrame, leaves: DataFrame, p: TemplateParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``h1, h2, t1, t2``: for lines that are variants of another, the line that leads their template."""
    spark = docs.sparkSession
    schema = "h1 long, h2 long, t1 long, t2 long"
    leaves = materialize(leaves.where("k > 1"), "line-leaves")
    if leaves.isEmpty():
        return spark.createDataFrame([], schema)
    found = _texts_of(docs, *leaf_bitmap(leaves, p), p, id_col, text_col)
    # (a row for a line before the join: a hot line is in many pieces of the corpus)
    found = materialize(found.dropDuplicates(["h1", "h2"]).join(leaves, "leaf"), "line-texts")
    columns = ["g", "s", "h1", "h2"]
    both = found.where(F.col("k") <= p.block).withColumn("g", F.col("leaf")).select(columns)
    large = found.where(F.col("k") > p.block)
    parts = None if large.isEmpty() else materialize(divided(large, p), "line-parts")
    if parts is not None:
        both = both.unionByName(parts.where(F.col("k") <= p.block).select(columns))
    # groups are small and many: they follow each other in a partition's order, without a frame for each
    sorted_groups = both.repartition("g").sortWithinPartitions(*columns)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[], [], [], []]

        def close(rows: list[tuple]) -> None:
            for (_, h1, h2), at in zip(rows, group_variants([r[0] for r in rows], p.similarity)):
                _, t1, t2 = rows[at]
                if (h1, h2) != (t1, t2):
                    for column, value in zip(out, (h1, h2, t1, t2)):
                        column.append(value)

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h1", "h2", "t1", "t2"])
            for c in out:
                c.clear()
            return batch

        group, rows = None, []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and rows:
                    close(rows)
                    rows = []
                group = g
                rows.append(tuple(row))
            yield taken()
        if rows:
            close(rows)
            yield taken()

    named = materialize(sorted_groups.mapInArrow(lead, schema), "line-templates")
    return named if parts is None else named.unionByName(large_templates(parts.where(F.col("k") > p.block), p))


def recurring_lines(docs: DataFrame, p: TemplateParams = TemplateParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, lines``: for each document that loses lines, their numbers; ``key`` is a hash of id and text."""
    spark = docs.sparkSession
    path = new_table_path(spark, "lines")
    _lines(docs, p, id_col, text_col).write.parquet(path)
    lines = spark.read.parquet(path)
    leaves = materialize(busy_leaves(lines, p), "line-leaves")
    # most lines are alone in their leaves, and go before anything else is asked of them
    lines = materialize(lines.join(leaves.select("leaf"), "leaf", "left_semi").drop("leaf"), "lines")
    drop_table(spark, path)
    variants = templates(docs, leaves, p, id_col, text_col).select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), "t1", "t2")
    same = (lines["h1"] == variants["v1"]) & (lines["h2"] == variants["v2"])
    named = lines.join(variants, same, "left").select("key", "doc_id", "line", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2"))
    named = materialize(named, "line-named")
    # a null id comes last
    once = named.select("t1", "t2", "key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d")).distinct()
    per = once.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min(F.struct("d", "key")).alias("head"))
    per = materialize(per.where(F.col("n") >= p.min_docs).select("t1", "t2", "head"), "line-recurring")
    gone = named.join(per, ["t1", "t2"])
    if p.keep_first:
        gone = gone.where((F.col("key") != F.col("head.key")) | (F.coalesce("doc_id", F.lit((1 << 63) - 1)) != F.col("head.d")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("line").alias("lines"))


def drop_recurring(docs: DataFrame, p: TemplateParams = TemplateParams(), id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the text of each document without its recurring lines.

    With ``counts``, two columns more: ``n_lines`` and ``n_dropped``.
    """
    gone = materialize(recurring_lines(docs, p, id_col, text_col), "line-gone")
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
    # the same join at every size: the list of affected documents grows with the corpus
    gone = gone.select(F.col("doc_id").alias("__line_id"), F.col("key").alias("__line_key"), F.col("lines").alias("__gone")).hint("merge")
    joined = docs.join(gone, (key == F.col("__line_key")) & docs[id_col].cast("long").eqNullSafe(F.col("__line_id")), "left")
    parts = F.split(docs[text_col], "\n", -1)
    # the runs of lines between those that go
    at = F.array_sort("__gone")
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(parts))), lambda a, b: F.slice(parts, a + 2, b - a - 1))
    kept = F.flatten(runs)
    text = F.when(F.col("__gone").isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n")).alias(text_col)
    out = [text if c == text_col else docs[c] for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)
