"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint has 64 bits from its document's word shingles.  It is mapped to the bit counts of
its 32 segments of two bits: a point of {0, 1, 2}^32.  A bit that differs changes one
coordinate by one at most, so the Manhattan distance of two points is a lower bound of the
Hamming distance of their fingerprints, and all links lie within Manhattan distance 3.

The range-join runs on a grid: each point is seen in two halves of 16 coordinates, and of two
points within distance 3 one half at least lies within distance 1.  A half's cell is its
16 counts; a point looks into its own cell and into the cells one step up in a coordinate
(of two points one step apart, one finds the other so).  No link is lost, and every
candidate is verified exactly with XOR and a bit count.

Equal fingerprints are one row throughout.  Cells of few rows are joined.  Those of many are divided by the other half:
within distance 3 one at least of its four quarters has the same counts in both points.  Where a quarter's cell is still
dense, as in a large group of near copies, its rows are compared with the smallest one, and components are formed; then only
rows outside of a cell's largest component are compared with all others, in pairs of blocks of bounded size, each of which gives
links between different components only.  So a group that hangs together costs as much as it has members.
Components come from alternating large-star and small-star steps.

Defined cases: null or wordless texts have fingerprint zero and are linked like any
other; ids that repeat are separate rows with one result each; an empty table gives an empty result.
Only the id and text columns are read, so that other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, release, text_bytes

SEED, BITS, MOST = 42, 3, 4096
#: Rows of a block in a cell with many rows.
BLOCK = 1024


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Hashes of the word shingles of a text in UTF-8; a shorter text is one shingle, one without words none."""
    tokens = raw.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = max(1, len(tokens) - words + 1)
    stops = ends[words - 1 :] - 1 if len(tokens) > words else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), stops.tolist())], np.uint64)


def fingerprint(raw: bytes, words: int = 3) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer."""
    return majority_bits(shingles(raw, words))


def majority_bits(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    k = len(h)
    if not k:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, k, 4096):  # bounded memory for long texts
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > k, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, key, fp`` of every row; ``key`` is a hash of id and text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint(raw or b"", words) for raw in text_bytes(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], names=["doc_id", "key", "fp"])

    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return map_batches(docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("t")), run, "doc_id long, key long, fp long")


def _halves(fp: Column) -> list[Column]:
    """The two-bit fields of both halves of the embedding; the half's number is bit 32."""
    low = F.lit(0xFFFFFFFF)

    def counts(bits: Column) -> Column:
        return bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))

    return [counts(fp.bitwiseAND(low)), counts(F.shiftrightunsigned(fp, 32)).bitwiseOR(F.lit(1 << 32))]


def grid_cells(fps: DataFrame, grid: Column | None = None) -> DataFrame:
    """``cell, own`` and the columns of ``fps``: the cell that a fingerprint lies in (own) and those one step up.

    Where there are several grids, ``grid`` is the number of the row's one.
    """
    cells = []
    for half in _halves(F.col("fp")):
        half = half if grid is None else half + F.shiftleft(grid.cast("long"), 33)
        cells.append(F.struct(half.alias("cell"), F.lit(True).alias("own")))
        for i in range(0, 32, 2):
            up = F.when(F.shiftrightunsigned(half, i).bitwiseAND(F.lit(3)) < 2, half + F.lit(1 << i))
            cells.append(F.struct(up.alias("cell"), F.lit(False).alias("own")))
    return fps.select(F.explode(F.array(*cells)).alias("c"), *fps.columns).where("c.cell is not null").select("c.cell", "c.own", *fps.columns)


def _forest(a: np.ndarray, b: np.ndarray, bits: int, group: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links between two blocks of fingerprints, enough to connect all that are linked and in different groups."""
    both = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(both, np.unique(a)), np.searchsorted(both, np.unique(b))
    label = np.arange(len(both)) if group is None else np.unique([group[x] for x in both.tolist()], return_inverse=True)[1]
    out, codes = [], both.view(np.uint64)
    for i in ia.tolist():
        near = ib[(label[ib] != label[i]) & (np.bitwise_count(codes[ib] ^ codes[i]) <= bits)]
        for j in near.tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(both[i]), int(both[j])))
    return out


def deal(many: DataFrame, block: int) -> DataFrame:
    """``cell, own, fp, part, kind, i, j``: rows of dense cells (``cell, own, fp, n_own, n_up``) in pairs of blocks.

    Own rows meet own rows (kind 0) and all others (kind 1), which don't meet each other.
    """

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / block).cast("int")

    part = F.pmod(F.xxhash64(F.lit(11), "fp"), F.greatest(F.when(F.col("own"), blocks("n_own")).otherwise(blocks("n_up")), F.lit(1)))
    dealt = many.withColumn("part", part.cast("int"))
    one = F.lit(1)
    # own block i against own block j >= i, and against block j of those that look in
    own_own = F.transform(
        F.sequence(F.lit(0), F.greatest(blocks("n_own"), one) - 1),
        lambda j: F.struct(F.lit(0).alias("kind"), F.least("part", j).alias("i"), F.greatest("part", j).alias("j")),
    )
    own_up = F.transform(
        F.sequence(F.lit(0), F.greatest(blocks("n_up"), one) - 1),
        lambda j: F.struct(F.lit(1).alias("kind"), F.col("part").alias("i"), j.cast("int").alias("j")),
    )
    up_own = F.transform(
        F.sequence(F.lit(0), F.greatest(blocks("n_own"), one) - 1),
        lambda i: F.struct(F.lit(1).alias("kind"), i.cast("int").alias("i"), F.col("part").alias("j")),
    )
    tasks = F.when(F.col("own"), F.concat(own_own, own_up)).otherwise(up_own)
    return dealt.select("cell", "own", "fp", "part", F.explode(tasks).alias("t")).select("cell", "own", "fp", "part", "t.kind", "t.i", "t.j")


def _quarters(fp: Column, cell: Column) -> Column:
    """Cells within a half's cell, by the four quarters of the other half."""
    low, high = _halves(fp)
    other = F.when(cell.bitwiseAND(F.lit(1 << 32)) != 0, low).otherwise(high)
    return F.array(*[F.xxhash64(cell, F.lit(i), F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255))) for i in range(4)])


def _busy(cells: DataFrame) -> DataFrame:
    """The rows of ``cells`` that hold own rows and any others, with ``n_own, n_up``."""
    counts = cells.groupBy("cell").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_up"))
    counts = materialize(counts.where((F.col("n_own") > 0) & (F.col("n_own") + F.col("n_up") > 1)), "simhash-counts")
    # (tables on both sides of a join let Spark split a hot cell's rows)
    return materialize(cells.join(counts, "cell"), "simhash-busy")


def _joined(few: DataFrame, bits: int) -> DataFrame:
    """``a, b``: all links of an own row and another one in its cell."""
    x = few.where("own").select("cell", F.col("fp").alias("a"))
    y = few.select("cell", F.col("fp").alias("b"), F.col("own").alias("b_own"))
    # in one cell a pair counts once; from the cell below it comes from one side only
    found = x.join(y, "cell").where((F.col("a") != F.col("b")) & (~F.col("b_own") | (F.col("a") < F.col("b"))))
    return found.where(_near(bits)).select("a", "b")


def _near(bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits


def outside_top(many: DataFrame, groups: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``cell, fp, component, size, own, n_own, n_up, k_own, k_all``: rows of cells (``cell, fp``) that hold several components (``groups``).

    ``own`` marks rows outside of the cell's largest component, which are all that is left to compare with others.  ``n_own`` and ``n_up`` are the sums of
    ``sizes`` (``fp, size``; 1 without) of these and of the others, ``k_own`` and ``k_all`` the numbers of these and of all.
    """
    named = many.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select("cell", "fp", F.coalesce("component", "fp").alias("component"))
    named = named.withColumn("size", F.lit(1).cast("long")) if sizes is None else named.join(sizes, "fp")
    named = materialize(named, "dense-named")
    counted = named.groupBy("cell", "component").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    cells = counted.groupBy("cell").agg(F.max(F.struct("n", "component", "k")).alias("top"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    cells = cells.where(F.col("k") > F.col("top.k")).select(
        "cell", F.col("top.component").alias("top"), (F.col("n") - F.col("top.n")).alias("n_own"), F.col("top.n").alias("n_up"),
        (F.col("k") - F.col("top.k")).alias("k_own"), F.col("k").alias("k_all"),
    )
    cells = materialize(cells, "dense-cells")
    return materialize(named.join(cells, "cell").withColumn("own", F.col("component") != F.col("top")).drop("top"), "dense-rows")


def links(fps: DataFrame, bits: int = BITS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between different fingerprints, enough to connect all that are linked.

    ``fps`` has one row for each fingerprint.  ``bits`` up to 3.
    """
    if bits > 3:
        raise ValueError("the halves of the grid hold for up to 3 differing bits")
    few, many = shared_cells(fps, most)
    found = [_joined(x, bits) for x in few]
    if many is not None:
        found.append(_stars(many, bits))
        linked = materialize(reduce(DataFrame.unionByName, found).distinct(), "simhash-links")
        return linked.unionByName(_dense_links(many.select("cell", "fp"), connected_components(linked), bits, block))
    return reduce(DataFrame.unionByName, found).distinct()


def shared_cells(fps: DataFrame, most: int = MOST, grid: Column | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows (``cell, own`` and those of ``fps``) of the grid's cells of few rows that hold others too, and of dense ones, if any.

    A pair within 3 bits shares a cell.  So does one further apart of which a half lies within distance 1 and, where that half's cell is dense, a quarter of
    the other one is equal.
    """
    cells = grid_cells(fps, grid)
    rest = [c for c in cells.columns if c != "cell"]
    # nearly all cells one step up hold nobody: they go first
    used = cells.where("own").select(F.col("cell").alias("used")).distinct()
    busy = _busy(materialize(cells.join(used, F.col("cell") == F.col("used"), "left_semi"), "simhash-cells"))
    dense = F.col("n_own") * (F.col("n_own") + F.col("n_up")) > most
    few, many = [busy.where(~dense)], busy.where(dense)
    if many.isEmpty():
        return few, None
    inner = _busy(materialize(many.select(F.explode(_quarters(F.col("fp"), F.col("cell"))).alias("cell"), *rest), "simhash-cells"))
    few.append(inner.where(~dense))
    many = materialize(inner.where(dense).select("cell", *rest), "simhash-dense")
    return few, None if many.isEmpty() else many


def _stars(many: DataFrame, bits: int) -> DataFrame:
    """Links of a cell's rows with the smallest own one."""
    heads = materialize(many.where("own").groupBy("cell").agg(F.min("fp").alias("a")), "simhash-heads")
    return many.join(heads, "cell").withColumnRenamed("fp", "b").where("a != b").where(_near(bits)).select("a", "b")


def _dense_links(many: DataFrame, groups: DataFrame, bits: int, block: int) -> DataFrame:
    """Links among rows of a cell (``cell, fp``) that are in different components (``groups``)."""
    rows = outside_top(many, groups)
    dealt = deal(rows, block).join(rows.select("cell", "fp", "component"), ["cell", "fp"])

    def join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own, part = pdf["fp"].to_numpy(), pdf["own"].to_numpy(bool), pdf["part"].to_numpy()
        kind, i, j = int(pdf["kind"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = fp[own & (part == i)]
        b = fp[own & (part == j)] if kind == 0 else fp[~own]
        return pd.DataFrame(_forest(a, b, bits, dict(zip(fp.tolist(), pdf["component"].tolist()))), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cell", "kind", "i", "j").applyInPandas(join_blocks, "a long, b long").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes in ``edges`` (``a, b``).

    Alternates large-star and small-star steps (Kiveris et al., 2014), each written to the shared
    folder, until no edge changes.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen = stamp(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        # large star: each neighbour above a node moves to the node's smallest neighbour
        around = both(now)
        # (tables of the shared folder on both sides of a join let Spark split a hot node's rows)
        least = materialize(around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components")
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "components")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "components")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then = materialize(small.where("a != b").distinct(), "components")
        new = stamp(then)
        release(now, least, large, low)
        now = then
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """``doc_id, key, fp, group, component_id`` of every row.

    ``component_id`` is the smallest doc_id reachable (null only where all are null), ``group`` tells
    components apart, and ``key`` is a hash of the row's id and text.  With ``similarity``, links are those of that Jaccard
    similarity or more (``near_copies``, where ``fp`` is a hash of the set of shingles).
    """
    if similarity is not None:
        from .near_copies import near_copies

        return near_copies(docs, id_col, text_col, words, similarity)
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash-docs")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-fps")
    return name_groups(rows, fps, connected_components(links(fps.select("fp"), bits)))


def name_groups(rows: DataFrame, fps: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, key, fp, group, component_id`` of ``rows``, from ``fp, least_id`` and the components of ``fp``."""
    named = fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("group"))
    named = materialize(named, "simhash-groups")
    heads = materialize(named.groupBy("group").agg(F.min("least_id").alias("component_id")), "simhash-heads")
    named = materialize(named.join(heads, "group").select(F.col("fp").alias("__fp"), "group", "component_id"), "simhash-named")
    return rows.join(named, rows["fp"] == named["__fp"]).select("doc_id", "key", "fp", "group", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest id (null only where all are null).

    Of rows with that id, the one with the smallest hash of id and text stays, and of rows equal in both the one whose other columns have the smallest hash.
    """
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words, bits, similarity), id_col, text_col)


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs``, whose groups are named as by ``near_duplicates``."""
    found = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n"))
    keep = heads.groupBy("group").agg(F.min_by(F.struct("n", F.col("doc_id").alias("__id"), F.col("key").alias("__keep")), F.col("key")).alias("head")).select("head.*")
    keep = materialize(keep, "simhash-keep")
    same = (F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")) == keep["__keep"]) & docs[id_col].cast("long").eqNullSafe(keep["__id"])
    # the same join at every size: one key for each group grows with the corpus
    once = docs.join(keep.where("n = 1").hint("merge"), same, "left_semi")
    more = keep.where("n > 1")
    if more.isEmpty():
        return once
    # of rows equal in id and text, the one whose other columns have the smallest hash
    repeated = docs.join(more, same, "left_semi")
    place = F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))).alias("__place")
    return once.unionByName(repeated.select("*", place).where("__place = 1").drop("__place"))
