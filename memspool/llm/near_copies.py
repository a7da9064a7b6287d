"""Near copies by Jaccard similarity of five-word shingles.

Candidates come from operator 7's method: a set has ``PRINTS`` SimHash fingerprints of 64 bits, each with a grid of its own, on whose cells of segment
popcounts the range-join runs.  Sets are compared where a fingerprint differs in ``REACH`` bits or fewer and a half of it lies within Manhattan distance 1, so all
are that differ in 3 bits or fewer of any fingerprint.  In dense cells of the grid, sets that are in different components by then are compared, whatever their bits.

Near copies at 0.8 are some ten bits of 64 apart, where the grid finds a part of them (21 of 48 links at sf0.1).  So that none is lost, MinHash adds
candidates: a document has ``BANDS`` keys of ``ROWS`` minima each, and documents that share a key are compared.  Of pairs at similarity 0.8, 3 in 100,000 share
no key; of more similar ones fewer.  Each link, of either kind, is verified on the whole sets of shingle hashes.

Minima of a small set are those of ``BANDS * ROWS`` hash functions.  Large sets are hashed once and dealt to as many bins, each of which
gives its minimum (one-permutation hashing; an empty bin takes that of the next one).  Sets near the border have both kinds of keys, so that similar sets always share a kind.

Documents with equal sets are one node throughout.  The members of a key are compared with its smallest one first, and so are the pairs of the grid, but for those
that share one of their ``KNOWN`` keys of most members; components are formed.  Where a key or a dense cell has several components, its members outside of the largest one
are compared with those of others: in listed pairs, or, where these would be many, in pairs of blocks of bounded bytes.  So all candidates are compared or connected
already, those of the grid that share a key by way of that key.

Cells of the grid hold strangers too, the more the more sets there are.  What is to be known of a set is therefore joined to the sets, one row for each, before they go
into cells, and only pairs within reach come out of these.

Defined cases: null or wordless texts are equal to each other; a text of fewer than five words is one shingle;
ids that repeat are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, map_batches, materialize, release, text_bytes
from .op07_simhash import MOST, connected_components, deal, keep_first, majority_bits, name_groups, outside_top, shared_cells, shingles

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Fingerprints of a set, and differing bits up to which the grid's pairs are compared.
PRINTS, REACH = 4, 12
#: Keys of a set, those of most members, by which the grid leaves a pair to the keys.
KNOWN = 4
#: Pairs of a key that are listed, and shingles of a block where there are more.
FEW, BLOCK = 1024, 1 << 18
#: Bytes of texts that a task hands to Python at once, or one text that has more.
BATCH = 4 << 20
#: Sets up to ``SMALL`` have keys of all hash functions, those from four fifths of it on have keys of bins.
SMALL = 640
_RANDOM = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)


def function_minima(high: np.ndarray) -> np.ndarray:
    """The minima of all hash functions, for a set that isn't empty."""
    return ((high[None] ^ _RANDOM[0]) * (_RANDOM[1] | np.uint32(1))).min(1)


def bin_minima(high: np.ndarray) -> np.ndarray:
    """The minimum of each bin; that of the next bin that isn't empty where it is.  ``high`` is in order."""
    n = BANDS * ROWS
    mixed = high.astype(np.uint64) * np.uint64(n)
    at = (mixed >> np.uint64(32)).astype(np.intp)  # in order too, so a bin's first is its least
    filled, first = np.unique(at, return_index=True)
    following = np.searchsorted(filled, np.arange(n)) % len(filled)
    # a borrowed minimum counts how far it came, so that it isn't taken for the bin's own
    far = ((filled[following] - np.arange(n)) % n).astype(np.uint32)
    return mixed[first][following].astype(np.uint32) + far * np.uint32(0x9E3779B1)


def band_keys(hashes: np.ndarray, small: int = SMALL) -> list[int]:
    """The MinHash keys of a set of shingle hashes."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)  # ties of different shingles only add candidates
    kinds = [function_minima(high)] if len(high) < small else []
    if len(high) >= SIMILARITY * small:
        kinds.append(bin_minima(high))
    keys = [xxhash.xxh3_64_intdigest(x.tobytes(), i) for i, x in enumerate(np.concatenate(kinds).reshape(-1, ROWS), 0 if len(high) < small else BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def prints(hashes: np.ndarray) -> list[int]:
    """The SimHash fingerprints of a set of shingle hashes: one of the hashes themselves, the others of hashes of these."""
    out = [majority_bits(hashes)]
    for i in range(1, PRINTS):
        mixed = hashes + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(majority_bits(mixed ^ mixed >> np.uint64(31)))
    return out


def _set_of(raw: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingles(raw or b"", words))


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int, minhash: bool) -> DataFrame:
    """``doc_id, key, fp, size, prints, bands`` of every row; ``fp`` is a hash of the set of shingles, ``size`` their number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, size, codes, bands = [], [], [], []
        for raw in text_bytes(batch.column(2)):
            distinct = _set_of(raw, words)
            fp.append(xxhash.xxh3_64_intdigest(distinct.tobytes()))
            size.append(len(distinct))
            codes.append(prints(distinct) if len(distinct) else [])
            bands.append(band_keys(distinct) if minhash and len(distinct) else [])
        fp = np.array(fp, np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (codes, bands))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "fp", "size", "prints", "bands"])

    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keyed = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("t"))
    return map_batches(keyed, run, "doc_id long, key long, fp long, size long, prints array<long>, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``fp, items`` of ``nodes`` (``one_id, key, fp``), with the hashes of their shingles in order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [_set_of(raw, words).view(np.int64) for raw in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], names=["fp", "items"])

    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("own"), text.alias("t"))
    # the same join at every size
    nodes = nodes.hint("merge")
    found = texts.join(nodes, (texts["own"] == nodes["key"]) & texts["doc_id"].eqNullSafe(nodes["one_id"])).select("fp", "t")
    return map_batches(found.dropDuplicates(["fp"]), run, "fp long, items array<long>")


def _similar(common: np.ndarray, n: np.ndarray, m: int, similarity: float) -> np.ndarray:
    return common >= similarity * (n + m - common)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` that are similar.

    Compared by Spark, a pair at a time: a batch of pairs for Python would hold both sets of each, and the set of a large group's head in every row.
    """
    x = sets.select(F.col("fp").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("items").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(_fits(F.size("x"), F.size("y"), similarity))
    # (exploded, so that the sets are intersected once)
    met = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.explode(F.array(F.size(F.array_intersect("x", "y")))).alias("common"))
    return met.where(F.col("common") >= (F.col("n") - F.col("common")) * similarity).select("a", "b")


def forest(nodes: np.ndarray, items: list[np.ndarray], group: np.ndarray, first: np.ndarray, second: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between ``first`` and ``second`` (positions), enough to connect all that are linked and in different groups."""
    _, codes = np.unique(np.concatenate(items), return_inverse=True)
    size = np.array([len(x) for x in items])
    ends = np.cumsum(size)
    label = np.unique(group, return_inverse=True)[1]
    out = []
    for i in first.tolist():
        rest = second[label[second] != label[i]]
        rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        mine = np.zeros(codes.max() + 1, bool)
        mine[codes[ends[i] - size[i] : ends[i]]] = True
        common = np.array([np.count_nonzero(mine[codes[ends[j] - size[j] : ends[j]]]) for j in rest.tolist()])
        for j in rest[_similar(common, size[rest], size[i], similarity)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _fits(a: str | Column, b: str | Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) >= F.greatest(a, b) * similarity


def _listed(rest: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: rows outside of a key's largest component (``own``) with all rows of other components."""
    x = rest.where("own").select("cell", F.col("fp").alias("a"), F.col("component").alias("p"), F.col("size").alias("m"))
    y = rest.select("cell", F.col("fp").alias("b"), F.col("component").alias("q"), F.col("size").alias("n"), F.col("own").alias("both"))
    met = x.join(y, "cell").where((F.col("p") != F.col("q")) & (~F.col("both") | (F.col("a") < F.col("b"))) & _fits("m", "n", similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(many: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """The same for keys with many such pairs, in pairs of blocks of ``block`` shingles, or of one text that has more."""
    dealt = deal(many.drop("component", "size"), block).join(many.select("cell", "fp", "component"), ["cell", "fp"]).join(sets, "fp")

    def join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        own, part = pdf["own"].to_numpy(bool), pdf["part"].to_numpy()
        kind, i, j = int(pdf["kind"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        second = own & (part == j) if kind == 0 else ~own
        at = [np.flatnonzero(x) for x in (own & (part == i), second)]
        found = forest(pdf["fp"].to_numpy(), list(pdf["items"]), pdf["component"].to_numpy(), *at, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cell", "kind", "i", "j").applyInPandas(join_blocks, "a long, b long").distinct()


def known_keys(busy: DataFrame) -> DataFrame:
    """``fp, known``: the keys of most members (``n``) of each set in ``busy`` (``cell, fp, n``)."""
    most = F.slice(F.sort_array(F.collect_list(F.struct("n", "cell")), asc=False), 1, KNOWN)
    return busy.groupBy("fp").agg(most["cell"].alias("known"))


def grid_rows(fps: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """``cell, own, code, fp, known``: the sets of ``fps`` (``fp, prints`` and ``known``, if there is) in cells of their popcount grids that hold others too; and ``cell, fp`` of dense cells, if any."""
    known = F.col("known") if "known" in fps.columns else F.lit(None).cast("array<long>").alias("known")
    coded = fps.select(F.col("fp").alias("node"), known, F.posexplode("prints").alias("grid", "fp"))
    few, many = shared_cells(coded.select("node", "known", "fp", "grid"), most, F.col("grid"))
    rows = reduce(DataFrame.unionByName, (x.select("cell", "own", F.col("fp").alias("code"), F.col("node").alias("fp"), "known") for x in few))
    return rows, None if many is None else many.select("cell", F.col("node").alias("fp"))


def grid_pairs(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``a, b``: all pairs of a set that lies in a cell and another one there, within reach and without a known key in common; of different components, if there are ``groups``."""
    x = rows.where("own").select("cell", F.col("fp").alias("a"), F.col("code").alias("x"), F.col("known").alias("p"))
    y = rows.select("cell", F.col("fp").alias("b"), F.col("code").alias("y"), F.col("known").alias("q"), F.col("own").alias("both"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= REACH
    apart = ~F.coalesce(F.arrays_overlap("p", "q"), F.lit(False))
    met = x.join(y, "cell").where((F.col("a") != F.col("b")) & (~F.col("both") | (F.col("a") < F.col("b"))) & near & apart)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if groups is None:
        return pairs
    p, q = (groups.select(F.col("node").alias(end), F.col("component").alias(name)) for end, name in (("a", "p"), ("b", "q")))
    named = pairs.join(p, "a", "left").join(q, "b", "left")
    return named.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, few: int = FEW, block: int = BLOCK,
    most: int = MOST, minhash: bool = True,
) -> DataFrame:
    """``doc_id, key, fp, group, component_id`` of every row, as of ``op07_simhash.near_duplicates``.

    ``similarity`` of 0.8 or more: lower ones would need other keys.  Without ``minhash``, by the grid alone, which shows what it finds.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the keys hold for similarities of {SIMILARITY} or more")
    with batches_of(docs.sparkSession, BATCH):
        rows = materialize(_sketches(docs, id_col, text_col, words, minhash), "near-docs")
    fps = rows.groupBy("fp", "size").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("key", "doc_id", "prints")).alias("one"))
    fps = materialize(fps.select("fp", "size", "least_id", "one.key", F.col("one.doc_id").alias("one_id"), "one.prints"), "near-fps")
    cells = materialize(rows.select(F.explode("bands").alias("cell"), "fp", "size").distinct(), "near-cells")
    heads = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("fp", "size")).alias("head")).where("n > 1")
    # (tables on both sides of a join let Spark split a hot key's rows)
    busy = materialize(cells.join(materialize(heads.select("cell", "n", "head.fp", F.col("head.size").alias("m")).withColumnRenamed("fp", "least"), "near-heads"), "cell"), "near-busy")
    stars = busy.where((F.col("least") < F.col("fp")) & _fits("m", "size", similarity)).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    # (one row for each set: its cells are many, and the more so the more sets share them)
    coded = materialize(fps.select("fp", "prints").join(materialize(known_keys(busy), "near-known"), "fp", "left"), "near-coded")
    grid, dense = grid_rows(coded, most)
    lone = materialize(grid_pairs(grid), "near-lone")
    stars = materialize(stars.unionByName(lone).distinct(), "near-pairs")
    met = [busy.select("fp"), lone.select(F.explode(F.array("a", "b")).alias("fp")), *([] if dense is None else [dense.select("fp")])]
    met = reduce(DataFrame.unionByName, met).distinct()
    with batches_of(docs.sparkSession, BATCH):
        sets = materialize(_sets(docs, fps.select("one_id", "key", "fp").join(met, "fp", "left_semi"), id_col, text_col, words), "near-sets")
    groups = connected_components(materialize(verified(stars, sets, similarity), "near-links"))
    # what the heads left apart
    keys = busy.select("cell", "fp") if dense is None else busy.select("cell", "fp").unionByName(dense)
    rest = outside_top(keys, groups, fps.select("fp", "size"))
    pairs = F.col("k_own") * F.col("k_all")
    listed = materialize(_listed(rest.where(pairs <= few), similarity).join(stars, ["a", "b"], "left_anti"), "near-pairs")
    more = verified(listed, sets, similarity)
    many = rest.where(pairs > few)
    if not many.isEmpty():
        more = more.unionByName(_block_links(many, sets, similarity, block))
    more = materialize(more.distinct(), "near-links")
    if not more.isEmpty():
        # each component is a star by now
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = name_groups(rows.select("doc_id", "key", "fp"), fps.select("fp", "least_id"), groups)
    release(cells, stars, sets, listed, more)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies in ``docs``: that of the smallest id (null only where all are null)."""
    return keep_first(docs, near_copies(docs, id_col, text_col), id_col, text_col)
