"""Substring search by an index of trigrams over blocks of nodes, with exact verification.

The index holds, for each three letters, the blocks in which they occur, sorted by letters.  A query's text can only be in blocks that have all of its trigrams; these are
found from the postings of its trigrams alone, and then only their nodes are read and tested.  Queries of fewer than three letters are tested against all nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import search

#: Neighbours in the order of a part that are one block, and blocks up to which a scan is told their places.
BLOCK, LISTED = 256, 200


def trigrams(x: Column) -> Column:
    """The distinct runs of three letters of a text in lower case."""

    def runs(c: Column) -> Column:
        of_three = F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1), F.element_at(c, i + 2)))
        return F.when(F.size(c) >= 3, F.array_distinct(of_three)).otherwise(F.array().cast("array<string>"))

    # (in a list of one, so that the letters are a variable and not split again for each run)
    return F.flatten(F.transform(F.array(F.split(F.lower(x), "")), runs))


def block_of(order: Column) -> Column:
    return F.floor(order / BLOCK).cast("long")


def _codes(text: str) -> np.ndarray:
    """The runs of three letters of a text as numbers."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, part, block`` of ``part, block, texts``: once for neighbours of one block, as the store keeps nodes in order."""

    def listed(key: tuple, found: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        letters = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        columns = [pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)], pa.string()), pa.array([key[0]] * len(codes), pa.string()), pa.array([key[1]] * len(codes), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "part", "block"])

    key, found = None, []
    for batch in batches:
        for part, block, texts in zip(*(c.to_pylist() for c in batch.columns)):
            if (part, block) != key:
                if key is not None:
                    yield listed(key, found)
                key, found = (part, block), []
            found += [_codes(x) for x in texts if x is not None and len(x) > 2]
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
    if key is not None:
        yield listed(key, found)


def postings(nodes: DataFrame) -> DataFrame:
    """``gram, part, block`` of nodes, dealt and sorted by gram."""
    texts = F.concat(F.array("text"), F.coalesce("tags", F.array().cast("array<string>")))
    rows = nodes.select("part", block_of(F.col("ord")).alias("block"), F.transform(texts, F.lower).alias("texts")).mapInArrow(_grams, "gram string, part string, block long").distinct()
    return rows.select("gram", "part", "block").repartitionByRange("gram", "part", "block").sortWithinPartitions("gram", "part", "block")


def find(nodes: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """What ``context.search`` finds, from the blocks that can hold it; ``index`` is that of ``nodes``."""
    wanted = nodes.sparkSession.range(1).select(trigrams(F.lit(query)).alias("g")).first()["g"]
    if not wanted:
        return search(nodes, query)
    hits = index.where(F.col("gram").isin(wanted)).groupBy("part", "block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("part", "block")
    few = hits.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        # literal ranges reach the scan, which skips files and row groups without them
        place = F.lit(False)
        for part in sorted({r["part"] for r in few}):
            within = F.lit(False)
            for r in few:
                if r["part"] == part:
                    within |= F.col("ord").between(r["block"] * BLOCK, r["block"] * BLOCK + BLOCK - 1)
            place |= (F.col("part") == part) & within
        return search(nodes.where(place), query)
    held = nodes.withColumn("block", block_of(F.col("ord"))).join(hits, ["part", "block"], "left_semi")
    return search(held.select(*nodes.columns), query)
