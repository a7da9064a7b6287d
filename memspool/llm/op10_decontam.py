"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by single spaces.  A test item may
occur with up to ``k`` edits, a share of its length.  Cut into k + 1 pieces, one of them is then
untouched: exact hits of all pieces are found with an Aho-Corasick automaton in one pass over
a document, and around each hit the item is verified with Myers' bit-parallel edit distance.

Windows around the hits of one item that overlap are searched once.  Test items are taken in blocks of
``block_chars`` characters (some ten thousand items); each block is one pass over the documents, so the work grows with the
number of blocks.  A block is broadcast, and a worker process builds its automaton once.

Defined cases: null texts and items are empty; an item with no words matches nothing; an item without an id is searched for like any other and reported with a null id;
repeated items and documents are reported each by their ids; empty tables give an empty result.
Only the columns named are read, so that others can't clash.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class MatchParams:
    error_share: float = 0.05
    #: Characters of test items in one block.
    block_chars: int = 4_000_000


def normalize(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of near equal length with their offsets."""
    n = len(item)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers_search(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to a substring of ``text``, and where the first such ends.

    None if it is over ``k``.
    """
    m = len(pattern)
    if not m:
        return None
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: no carry into row 0
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = score, j + 1
    return best


def windows(starts: set[int], length: int, k: int, end: int) -> list[tuple[int, int]]:
    """Where an item may lie that begins near one of ``starts``; windows that overlap are one, so no character is searched twice."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        lo, hi = max(0, s - k), min(end, s + length + k)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        elif hi > lo:
            out.append((lo, hi))
    return out


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], p: MatchParams) -> None:
        self.items = [(i, n, int(p.error_share * len(n))) for i, n in ((i, normalize(t)) for i, t in items) if n]
        found: dict[str, list[tuple[int, int]]] = {}
        for x, (_, item, k) in enumerate(self.items):
            for at, piece in pieces(item, k):
                found.setdefault(piece, []).append((x, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """``item_id, distance, end_char`` of each item that occurs; the latter in the normalized text."""
        if not self.any or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for x, at in where:
                starts.setdefault(x, set()).add(end + 1 - length - at)
        out = []
        for x, begin in sorted(starts.items()):
            item_id, item, k = self.items[x]
            best = None
            for lo, hi in windows(begin, len(item), k, len(text)):
                got = myers_search(item, text[lo:hi], k)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], lo + got[1]
            if best:
                out.append((item_id, *best))
        return out


_built: dict[str, Matcher] = {}


def _matcher(name: str, block: Broadcast, p: MatchParams) -> Matcher:
    """The matcher of a block: one for each worker process, which keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(block.value, p)
    return _built[name]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, p: MatchParams):
    """Lists of (id, text) of at most ``block_chars`` characters, or of one item that is longer."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    block, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > p.block_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def find_leaks(docs: DataFrame, items: DataFrame, p: MatchParams = MatchParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, key, item_id, distance, end_char`` for each document that holds an item.

    ``key`` is a hash of the document's id and text.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("t"))
    schema = "doc_id long, key long, item_id long, distance int, end_char long"

    def one(block: list[tuple[int | None, str]]) -> DataFrame:
        name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)

        def prepare():
            matcher = _matcher(name, sent, p)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(i, key, *hit) for i, key, t in zip(ids, keys, batch.column(2).to_pylist()) if t for hit in matcher.find(normalize(t))]
                columns = list(zip(*found)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "key", "item_id", "distance", "end_char"])

            return run

        return map_batches(rows, None, schema, prepare)

    return reduce(DataFrame.unionByName, (one(b) for b in _item_blocks(items, item_col, item_text, p)))


def decontaminate(docs: DataFrame, items: DataFrame, p: MatchParams = MatchParams(), id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    leaks = materialize(find_leaks(docs, items, p, id_col, text_col, **names), "leaks")
    bad = leaks.select(F.col("doc_id").alias("__leak_id"), F.col("key").alias("__leak")).distinct()
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return docs.join(bad, (key == bad["__leak"]) & docs[id_col].cast("long").eqNullSafe(bad["__leak_id"]), "left_anti")
