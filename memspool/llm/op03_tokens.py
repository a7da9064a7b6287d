"""Token-id output with Re-Pair grammar compression.

Documents are dealt by ranges of their ids, so that files follow in ascending order, and encoded
with a public tokenizer; an end id closes each.  Some million ids make a shard.  Per shard,
frequent pairs of neighbouring ids are replaced by nonterminals, again and again, until no pair occurs
``least_count`` times: a round counts the pairs of the shard and makes rules of the frequent ones; where
occurrences overlap, the more frequent pair goes first.  Pairs never cross the end of a document.  A shard's file holds its rules, the
lengths of their expansions and where each document's symbols begin, so that one
document is decoded without the rest.

File format (little-endian): magic ``RPS1``; unsigned 32-bit numbers of documents and rules, first
nonterminal, and bytes of a symbol (2 or 4); unsigned 64-bit number of symbols; then arrays: ids of
documents (int64), whether these are null (uint8), numbers of ids (uint64), first symbols (uint64, one
more than documents), left and right symbols of rules, lengths of expansions (uint32), symbols.

Defined cases: a null or empty text is its end id alone; null ids come first; rows with equal ids
follow in the order of a hash of their texts; an empty table gives no shards and an empty
result.  Only the id and text columns are read, so that others can't clash.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_table_path

MAGIC = b"RPS1"
_HEAD = "<4sIIIIQ"


@dataclass(frozen=True)
class TokenParams:
    end_id: int = 2
    #: Ids after which a shard ends.
    shard_tokens: int = 2_000_000
    #: A pair must occur so often in its shard.
    least_count: int = 24
    #: Limits for grammars that end early; None: they end where no pair is frequent.
    rounds: int | None = None
    rules_per_round: int | None = None
    #: Words kept with their ids in a worker's cache.
    cache_words: int = 300_000


# --- encoding ---------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned integers.

    No token of a text crosses ASCII white space, so a text's ids are those of its words in turn, and a
    word that was seen is not encoded again.  Of letters and marks behind them, which are two pieces for the
    tokenizer, each is looked up alone, letters in lower case.  A full cache takes no more words: those that are
    frequent came early.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, dtype: str, cache_words: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.code, self.most = Tokenizer.from_file(path), "H" if np.dtype(dtype).itemsize == 2 else "I", cache_words
        state = self.t.to_str()
        # the short cuts below hold for a tokenizer that drops white space and lowers case
        self.by_word = '"ByteLevel"' in state and '"Lowercase"' in state and '"behavior":"Removed"' in state.replace(" ", "")
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.model = self.t.model
        # the characters that stand for the bytes of letters outside ASCII
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _core(self, word: str) -> bytes:
        got = self.cores.get(word)
        if got is None:
            got = self._pack([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))])
            if len(self.cores) < self.most:
                self.cores[word] = got
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = self._plain.fullmatch(text)
        if m:
            letters, marks = m[1], m[2]
            if not marks:
                return self._core(letters.lower())
            return self._core(letters.lower()) + self._core(marks) if letters else self._core(marks)
        return self._pack(self.t.encode(text, add_special_tokens=False).ids)

    def __call__(self, raw: bytes) -> bytes:
        if not self.by_word:
            return self._pack(self.t.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)
        words, known = raw.split(), self.words
        out = list(map(known.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    x = known.get(w)
                    if x is None:
                        x = self._word(w)
                        if len(known) < self.most:
                            known[w] = x
                    out[i] = x
        return b"".join(out)


def _encoder(path: str, dtype: str, cache_words: int) -> Encoder:
    """One encoder in a worker process, whose cache lasts over tasks."""
    kept = sys.modules.setdefault("_memspool_worker", types.ModuleType("_memspool_worker")).__dict__
    key = ("encoder", path, dtype, cache_words)
    if key not in kept:
        kept[key] = Encoder(path, dtype, cache_words)
    return kept[key]


def symbol_type(path: str, p: TokenParams) -> tuple[int, str]:
    """The first nonterminal, and the type that has room for all ids."""
    from tokenizers import Tokenizer

    first = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), p.end_id + 1)
    return first, "<u2" if first <= 1 << 16 else "<u4"


# --- grammar ----------------------------------------------------------------------------------------------------------


def _frequent(keys: np.ndarray, most: int | None, least: int) -> np.ndarray:
    """The keys that occur ``least`` times at least, most frequent first, and of equal counts the smaller key first."""
    keys = np.sort(keys)
    last = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], np.ones(len(keys[:1]), bool)]))
    counts = np.diff(last, prepend=-1)
    enough = np.flatnonzero(counts >= least)
    # keys are sorted already
    return keys[last[enough[np.argsort(-counts[enough], kind="stable")]]][:most]


def _ranks(left: np.ndarray, right: np.ndarray, keys: np.ndarray, chosen: np.ndarray, shift: np.unsignedinteger, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs are chosen ones, and the places of these in ``chosen``."""
    a, b = (chosen >> shift).astype(np.int64), (chosen & chosen.dtype.type((1 << int(shift)) - 1)).astype(np.int64)
    ls, rs = np.unique(a), np.unique(b)
    width = len(rs) + 1
    if (len(ls) + 1) * width <= 1 << 24 and len(chosen) < 1 << 16:
        # a table by the numbers of the left and right symbols
        in_left, in_right = np.zeros(top, np.uint16), np.zeros(top, np.uint16)
        in_left[ls], in_right[rs] = np.arange(1, len(ls) + 1), np.arange(1, width)
        table = np.zeros((len(ls) + 1) * width, np.uint16)
        table[in_left[a].astype(np.int64) * width + in_right[b]] = np.arange(1, len(chosen) + 1)
        cell = in_left[left].astype(np.uint32)
        cell *= np.uint32(width)
        cell += in_right[right]
        found = table[cell]
        at = np.flatnonzero(found)
        return at, found[at].astype(np.int32) - 1
    order = np.argsort(chosen)
    found = order[np.minimum(np.searchsorted(chosen[order], keys), len(chosen) - 1)]
    at = np.flatnonzero(chosen[found] == keys)
    return at, found[at].astype(np.int32)


def _disjoint(where: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences at neighbouring places, those of smaller ranks; in a run of one rank every other one."""
    won = np.zeros(len(where), bool)
    touch = np.diff(where) == 1
    again = np.flatnonzero(touch & (rank[1:] == rank[:-1])) + 1
    left = np.ones(len(where), bool)
    if len(again):
        run = np.flatnonzero(np.diff(again, prepend=-1) != 1)
        left[again[(np.arange(len(again)) - np.repeat(run, np.diff(np.append(run, len(again))))) % 2 == 0]] = False
    at = np.flatnonzero(left)
    while len(at):
        w, r = where[at], rank[at]
        touch = np.diff(w) == 1
        first = r[:-1] <= r[1:]
        wins = np.ones(len(at), bool)
        wins[1:] = ~(touch & first)
        wins[:-1] &= ~(touch & ~first)
        won[at[wins]] = True
        # those that touch a winner have lost a symbol
        left = ~wins
        left[1:] &= ~(touch & wins[:-1])
        left[:-1] &= ~(touch & wins[1:])
        at = at[left]
    return where[won], rank[won]


def compress(symbols: np.ndarray, firsts: np.ndarray, nonterminal: int, p: TokenParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: left and right symbols of the rules, the symbols that remain, and the documents' first ones.

    ``firsts`` has where each document begins, and the end.  Symbols of two bytes become ones of four when rules need them.
    """
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # a round leaves no occurrence of its rules' pairs, so the next one counts pairs with a new symbol only;
    # the end is tested over all pairs
    top, fresh, rounds = nonterminal, 0, 0
    while len(symbols) > 1 and (p.rounds is None or rounds < p.rounds):
        kind, shift = (np.uint64, np.uint64(32)) if symbols.dtype.itemsize > 2 else (np.uint32, np.uint32(16))
        ends = firsts[1:-1] - 1  # the last symbol of a document and the first of the next are no pair
        ends = ends[(ends >= 0) & (ends < len(symbols) - 1)]
        left, right, places = symbols[:-1], symbols[1:], None
        if fresh:
            new = symbols >= fresh
            inside = new[:-1] | new[1:]
            inside[ends] = False
            places = np.flatnonzero(inside).astype(np.int32 if len(symbols) < 1 << 31 else np.int64)
            left, right = left[places], right[places]
        keys = left.astype(kind)
        keys <<= shift
        keys |= right
        chosen = _frequent(np.delete(keys, ends) if places is None else keys, p.rules_per_round, p.least_count)
        if not len(chosen):
            if not fresh:
                break
            fresh = 0
            continue
        at, rank = _ranks(left, right, keys, chosen, shift, top)
        if places is None:
            inside = np.ones(len(keys), bool)
            inside[ends] = False
            inner = inside[at]
            at, rank = at[inner], rank[inner]
        else:
            at = places[at]
        where, won = _disjoint(at, rank)
        uses = np.bincount(won, minlength=len(chosen))
        # pairs that lost most of their occurrences to others make no rule (the first pair keeps half at least)
        good = uses >= max(1, p.least_count // 2)
        if not good.all():
            still = good[rank]
            where, won = _disjoint(at[still], (np.cumsum(good, dtype=np.int32) - 1)[rank[still]])
            chosen = chosen[good]
        if top + len(chosen) > 1 << 16 and symbols.dtype.itemsize == 2:
            symbols = symbols.astype("<u4")
        else:
            symbols = symbols.copy()
        symbols[where] = (won + top).astype(symbols.dtype)
        stays = np.ones(len(symbols), bool)
        stays[where + 1] = False
        symbols = symbols[stays]
        firsts = firsts - np.searchsorted(where + 1, firsts, "left")
        lefts.append((chosen >> shift).astype(np.int64))
        rights.append((chosen & kind((1 << int(shift)) - 1)).astype(np.int64))
        fresh = top if p.rules_per_round is None else 0
        top, rounds = top + len(chosen), rounds + 1
    return np.concatenate(lefts), np.concatenate(rights), symbols, firsts


def expansion_lengths(left: np.ndarray, right: np.ndarray, nonterminal: int) -> np.ndarray:
    lengths = np.ones(nonterminal + len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        lengths[nonterminal + i] = lengths[a] + lengths[b]
    return lengths[nonterminal:]


def pack_shard(ids: list[int | None], counts: np.ndarray, symbols: np.ndarray, nonterminal: int, p: TokenParams) -> bytes:
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    left, right, left_over, firsts = compress(symbols, firsts, nonterminal, p)
    dtype = left_over.dtype
    return b"".join([
        struct.pack(_HEAD, MAGIC, len(ids), len(left), nonterminal, dtype.itemsize, len(left_over)),
        np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "u1").tobytes(),
        np.asarray(counts, "<u8").tobytes(), firsts.astype("<u8").tobytes(),
        left.astype(dtype).tobytes(), right.astype(dtype).tobytes(), expansion_lengths(left, right, nonterminal).astype("<u4").tobytes(), left_over.tobytes(),
    ])


class Shard:
    """A shard's file, opened for reading."""

    def __init__(self, data: bytes) -> None:
        magic, docs, rules, self.nonterminal, width, n = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.counts, self.firsts = take("<u8", docs).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        symbol = f"<u{width}"
        self.left, self.right, self.lengths, self.symbols = take(symbol, rules), take(symbol, rules), take("<u4", rules), take(symbol, n)
        self._lengths = np.concatenate([np.ones(self.nonterminal, np.int64), self.lengths.astype(np.int64)])

    @cached_property
    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all symbols in one array, and where they start; those of terminals are themselves."""
        lengths = self._lengths
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.empty(int(starts[-1]), "<u4")
        flat[: self.nonterminal] = np.arange(self.nonterminal)
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            s, m, e = starts[self.nonterminal + i], starts[self.nonterminal + i] + lengths[a], starts[self.nonterminal + i + 1]
            flat[s:m], flat[m:e] = flat[starts[a] : starts[a + 1]], flat[starts[b] : starts[b + 1]]
        return flat, starts

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self._expansions
        lengths = self._lengths[symbols]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(starts[symbols] - ends + lengths, lengths) + np.arange(total)]

    def slice(self, i: int, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` (exclusive) of the i-th document.

        Symbols before the range are passed by their lengths, and only rules that reach into it are opened, so no other expansion is made.
        """
        symbols = self.symbols[self.firsts[i] : self.firsts[i + 1]]
        a, b = max(0, a), min(b, int(self.counts[i]))
        if a >= b:
            return np.zeros(0, "<u4")
        ends = np.cumsum(self._lengths[symbols])
        first, last = np.searchsorted(ends, [a, b - 1], "right").tolist()
        at, out = int(ends[first] - self._lengths[symbols[first]]), []
        left = symbols[first : last + 1][::-1].tolist()  # a stack: the next symbol is its end
        while at < b:
            x = left.pop()
            n = int(self._lengths[x])
            if at + n <= a:
                at += n
            elif x < self.nonterminal:
                out.append(x)
                at += 1
            else:
                left += [int(self.right[x - self.nonterminal]), int(self.left[x - self.nonterminal])]
        return np.array(out, "<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, read from its own symbols only."""
        return self._expand(self.symbols[self.firsts[i] : self.firsts[i + 1]])

    def documents(self, part: int = 1 << 18) -> Iterator[np.ndarray]:
        """Ids of all documents in turn; some are expanded together."""
        i, n = 0, len(self.ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + part, "right")) - 1)
            flat = self._expand(self.symbols[self.firsts[i] : self.firsts[j]])
            ends = np.cumsum(self.counts[i:j])
            for a, b in zip(ends - self.counts[i:j], ends):
                yield flat[a:b]
            i = j


# --- files ------------------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, p: TokenParams = TokenParams(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all rows and write the shards as a table: ``part, seq, ids_before, n_ids, shard``.

    ``part`` and ``seq`` give the order of the shards, ``ids_before`` counts the ids of the part before a shard.
    """
    nonterminal, dtype = symbol_type(tokenizer, p)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer, dtype, p.cache_words), np.array([p.end_id], dtype).tobytes()
        part, width = TaskContext.get().partitionId(), np.dtype(dtype).itemsize
        ids: list = []
        held: list[bytes] = []
        size = seq = before = 0

        def shard() -> pa.RecordBatch:
            nonlocal size, seq, before
            counts = np.array([len(x) // width for x in held], np.int64)
            data = pack_shard(ids, counts, np.frombuffer(b"".join(held), dtype), nonterminal, p)
            row = ([part], [seq], [before], [size], [data])
            seq, before, size = seq + 1, before + size, 0
            ids.clear()
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "seq", "ids_before", "n_ids", "shard"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            for i, raw in zip(batch.column(0).to_pylist(), texts):
                data = encode(raw.as_py() or b"") + end
                ids.append(i)
                held.append(data)
                size += len(data) // width
                if size >= p.shard_tokens:
                    yield shard()
        if held:
            yield shard()

    rows.mapInArrow(run, "part int, seq int, ids_before long, n_ids long, shard binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    shards = spark.read.parquet(path)
    # one number for each part, that is for each task that wrote
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for r in totals:
        starts[r["part"]] = at
        at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = Shard(data.as_py())
                crc = [zlib.crc32(x) for x in shard.documents()]
                start = starts[part] + before + np.cumsum(shard.counts) - shard.counts
                columns = [pa.array(shard.ids, pa.int64()), pa.array(start, pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "ids_before", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, tokenizer: str, p: TokenParams = TokenParams(), **columns) -> DataFrame:
    """Write the corpus to a new table in the shared folder and read it back."""
    path = new_table_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, p, **columns)
    return read_tokens(docs.sparkSession, path)
