"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick automaton runs over a whole text, in UTF-8 with A-Z lower-cased.  Its keywords are what a secret begins with, and for runs
without such a word, as hexadecimal ones, all combinations of four hexadecimal digits.  At a hit the
kind's expression is matched on the text itself, anchored at the place of the hit; text without hits is never looked at again.  A kind's matches don't overlap: a
hit inside the last one is passed over.  As every match of a kind begins at a hit, these are the matches that a scan of the whole text with the
expression would find.

Three kinds are spans as the contract words them (``assign``, ``access``, ``hex``).  The others hold a checksum, and only matches that it proves are reported:

* ``token``: ``ghp_`` and its like, ``npm_``: 30 characters, then their CRC-32 in six base-62 digits;
* ``extended``: ``xprv``, ``xpub`` and their like: base 58, whose last four bytes begin the double SHA-256 of the others;
* ``card``: 13 to 19 digits that open like a payment card's and meet Luhn's rule.

Defined cases: null and empty texts have no spans; offsets count code points; repeated rows give repeated results; rows with null ids are scanned; an empty table gives an empty
result.  Time is linear in the text.  Only the id and text columns are read, so that others can't clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

#: Digits of base 62 and base 58, in order.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_token(m: re.Match[bytes]) -> bool:
    """Whether the last six characters are the CRC-32 of those before, behind the prefix."""
    body = m[0][4:]
    left, digits = zlib.crc32(body[:30]), []
    for _ in range(6):
        left, d = divmod(left, 62)
        digits.append(BASE62[d])
    return bytes(reversed(digits)) == body[30:]


def base58_check(m: re.Match[bytes]) -> bool:
    """Whether the last four bytes begin the double SHA-256 of the others."""
    n = 0
    for c in m[0]:
        n = n * 58 + BASE58.index(c)
    zeros = len(m[0]) - len(m[0].lstrip(b"1"))
    data = bytes(zeros) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(data) == 82 and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def luhn(m: re.Match[bytes]) -> bool:
    """Whether every second digit from the right, doubled and summed by digits, and the others give a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(m[0])):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@dataclass(frozen=True)
class Kind:
    """What to look for: ``keywords`` in lower case, the expression of a match that begins with one, and what a match must meet."""

    name: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    holds: Callable[[re.Match[bytes]], bool]


_HEX4 = tuple(bytes(x) for x in product(b"0123456789abcdef", repeat=4))
_DIGITS4 = tuple(bytes(x) for x in product(b"0123456789", repeat=4))

#: The expressions and least lengths of the three base kinds.
BASE = (
    Kind("assign", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: m.end(2) - m.start(2) >= 8),
    Kind("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16),
    Kind("hex", _HEX4, re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= 32),
)
CHECKED = (
    Kind("token", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"npm_"), re.compile(rb"(?<![0-9A-Za-z_])(?:gh[pousr]|npm)_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"), crc_token),
    Kind("extended", (b"xprv", b"xpub", b"tprv", b"tpub"), re.compile(rb"(?<![0-9A-Za-z])[xt]p(?:rv|ub)[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"), base58_check),
    Kind("card", _DIGITS4, re.compile(rb"(?<![0-9A-Za-z])(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12,15})(?![0-9A-Za-z])"), luhn),
)
KINDS = BASE + CHECKED


class Scanner:
    """Finds the spans of ``kinds`` in texts."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS) -> None:
        self.kinds = kinds
        words: dict[bytes, list[int]] = {}
        for k, kind in enumerate(kinds):
            for word in kind.keywords:
                words.setdefault(word, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, of in words.items():
            self.automaton.add_word(word.decode("latin-1"), (len(word) - 1, of))
        self.automaton.make_automaton()

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """``start, kind, end`` in bytes of a text in UTF-8, in order."""
        done, out = [0] * len(self.kinds), []
        # no keyword of a kind holds another one, so hits come in order of their starts too
        for end, (back, of) in self.automaton.iter(raw.lower().decode("latin-1")):
            for k in of:
                if end - back >= done[k] and (m := self.kinds[k].pattern.match(raw, end - back)):
                    done[k] = m.end()
                    if self.kinds[k].holds(m):
                        out.append((m.start(), k, m.end()))
        return sorted(out)


@cache
def _scanner() -> Scanner:
    """One automaton for each worker process."""
    return Scanner()


def code_points(raw: bytes, at: list[int]) -> list[int]:
    """Byte offsets of characters as numbers of code points before them."""
    if not at or raw.isascii():
        return at
    seen, last, n = {}, 0, 0
    for i in sorted(set(at)):
        n += len(raw[last:i].decode())
        seen[i], last = n, i
    return [seen[i] for i in at]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row: an array of ``kind, start, end`` in order of start, then of ``KINDS``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, names = _scanner().spans, [k.name for k in KINDS]
        rows = []
        for raw in text_bytes(batch.column(1)):
            found = scan(raw) if raw else []
            at = code_points(raw, [x for a, _, b in found for x in (a, b)]) if found else []
            rows.append([{"kind": names[k], "start": a, "end": b} for (_, k, _), a, b in zip(found, at[::2], at[1::2])])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def _is(name: str) -> Callable[[Column], Column]:
    return lambda x: x == name


def secrets_report(docs: DataFrame, **columns: str) -> DataFrame:
    """Per document the numbers of base spans, a digest of them, all spans as text, and how many a checksum proved."""
    base = [k.name for k in BASE]
    found = find_secrets(docs, **columns)
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in base]
    proved = (F.size("spans") - F.size(of_base)).cast("long").alias("n_checked")
    return found.select("doc_id", *counts, F.sha2(listed(of_base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), proved)


def redact_secrets(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its texts, or run of spans that overlap, replaced by ``mark``."""
    names = docs.columns
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, texts = _scanner().spans, []
        for raw in text_bytes(batch.column(at)):
            found = scan(raw) if raw else []
            parts, done = [], 0
            for a, _, b in found:
                if a >= done:
                    parts += [raw[done:a], mark.encode()]
                done = max(done, b)
            texts.append(b"".join([*parts, raw[done:]]).decode() if found else raw.decode() if raw is not None else None)
        columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs.withColumn(text_col, F.col(text_col).cast("string")), run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
