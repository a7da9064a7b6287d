"""Quality rules: compression bands.

A document is compressed with zstandard as a whole and in chunks of fixed size, the last of which ends
with the text, so that every byte is in a chunk (and some in two).  A ratio
(compressed over raw bytes) that is too low marks repetitive text, one that is too
high marks incompressible text.  The limits depend on the length, since short
texts compress worse.  Base statistics of words and lines go with the verdict.

Defined cases: null text is an empty text; a text without words has ``n_words`` 0 and
fails the base rules; repeated rows give repeated results; an empty table gives an
empty result.  Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_batches, text_bytes

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: class i holds lengths under ``ends[i]``."""

    ends: tuple[int, ...] = (128, 512, 2048, 8192, 32768)
    low: tuple[float, ...] = (0.45, 0.40, 0.33, 0.29, 0.25, 0.22)
    high: tuple[float, ...] = (1.60, 1.05, 0.80, 0.72, 0.68, 0.66)
    chunk_bytes: int = 2048
    chunk_low: float = 0.30
    chunk_high: float = 0.85
    bad_chunk_share: float = 0.3
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


@dataclass
class _Scorer:
    bands: Bands
    c: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self) -> None:
        self.c = zstandard.ZstdCompressor(level=self.bands.level, write_content_size=False)

    def ratios(self, raw: bytes) -> tuple[float, int, int]:
        """Ratio of the whole, number of chunks, number of chunks out of their band."""
        b = self.bands
        if not raw:
            return 0.0, 0, 0
        size = b.chunk_bytes
        whole = len(self.c.compress(raw)) / len(raw)
        if len(raw) <= size:  # the whole is the only chunk, and has its own limits
            return whole, 0, 0
        starts = [*range(0, len(raw) - size, size), len(raw) - size]  # the last one ends with the text
        ratios = [len(self.c.compress(raw[i : i + size])) / size for i in starts]
        n, bad = len(ratios), sum(not b.chunk_low <= r <= b.chunk_high for r in ratios)
        return whole, n, bad

    def in_bands(self, n_bytes: int, ratio: float, n_chunks: int, bad: int) -> bool:
        k = bisect.bisect_right(self.bands.ends, n_bytes)
        return self.bands.low[k] <= ratio <= self.bands.high[k] and bad <= self.bands.bad_chunk_share * n_chunks


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(distinct := set(windows)) == len(windows):
        return 0
    counts = dict.fromkeys(distinct, 0)
    for w in windows:
        counts[w] += 1
    n, covered = 0, 0  # covered: the first position that isn't counted yet
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)


def quality_rules(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with base statistics, compression ratios and the verdict ``kept``."""
    spaces, symbols = [c.encode() for c in SPACES], [c.encode() for c in SYMBOLS]

    def prepare():
        scorer = _Scorer(bands)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(10)]
            for raw in text_bytes(batch.column(1)):
                raw = raw or b""
                words = raw.split()
                n, repeats = len(words), repeated_words(words)
                # code points: all bytes but continuation bytes
                points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
                whole, chunks, bad = scorer.ratios(raw)
                failed = n < bands.min_words or 100 * repeats > bands.repeat_percent * n
                row = (
                    n, points - sum(map(raw.count, spaces)), sum(map(raw.count, symbols)), duplicate_lines(raw), repeats,
                    whole, chunks, bad, failed, not failed and scorer.in_bands(len(raw), whole, chunks, bad),
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=names)

        return run

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")), None, SCHEMA, prepare)
