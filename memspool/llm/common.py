"""Helpers that the training-data operators share.

Nothing in the rest of the library depends on this subpackage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop_table, materialize, new_table_path, release, shared_dir

__all__ = ["batches_of", "crc_mod", "drop_table", "map_batches", "materialize", "new_table_path", "release", "shared_dir", "text_bytes", "training_sample"]

#: The six white-space bytes that separate words everywhere in this subpackage;
#: ``bytes.split()`` separates on exactly these.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
PIECE_ROWS = 512


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the split of train and held-out rows."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, prepare: Callable[[], Callable] | None = None
) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``prepare`` makes it once a task.

    Batches come in pieces of ``PIECE_ROWS`` rows, which bounds the texts that are Python objects at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = prepare() if prepare else function
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                yield f(batch.slice(at, PIECE_ROWS))

    return df.mapInArrow(run, schema)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run within hands batches of about ``size`` bytes to Python, besides Spark's own limit of rows; the setting is put back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def training_sample(rows: DataFrame, group: str, id_col: str, per_group: int, keep: list[str]) -> DataFrame:
    """The ``per_group`` rows of each value of ``group`` whose ids have the smallest hashes; all rows of a smaller group.

    The sample is the same on every run.  A count of each group gives a limit for the hash that somewhat more than
    ``per_group`` rows pass, and only these are ranked, so no group's rows ever meet in a task.
    ``group`` must have few values.  Rows of one id have one place: the order of a hash of ``keep`` decides among them, and where
    a few ids hold most rows of a group, fewer rows than ``per_group`` may come.
    """
    counts = rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    # a hash other than the one that splits the rows
    hashed = rows.withColumn("__h", F.xxhash64(F.lit("sample"), F.col(id_col)))
    few = per_group + 8 * per_group**0.5 + 64
    place = F.shiftrightunsigned("__h", 11) * F.lit(2.0**-53)
    near = hashed.join(F.broadcast(counts), F.col(group) == F.col("__group")).where(place <= F.lit(few) / F.col("__n"))
    order = Window.partitionBy(group).orderBy(place, "__h", F.xxhash64(*keep))
    return near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_group).select(*keep)
