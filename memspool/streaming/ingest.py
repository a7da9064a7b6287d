"""Histories that arrive as files, distilled batch by batch into a profile.

A batch's conversations go through the ledger first, so a batch that runs again after a failure changes nothing.
Lines that are no turns go into a table of their own.  A conversation is distilled from what its batch has of it: put whole conversations
into a file, or those that go on into a later one again from their start.  ``sessions`` holds conversations until they are complete.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.extract import Extraction
from ..plans.models import Adapter
from ..schema import TURN_JSON, TURNS
from ..sources.history import NEEDED, line_positions, turn_columns
from ..sources.store import Store


def turn_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the lines of files that are put into ``folder``."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def as_turns(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of a batch's lines (``value, file, at``), by file and position, and the lines that are none (``src_ord, value``)."""
    rows = line_positions(lines).select("src_ord", "value", F.from_json("value", TURN_JSON).alias("t"))
    whole = F.coalesce(reduce(and_, [F.col(f"t.{c}").isNotNull() for c in NEEDED]), F.lit(False))
    return rows.where(whole).select("src_ord", *turn_columns("t")), rows.where(~whole).select("src_ord", "value")


def rejected_path(store: Store, profile: str) -> str:
    """The table of lines that are no turns, by batch."""
    return f"{store.root}/rejected/profile={profile}"


def ingest(spark: SparkSession, folder: str, store: Store, profile: str, adapter: Adapter, checkpoint: str, scratch: str):
    """Process what has arrived and stop; run it again for more.  Returns the finished query."""

    def one(batch: DataFrame, number: int) -> None:
        path = f"{scratch}/batch-{number}"
        batch.withColumn("at", F.struct("start", F.monotonically_increasing_id().alias("m"))).write.mode("overwrite").parquet(f"{path}/lines")
        good, bad = as_turns(spark.read.parquet(f"{path}/lines"))
        good.write.mode("overwrite").parquet(f"{path}/turns")
        turns = spark.read.schema(TURNS).parquet(f"{path}/turns")
        if bad.limit(1).count():
            bad.write.mode("overwrite").parquet(f"{rejected_path(store, profile)}/batch={number}")
        if turns.limit(1).count():
            if profile not in store.profiles():
                store.init(profile)
            base = store.load(profile)
            pack = Extraction(spark, adapter, f"{path}/steps").run(turns, base)
            if pack.ledger.join(base.ledger, ["conv_id", "digest"], "left_anti").limit(1).count():
                store.commit(pack, profile, f"ingest batch {number}")

    query = turn_stream(spark, folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
