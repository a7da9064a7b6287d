"""Conversations that are complete: a stream's turns are held until a conversation has been silent for a while.

Turns land in a table first, batch by batch, with lines that are no turns and turns that come too late in tables of their own, so no line is lost.  A second
stream reads that table and keeps one row of state for each open session, its bounds and its number of turns, and no text; when
the watermark passes a session's end it is closed, its turns are taken from the table, and they are distilled together, whatever files and
batches they came in.

A turn is too late if it is older than the newest one of all earlier batches by more than ``delay``.  The second stream's watermark is never ahead
of that, so it drops nothing.  Both streams write what a batch gives under the batch's number, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import placed
from ..plans.extract import Extraction
from ..plans.models import Adapter
from ..schema import TURNS
from ..sources.files import Files
from ..sources.store import Store
from .ingest import as_turns, turn_stream

LANDED = T.StructType([*TURNS.fields, T.StructField("at", T.TimestampType())])
SESSIONS = T.StructType([T.StructField("conv_id", T.StringType()), T.StructField("started", T.TimestampType()), T.StructField("last", T.TimestampType()), T.StructField("n_turns", T.LongType())])


def closed_sessions(turns: DataFrame, gap: str, delay: str) -> DataFrame:
    """``conv_id, started, last, n_turns``: runs of a conversation's turns (``conv_id, at``) that no gap of ``gap`` parts.

    Of a stream, in append mode: each when the watermark, ``delay`` behind the newest turn, is past its end.
    """
    held = turns.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("s"), "conv_id")
    return held.agg(F.min("at").alias("started"), F.max("at").alias("last"), F.count("*").alias("n_turns")).select("conv_id", "started", "last", "n_turns")


def turn_time(ts: Column | str) -> Column:
    """The time of a turn; null where there is none."""
    return F.try_to_timestamp(F.col(ts) if isinstance(ts, str) else ts)


@dataclass
class SessionStream:
    """Files in ``folder`` become closed sessions under ``root``, a folder that all executors share.

    ``gap`` and ``delay`` are intervals as ``30 minutes``; ``files_at_once`` bounds the files of a batch.
    """

    spark: SparkSession
    folder: str
    root: str
    gap: str = "30 minutes"
    delay: str = "10 minutes"
    files_at_once: int = 1000

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if Files(self.spark).exists(path) else self.spark.createDataFrame([], schema)

    def turns(self) -> DataFrame:
        return self._table("turns", LANDED)

    def late(self) -> DataFrame:
        return self._table("late", LANDED)

    def sessions(self) -> DataFrame:
        return self._table("sessions", SESSIONS)

    def rejected(self) -> DataFrame:
        return self._table("rejected", T.StructType([T.StructField("src_ord", T.LongType()), T.StructField("value", T.StringType())]))

    def land(self) -> None:
        """Put the lines of new files into the tables; a turn without a time counts as late."""

        def one(batch: DataFrame, number: int) -> None:
            part = f"batch={number}"
            kept = f"{self.root}/lines/{part}"
            batch.withColumn("at", F.struct("start", F.monotonically_increasing_id().alias("m"))).write.mode("overwrite").parquet(kept)
            good, bad = as_turns(self.spark.read.parquet(kept))
            timed = good.withColumn("at", turn_time("ts"))
            earlier = self.turns()
            before = earlier.where(F.col("batch") < number).agg(F.max("at")).first()[0] if "batch" in earlier.columns else None
            on_time = F.col("at").isNotNull()
            if before is not None:
                on_time &= F.col("at") >= F.lit(before) - F.expr(f"INTERVAL {self.delay}")
            timed = timed.withColumn("on_time", F.coalesce(on_time, F.lit(False)))
            timed.write.mode("overwrite").parquet(f"{self.root}/parsed/{part}")
            timed = self.spark.read.parquet(f"{self.root}/parsed/{part}")
            for name, rows in (("late", timed.where("not on_time").drop("on_time")), ("rejected", bad), ("turns", timed.where("on_time").drop("on_time"))):
                if not rows.isEmpty():
                    rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{part}")

        stream = turn_stream(self.spark, self.folder, self.files_at_once)
        stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{self.root}/landing").trigger(availableNow=True).start().awaitTermination()

    def close(self, done=None) -> None:
        """Close what is complete by now; ``done`` gets the turns of each batch's closed sessions, and the batch's number."""

        def one(batch: DataFrame, number: int) -> None:
            path = f"{self.root}/sessions/batch={number}"
            batch.write.mode("overwrite").parquet(path)
            closed = self.spark.read.schema(SESSIONS).parquet(path)
            if done is not None and not closed.isEmpty():
                done(self.turns_of(closed), number)

        if Files(self.spark).exists(f"{self.root}/turns"):
            landed = self.spark.readStream.schema(LANDED).option("maxFilesPerTrigger", self.files_at_once).parquet(f"{self.root}/turns")
            query = closed_sessions(landed, self.gap, self.delay).writeStream.outputMode("append").foreachBatch(one)
            query.option("checkpointLocation", f"{self.root}/closing").trigger(availableNow=True).start().awaitTermination()

    def turns_of(self, closed: DataFrame) -> DataFrame:
        """The turns of closed sessions, session by session and by time; only files that hold times between their bounds are read."""
        lo, hi = closed.agg(F.min("started"), F.max("last")).first()
        within = self.turns().where(F.col("at").between(F.lit(lo), F.lit(hi)))
        s = closed.select(F.col("conv_id").alias("__conv"), F.col("started").alias("__started"), "last")
        met = within.join(s, (within["conv_id"] == s["__conv"]) & within["at"].between(s["__started"], s["last"])).withColumnRenamed("src_ord", "__line")
        # numbers of lines begin anew in each batch; a session's turns are neighbours
        ordered = placed(met.withColumn("__all", F.lit(0)), ("__all",), ("__started", "conv_id", "at", "batch", "__line"))
        return ordered.withColumnRenamed("pos", "src_ord").select(*TURNS.fieldNames())


def ingest_sessions(stream: SessionStream, store: Store, profile: str, adapter: Adapter) -> None:
    """Process what has arrived and stop: sessions that are complete are distilled into a profile, each once."""

    def distil(turns: DataFrame, number: int) -> None:
        path = f"{stream.root}/steps/batch-{number}"
        turns.write.mode("overwrite").parquet(f"{path}/turns")
        if profile not in store.profiles():
            store.init(profile)
        base = store.load(profile)
        pack = Extraction(stream.spark, adapter, path).run(stream.spark.read.schema(TURNS).parquet(f"{path}/turns"), base)
        if pack.ledger.join(base.ledger, ["conv_id", "digest"], "left_anti").limit(1).count():
            store.commit(pack, profile, f"ingest sessions {number}")

    stream.land()
    stream.close(distil)
