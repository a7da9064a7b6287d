"""Long-conversation benchmark files as turns and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import session_time
from ..functions.text import strip
from .arrays import array_members

#: Sessions that are read, questions of a category, and the categories that a substring can judge.
MAX_SESSIONS, PER_CATEGORY = 12, 15
CATEGORIES = {4: "single-hop", 1: "multi-hop", 2: "temporal"}

_TURN = "array<struct<speaker:string,text:string,dia_id:string,blip_caption:string>>"
_QA = "array<struct<question:string,answer:string,category:int,evidence:array<string>>>"


def read_samples(spark: SparkSession, path: str, sessions: int = MAX_SESSIONS) -> DataFrame:
    """``idx, speaker_a, speaker_b, sessions (n, ts, turns), qa`` of each sample; sessions count while they are present."""
    rows = array_members(spark, path).select(F.col("idx").cast("int").alias("idx"), F.from_json("item", "map<string,string>").alias("m"))
    fields = ", ".join(f"session_{n}:string, session_{n}_date_time:string" for n in range(1, sessions + 1))
    c = F.from_json(F.col("m")["conversation"], f"struct<speaker_a:string, speaker_b:string, {fields}>")
    rows = rows.select("idx", c.alias("c"), F.from_json(F.col("m")["qa"], _QA).alias("qa"))
    listed = [
        F.struct(F.lit(n).alias("n"), session_time(F.col(f"c.session_{n}_date_time")).alias("ts"), F.from_json(F.col(f"c.session_{n}"), _TURN).alias("turns"))
        for n in range(1, sessions + 1)
    ]
    here = F.array(*[F.col(f"c.session_{n}").isNotNull() for n in range(1, sessions + 1)])
    count = F.coalesce(F.nullif(F.array_position(here, F.lit(False)), F.lit(0)) - 1, F.lit(sessions))
    return rows.select("idx", "c.speaker_a", "c.speaker_b", F.slice(F.array(*listed), F.lit(1), count.cast("int")).alias("sessions"), "qa")


def _eligible(q: Column, a: Column, b: Column, sessions: Column) -> Column:
    """Of a known category, about the first speaker only, with its evidence in the sessions that are read."""
    text = F.lower(q["question"])
    session = lambda e: F.regexp_extract(e, r"^.(\d+)(?::.*)?$", 1).try_cast("int")
    inside = F.forall(q["evidence"], lambda e: F.coalesce(session(e) <= sessions, F.lit(False)))
    return q["category"].isin(*CATEGORIES) & F.contains(text, F.lower(a)) & ~F.contains(text, F.lower(b)) & (F.size(q["evidence"]) > 0) & inside


def eligible(samples: DataFrame) -> DataFrame:
    """Samples with the questions that can be asked, and their number ``n``."""
    kept = F.filter("qa", lambda q: F.coalesce(_eligible(q, F.col("speaker_a"), F.col("speaker_b"), F.size("sessions")), F.lit(False)))
    return samples.withColumn("qa", kept).withColumn("n", F.size("qa"))


def best_sample(samples: DataFrame) -> DataFrame:
    """The first sample with the most questions."""
    return eligible(samples).orderBy(F.desc("n"), "idx").limit(1)


def history(sample: DataFrame) -> DataFrame:
    """Turns of a sample: its first speaker is the user."""
    rows = sample.select("speaker_a", F.explode("sessions").alias("s")).select("speaker_a", "s.n", "s.ts", F.posexplode("s.turns").alias("at", "t"))
    photo = F.concat(F.lit(" [shares a photo: "), "t.blip_caption", F.lit("]"))
    said = F.coalesce("t.text", F.lit(""))
    text = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", strip(F.concat(said, photo))).otherwise(said)
    rows = rows.withColumn("text", text).where("text != ''")
    return rows.select(
        (F.col("n") * 1_000_000 + F.col("at")).cast("long").alias("src_ord"), F.format_string("locomo-s%02d", "n").alias("conv_id"), F.col("t.dia_id").alias("turn_id"),
        F.when(F.col("t.speaker") == F.col("speaker_a"), "user").otherwise("assistant").alias("role"), F.concat("t.speaker", F.lit(": "), "text").alias("content"), "ts",
    )


def questions(sample: DataFrame, per_category: int = PER_CATEGORY) -> DataFrame:
    """``q_ord, question, expected, category``: the first of each category."""
    names = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    rows = sample.select(F.posexplode("qa").alias("q_ord", "q")).select("q_ord", "q.question", F.array("q.answer").alias("expected"), F.element_at(names, F.col("q.category")).alias("category"))
    by = Window.partitionBy("category").orderBy("q_ord")
    return rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= per_category).drop("__n")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``q_ord, question, expected, category`` of a JSON array."""
    from ..schema import QUESTIONS

    asked = array_members(spark, path)
    return asked.select(F.col("idx").cast("int").alias("q_ord"), F.from_json("item", QUESTIONS, {"mode": "FAILFAST"}).alias("q")).select("q_ord", "q.*")
