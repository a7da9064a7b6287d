"""Which standing nodes chunks of new ones can meet: a similarity join over an inverted index of words.

The index has a row for each word of each standing node, sorted by word, so a chunk reads only the ranges of its own words.  Of a new node the rarest
words are looked up (the prefix that a similarity join tests, as any two texts that have much in common share one of their rare words), standing nodes
are weighed by the rarity of the words that they share with it, and the best few are listed for it.  So a chunk's list is bounded, however large the memory is.

Several chunks are looked up at once, each against what stands before it: a row of the index holds for the chunks behind ``since`` and up to ``until``.

Words that more than ``hot`` nodes have don't meet node by node, as new and standing nodes would meet all to all.  Of nodes that share nothing else with a new one
those of the same hot words weigh the same, so for each set of hot words that new nodes ask for, the first few nodes with each part of it are
enough, and new nodes with that set share them.  The lists are the same.

What the filter loses: a standing node that shares none of a new one's ``probe`` rarest known words, or that ``top`` others of its part come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words as words_of
from ..sources.scratch import materialize

#: Words of a new node that are looked up, and standing nodes listed for it.
PROBE, TOP = 8, 20
#: Words of the chunks up to which the index is asked for them by value, and nodes up to which a word's nodes are all met.
ASKED, HOT = 5000, 200
#: ``until`` of what stands for good.
ALWAYS = 1 << 40


def word_index(nodes: DataFrame) -> DataFrame:
    """``part, word, pos`` and what else nodes (``part, pos, text``) have, dealt and sorted by word."""
    rest = [c for c in nodes.columns if c not in ("part", "text")]
    rows = nodes.select("part", F.explode(F.array_distinct(words_of("text"))).alias("word"), *rest)
    return rows.repartitionByRange("part", "word").sortWithinPartitions("part", "word")


def stands(since: str = "since", until: str = "until") -> Column:
    """Whether a row holds for a chunk."""
    return (F.col(since) < F.col("chunk")) & (F.col("chunk") <= F.col(until))


def meeting(index: DataFrame, chunks: DataFrame, probe: int = PROBE, top: int = TOP, hot: int = HOT) -> DataFrame:
    """``part, chunk, pos`` of the standing nodes that new ones (``part, chunk, pos, text``) may meet; ``index`` has ``part, word, pos, since, until, moved``.

    ``moved`` marks what a node with another text before or behind it has: all else stands from its place on.
    """
    asked = materialize(chunks.select("part", "chunk", F.col("pos").alias("j"), F.explode(F.array_distinct(words_of("text"))).alias("word")), "gate-asked")
    words = [r["word"] for r in asked.select("word").distinct().limit(ASKED + 1).collect()]
    known = index.where(F.col("word").isin(words)) if len(words) <= ASKED else index.join(asked.select("part", "word").distinct(), ["part", "word"], "left_semi")
    known = materialize(known.select("part", "word", "pos", "since", "until", "moved"), "gate-known")

    # how many nodes have a word when a chunk comes
    begins = known.select("part", "word", (F.col("since") * 2).alias("k"), F.lit(1).alias("n"))
    ends = known.where(F.col("until") < ALWAYS).select("part", "word", (F.col("until") * 2).alias("k"), F.lit(-1).alias("n"))
    asks = asked.select("part", "word", (F.col("chunk") * 2 - 1).alias("k"), F.lit(0).alias("n")).distinct()
    steps = begins.unionByName(ends).unionByName(asks).groupBy("part", "word", "k").agg(F.sum("n").alias("n"))
    steps = steps.withColumn("df", F.sum("n").over(Window.partitionBy("part", "word").orderBy("k")))
    counts = steps.where((F.pmod("k", F.lit(2)) == 1) & (F.col("df") > 0)).select("part", "word", F.floor((F.col("k") + 1) / 2).alias("chunk"), "df")
    rare = asked.join(counts, ["part", "word", "chunk"])
    rare = rare.withColumn("n", F.row_number().over(Window.partitionBy("part", "chunk", "j").orderBy("df", "word"))).where(F.col("n") <= probe)
    common = known.groupBy("part", "word").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("part", "word", F.lit(True).alias("hot"))
    rare = materialize(rare.drop("n").join(common, ["part", "word"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "gate-rare")
    mine = ["part", "chunk", "j"]
    wanted = rare.where("hot").groupBy(*mine).agg(F.array_sort(F.collect_list("word")).alias("set"), F.array_sort(F.collect_list(F.struct("df", "word"))).alias("costs"))
    wanted = materialize(wanted, "gate-sets")
    known_hot = materialize(known.join(common, ["part", "word"], "left_semi"), "gate-hot")

    def weight(shared: Column) -> Column:
        return F.aggregate(F.array_sort(shared), F.lit(0.0), lambda s, x: s + F.lit(1.0) / x["df"])

    # nodes that share a word which few have, with all that they share
    light = rare.where("not hot").join(known, ["part", "word"]).where(stands())
    light = light.groupBy(*mine, "pos", "since").agg(F.collect_list(F.struct("df", "word")).alias("shared"))
    has = known_hot.groupBy("part", "pos", "since").agg(F.collect_set("word").alias("has"))
    light = light.join(wanted.select(*mine, "costs"), mine, "left").join(has, ["part", "pos", "since"], "left")
    also = F.coalesce(F.filter("costs", lambda x: F.array_contains("has", x["word"])), F.array().cast("array<struct<df:bigint,word:string>>"))
    light = light.select(*mine, F.col("pos").alias("i"), weight(F.concat("shared", also)).alias("weight"))

    # and those that share hot words only
    sets = wanted.select("part", "set").distinct()
    within = sets.select("part", "set", F.explode("set").alias("word")).join(known_hot, ["part", "word"])
    within = within.groupBy("part", "set", "pos", "since", "until", "moved").agg(F.array_sort(F.collect_set("word")).alias("has"))
    place = F.row_number().over(Window.partitionBy("part", "set", "has").orderBy("pos"))
    first = within.where("not moved").withColumn("n", place).where(F.col("n") <= top).drop("n").unionByName(within.where("moved"))
    first = materialize(first, "gate-first")
    met = wanted.join(first, ["part", "set"]).where(stands())
    met = met.select(*mine, F.col("pos").alias("i"), weight(F.filter("costs", lambda x: F.array_contains("has", x["word"]))).alias("weight"))

    each = light.unionByName(met).groupBy(*mine, "i").agg(F.max("weight").alias("weight"))
    best = Window.partitionBy(*mine).orderBy(F.desc("weight"), "i")
    return each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).select("part", "chunk", F.col("i").alias("pos")).distinct()
