"""Ways to the root in tables of nodes and parents, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import present
from ..sources.scratch import materialize, release


def ancestors(nodes: DataFrame, starts: DataFrame, keys: tuple[str, ...], rounds: int = 64) -> DataFrame:
    """``keys, key, up``: each node on the way up from a start, the start included, and how many steps above it that is.

    ``nodes`` has ``keys, key, parent``, one row for each key; ``starts`` has ``keys, key``, one for each value of ``keys``.  A parent that is
    no node ends the way, and so does one that was passed before.  In every round pointers get twice as long and what was found
    takes one of them, so a way of n nodes takes log2(n) rounds, each a join by key of pointers alone.
    """
    jump = nodes.where(present(F.col("parent")).isNotNull()).select(*keys, "key", F.col("parent").alias("to"))
    jump = materialize(jump, "branch-jumps")
    found = materialize(starts.where(present(F.col("key")).isNotNull()).select(*keys, "key", F.lit(0).cast("long").alias("up")), "branch-found")
    n, step = found.count(), 1
    for _ in range(rounds):
        above = found.join(jump, [*keys, "key"]).select(*keys, F.col("to").alias("key"), (F.col("up") + step).alias("up"))
        # a node that is met again, on a cycle, keeps its first place
        more = materialize(found.unionByName(above).groupBy(*keys, "key").agg(F.min("up").alias("up")), "branch-found")
        m = more.count()
        release(found)
        found = more
        if m == n:
            break
        n = m
        longer = jump.join(jump.select(*keys, F.col("key").alias("to"), F.col("to").alias("next")), [*keys, "to"]).select(*keys, "key", F.col("next").alias("to"))
        longer = materialize(longer, "branch-jumps")
        release(jump)
        jump, step = longer, step * 2
    return found
