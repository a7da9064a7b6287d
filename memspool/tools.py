"""The memory of one profile as three tools for an agent: a context block, search, and adding a fact.

``serve`` offers them over a protocol server where the optional package for it is installed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import sanitize
from .operators.context import build_context
from .operators.merge import placed
from .schema import PARTS
from .sources.store import Store


class Memory:
    def __init__(self, store: Store, profile: str | None = None) -> None:
        self.store, self.profile = store, profile or os.environ.get("MEMSPOOL_PROFILE", "default")

    def context(self, budget: int = 2000, query: str = "", today: str | None = None) -> str:
        """The block of this profile, facts that are relevant to the query first."""
        pack = self.store.load(self.profile)
        card = self.store.spark.createDataFrame([(pack.style,)], "text string")
        return build_context(pack.nodes, card, budget, query or None, today, keys=()).first()["context"]

    def search(self, query: str) -> list[str]:
        """Texts of facts that aren't superseded and have the query in text or tags, in the order of the parts."""
        return [r["line"] for r in self.found(query).orderBy("n").toLocalIterator()]

    def found(self, query: str) -> DataFrame:
        """``n, line``: the same as a table."""
        place = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
        rows = self.store.find(self.profile, query).select(F.lit(0).alias("__all"), place.alias("__part"), "ord", "id", "text")
        return placed(rows, ("__all",), ("__part", "ord", "id")).select(F.col("pos").alias("n"), sanitize("text").alias("line"))

    def add_fact(self, text: str, part: str = "episodes", tags: list[str] | None = None) -> str:
        """Store one fact; returns its id."""
        return self.store.add_fact(self.profile, text, part, tags)

    def enrich(self, prompt: str, profiles: list[str] | None = None, budget: int = 2000, today: str | None = None) -> str:
        """The prompt behind the merged memory of several profiles (all by default); without any, the prompt alone."""
        from .operators.merge import merge_packs

        names = self.store.profiles() if profiles is None else profiles
        if not names:
            return prompt
        nodes, cards = None, []
        for k, name in enumerate(names):
            pack = self.store.load(name)
            rows = pack.nodes.withColumn("pack_ord", F.lit(k))
            nodes = rows if nodes is None else nodes.unionByName(rows)
            cards.append((k, pack.style))
        kept, style = merge_packs(nodes, self.store.spark.createDataFrame(cards, "pack_ord int, text string"))
        # order of the union: pack, then the node's own
        kept = kept.withColumn("ord", F.col("pack_ord").cast("long") * (1 << 40) + F.col("ord"))
        return build_context(kept, style, budget, None, today, keys=()).first()["context"] + "\n\n" + prompt


def serve(memory: Memory) -> None:  # pragma: no cover - needs the optional package
    from mcp.server.fastmcp import FastMCP

    server = FastMCP("memspool")
    server.tool(name="memory_profile")(memory.context)
    server.tool(name="memory_search")(memory.search)
    server.tool(name="memory_add_fact")(memory.add_fact)
    server.run()
