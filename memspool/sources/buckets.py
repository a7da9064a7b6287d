"""Tables whose versions share what didn't change.

A table's rows lie in buckets, ranges of a position within a part.  A manifest has one entry for each bucket: its rows, its
last position, a digest of its contents and the write that made it.  A version writes only the buckets whose digests
aren't in the manifest before it, and two versions are compared by their manifests first.

Digests are sums of four 60-bit pieces of the rows' SHA-256.  They don't depend on order, need no list of rows, and the digest of a range
is the sum of those of its halves.  So the buckets of two manifests with ranges of different width (powers of two) can
be compared at the wider one.  Repeated rows count as often as they stand.

A manifest has at most ``MOST`` + 1 entries for each part, as ranges get wider with the part, so it fits in the driver
at every size.  Buckets that hold many rows are written by several tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 1024
ROWS = 1 << 16


def hashed(key: str) -> Column:
    """A position for rows without one."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40))


def _pieces(df: DataFrame, fields: list[str]) -> list[Column]:
    """Sums over the rows' hashes; time stamps count to the microsecond."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    exact = [F.unix_micros(c).alias(c) if isinstance(kinds[c], T.TimestampType) else F.col(c) for c in fields]
    sha = F.sha2(F.to_json(F.struct(*exact)), 256)
    return [F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"d{k}") for k in range(4)]


def _upto(n: int) -> int:
    """The smallest power of two that isn't below ``n``."""
    return 1 << max(n - 1, 0).bit_length()


class Buckets:
    """A bucketed table at ``path``: ``fields`` are its columns, ``place`` a row's position, ``part`` its part."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, place: Column, part: Column, rows: int = ROWS) -> None:
        self.spark, self.path, self.schema, self.place, self.part, self.rows = spark, path, schema, place, part, rows
        self.fields = schema.fieldNames()

    def _widths(self, placed: DataFrame, before: list[dict]) -> dict[str, int]:
        """The width of each part's ranges: the one before while it is within twice of what its rows want."""
        old = {e["part"]: e["width"] for e in before}
        sizes = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("a"), F.max("__at").alias("z")).collect()
        out = {}
        for s in sizes:
            span = s["z"] - s["a"] + 1
            least = _upto(-(-span // MOST))
            want = max(_upto(-(-span * self.rows // s["n"])), least)
            was = old.get(s["__part"], want)
            out[s["__part"]] = was if was >= least and want <= 2 * was and was <= 2 * want else want
        return out

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.select(*self.fields).withColumns({"__part": self.part, "__at": F.coalesce(self.place, F.lit(0).cast("long"))})

    def _in_buckets(self, placed: DataFrame, widths: dict[str, int]) -> DataFrame:
        width = F.lit(None).cast("long")
        for part, w in widths.items():
            width = F.when(F.col("__part") == part, F.lit(w).cast("long")).otherwise(width)
        return placed.withColumn("__bucket", F.col("__at") - F.pmod(F.col("__at"), width))

    def _entries(self, rows: DataFrame, widths: dict[str, int]) -> list[dict]:
        """What a manifest says of these rows, but for where they are written."""
        found = rows.groupBy("__part", "__bucket").agg(F.count("*").alias("n"), F.max("__at").alias("last"), *_pieces(rows, self.fields)).collect()
        return [
            {"part": r["__part"], "start": r["__bucket"], "width": widths[r["__part"]], "rows": r["n"], "last": r["last"], "digest": [int(r[f"d{k}"]) for k in range(4)]}
            for r in sorted(found, key=lambda r: (r["__part"], r["__bucket"]))
        ]

    def _put(self, rows: DataFrame, entries: list[dict]) -> list[dict]:
        """Write the buckets of ``entries`` and say where."""
        if not entries:
            return []
        token = uuid.uuid4().hex
        marks = [(e["part"], e["start"], -(-e["rows"] // self.rows)) for e in entries]
        which = self.spark.createDataFrame(marks, "__part string, __bucket long, __tasks long")
        out = rows.join(F.broadcast(which), ["__part", "__bucket"])  # bounded as a manifest is
        out = out.withColumn("__task", F.pmod(F.xxhash64(*self.fields), F.col("__tasks")))
        out = out.repartition("__part", "__bucket", "__task").sortWithinPartitions("__part", "__bucket", "__at")
        out.select(*self.fields, F.col("__part").alias("in_part"), F.col("__bucket").alias("start")).write.partitionBy("in_part", "start").parquet(f"{self.path}/w={token}")
        return [{**e, "written": token} for e in entries]

    def write(self, df: DataFrame, before: list[dict] | None = None) -> list[dict]:
        """The manifest of ``df``; buckets that the manifest ``before`` has aren't written again.

        ``df`` is computed three times (sizes, digests, rows), so it should be a table or a cheap plan.  If these differ, a later version
        writes the buckets anew; rows are never taken from another version than the one that has their digest.
        """
        before = before or []
        placed = self._placed(df)
        widths = self._widths(placed, before)
        rows = self._in_buckets(placed, widths)
        have = {(e["part"], e["start"], e["width"], *e["digest"]): e for e in before}
        new, kept = [], []
        for e in self._entries(rows, widths):
            old = have.get((e["part"], e["start"], e["width"], *e["digest"]))
            if old is None:
                new.append(e)
            else:
                kept.append(old)
        return sorted(kept + self._put(rows, new), key=lambda e: (e["part"], e["start"]))

    def extend(self, added: DataFrame, before: list[dict]) -> list[dict]:
        """The manifest with rows added: only the buckets where they belong are read and written."""
        placed = self._placed(added)
        widths = {**self._widths(placed, []), **{e["part"]: e["width"] for e in before}}
        fresh = self._entries(self._in_buckets(placed, widths), widths)
        at = {(e["part"], e["start"]): e for e in before}
        touched, rest = [], dict(at)
        for e in fresh:
            old = rest.pop((e["part"], e["start"]), None)
            if old is not None:
                e = {**e, "rows": e["rows"] + old["rows"], "last": max(e["last"], old["last"]), "digest": [a + b for a, b in zip(e["digest"], old["digest"])]}
            touched.append(e)
        parts = [e["part"] for e in touched] + [p for p, _ in rest]
        if max(map(parts.count, set(parts)), default=0) > 2 * MOST:
            return self.write(self.read(before).unionByName(added.select(*self.fields)), before)
        olds = [at[k] for e in touched if (k := (e["part"], e["start"])) in at]
        rows = self._in_buckets(self._placed(self.read(olds).unionByName(added.select(*self.fields))), widths)
        return sorted([*rest.values(), *self._put(rows, touched)], key=lambda e: (e["part"], e["start"]))

    def read(self, manifest: list[dict]) -> DataFrame:
        """The rows of a manifest's buckets."""
        if not manifest:
            return self.spark.createDataFrame([], self.schema)
        # names of parts are letters here, so their folders are named alike
        paths = [f"{self.path}/w={e['written']}/in_part={e['part']}/start={e['start']}" for e in manifest]
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).select(*self.fields)


def changed(a: list[dict], b: list[dict]) -> tuple[list[dict], list[dict]]:
    """The buckets of either manifest that aren't in both with the same contents.

    Where a part's ranges differ in width, both are summed up to the wider one first.
    """
    widest: dict[str, int] = {}
    for e in [*a, *b]:
        widest[e["part"]] = max(widest.get(e["part"], 0), e["width"])

    def key(e):
        return e["part"], e["start"] - e["start"] % widest[e["part"]]

    def sums(entries):
        out: dict[tuple, list[int]] = {}
        for e in entries:
            out[key(e)] = [x + y for x, y in zip(out.get(key(e), [0] * 5), [e["rows"], *e["digest"]])]
        return out

    x, y = sums(a), sums(b)
    differ = {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    return [e for e in a if key(e) in differ], [e for e in b if key(e) in differ]
