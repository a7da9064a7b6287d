"""Merkle manifest of a dataset in Pregel-style RDD supersteps.

Each row is a leaf with a digest of its columns.  The leaves of a source, by id, are the lowest vertices of its tree, and the sources' subroots those of one more tree.
In a superstep every active vertex sends its digest to its parent; parents have all of their children then, hash and are active in the
next superstep, until each tree has its root.  In the reverse supersteps each vertex sends its children the path that it got, with their siblings in front,
down to the leaves, which are folded along it and compared with the root.

A vertex is ``(tree, index)`` on its level; a parent's index is its child's divided by ``FAN``, so a key has ``FAN`` messages at most, and the largest
source is spread like any other.  Places of leaves are counted by ranges.  What a superstep finished is a table in the shared folder, so that
a lost executor costs one superstep.  There are as many supersteps as levels, so the work is a small multiple of the leaves'.  Leaves are held with
their parent's vertex from the first superstep on: each text is read once.

Defined cases: null columns are ``-``; a null id comes first in its source, is ``-`` in its leaf and is never tampered with; rows of equal ids order by leaf, and equal
leaves are places of their own; the null source is a tree of its own, apart from the empty one; an empty table gives an
empty result.  Other columns are not read, so that none can clash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import placed
from .common import crc_mod, materialize

FAN = 16
#: Vertices of a partition in a superstep.
PART = 2_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def joined_hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of columns, each ``-`` if null, else its length in bytes, ``:`` and its value."""
    texts = [c.cast("string") for c in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, tampered``: the digest of each row, and of what a tampered copy of it would be (null: untouched)."""
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    fields = [doc_id, source, F.col("lang"), F.col("n_chars"), text]
    tampered = F.when(doc_id.isNotNull() & (crc_mod(doc_id, 5) == 0), leaf_digest([*fields[:4], F.translate(text, _UPPER, _UPPER.lower())]))
    # null first, then by bytes
    tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    return docs.select(tree.alias("tree"), doc_id.alias("doc_id"), leaf_digest(fields).alias("leaf"), tampered.alias("tampered"))


def _written(rdd: RDD, schema: str, name: str) -> DataFrame:
    return materialize(SparkSession.active().createDataFrame(rdd, schema, verifySchema=False), name)


def _parts(vertices: int) -> int:
    return 1 + vertices // PART


_VERTEX = "tree string, at long, n long, digest binary, kids array<binary>"


def _hashed(children: list[tuple[int, bytes]], n: int) -> tuple[bytes, list[bytes]]:
    """A parent's digest and its children in order; the only vertex of a level (``n``) has no parent and stands for itself."""
    kids = [d for _, d in sorted(children)]
    return (kids[0] if n == 1 else joined_hash(kids)), kids


def _up(active: RDD, parts: int) -> RDD:
    """One superstep upward: ``(tree, index), (n, digest)`` to ``tree, index, n, digest, kids`` of the parents."""
    sent = active.map(lambda v: ((v[0][0], v[0][1] // FAN), (v[0][1] % FAN, v[1][0], v[1][1])))

    def complete(message):
        (tree, at), got = message
        got = list(got)
        n = got[0][1]
        digest, kids = _hashed([(slot, d) for slot, _, d in got], n)
        return tree, at, -(-n // FAN), digest, kids

    return sent.groupByKey(parts).map(complete)


def ascend(first: DataFrame, counts: list[int]) -> list[DataFrame]:
    """The levels above ``first`` (``tree, at, n, digest``), lowest first; ``counts`` has the vertices of each level."""
    levels, now = [], first
    for vertices in counts:
        active = now.where("n > 1").select("tree", "at", "n", "digest").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]))))
        now = _written(_up(active, _parts(vertices)), _VERTEX, "merkle-level")
        levels.append(now)
    return levels


def level_sizes(sizes: DataFrame) -> list[int]:
    """Vertices on the levels above those of ``sizes`` (``n`` of each tree), up to the last root."""
    most = sizes.agg(F.max("n")).first()[0] or 0
    steps, n = [], F.col("n")
    while most > 1:
        alive = n > 1
        n = F.ceil(n / FAN)
        steps.append(F.sum(F.when(alive, n).otherwise(0)))
        most = -(-most // FAN)
    return list(sizes.agg(*steps).first()) if steps else []


def _down(level: RDD, paths: RDD, parts: int) -> RDD:
    """One superstep downward: ``(tree, index), path`` of parents to those of their children, with the siblings in front.

    A path is a list of (slot, siblings) and an ending that goes down as it is.
    """

    def send(met):
        (tree, at), (kids, (steps, ending)) = met
        for slot, _ in enumerate(kids):
            yield (tree, at * FAN + slot), ([(slot, kids[:slot] + kids[slot + 1 :]), *steps], ending)

    return level.join(paths, parts).flatMap(send)


def folded(leaf: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf leads to along its path."""
    for slot, siblings in steps:
        leaf = joined_hash([*siblings[:slot], leaf, *siblings[slot:]])
    return leaf


def _kids(level: DataFrame) -> RDD:
    return level.select("tree", "at", "kids").rdd.map(lambda r: ((r[0], r[1]), [bytes(k) for k in r[2]]))


def descend(levels: list[DataFrame], counts: list[int], start: RDD, entering: dict[int, RDD] | None = None) -> RDD:
    """Paths of the vertices below ``levels``, from those of vertices on the top (``start``) and of roots on other levels."""
    paths = start
    for k in range(len(levels) - 1, -1, -1):
        if entering and k in entering:
            paths = paths.union(entering[k])
        paths = _down(_kids(levels[k]), paths, _parts(counts[k]))
    return paths


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, depth int"


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, depth`` of each row (``depth``: levels from leaf to root)."""
    spark = docs.sparkSession
    table = materialize(leaves(docs.select(*FIELDS)), "merkle-leaves")
    at = materialize(placed(table, ("tree",), ("doc_id", "leaf")).withColumnRenamed("pos", "at"), "merkle-places")
    sizes = materialize(at.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")

    # the first superstep: parents keep their leaves
    total = sizes.agg(F.sum(F.ceil(F.col("n") / FAN))).first()[0]
    if not total:
        return spark.createDataFrame([], _RESULT)
    sent = at.rdd.map(lambda r: ((r["tree"], r["at"] // FAN), (r["at"] % FAN, r["doc_id"], bytes(r["leaf"]), r["tampered"] and bytes(r["tampered"]))))
    held = sent.groupByKey(_parts(total)).map(lambda m: (m[0][0], m[0][1], *zip(*[x[1:] for x in sorted(m[1], key=lambda x: x[0])])))
    low = _written(held, "tree string, at long, ids array<long>, kids array<binary>, tampered array<binary>", "merkle-held")
    # a source is one key here, but its vertices are few and equal in size: Spark splits or broadcasts it by its sizes
    known = low.select("tree", "at", "kids").join(sizes, "tree")
    hashed = known.rdd.map(lambda r: (r[0], r[1], -(-r[3] // FAN), _hashed(list(enumerate(map(bytes, r[2]))), r[3])[0]))
    first = _written(hashed, "tree string, at long, n long, digest binary", "merkle-first")
    counts = level_sizes(sizes.select(F.ceil(F.col("n") / FAN).alias("n")))
    levels = ascend(first, counts)

    # the tree of subroots
    tops = [t.where("n = 1").select("tree", F.lit(k).alias("level"), "digest") for k, t in enumerate([first, *levels])]
    tops = materialize(placed(reduce(DataFrame.unionByName, tops).withColumn("all", F.lit(0)), ("all",), ("tree",)), "merkle-subroots")
    n_trees = tops.count()
    over = tops.select(F.lit("").alias("tree"), F.col("pos").alias("at"), F.lit(n_trees).cast("long").alias("n"), "digest")
    over_counts = level_sizes(spark.createDataFrame([(n_trees,)], "n long"))
    over_levels = ascend(over, over_counts)
    root = bytes((over_levels[-1] if over_levels else over).select("digest").first()[0])

    # reverse supersteps: from the root to the subroots, then from these, each on its level, to the lowest parents
    sub_paths = descend(over_levels, over_counts, spark.sparkContext.parallelize([(("", 0), ([], None))], 1))
    named = tops.rdd.map(lambda r: (("", r["pos"]), (r["tree"], r["level"], bytes(r["digest"]))))
    entries = named.join(sub_paths, _parts(n_trees)).map(lambda m: (m[1][0][0], m[1][0][1], m[1][0][2], [list(s) for s in m[1][1][0]]))
    step = "struct<slot: int, siblings: array<binary>>"
    entries = _written(entries, f"tree string, level int, subroot binary, steps array<{step}>", "merkle-entries")

    def entering(level: int) -> RDD:
        rows = entries.where(F.col("level") == level).rdd
        return rows.map(lambda r: ((r["tree"], 0), ([(s["slot"], [bytes(x) for x in s["siblings"]]) for s in r["steps"]], bytes(r["subroot"]))))

    top = len(levels)
    paths = descend(levels, counts, entering(top), {k: entering(k + 1) for k in range(top - 1)})
    if top:
        paths = paths.union(entering(0))

    def verify(met):
        _, ((ids, kids, tampered, n), (steps, subroot)) = met
        for slot, (doc_id, leaf, changed) in enumerate(zip(ids, kids, tampered)):
            own = steps if n == 1 else [(slot, kids[:slot] + kids[slot + 1 :]), *steps]
            got = folded(changed or leaf, own)
            yield doc_id, leaf.hex(), subroot.hex(), root.hex(), joined_hash([d for _, s in own for d in s]).hex(), got.hex(), got == root, len(own)

    held = low.join(sizes, "tree").rdd.map(lambda r: ((r["tree"], r["at"]), (list(r["ids"]), [bytes(k) for k in r["kids"]], [t and bytes(t) for t in r["tampered"]], r["n"])))
    return spark.createDataFrame(held.join(paths, _parts(total)).flatMap(verify), _RESULT, verifySchema=False)


#: DuckDB: both trees by recursion over levels, and each leaf folded along its way.
ORACLE = """
with recursive rows_ as (
  select doc_id, source, lower(sha256(
           coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-') ||
           coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') ||
           coalesce(strlen(text)::varchar || ':' || text, '-'))) as leaf,
         lower(sha256(
           coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-') ||
           coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') ||
           coalesce(strlen(text)::varchar || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) as changed,
         xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::ubigint)),
             lambda a, b: list_reduce([xor(a, b), 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint],
                                      lambda c, z: xor(c >> 1, (c & 1::ubigint) * 3988292384::ubigint))), 4294967295::ubigint) % 5 as remainder
  from documents),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n,
         row_number() over (order by source nulls first, doc_id nulls first, leaf) as place from rows_),
up(level, source, pos, n, digest) as (
  select 0, source, pos, n, leaf from leaves
  union all
  select level + 1, source, pos // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' order by pos)) from up where n > 1 group by level, source, pos // 16),
subroots as (
  select source, digest, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
tree_over(level, pos, n, digest) as (
  select 0, pos, n, digest from subroots
  union all
  select level + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' order by pos)) from tree_over where n > 1 group by level, pos // 16),
both_trees as (
  select level, 0 as tree, source, pos, n, digest from up union all select level, 1, null, pos, n, digest from tree_over),
runs as (
  select level, tree, source, pos // 16 as run, list(digest order by pos) as kids from both_trees where n > 1 group by all),
way(doc, tree, source, level, pos, digest, proof, subroot) as (
  select l.place, 0, l.source, 0, l.pos, case when l.remainder = 0 then l.changed else l.leaf end, '', s.digest
  from leaves l join subroots s on s.source is not distinct from l.source
  union all
  select w.doc,
         case when r.run is null then 1 else w.tree end,
         case when r.run is null then null else w.source end,
         case when r.run is null then 0 else w.level + 1 end,
         case when r.run is null then s.pos else w.pos // 16 end,
         case when r.run is null then w.digest else sha256(array_to_string(list_transform(r.kids, lambda x, i: case when i = w.pos % 16 + 1 then w.digest else x end), '')) end,
         case when r.run is null then w.proof else w.proof || array_to_string(list_filter(r.kids, lambda x, i: i <> w.pos % 16 + 1), '') end,
         w.subroot
  from way w left join runs r on r.tree = w.tree and r.source is not distinct from w.source and r.level = w.level and r.run = w.pos // 16
  left join subroots s on w.tree = 0 and s.source is not distinct from w.source
  where r.run is not null or w.tree = 0),
ends as (
  select doc, tree, arg_max(digest, tree * 1000 + level) as folded_root, arg_max(proof, tree * 1000 + level) as proof, any_value(subroot) as subroot
  from way where tree = 1 group by doc, tree)
select l.doc_id::bigint as doc_id, l.leaf, e.subroot, r.digest as root, sha256(e.proof) as proof_sha256, e.folded_root, e.folded_root = r.digest as verified
from leaves l join ends e on e.doc = l.place cross join (select digest from tree_over where n = 1) r
"""
