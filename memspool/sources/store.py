"""A versioned store of memory: Parquet tables whose versions share buckets, published by a commit row.

``root/profile=P/nodes`` and ``ledger`` are bucketed tables (see ``buckets``): a version writes only the buckets that changed.
``root/profile=P/v=N/meta.json`` holds the manifests of version N, its style card and models, and the place of its raw lines (such that can't be parsed too),
which versions share as well until new ones are given.  ``root/commits/profile=P`` holds one row for each commit; it is written last, so
a version that fails half-way is never seen.  One writer at a time for each profile.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize, sortable_id
from ..operators.merge import placed
from ..operators.revisions import diff, purge_turns, remove_nodes
from ..operators.trigrams import find, postings
from ..schema import LEDGER, NODES, PARTS
from .buckets import ROWS, Buckets, changed, hashed
from .files import Files
from .packs import ARCHIVE_SUFFIX, IntegrityError, Pack, export_archive, load_pack, pack_errors, sanitized, unpack_archive
from .scratch import materialize

COMMITS = "version long, tree_version long, sha string, ts string, message string"
GRAMS = "gram string, part string, block long"
RAW = "file string, n long, line string, turn_id string"


def raw_lines(turns: DataFrame, file: str = "turns.jsonl") -> DataFrame:
    """Turns as lines of a raw file."""
    line = F.to_json(F.struct("role", "content", F.col("ts").alias("timestamp"), F.col("conv_id").alias("conversation_id"), "turn_id"))
    return turns.select(F.lit(file).alias("file"), F.col("src_ord").alias("n"), line.alias("line"), "turn_id")


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of raw files as they are."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = spark.read.text(paths).select(name.alias("file"), (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id()).alias("n"), F.col("value").alias("line"))
    return lines.withColumn("turn_id", F.try_variant_get(F.try_parse_json("line"), "$.turn_id", "string"))


class Store:
    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = ROWS) -> None:
        self.spark, self.root, self.files, self.bucket_rows = spark, root.rstrip("/"), Files(spark), bucket_rows

    # --- versions ---------------------------------------------------------------------------------------------------

    def _commits_path(self, profile: str) -> str:
        return f"{self.root}/commits/profile={profile}"

    def _tree(self, profile: str, version: int) -> str:
        return f"{self.root}/profile={profile}/v={version}"

    def profiles(self) -> list[str]:
        """Names of profiles, sorted."""
        return [n.removeprefix("profile=") for n in self.files.names(f"{self.root}/commits") if n.startswith("profile=")]

    def commits(self, profile: str) -> DataFrame:
        if not self.files.exists(self._commits_path(profile)):
            raise FileNotFoundError(f"no profile '{profile}'")
        return self.spark.read.schema(COMMITS).json(self._commits_path(profile))

    def log(self, profile: str) -> DataFrame:
        """``sha, ts, message``, newest first."""
        return self.commits(profile).orderBy(F.desc("version")).select(F.substring("sha", 1, 8).alias("sha"), "ts", "message")

    def _row(self, profile: str, rev: int | str) -> dict:
        """The commit that a revision names: a version, a beginning of its sha, ``HEAD`` or ``HEAD~n``."""
        rows = self.commits(profile)
        if isinstance(rev, str) and rev.startswith("HEAD"):
            back = int(rev[5:] or 1) if rev.startswith("HEAD~") else 0
            got = rows.orderBy(F.desc("version")).limit(back + 1).collect()
            if len(got) <= back:
                raise KeyError(rev)
            return got[back].asDict()
        found = rows.where(F.col("version") == rev if isinstance(rev, int) else F.col("sha").startswith(rev)).limit(2).collect()
        if len(found) != 1:
            raise KeyError(rev)
        return found[0].asDict()

    def _publish(self, profile: str, version: int, tree: int, message: str) -> str:
        ts = datetime.now(UTC).isoformat()
        sha = hashlib.sha1(f"{profile}\0{version}\0{tree}\0{ts}\0{message}\0{uuid.uuid4()}".encode()).hexdigest()
        row = {"version": version, "tree_version": tree, "sha": sha, "ts": ts, "message": message}
        self.files.write(f"{self._commits_path(profile)}/{version:012d}.json", json.dumps(row).encode())
        return sha

    def _next(self, profile: str) -> int:
        return int(self.commits(profile).agg(F.max("version")).first()[0]) + 1

    def _nodes(self, profile: str) -> Buckets:
        return Buckets(self.spark, f"{self.root}/profile={profile}/nodes", NODES, F.col("ord"), F.col("part"), self.bucket_rows)

    def _ledger(self, profile: str) -> Buckets:
        return Buckets(self.spark, f"{self.root}/profile={profile}/ledger", LEDGER, hashed("conv_id"), F.lit("ledger"), self.bucket_rows)

    def meta(self, profile: str, rev: int | str = "HEAD") -> dict:
        """What a version's ``meta.json`` says."""
        return json.loads(self.files.read(f"{self._tree(profile, self._row(profile, rev)['tree_version'])}/meta.json"))

    def _write_meta(self, profile: str, version: int, meta: dict) -> None:
        tree = self._tree(profile, version)
        self.files.delete(tree)  # what a failed writer left
        self.files.write(f"{tree}/meta.json", json.dumps(meta).encode())

    def _write(self, pack: Pack, profile: str, version: int, raw: DataFrame | None, before: dict | None) -> None:
        """Write a version that shares what it can with the one ``before``; without one it shares nothing."""
        old = before or {"nodes": [], "ledger": [], "raw": None}
        meta = {
            "style": pack.style, "source_models": pack.source_models, "created_at": pack.created_at, "raw": old["raw"],
            "nodes": self._nodes(profile).write(pack.nodes, old["nodes"]), "ledger": self._ledger(profile).write(pack.ledger, old["ledger"]),
        }
        if raw is not None:
            meta["raw"] = f"r={uuid.uuid4().hex}"
            raw.select("file", "n", "line", "turn_id").write.parquet(f"{self.root}/profile={profile}/raw/{meta['raw']}")
        self._write_meta(profile, version, meta)

    def init(self, profile: str) -> str:
        if self.files.exists(self._commits_path(profile)):
            raise FileExistsError(f"profile '{profile}' exists")
        self._write_meta(profile, 0, {"style": "", "source_models": [], "created_at": None, "nodes": [], "ledger": [], "raw": None})
        return self._publish(profile, 0, 0, "initialize empty memory")

    def commit(self, pack: Pack, profile: str, message: str, raw: DataFrame | None = None) -> str:
        """Write the buckets that differ from the version before and publish.  Raw lines of that version are kept unless new ones are given."""
        version = self._next(profile)
        self._write(pack, profile, version, raw, self.meta(profile))
        return self._publish(profile, version, version, message)

    def load(self, profile: str, rev: int | str = "HEAD") -> Pack:
        m = self.meta(profile, rev)
        return Pack(self._nodes(profile).read(m["nodes"]), m["style"], self._ledger(profile).read(m["ledger"]), m["source_models"], m["created_at"])

    def raw(self, profile: str, rev: int | str = "HEAD") -> DataFrame | None:
        kept = self.meta(profile, rev)["raw"]
        return self.spark.read.schema(RAW).parquet(f"{self.root}/profile={profile}/raw/{kept}") if kept else None

    def find(self, profile: str, query: str, rev: int | str = "HEAD") -> DataFrame:
        """Nodes that aren't superseded and have the query in text or tags, by the version's index of trigrams, which the first search makes."""
        tree = self._tree(profile, self._row(profile, rev)["tree_version"])
        nodes = self.load(profile, rev).nodes
        if not self.files.exists(f"{tree}/grams/_SUCCESS"):
            postings(nodes).write.mode("overwrite").parquet(f"{tree}/grams")
        return find(nodes, self.spark.read.schema(GRAMS).parquet(f"{tree}/grams"), query)

    def nodes_at(self, profile: str, rev: int | str) -> DataFrame:
        """Nodes of a revision; of one that doesn't exist, none."""
        try:
            return self.load(profile, rev).nodes
        except KeyError:
            return self.spark.createDataFrame([], NODES)

    def diff(self, profile: str, rev_a: int | str = "HEAD~1", rev_b: int | str = "HEAD") -> list[str]:
        """Lines of changes, by part and id; a changed style card is one line."""
        return [r["line"] for r in self.diff_lines(profile, rev_a, rev_b).orderBy("n").toLocalIterator()]

    def diff_lines(self, profile: str, rev_a: int | str = "HEAD~1", rev_b: int | str = "HEAD") -> DataFrame:
        """``n, line``: the same as a table."""
        def at(rev):
            try:
                return self.meta(profile, rev)
            except KeyError:
                return {"nodes": [], "style": None}

        a, b, table = at(rev_a), at(rev_b), self._nodes(profile)
        # (a node that moves changes the bucket it leaves and the one it comes to, so both are read)
        was, now = changed(a["nodes"], b["nodes"])
        place = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
        changes = diff(table.read(was), table.read(now)).withColumns({"__all": F.lit(0), "__part": place})
        lines = placed(changes, ("__all",), ("__part", "change", "id")).select(F.col("pos").alias("n"), "line")
        if a["style"] == b["style"]:
            return lines
        return lines.unionByName(lines.agg(F.count("*").alias("n")).select("n", F.lit("~ [style] style card changed").alias("line")))

    def checkout(self, profile: str, rev: int | str) -> str:
        """Restore a revision as a new commit; it points to the old snapshot, and history stays."""
        row = self._row(profile, rev)
        return self._publish(profile, self._next(profile), row["tree_version"], f"restore memory of {rev}")

    # --- erasure ----------------------------------------------------------------------------------------------------

    def redact(self, profile: str, node_ids: str | list[str] | DataFrame) -> str:
        """Erase nodes, the turns they came from, and all history before: the result is the only version left.

        Copies that were exported are out of reach.  Many ids come as a table (``id``).
        """
        pack = self.load(profile)
        if isinstance(node_ids, DataFrame):
            gone, named = node_ids.select("id"), f"{node_ids.count()} nodes"
        else:
            ids = [node_ids] if isinstance(node_ids, str) else list(node_ids)
            gone, named = self.spark.createDataFrame([(i,) for i in ids], "id string"), ", ".join(ids)
        missing = gone.join(pack.nodes.select("id"), "id", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0]["id"])
        raw = self.raw(profile)
        kept = purge_turns(raw, pack.nodes, gone) if raw is not None else None
        version = self._next(profile)
        clean = Pack(remove_nodes(pack.nodes, gone), pack.style, pack.ledger, pack.source_models, pack.created_at)
        self._write(clean, profile, version, kept, None)
        self.spark.catalog.clearCache()
        sha = self._publish(profile, version, version, f"redact {named}; history squashed")
        for name in self.files.names(self._commits_path(profile)):
            if not name.startswith(f"{version:012d}"):
                self.files.delete(f"{self._commits_path(profile)}/{name}")
        home, now = f"{self.root}/profile={profile}", self.meta(profile)
        used = {f"w={e['written']}" for e in now["nodes"] + now["ledger"]} | {now["raw"], f"v={version}", "nodes", "ledger", "raw"}
        for folder in ("", "/nodes", "/ledger", "/raw"):
            for name in self.files.names(home + folder):
                if name not in used:
                    self.files.delete(f"{home}{folder}/{name}")
        return sha

    # --- portable packs ---------------------------------------------------------------------------------------------

    def export(self, profile: str, dest: str) -> str:
        return export_archive(self.load(profile), dest, self.raw(profile))

    def import_(self, source: str, profile: str, force: bool = False) -> str:
        """Take over a pack from a directory or archive: verified unless forced, sanitized, replacing the profile's."""
        scratch = f"{self.root}/incoming/{uuid.uuid4().hex}"
        try:
            path = unpack_archive(self.spark, source, scratch) if source.endswith((ARCHIVE_SUFFIX, ".zip")) else source
            errors = pack_errors(self.spark, path)
            if errors and not force:
                raise IntegrityError(f"the pack does not verify: {errors}")
            pack = sanitized(load_pack(self.spark, path, check=False))
            # a commit reads nodes three times: they are parsed and sanitized once
            pack.nodes = materialize(pack.nodes, "imported")
            names = [n for n in self.files.names(f"{path}/raw") if n.endswith(".jsonl")]
            raw = read_raw(self.spark, [f"{path}/raw/{n}" for n in names]) if names else None
            if profile not in self.profiles():
                self.init(profile)
            return self.commit(pack, profile, f"import from {source.rsplit('/', 1)[-1]}", raw)
        finally:
            self.files.delete(scratch)

    def add_fact(self, profile: str, text: str, part: str = "episodes", tags: list[str] | None = None) -> str:
        """Append one sanitized fact and commit; returns its id.  One bucket is read and written."""
        if part not in PARTS:
            raise ValueError(f"part must be one of {', '.join(PARTS)}")
        m = self.meta(profile)
        last = max((e["last"] for e in m["nodes"] if e["part"] == part), default=None)
        at = F.lit(datetime.now(UTC))
        node = self.spark.createDataFrame([(part, text, tags or [])], "part string, text string, tags array<string>")
        new_id = self.spark.range(1).select(sortable_id(F.unix_millis(at), F.lit(0).cast("long"), F.lit(uuid.uuid4().hex), F.lit(text)).alias("id")).first()["id"]
        row = node.select(
            "part", F.lit(0 if last is None else last + 1).cast("long").alias("ord"), F.lit(new_id).alias("id"), sanitize("text").alias("text"),
            F.lit("episode").alias("granularity"), F.lit(0.5).alias("salience"), F.lit("stated").alias("confidence"), at.alias("created_at"), at.alias("last_confirmed_at"),
            F.array().cast("array<string>").alias("source_refs"), "tags",
        )
        row = self.spark.createDataFrame([], NODES).unionByName(row, allowMissingColumns=True)
        version = self._next(profile)
        self._write_meta(profile, version, {**m, "nodes": self._nodes(profile).extend(row, m["nodes"])})
        self._publish(profile, version, version, f"add fact ({part})")
        return new_id
