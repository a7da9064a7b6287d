"""Portable packs: a directory or archive of JSON parts, a style card and a manifest of hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..operators.revisions import REQUIRED, verify
from ..schema import FORMAT_VERSION, LEDGER, NODE_FIELDS, NODE_JSON, NODES, PARTS, with_node_defaults
from .arrays import array_members
from .files import Files
from .scratch import new_table_path

#: Names in the portable format.
MANIFEST, STYLE, ARCHIVE_SUFFIX = "mempack.json", "style.md", ".mempack"
#: Bytes of a file that a task may hold.
WHOLE_FILE = 1 << 26


class IntegrityError(Exception):
    pass


@dataclass
class Pack:
    """Nodes (with ``part, ord``), style card, ledger of conversations (``conv_id, digest``), and the manifest's other fields."""

    nodes: DataFrame
    style: str = ""
    ledger: DataFrame | None = None
    source_models: list[str] = field(default_factory=list)
    created_at: str | None = None

    def __post_init__(self) -> None:
        if self.ledger is None:
            self.ledger = self.nodes.sparkSession.createDataFrame([], LEDGER)

    @classmethod
    def empty(cls, spark: SparkSession) -> Pack:
        return cls(spark.createDataFrame([], NODES))


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _pieces(files: Files, folder: str, start: int, size: int) -> list[tuple[str, int, int]]:
    """Where bytes of the text lie that Spark wrote into a folder: files in order, each with a place and a number of bytes."""
    out, at = [], 0
    for path in (f"{folder}/{n}" for n in files.names(folder) if n.startswith("part-")):
        length = files.size(path)
        a, z = max(start, at), min(start + size, at + length)
        if a < z:
            out.append((path, a - at, z - a))
        at += length
    return out


def _bytes(line: Column, separator: str) -> Column:
    return F.coalesce(F.sum(F.octet_length(line) + len(separator)), F.lit(0))


def _contents(pack: Pack, raw: dict[str, bytes] | DataFrame | None, scratch: str) -> dict[str, list]:
    """Each file of a pack but the manifest as bytes and pieces of files, which tasks write under ``scratch``."""
    files, between = Files(pack.nodes.sparkSession), ",\n"
    stamped = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if c.endswith("_at") else F.col(c) for c in NODE_FIELDS]
    lines = pack.nodes.select("part", "ord", F.to_json(F.struct(*stamped), {"ignoreNullFields": "false"}).alias("value"))
    sizes = {r["part"]: r["n"] for r in lines.groupBy("part").agg(_bytes(F.col("value"), between).alias("n")).collect()}
    out: dict[str, list] = {}
    for p in PARTS:
        lines.where(F.col("part") == p).orderBy("ord").select("value").write.option("lineSep", between).text(f"{scratch}/{p}")
        out[f"{p}.json"] = [b"[\n", *_pieces(files, f"{scratch}/{p}", 0, sizes.get(p, 0) - len(between)), b"\n]"]
    out[STYLE] = [pack.style.encode()]
    if not isinstance(raw, DataFrame):
        return out | {f"raw/{k}": [v] for k, v in sorted((raw or {}).items())}
    # all files in one text, in order, so each is a range of its bytes
    kept = raw.select("file", "n", F.coalesce("line", F.lit("")).alias("value"))
    kept.orderBy("file", "n").select("value").write.text(f"{scratch}/raw")
    start = 0
    for r in kept.groupBy("file").agg(_bytes(F.col("value"), "\n").alias("n")).orderBy("file").collect():
        out[f"raw/{r['file']}"] = _pieces(files, f"{scratch}/raw", start, r["n"])
        start += r["n"]
    return out


def _write(pack: Pack, raw: dict[str, bytes] | DataFrame | None, scratch: str, entry: Callable) -> None:
    """Write a pack's files one after another, the manifest last; ``entry`` opens the stream of a name.

    The format has one file for each part, whose hash is one pass.  Tasks make the text; here its bytes are only copied and hashed, a buffer at a time.
    """
    spark = pack.nodes.sparkSession
    files, jvm, hashes = Files(spark), spark.sparkContext._jvm, {}
    try:
        for name, content in _contents(pack, raw, scratch).items():
            with entry(name) as out:
                digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
                hashing = jvm.java.security.DigestOutputStream(out, digest)
                for piece in content:
                    if isinstance(piece, bytes):
                        hashing.write(bytearray(piece))
                    else:
                        files.copy(piece, hashing)
                hashing.flush()
                hashes[name] = bytes(digest.digest()).hex()
        manifest = {
            "format_version": FORMAT_VERSION, "created_at": pack.created_at or now(), "updated_at": now(), "source_models": pack.source_models,
            "generator": "memspool", "content_hashes": hashes, "extracted": {r["conv_id"]: r["digest"] for r in pack.ledger.orderBy("conv_id").toLocalIterator()},
        }
        with entry(MANIFEST) as out:
            out.write(bytearray(json.dumps(manifest, indent=2).encode()))
    finally:
        files.delete(scratch)


def save_pack(pack: Pack, path: str, raw: dict[str, bytes] | DataFrame | None = None) -> None:
    """Write a pack as a directory; raw files come as bytes, or as a table of lines (``file, n, line``)."""
    spark = pack.nodes.sparkSession
    _write(pack, raw, new_table_path(spark, "pack-pieces"), lambda name: Files(spark).opened(f"{path}/{name}"))


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark).read(f"{path}/{MANIFEST}"))


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """``path, sha256`` of the files of a pack as they are.

    Tasks hash files of up to ``whole`` bytes.  The hash of a larger one can't be divided, and no task may hold it: its bytes pass a buffer of the driver, as they did when it was written.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = [r["path"] for r in listed.where(F.col("length") > whole).select("path").collect()]
    with ThreadPool(4) as pool:
        hashes = pool.map(Files(spark).sha256, large)
    found = listed.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"))
    if large:
        found = found.unionByName(spark.createDataFrame(list(zip(large, hashes)), "path string, sha256 string"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    inside = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return found.select(F.substring(inside, len(root) + 2, 10_000).alias("path"), "sha256")


def pack_errors(spark: SparkSession, path: str) -> list[str]:
    """What doesn't verify; an unreadable manifest is one error."""
    try:
        hashes = list(_manifest(spark, path)["content_hashes"].items())
    except Exception as e:  # of the JVM, JSON or a missing key
        return [f"{MANIFEST} unreadable: {str(e).splitlines()[0]}"]
    listed = spark.createDataFrame(hashes, "path string, sha256 string")
    found, files = file_hashes(spark, path), Files(spark)
    # scans leave out empty files
    if empty := [(n, hashlib.sha256().hexdigest()) for n, _ in hashes if ".." not in n.split("/") and files.size(f"{path}/{n}") == 0]:
        found = found.unionByName(spark.createDataFrame(empty, "path string, sha256 string"))
    return [f"{r['path']}: {r['error']}" for r in verify(listed, found, REQUIRED).orderBy("path").collect()]


def load_pack(spark: SparkSession, path: str, check: bool = True) -> Pack:
    """A pack from a directory; unless ``check`` is off, its hashes must hold and its major version be known."""
    if check and (errors := pack_errors(spark, path)):
        raise IntegrityError("; ".join(errors))
    m = _manifest(spark, path)
    if str(m.get("format_version", FORMAT_VERSION)).split(".")[0] != FORMAT_VERSION.split(".")[0]:
        raise IntegrityError(f"unknown format version {m['format_version']}")
    members = array_members(spark, [f"{path}/{p}.json" for p in PARTS])
    part = F.regexp_extract("file", r"([^/]*)\.json$", 1)
    parts = members.select(part.alias("part"), F.col("idx").cast("long").alias("ord"), F.from_json("item", NODE_JSON, {"mode": "FAILFAST"}).alias("n")).select("part", "ord", "n.*")
    style = Files(spark).read(f"{path}/{STYLE}").decode()
    ledger = spark.createDataFrame(list((m.get("extracted") or {}).items()), LEDGER)
    return Pack(with_node_defaults(parts, F.current_timestamp()), style, ledger, m.get("source_models") or [], m.get("created_at"))


def sanitized(pack: Pack) -> Pack:
    """Texts and style neutralized.  Quotes are too, as they reach prompts."""
    spark = pack.nodes.sparkSession
    style = spark.range(1).select(sanitize(F.lit(pack.style)).alias("s")).first()["s"]
    nodes = pack.nodes.withColumns({"text": sanitize("text"), "quote": sanitize("quote")})
    return Pack(nodes, style, pack.ledger, pack.source_models, pack.created_at)


def export_archive(pack: Pack, dest: str, raw: dict[str, bytes] | DataFrame | None = None) -> str:
    """Zip a pack; the suffix is made the format's."""
    if not dest.endswith(ARCHIVE_SUFFIX):
        head, _, tail = dest.rpartition("/")
        dest = (head + "/" if head else "") + tail.rsplit(".", 1)[0] + ARCHIVE_SUFFIX
    spark = pack.nodes.sparkSession
    zipped = spark.sparkContext._jvm.java.util.zip
    with Files(spark).opened(dest) as out:
        archive = zipped.ZipOutputStream(out)
        archive.setLevel(zipped.Deflater.BEST_SPEED)  # one stream packs all

        @contextmanager
        def entry(name):
            archive.putNextEntry(zipped.ZipEntry(name))
            yield archive
            archive.closeEntry()

        _write(pack, raw, new_table_path(spark, "pack-pieces"), entry)
        archive.finish()
    return dest


def unpack_archive(spark: SparkSession, source: str, into: str) -> str:
    """Write an archive's files under ``into``; names that leave it are refused."""
    files, jvm = Files(spark), spark.sparkContext._jvm
    with files.reading(source) as stream:
        archive, found = jvm.java.util.zip.ZipInputStream(stream), False
        while (entry := archive.getNextEntry()) is not None:
            name, found = entry.getName(), True
            if entry.isDirectory():
                continue
            if name.startswith("/") or ".." in name.split("/"):
                raise IntegrityError(f"{name}: outside the pack")
            with files.opened(f"{into}/{name}") as out:
                jvm.org.apache.commons.io.IOUtils.copyLarge(archive, out)
    if not found:
        raise IntegrityError(f"{source}: no archive")
    return into
