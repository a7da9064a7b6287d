"""Small files through Hadoop's file systems, so that any path Spark reads will do."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


class Files:
    """Metadata-sized reads and writes; data go through DataFrames."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        """Bytes of a file; -1 if there is none."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen() if fs.exists(p) and fs.getFileStatus(p).isFile() else -1

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    @contextmanager
    def opened(self, path: str):
        """A stream of the JVM that writes a file."""
        fs, p = self._at(path)
        fs.setWriteChecksum(False)  # no hidden files beside those that people see
        try:
            out = fs.create(p, True)
            try:
                yield out
            finally:
                out.close()
        finally:
            fs.setWriteChecksum(True)

    def write(self, path: str, data: bytes) -> None:
        with self.opened(path) as out:
            out.write(bytearray(data))

    def copy(self, piece: tuple[str, int, int], out) -> None:
        """Append a range of a file (path, place, number of bytes) to a stream, a buffer at a time."""
        path, start, size = piece
        with self.reading(path) as stream:
            stream.seek(start)
            self.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)

    def sha256(self, path: str) -> str:
        """The hash of a file, a buffer at a time."""
        digest = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        with self.reading(path) as stream:
            self.jvm.org.apache.commons.io.IOUtils.copyLarge(self.jvm.java.security.DigestInputStream(stream, digest), self.jvm.java.io.OutputStream.nullOutputStream())
        return bytes(digest.digest()).hex()

    @contextmanager
    def reading(self, path: str):
        """A stream of the JVM that reads a file."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            yield stream
        finally:
            stream.close()

    def read(self, path: str) -> bytes:
        with self.reading(path) as stream:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))

    def move(self, source: str, dest: str) -> None:
        fs, p = self._at(source)
        _, q = self._at(dest)
        if not fs.rename(p, q):
            raise OSError(f"can't move {source} to {dest}")
