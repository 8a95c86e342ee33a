"""Files and archives as rows."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import parts

#: Fixed value: a larger document is not converted.
MAX_DOCUMENT = 10 * 1024 * 1024


def files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of a folder's files at any depth; hidden ones are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).where(~F.col("path").rlike(r"/\.[^/]")).select("path", "length", "content")


def safe(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


def entries(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(inner path, content) of a zip, tar or gzipped tar; folders and paths that lead out are left out."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir() and safe(i.filename):
                    yield i.filename, z.read(i)
    elif name.lower().endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and safe(m.name):
                    yield m.name, t.extractfile(m).read()
    elif name.lower().endswith(".gz"):
        yield name.rsplit("/", 1)[-1][:-3], gzip.decompress(data)


def unpacked(archives: DataFrame) -> DataFrame:
    """(path, length, content) of all entries of archives (path, content); an entry's path is the archive's, a slash and its own. One row leaves at a time."""

    def run(batches):
        for b in parts(batches, 1, None):
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for inner, body in entries(path, data):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{inner}"]), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())], names=["path", "length", "content"])
                except (zipfile.BadZipFile, tarfile.TarError, OSError):
                    continue  # a damaged archive has no entries

    return archives.select("path", "content").mapInArrow(run, "path string, length long, content binary")


def member(archives: DataFrame, virtual: str) -> DataFrame:
    """The one entry that ``archive/inner`` names."""
    return unpacked(archives.where(F.lit(virtual).startswith(F.concat("path", F.lit("/"))))).where(F.col("path") == virtual)


def root_archives(responses: DataFrame) -> DataFrame:
    """Of responses (path: the address, content, mime) those that are archives, by type or by the ending of the address."""
    typed = F.col("mime").isin("application/zip", "application/x-zip-compressed", "application/x-tar", "application/gzip", "application/x-gzip")
    return responses.where(typed | F.lower(F.regexp_replace("path", r"[?#].*$", "")).rlike(r"\.(?:zip|tar|tgz|tar\.gz)$")).select("path", "content")
