"""File scans. Bodies are read only where a digest or header is asked for."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY_BYTES = 512 * 1024 * 1024
CHUNK_BYTES = 8 * 1024 * 1024


def _binary(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def relative_to(root: str, path="path"):
    """Path below ``root`` whatever scheme prefix the reader shows."""
    bare = F.regexp_replace(path, r"^[A-Za-z0-9+.-]+:/+", "/")
    local_root = re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", root).rstrip("/")
    return F.substring(bare, F.lit(len(local_root) + 2), F.length(bare))


def scan_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Path, size and modification time. The body column is pruned from the scan."""
    return _binary(spark, root, glob).select(
        "path",
        relative_to(root).alias("relative_path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def opened(path: str) -> tuple[fs.FileSystem, str] | None:
    """The store of a path and the path in it, None for a store that Python has no reader for."""
    scheme, authority, bare = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?)?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), bare
    try:
        store, _ = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    except (OSError, ValueError, NotImplementedError):
        return None
    return store, bare if scheme in ("hdfs", "viewfs") else f"{authority}{bare}"


def digest_in_chunks(path: str) -> tuple[str | None, bytes | None]:
    """sha256 and header of a body that is never in memory as a whole; nulls only where Python has no reader.

    A body that is there but cannot be read now is an error, so that the task is tried again and no digest is lost.
    """
    found = opened(path)
    if found is None:
        return None, None
    store, bare = found
    digest, header = hashlib.sha256(), None
    with store.open_input_stream(bare) as body:
        while chunk := body.read(CHUNK_BYTES):
            header = chunk[:16] if header is None else header
            digest.update(chunk)
    return digest.hexdigest(), header


def _hash_large(batches):
    for batch in batches:
        found = [digest_in_chunks(p) for p in batch.column(0).to_pylist()]
        columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.binary()))]
        yield pa.record_batch([*batch.columns, *columns], names=["path", "relative_path", "size_bytes", "sha256", "header"])


def scan_files(
    spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """Inventory plus sha256 and header.

    The length bound is pushed into the scan, so a body above ``max_bytes`` is never loaded; a Python task hashes it in
    chunks from its path. In a store that only Spark's readers can open its digest and header stay null, which an import
    reports as ATTACHMENT_NOT_HASHED.
    """
    base = _binary(spark, root, glob)
    columns = ["path", relative_to(root).alias("relative_path"), F.col("length").alias("size_bytes")]
    read = base.filter(F.col("length") <= max_bytes).select(
        *columns,
        F.sha2("content", 256).alias("sha256"),
        F.substring("content", 1, 16).alias("header"),
    )
    large = base.filter(F.col("length") > max_bytes).select(*columns)
    schema = "path string, relative_path string, size_bytes long, sha256 string, header binary"
    return read.unionByName(large.mapInArrow(_hash_large, schema))
