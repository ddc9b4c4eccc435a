"""The normalised store: a log of committed file sets over Parquet folders that are never written twice.

A commit adds folders and then one entry of the log for each table it changed. Tables that only grow get a folder of
new rows. Tables whose rows change are dealt over buckets by the hash of a key, and a commit writes only the buckets
that it touched; the newest folder of a bucket holds its rows. A growing table that is looked up by a key is dealt over
buckets as well: each of them has the folders of all commits that added to it, and ``tidy`` makes one of them where
they are many. Readers list nothing but the folders of the entries up
to their version, and read them with declared columns, so no footers are compared and a column that an older writer
did not know is null.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evidentia.schemas import TABLES, conform, empty_table

# tables are sorted by these columns inside each file, so row-group statistics prune reads
CLUSTERING = {
    "messages": ["source_id", "conversation_id", "sent_at"],
    "parts": ["message_id"],
    "attachments": ["message_id"],
    "participants": ["conversation_id"],
}

#: Tables that are dealt over buckets, by the column whose hash is a row's bucket.
BUCKETED = {
    "sources": "source_id",
    "identities": "identity_id",
    "conversations": "conversation_id",
    "participants": "conversation_id",
    "blobs": "sha256",
    "candidates": "candidate_id",
    "evidence": "candidate_id",
    "heartbeats": "detector_id",
    "scan_state": "message_id",
}
#: Of these, the ones that only grow; a commit adds to their buckets and replaces none.
GROWING = {"scan_state"}
BUCKETS = 64
#: Values up to which a read of a growing table is narrowed by a list that reaches the row-group statistics.
LISTED = 1000

LOG = "version long, tag string, name string, action string, folder string, buckets int, touched array<int>, filled array<int>, committed_at timestamp"


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first; nothing of this commit is visible."""


def committed_versions(spark: SparkSession, root: str) -> DataFrame | None:
    """The log, or None for a folder without commits."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/_commits")
    except AnalysisException:
        return None


def current_version(spark: SparkSession, root: str) -> int:
    """Newest committed version, 0 for an empty store."""
    log = committed_versions(spark, root)
    return 0 if log is None else (log.agg(F.max("version")).first()[0] or 0)


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store(Mapping):
    """The tables of one version. ``store[name]`` is a whole table, ``touching`` the part that a batch can change."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root
        self.version = current_version(spark, root) if version is None else version
        #: Buckets that ``touching`` has read, by table: a commit replaces them even where no row is left.
        self.touched: dict[str, set[int]] = {}
        self._entries: dict[str, list] = {}
        log = committed_versions(spark, root) if self.version else None
        if log is not None:
            log = log.filter(F.col("version") <= self.version)
            # a whole table replaces what was committed before it
            since = log.filter("action = 'whole'").groupBy("name").agg(F.max("version").alias("since"))
            rows = log.join(since, "name", "left").filter("since IS NULL OR version >= since").orderBy("version").collect()
            for row in rows:
                self._entries.setdefault(row["name"], []).append(row)

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def __contains__(self, name: object) -> bool:
        return name in self._entries

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._entries:
            raise KeyError(name)
        return self._read(name)

    def buckets(self, name: str) -> int:
        """How many buckets a table has; set by the newest commit of the whole table."""
        return self._entries[name][0]["buckets"] if name in self._entries else BUCKETS

    def folders(self, name: str, buckets: set[int] | None = None) -> list[str]:
        """Folders that hold the table, or only ``buckets`` of it."""
        at = f"{self.root}/{name}"
        if name not in BUCKETED:
            return [f"{at}/{e['folder']}" for e in self._entries.get(name, [])]
        layers = self.layers(name)
        wanted = sorted(b for b in layers if buckets is None or b in buckets)
        return [f"{at}/{folder}/bucket={b}" for b in wanted for folder in layers[b]]

    def layers(self, name: str) -> dict[int, list[str]]:
        """The folders that hold the rows of each bucket, oldest first."""
        found: dict[int, list[str]] = {}
        for entry in self._entries.get(name, []):
            filled = set(entry["filled"])
            for bucket in entry["touched"]:
                before = found.get(bucket, []) if entry["action"] == "append" else []
                found[bucket] = [*before, entry["folder"]] if bucket in filled else before
        return {bucket: folders for bucket, folders in found.items() if folders}

    def has(self, tag: str) -> bool:
        """Whether some commit carried ``tag``."""
        log = committed_versions(self.spark, self.root)
        return log is not None and not log.filter((F.col("tag") == tag) & (F.col("version") <= self.version)).isEmpty()

    def _read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        folders = self.folders(name, buckets)
        if not folders:
            return empty_table(self.spark, name)
        return self.spark.read.schema(TABLES[name]).parquet(*folders)

    def touching(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The stored rows that rows with ``keys`` (one column of the table) can meet, None without the table.

        Of a bucketed table these are the buckets of the keys. A growing table is narrowed by the values themselves
        where they are few, by which its sorted files are skipped.
        """
        if name not in self._entries:
            return None
        column = keys.columns[0]
        if BUCKETED.get(name) == column:
            rows = keys.select(bucket_of(column, self.buckets(name)).alias("bucket")).distinct().collect()
            found = {r["bucket"] for r in rows}
            self.touched[name] = self.touched.get(name, set()) | found
            return self._read(name, found)
        values = [r[0] for r in keys.distinct().limit(LISTED + 1).collect()]
        return self[name] if len(values) > LISTED else self[name].filter(F.col(column).isin(values))

    def commit(self, changes: Mapping[str, DataFrame], tag: str | None = None) -> int:
        """Add ``changes`` as the next version: new rows of growing tables, all rows of the touched buckets of others.

        The buckets of a table that ``touching`` has read are replaced, and so are those of the changed rows. ``tag``
        names the work that the commit does, so that a repetition of it can tell.
        """
        grow = {n for n in changes if n not in BUCKETED or n in GROWING}
        sets = {n: set() if n in grow else self.touched.get(n, set()) for n in changes}
        return _commit(self.spark, self.root, changes, self.version + 1, {n: self.buckets(n) for n in changes}, sets, grow, tag)

    def tidy(self, name: str, most: int = 8) -> int | None:
        """Make one folder of each bucket that has more than ``most``; the new version, None where there is nothing to do.

        A row is written again once in ``most`` commits that touch its bucket, and no read opens more than ``most`` + 1
        folders of a bucket.
        """
        long = {b for b, folders in self.layers(name).items() if len(folders) > most}
        if not long:
            return None
        rows = self._read(name, long)
        return _commit(self.spark, self.root, {name: rows}, self.version + 1, {name: self.buckets(name)}, {name: long}, set(), None)

    def compact(self, names: list[str] | None = None, buckets: int | None = None) -> int:
        """Write tables whole again, so that many small folders become one; ``buckets`` changes how they are dealt."""
        tables = {name: self[name] for name in names or list(self)}
        return _commit(self.spark, self.root, tables, self.version + 1, {n: buckets or self.buckets(n) for n in tables}, None)


def _commit(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame],
    version: int,
    buckets: dict[str, int],
    touched: dict[str, set[int]] | None,
    grow: set[str] = frozenset(),
    tag: str | None = None,
) -> int:
    """Write the folders, then the log entry that makes them visible; ``touched`` is None for whole tables."""
    entries = []
    for name, df in tables.items():
        folder = f"v={version}-{uuid.uuid4().hex[:12]}"
        filled = _write(conform(df, name), name, f"{root}/{name}/{folder}", buckets[name])
        replaced = filled if touched is None else sorted({*filled, *touched[name]})
        if touched is None and name in BUCKETED:
            replaced = list(range(buckets[name]))
        action = "whole" if touched is None else "append" if name in grow else "change"
        entries.append((tag, name, action, folder, buckets[name], replaced, filled))
    log = spark.createDataFrame(entries, "tag string, name string, action string, folder string, buckets int, touched array<int>, filled array<int>")
    log = log.withColumn("committed_at", F.current_timestamp()).coalesce(1)
    try:
        log.write.mode("errorifexists").parquet(f"{root}/_commits/version={version}")
    except AnalysisException as error:
        raise ConcurrentCommit(f"version {version} of {root} is committed already") from error
    return version


def _write(df: DataFrame, name: str, path: str, buckets: int) -> list[int]:
    """Write one folder and name the buckets that have files; a large bucket is split over several tasks."""
    order = [c for c in CLUSTERING.get(name, []) if c in df.columns]
    if name not in BUCKETED:
        (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
        return []
    rows = df.withColumn("bucket", bucket_of(BUCKETED[name], buckets)).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
    files = df.sparkSession.read.schema("bucket int").parquet(path).inputFiles()
    return sorted({int(m.group(1)) for f in files if (m := re.search(r"/bucket=(\d+)/", f))})


def write_store(tables: dict[str, DataFrame], root: str, version: int | None = None, buckets: int = BUCKETS) -> int:
    """Commit whole tables as one version; what they held before stays readable under the versions before.

    Readers see the old version until the log entry exists, so a failed job leaves no partial import.
    """
    spark = next(iter(tables.values())).sparkSession
    target = version or current_version(spark, root) + 1
    return _commit(spark, root, tables, target, dict.fromkeys(tables, buckets), None)


def read_store(spark: SparkSession, root: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    """Tables of a version, with their declared columns."""
    store = Store(spark, root, version)
    return {name: store[name] for name in names}
