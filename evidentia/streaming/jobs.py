"""Streaming jobs.

Each micro-batch writes under its own batch number and reads the state of the newest batch
before it, so a replayed batch overwrites itself and every result appears once. The state lives
in the shared folder; no job depends on a surviving executor.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from evidentia.operators import collector, rules
from evidentia.schemas import empty_table
from evidentia.session import stage
from evidentia.sources.manifests import parse_documents
from evidentia.sources.store import Store


def stream_manifests(spark: SparkSession, path: str, glob: str = "*.json", files_per_trigger: int = 1000) -> DataFrame:
    """New export documents as they appear, parsed like the batch scan."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return parse_documents(raw)


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, continuous: str | None = None
) -> StreamingQuery:
    """Drain what is there, or keep running with ``continuous`` as the trigger interval."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def batch_path(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


def read_batches(spark: SparkSession, root: str, schema, before: int | None = None) -> DataFrame:
    """All batches written so far, or only those before a batch number."""
    try:
        df = spark.read.schema(schema).option("basePath", root).parquet(root)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if before is not None:
        df = df.filter(F.col("batch") < before)
    return df


# --- rule scan --------------------------------------------------------------------------


def stream_scan(
    messages: DataFrame, rule: rules.Rule, root: str, checkpoint: str, continuous: str | None = None, folders: int = 8
) -> StreamingQuery:
    """Scan each arriving message once per rule, into the store at ``root``.

    Old and late messages are scanned like new ones: what counts is the state by message id, not a time cursor. The
    state is the store's own table, dealt over buckets of the id: a batch reads the buckets of its ids, adds its rows to
    them, and makes one folder of a bucket that has gathered more than ``folders``. So nothing is kept beside the table,
    each id is there once, and a batch costs what it brings. Candidates and evidence are merged within the buckets that
    the batch touches. One commit holds all four tables and the batch's name, so a replayed batch changes nothing.
    ``messages`` carry ``message_id, sent_at, body``.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, root)
        stream = spark.read.text(f"{checkpoint}/metadata").first()[0]
        tag = f"{rule.id} {stream} {number}"
        if store.has(tag):
            return
        arrived = stage(batch.dropDuplicates(["message_id"]), "scan-arrived")
        known = store.touching("scan_state", arrived.select("message_id"))
        fresh = arrived if known is None else rules.select_unscanned(arrived, known, rule.id)
        scanned = stage(rules.match_rules(fresh, rule).drop("body"), "scan-matched")
        as_of, run_id = F.lit(datetime.now(timezone.utc)), f"{rule.id}-stream-{number}"
        states = rules.scan_state_rows(scanned, rule, as_of, run_id)
        progress = scanned.agg(F.count("*").alias("scanned_messages")).select(
            "scanned_messages", F.lit(0).cast("long").alias("remaining_messages"), F.lit("complete").alias("status")
        )
        candidates, evidence = rules.candidate_rows(scanned, rule, as_of), rules.evidence_rows(scanned)
        ids = candidates.select("candidate_id")
        changes = {
            "scan_state": states,
            "candidates": rules.merge_candidates(_or_empty(store, "candidates", ids), candidates),
            "evidence": rules.merge_evidence(_or_empty(store, "evidence", ids), evidence),
            "monitor_runs": rules.monitor_run(states, progress, rule, as_of, run_id),
        }
        store.commit(changes, tag)
        Store(spark, root).tidy("scan_state", folders)

    return run_batches(messages, each, checkpoint, continuous)


def _or_empty(store: Store, name: str, keys: DataFrame) -> DataFrame:
    found = store.touching(name, keys)
    return empty_table(store.spark, name) if found is None else found


# --- debounce -----------------------------------------------------------------------------


def stream_quiet_captures(
    changes: DataFrame, quiet_seconds: int, lateness: str, out: str, checkpoint: str, continuous: str | None = None
) -> StreamingQuery:
    """Bursts that ended, emitted once the watermark has passed their quiet time."""
    bursts = collector.quiet_captures(changes.withWatermark("changed_at", lateness), quiet_seconds)
    writer = bursts.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


# --- watermarks ---------------------------------------------------------------------------


def stream_watermarks(messages: DataFrame, out: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Rows, highest id and newest instant per stream, partial aggregates per batch.

    Each batch writes its own partial watermarks; ``fold_watermarks`` adds them up.
    """
    from evidentia.operators.snapshots import stream_watermarks as watermarks

    def each(batch: DataFrame, number: int) -> None:
        watermarks(batch).write.mode("overwrite").parquet(batch_path(out, number))

    return run_batches(messages, each, checkpoint, continuous)


def fold_watermarks(partials: DataFrame) -> DataFrame:
    return partials.groupBy("stream_id").agg(
        F.sum("rows").alias("rows"),
        F.max("max_local_id").alias("max_local_id"),
        F.max("max_create_time").alias("max_create_time"),
    )
