"""Import: documents to the normalised tables, reconciled with what is stored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import stable_id
from evidentia.operators import merge as M
from evidentia.operators.attachments import resolve_attachments
from evidentia.operators.validate import checked_documents, split_valid
from evidentia.schemas import conform, empty_table
from evidentia.session import stage
from evidentia.sources.manifests import (
    conversation_raw,
    conversation_rows,
    message_rows,
    part_rows,
    participant_rows,
    source_rows,
)
from evidentia.sources.store import Store


@dataclass
class ImportResult:
    """New store tables, the ledger of this batch, its warnings and its rejections.

    Against a ``Store``, ``tables`` are its changes instead: new rows of tables that grow, and all rows of the buckets
    that the batch touches in others. ``Store.commit`` takes them.
    """

    tables: dict[str, DataFrame]
    runs: DataFrame
    already_imported: DataFrame
    warnings: DataFrame
    problems: DataFrame


def _with(store: Mapping[str, DataFrame] | None, name: str, keys: DataFrame | None = None) -> DataFrame | None:
    """A stored table, or what of it rows with ``keys`` can meet, where the store can tell."""
    if isinstance(store, Store) and keys is not None:
        return store.touching(name, keys)
    return store.get(name) if store else None


def import_into(spark: SparkSession, root: str, documents: DataFrame, files: DataFrame, as_of: Column) -> tuple[int, ImportResult]:
    """Import a batch into the store at ``root`` as its next version, writing only what the batch touches."""
    store = Store(spark, root)
    result = import_documents(documents, files, as_of, store)
    return store.commit(result.tables), result


def import_documents(
    documents: DataFrame, files: DataFrame, as_of: Column, store: Mapping[str, DataFrame] | None = None, version: str | None = None
) -> ImportResult:
    """One batch of parsed documents against the store; ``version`` names the only schema version to take.

    Documents that are broken or known are left out first. Parsed documents and their flattened levels are written
    once to the shared folder, so that the input is read once, no later step parses JSON again and a lost executor
    costs only its own tasks. Shuffles happen only on the merge keys (message, conversation,
    identity, digest).
    """
    spark = documents.sparkSession
    runs = _with(store, "import_runs")
    if runs is None:
        runs = empty_table(spark, "import_runs")
    # the one pass over the documents: their JSON is parsed and checked, everything below reads the variants
    valid, problems = split_valid(stage(checked_documents(documents, version), "documents"))
    fresh, _ = M.split_new_manifests(valid, runs)
    # copies of a document are told by their few columns where nothing else of it is wanted
    fresh_sources, repeated = M.split_new_manifests(source_rows(valid), runs)
    sources_in = stage(fresh_sources, "sources")
    occurrences = stage(conversation_rows(fresh), "conversations")
    participants = stage(participant_rows(occurrences), "participants")
    conversations = conversation_raw(occurrences)
    stored_messages = _with(store, "messages", sources_in.select("source_id"))
    # both sides of the labels read these rows, whose texts and digests are made once
    rows = stage(message_rows(occurrences, participants), "message-rows")
    labelled = stage(M.label_messages(rows, stored_messages), "messages")
    inserted = labelled.filter("outcome = 'inserted'").drop("outcome", "conflict")
    conflicts = M.message_conflicts(labelled)

    parts = part_rows(inserted, ("manifest_sha256", "export_root"))
    bodies = parts.filter(F.col("attachment_id").isNotNull())
    attachments = stage(resolve_attachments(bodies, files), "attachments")
    ledger = M.import_run_metrics(sources_in, labelled, attachments)
    warnings = M.import_warnings(conflicts, attachments)

    source_of = sources_in.select("manifest_sha256", "source_id", "exported_at")
    new_runs = ledger.join(source_of, "manifest_sha256").select(
        "manifest_sha256",
        stable_id("imp", "manifest_sha256").alias("import_run_id"),
        "source_id",
        F.lit("complete").alias("status"),
        "inserted_messages", "reused_messages", "conflicts", "present_attachments", "missing_attachments",
        "exported_at",
        as_of.alias("finished_at"),
    )
    sources = M.upsert_latest(
        sources_in.select("source_id", "kind", "external_account_id", "display_name", "exported_at", "manifest_sha256"),
        ["source_id"], ["exported_at", "manifest_sha256"], _with(store, "sources", sources_in.select("source_id")),
    )
    message_columns = [
        "message_id", "source_id", "conversation_id", "external_message_id", "sender_identity_id",
        "sender_display_name", "sent_at", "direction", "search_body", "content_sha256", "raw_json",
    ]
    messages = inserted.select(*message_columns, stable_id("imp", "manifest_sha256").alias("import_run_id"))

    def appended(name: str, rows: DataFrame) -> DataFrame:
        old = None if isinstance(store, Store) else _with(store, name)
        return rows if old is None else old.unionByName(rows)

    part_columns = ["part_id", "message_id", "part_index", "part_type", "text_content", "attachment_id", "raw_json"]
    attachment_columns = [
        "attachment_id", "message_id", "part_index", "blob_sha256", "file_name", "mime_type",
        "source_relative_path", "status", "size_bytes", "raw_json",
    ]
    used = files.join(
        attachments.select(F.col("blob_sha256").alias("sha256")).distinct(), "sha256", "left_semi"
    )
    named = stage(conversations.select("conversation_id").distinct(), "conversation-ids")
    people = participants.select("identity_id").distinct()
    bodies_used = used.select("sha256").distinct()
    tables = {
        "sources": sources,
        "import_runs": appended("import_runs", new_runs),
        "identities": M.merge_identities(participants, _with(store, "identities", people)),
        "conversations": M.merge_conversations(conversations, labelled, _with(store, "conversations", named)),
        "participants": M.merge_roster(conversations, participants, _with(store, "participants", named)),
        "messages": appended("messages", messages),
        "parts": appended("parts", parts.select(*part_columns)),
        "attachments": appended("attachments", attachments.select(*attachment_columns)),
        "blobs": M.merge_blobs(used, _with(store, "blobs", bodies_used)),
    }
    tables = {name: conform(df, name) for name, df in tables.items()}
    return ImportResult(tables, new_runs, repeated, warnings, problems)
