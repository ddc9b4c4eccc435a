"""Declared columns of the normalised store, by table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "sources": "source_id string, kind string, external_account_id string, display_name string",
    "import_runs": (
        "manifest_sha256 string, import_run_id string, source_id string, status string, inserted_messages long, "
        "reused_messages long, conflicts long, present_attachments long, missing_attachments long, "
        "exported_at timestamp, finished_at timestamp"
    ),
    "identities": (
        "identity_id string, source_id string, external_identity_id string, display_name string, is_self boolean, raw_json string"
    ),
    "conversations": (
        "conversation_id string, source_id string, external_conversation_id string, title string, "
        "conversation_type string, last_activity timestamp, raw_json string"
    ),
    "participants": "conversation_id string, identity_id string, relation_raw string",
    "messages": (
        "message_id string, source_id string, conversation_id string, external_message_id string, "
        "sender_identity_id string, sender_display_name string, sent_at timestamp, direction string, "
        "search_body string, content_sha256 string, raw_json string, import_run_id string"
    ),
    "parts": (
        "part_id string, message_id string, part_index long, part_type string, text_content string, "
        "attachment_id string, raw_json string"
    ),
    "attachments": (
        "attachment_id string, message_id string, part_index long, blob_sha256 string, file_name string, "
        "mime_type string, source_relative_path string, status string, size_bytes long, raw_json string"
    ),
    "blobs": "sha256 string, size_bytes long, stored_path string",
    "derived_artifacts": (
        "artifact_id string, scope_type string, scope_id string, artifact_type string, content string, "
        "provenance_json string, created_at timestamp"
    ),
    "monitor_rules": "rule_id string, name string, rule_version string, enabled boolean, definition_json string",
    "monitor_runs": (
        "monitor_run_id string, rule_id string, started_at timestamp, finished_at timestamp, status string, "
        "scanned_messages long, candidate_count long, remaining_messages long"
    ),
    "candidates": (
        "candidate_id string, rule_id string, event_type string, title string, review_status string, "
        "first_seen_at timestamp, last_seen_at timestamp, event_at timestamp, deadline_at timestamp, "
        "time_uncertain boolean, importance string, dedup_key string, rationale_json string"
    ),
    "evidence": "candidate_id string, message_id string, evidence_role string, evidence_order long",
    "scan_state": "rule_id string, message_id string, scanned_at timestamp, matched boolean, monitor_run_id string",
    "heartbeats": (
        "detector_id string, source_kind string, external_account_id string, observation_scope string, state string, "
        "worker_heartbeat_at timestamp, source_observed_at timestamp, last_change_at timestamp, source_token string, "
        "consecutive_failures long, next_retry_at timestamp, error_code string, stale_after_seconds double, "
        "last_generation_id string, last_import_at timestamp"
    ),
    "collector_events": (
        "detector_id string, occurred_at timestamp, state string, observation_scope string, source_token string, "
        "error_code string"
    ),
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in order; columns that an older writer did not know become null."""
    fields = empty_table(df.sparkSession, name).schema.fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )
