"""Reconciling batches of export rows with the store.

Every batch row carries a total order (``exported_at, manifest_sha256, conversation_pos,
message_pos``), so the result does not depend on the order in which files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ordering import latest_per_key

MANIFEST_ORDER = ["exported_at", "manifest_sha256", "conversation_pos"]
MESSAGE_ORDER = [*MANIFEST_ORDER, "message_pos"]


def _oldest(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def _newest(columns: list[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


# --- manifests ------------------------------------------------------------------------


def split_new_manifests(batch: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unseen documents, and the counters of the completed runs the others repeat."""
    unique = batch.dropDuplicates(["manifest_sha256"])
    complete = runs.filter(F.col("status") == "complete")
    new = unique.join(complete.select("manifest_sha256"), "manifest_sha256", "left_anti")
    counters = ["import_run_id", "inserted_messages", "reused_messages", "present_attachments", "missing_attachments"]
    known = (
        unique.select("manifest_sha256")
        .join(complete.select("manifest_sha256", *counters), "manifest_sha256")
        .withColumn("status", F.lit("already_imported"))
    )
    return new, known


# --- messages -------------------------------------------------------------------------


def label_messages(batch: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Batch rows with ``outcome`` (inserted / reused) and ``conflict``.

    First write wins: the stored row, else the first batch row in the total order. A later
    row whose canonical content differs is a conflict and changes nothing. Both reference
    sides are unique per id, so the joins never multiply rows, and a hot id is cut to one
    row per map task before its shuffle.
    """
    slim = batch.select("message_id", *MESSAGE_ORDER, "content_sha256")
    first = latest_per_key(slim, ["message_id"], _oldest(MESSAGE_ORDER)).select(
        "message_id",
        F.struct(*MESSAGE_ORDER).alias("_first"),
        F.col("content_sha256").alias("_first_sha"),
    )
    if store is not None:
        stored = store.select("message_id", F.col("content_sha256").alias("_stored_sha"))
        first = first.join(stored, "message_id", "left")
    else:
        first = first.withColumn("_stored_sha", F.lit(None).cast("string"))
    is_first = F.col("_stored_sha").isNull() & F.struct(*MESSAGE_ORDER).eqNullSafe(F.col("_first"))
    reference = F.coalesce("_stored_sha", "_first_sha")
    return (
        batch.join(first, "message_id")
        .withColumn("outcome", F.when(is_first, F.lit("inserted")).otherwise(F.lit("reused")))
        .withColumn("conflict", F.col("content_sha256") != reference)
        .drop("_first", "_first_sha", "_stored_sha")
    )


def merge_messages(batch: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(inserted, reused, conflicts)``; nothing stored is ever changed."""
    labelled = label_messages(batch, store)
    inserted = labelled.filter("outcome = 'inserted'").drop("outcome", "conflict")
    reused = labelled.filter("outcome = 'reused'").drop("outcome", "conflict")
    return inserted, reused, message_conflicts(labelled)


def message_conflicts(labelled: DataFrame) -> DataFrame:
    return labelled.filter("outcome = 'reused' AND conflict").select(
        "manifest_sha256",
        F.lit("SOURCE_MESSAGE_CONFLICT").alias("code"),
        "message_id",
        F.col("external_message_id").alias("source_message_id"),
    )


# --- attributes -----------------------------------------------------------------------


def upsert_latest(batch: DataFrame, keys: list[str], order: list[str], store: DataFrame | None = None) -> DataFrame:
    """Last write wins: newest batch row per key, stored rows only where no batch row exists."""
    fresh = latest_per_key(batch, keys, _newest(order)).drop(*order)
    if store is None:
        return fresh
    untouched = store.join(fresh.select(*keys), keys, "left_anti")
    return fresh.unionByName(untouched, allowMissingColumns=True)


def last_activity(conversations: DataFrame, messages: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Monotone maximum of the stored, the stated and the newest message instant."""
    stated = conversations.groupBy("conversation_id").agg(F.max("explicit_last_activity").alias("_stated"))
    newest = messages.groupBy("conversation_id").agg(F.max("sent_at").alias("_newest"))
    joined = stated.join(newest, "conversation_id", "left")
    if store is None:
        return joined.select("conversation_id", F.greatest("_stated", "_newest").alias("last_activity"))
    joined = joined.join(
        store.select("conversation_id", F.col("last_activity").alias("_stored")), "conversation_id", "full"
    )
    return joined.select("conversation_id", F.greatest("_stored", "_stated", "_newest").alias("last_activity"))


def merge_conversations(
    conversations: DataFrame, messages: DataFrame, store: DataFrame | None = None
) -> DataFrame:
    """Newest attributes plus monotone last activity."""
    activity = last_activity(conversations, messages, store)
    attributes = upsert_latest(
        conversations.drop("explicit_last_activity", "participants_complete", "export_root"),
        ["conversation_id"],
        MANIFEST_ORDER,
        store.drop("last_activity") if store is not None else None,
    )
    return attributes.join(activity, "conversation_id")


# --- rosters --------------------------------------------------------------------------


def merge_roster(conversations: DataFrame, participants: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Replace-or-merge over ordered documents.

    A complete roster, even an empty one, discards everything before it, so only its position
    per conversation is needed: one aggregate and one join instead of a replay.
    """
    position = F.struct(*MANIFEST_ORDER)
    cutoff = (
        conversations.filter("participants_complete")
        .groupBy("conversation_id")
        .agg(F.max(position).alias("_cutoff"))
    )
    kept = (
        participants.join(cutoff, "conversation_id", "left")
        .filter(F.col("_cutoff").isNull() | (position >= F.col("_cutoff")))
        .drop("_cutoff")
    )
    order = [*MANIFEST_ORDER, "participant_pos"]
    columns = ["conversation_id", "identity_id", "relation_raw"]
    fresh = latest_per_key(
        kept.select(*columns, *order), ["conversation_id", "identity_id"], _newest(order)
    ).select(*columns)
    if store is None:
        return fresh
    untouched = store.join(cutoff.select("conversation_id"), "conversation_id", "left_anti").join(
        fresh.select("conversation_id", "identity_id"), ["conversation_id", "identity_id"], "left_anti"
    )
    return fresh.unionByName(untouched.select(*columns))


def merge_identities(participants: DataFrame, store: DataFrame | None = None) -> DataFrame:
    columns = ["identity_id", "source_id", "external_identity_id", "display_name", "is_self"]
    order = [*MANIFEST_ORDER, "participant_pos"]
    batch = participants.select(*columns, F.col("identity_raw").alias("raw_json"), *order)
    return upsert_latest(batch, ["identity_id"], order, store)


# --- blobs and exports ------------------------------------------------------------------


def merge_blobs(files: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """One row per content digest; copies collapse in the partial aggregate."""
    blobs = (
        files.filter(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(F.min("size_bytes").alias("size_bytes"), F.min("path").alias("stored_path"))
    )
    if store is None:
        return blobs
    return store.unionByName(blobs.join(store.select("sha256"), "sha256", "left_anti"))


def dedupe_exports(df: DataFrame, key: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """One row per key for identical copies, and the keys whose copies differ.

    Copies differ when any of two independent 64-bit digests does; bounds over numbers keep the
    aggregate in hash form and fold on the map side, however many copies a key has.
    """
    digests = [F.xxhash64(fingerprint), F.xxhash64(F.lit("second"), fingerprint)]
    sides = [f(d).alias(f"_{name}{i}") for i, d in enumerate(digests) for name, f in (("low", F.min), ("high", F.max))]
    differs = (F.col("_low0") != F.col("_high0")) | (F.col("_low1") != F.col("_high1"))
    conflicting = df.groupBy(key).agg(*sides).filter(differs).select(key)
    clean = latest_per_key(df, [key], [F.col(fingerprint).asc()]).join(conflicting, key, "left_anti")
    return clean, conflicting


# --- ledger -----------------------------------------------------------------------------


def import_warnings(conflicts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Warnings as rows, so no manifest gathers an unbounded list.

    A present body without a digest has no blob, so it is named too.
    """
    missing = attachments.filter("status = 'missing' OR (status = 'present' AND blob_sha256 IS NULL)").select(
        "manifest_sha256",
        F.when(F.col("status") == "missing", "ATTACHMENT_MISSING").otherwise("ATTACHMENT_NOT_HASHED").alias("code"),
        "message_id",
        F.lit(None).cast("string").alias("source_message_id"),
        "part_index",
        F.col("source_relative_path").alias("path"),
    )
    return conflicts.unionByName(missing, allowMissingColumns=True)


def import_run_metrics(documents: DataFrame, labelled: DataFrame, attachments: DataFrame) -> DataFrame:
    """Counters per manifest: one aggregate per grain, joined on the manifest."""
    messages = labelled.groupBy("manifest_sha256").agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted_messages"),
        F.count_if(F.col("outcome") == "reused").alias("reused_messages"),
        F.count_if((F.col("outcome") == "reused") & F.col("conflict")).alias("conflicts"),
    )
    bodies = attachments.groupBy("manifest_sha256").agg(
        F.count_if(F.col("status") == "present").alias("present_attachments"),
        F.count_if(F.col("status") == "missing").alias("missing_attachments"),
    )
    counters = ["inserted_messages", "reused_messages", "conflicts", "present_attachments", "missing_attachments"]
    return (
        documents.select("manifest_sha256")
        .distinct()
        .join(messages, "manifest_sha256", "left")
        .join(bodies, "manifest_sha256", "left")
        .select("manifest_sha256", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counters])
    )


def warning_counts(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings by code; a missing code counts as UNKNOWN."""
    return warnings.groupBy(*keys, F.coalesce("code", F.lit("UNKNOWN")).alias("code")).agg(
        F.count("*").alias("warnings")
    )


# --- resume -------------------------------------------------------------------------------

# (column, decision when the stored receipt differs from the current state), tested in order
RESUME_CHECKS = (
    ("generation_id", "REJECT_GENERATION"),
    ("fingerprint_token", "REJECT_FINGERPRINT"),
    ("configuration_sha256", "REJECT_CONFIGURATION"),
    ("manifest_sha256", "REJECT_MANIFEST"),
)


def resume_decisions(receipts: DataFrame, current: DataFrame, key: str = "output_id", schema: str | None = None) -> DataFrame:
    """Compare stored lifecycle receipts with the current state of each output.

    ``receipts`` may carry ``schema``; ``current`` carries the same check columns, its
    ``manifest_sha256`` being the digest of the export found (null when there is none).
    """
    columns = [name for name, _ in RESUME_CHECKS]
    r = receipts.select(key, F.lit(True).alias("_receipt"), *(["schema"] if schema else []), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = current.select(key, F.lit(True).alias("_current"), *columns).join(r, key, "full")
    decision = (
        F.when(F.col("_current").isNull(), F.lit("ORPHAN_RECEIPT"))
        .when(F.col("_receipt").isNull() & F.col("manifest_sha256").isNotNull(), F.lit("REJECT_UNTRUSTED_EXPORT"))
        .when(F.col("_receipt").isNull(), F.lit("NEW"))
    )
    if schema:
        decision = decision.when(~F.col("schema").eqNullSafe(F.lit(schema)), F.lit("REJECT_SCHEMA"))
    for name, rejection in RESUME_CHECKS:
        stored = F.col(f"_{name}")
        decision = decision.when(stored.isNull() | ~stored.eqNullSafe(F.col(name)), F.lit(rejection))
    return joined.select(key, decision.otherwise(F.lit("RESUME")).alias("decision"))
