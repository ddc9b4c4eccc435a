"""Group-chat exports: one JSON document per chat with messages and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import blank_to_null
from evidentia.operators.content import parts_from_resources
from evidentia.operators.merge import dedupe_exports
from evidentia.operators.resolve import classify_direction
from evidentia.operators.validate import ordered_window

DOCUMENT_SCHEMA = "chatInfo variant, messages array<variant>"


def _id(variant: str, path: str) -> Column:
    """Identifiers may be given as text or number."""
    return blank_to_null(F.try_variant_get(variant, path, "string"))


def parse_group_exports(raw: DataFrame) -> DataFrame:
    """``path, content`` to one row per document with its chat facts."""
    doc = raw.select("path", F.from_json(F.col("content").cast("string"), DOCUMENT_SCHEMA).alias("doc"))
    peer = F.coalesce(_id("doc.chatInfo", "$.peerUid"), _id("doc.chatInfo", "$.peerUin"))
    return doc.select(
        "path",
        F.regexp_replace("path", r"/[^/]*$", "").alias("export_root"),
        F.try_variant_get("doc.chatInfo", "$.type", "string").alias("chat_type"),
        F.try_variant_get("doc.chatInfo", "$.name", "string").alias("title"),
        _id("doc.chatInfo", "$.peerUid").alias("peer_uid"),
        _id("doc.chatInfo", "$.peerUin").alias("peer_uin"),
        F.concat(F.lit("group:"), peer).alias("external_conversation_id"),
        F.array_sort(
            F.array_compact(F.array(_id("doc.chatInfo", "$.selfUid"), _id("doc.chatInfo", "$.selfUin")))
        ).alias("self_ids"),
        _id("doc.chatInfo", "$.selfName").alias("self_name"),
        F.to_json("doc.chatInfo").alias("chat_info"),
        F.try_variant_get("doc.chatInfo", "$.participantCount", "long").alias("participant_count"),
        F.col("doc.messages").alias("messages"),
    )


def read_group_exports(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return parse_group_exports(raw)


def export_problems(documents: DataFrame) -> DataFrame:
    """Documents that cannot be used: not a group chat, no stable id, no messages."""
    problem = (
        F.when(~F.coalesce(F.col("chat_type") == "group", F.lit(False)), "not_a_group_export")
        .when(F.col("external_conversation_id").isNull(), "no_stable_group_id")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "title_missing")
        .when(F.col("messages").isNull(), "messages_not_array")
    )
    return documents.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def group_messages(documents: DataFrame, since=None, until=None) -> DataFrame:
    """Message rows inside the half-open window, with direction, parts and fingerprint."""
    ordered_window(since, until)
    rows = documents.select(
        "path", "external_conversation_id", "title", "self_ids", "export_root", F.explode("messages").alias("m")
    )
    resources = F.transform(
        F.try_variant_get("m", "$.content.resources", "array<variant>"),
        lambda r: F.struct(
            F.try_variant_get(r, "$.type", "string").alias("type"),
            F.try_variant_get(r, "$.filename", "string").alias("filename"),
            F.try_variant_get(r, "$.localPath", "string").alias("localPath"),
            F.to_json(r).alias("raw"),
        ),
    )
    uid, uin = _id("m", "$.sender.uid"), _id("m", "$.sender.uin")
    flat = rows.select(
        "path",
        "external_conversation_id",
        "title",
        "self_ids",
        "export_root",
        F.concat("external_conversation_id", F.lit(":"), F.try_variant_get("m", "$.id", "string")).alias(
            "external_message_id"
        ),
        F.timestamp_millis(F.try_variant_get("m", "$.timestamp", "long")).alias("sent_at"),
        F.coalesce(uid, uin).alias("sender_id"),
        F.array_compact(F.array(uid, uin)).alias("sender_ids"),
        F.try_variant_get("m", "$.sender.name", "string").alias("sender_name"),
        F.coalesce(F.try_variant_get("m", "$.system", "boolean"), F.lit(False)).alias("is_system"),
        F.try_variant_get("m", "$.content.text", "string").alias("text"),
        resources.alias("resources"),
        F.to_json("m").alias("raw_json"),
    )
    if since is not None:
        flat = flat.filter(F.col("sent_at") >= F.lit(since))
    if until is not None:
        flat = flat.filter(F.col("sent_at") < F.lit(until))
    directed = classify_direction(flat, "aliases", "sender_ids", "self_ids", "is_system")
    built = parts_from_resources(directed)
    return built.withColumn("fingerprint", F.sha2("raw_json", 256)).drop("resources", "text")


def dedupe_group_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical repeats across files collapse; ids with differing content are returned apart."""
    return dedupe_exports(messages, "external_message_id", "fingerprint")
