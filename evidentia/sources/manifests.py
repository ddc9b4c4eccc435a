"""Nested export documents: scan, flatten, write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.constants import TEXT_PART_TYPES, UNKNOWN_FILE, UNKNOWN_SENDER
from evidentia.functions import base_name, canonical_json, json_keys_without, parse_instant, stable_id
from evidentia.operators.ordering import ranked_in_slices

# Conversations stay separate variants: one document may hold many, and each is bounded alone.
DOCUMENT_SCHEMA = "schema_version variant, source variant, exported_at variant, conversations array<variant>"

ORDER = ["exported_at", "manifest_sha256", "conversation_pos"]


def _text(variant: str | Column, field: str) -> Column:
    return F.try_variant_get(variant, f"$.{field}", "string")


def parse_documents(raw: DataFrame) -> DataFrame:
    """From ``path, content`` (bytes or text) to one parsed row per document."""
    body = F.col("content").cast("string")
    return raw.select(
        F.sha2("content", 256).alias("manifest_sha256"),
        F.col("path").alias("manifest_path"),
        F.regexp_replace("path", r"/[^/]*$", "").alias("export_root"),
        F.from_json(body, DOCUMENT_SCHEMA).alias("doc"),
        body.alias("body"),
    ).withColumn("exported_at", parse_instant(F.try_variant_get("doc.exported_at", "$", "string")))


def read_manifests(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Manifest scan: document bytes, their digest and the parsed outer level."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return parse_documents(raw)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Many documents per file, one per line: splits like any text and avoids small files."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_documents(lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def write_manifest_lines(documents: DataFrame, path: str) -> None:
    """Sink for ``build_manifests``: one document per line."""
    documents.select("document").write.text(path)


def source_rows(documents: DataFrame) -> DataFrame:
    kind, account = _text("doc.source", "kind"), _text("doc.source", "account_id")
    return documents.select(
        "manifest_sha256",
        "manifest_path",
        "exported_at",
        stable_id("src", kind, account).alias("source_id"),
        kind.alias("kind"),
        account.alias("external_account_id"),
        _text("doc.source", "display_name").alias("display_name"),
    )


def conversation_rows(documents: DataFrame) -> DataFrame:
    """One row per conversation occurrence, its variant kept for the deeper levels."""
    source = stable_id("src", _text("doc.source", "kind"), _text("doc.source", "account_id"))
    exploded = documents.select(
        "manifest_sha256",
        "export_root",
        "exported_at",
        source.alias("source_id"),
        F.posexplode("doc.conversations").alias("conversation_pos", "conversation"),
    )
    external = _text("conversation", "source_conversation_id")
    return exploded.select(
        "*",
        stable_id("con", F.col("source_id"), external).alias("conversation_id"),
        external.alias("external_conversation_id"),
        _text("conversation", "title").alias("title"),
        F.coalesce(_text("conversation", "type"), F.lit("single")).alias("conversation_type"),
        parse_instant(_text("conversation", "last_activity")).alias("explicit_last_activity"),
        F.coalesce(
            F.try_variant_get("conversation", "$.participants_complete", "boolean"), F.lit(False)
        ).alias("participants_complete"),
    )


def conversation_raw(conversations: DataFrame) -> DataFrame:
    """Drop the variant, keep everything but the messages as canonical text.

    The messages, nearly all of the variant, are left out before anything becomes text.
    """
    fields = F.try_variant_get("conversation", "$", "map<string,variant>")
    kept = F.to_json(F.map_filter(fields, lambda key, _: key != "messages"))
    raw = F.coalesce(json_keys_without(kept, ["messages"]), F.lit("{}"))
    return conversations.withColumn("raw_json", raw).drop("conversation")


def participant_rows(conversations: DataFrame) -> DataFrame:
    exploded = conversations.select(
        *ORDER,
        "source_id",
        "conversation_id",
        "participants_complete",
        F.posexplode(F.try_variant_get("conversation", "$.participants", "array<variant>")).alias(
            "participant_pos", "participant"
        ),
    )
    external = _text("participant", "source_identity_id")
    raw = F.to_json("participant")
    return exploded.select(
        *ORDER,
        "participant_pos",
        "source_id",
        "conversation_id",
        "participants_complete",
        stable_id("idn", F.col("source_id"), external).alias("identity_id"),
        external.alias("external_identity_id"),
        _text("participant", "display_name").alias("display_name"),
        F.coalesce(F.try_variant_get("participant", "$.is_self", "boolean"), F.lit(False)).alias("is_self"),
        F.coalesce(
            json_keys_without(raw, ["role", "group_nickname", "membership"]), F.lit("{}")
        ).alias("identity_raw"),
        raw.alias("relation_raw"),
    )


def _part(variant: Column, position: Column) -> Column:
    kind = _text(variant, "type")
    path = _text(variant, "path")
    given = _text(variant, "file_name")
    is_text = kind.isin(*TEXT_PART_TYPES)
    text = F.when(is_text, F.coalesce(_text(variant, "text"), _text(variant, "url"))).otherwise(
        _text(variant, "transcription")
    )
    name = F.when(given != "", given).when(path != "", base_name(path)).otherwise(F.lit(UNKNOWN_FILE))
    return F.struct(
        position.cast("long").alias("part_index"),
        kind.alias("part_type"),
        text.alias("text_content"),
        F.when(~is_text, name).alias("file_name"),
        F.when(~is_text, path).alias("path"),
        F.when(~is_text, _text(variant, "mime_type")).alias("mime_type"),
        F.to_json(variant).alias("raw_json"),
    )


def search_body(sender: str | Column, parts: str | Column) -> Column:
    """Sender, then per part its text or its transcription and file name; no shuffle."""
    pieces = F.transform(parts, lambda p: F.array_compact(F.array(p["text_content"], p["file_name"])))
    return F.array_join(F.concat(F.array(F.col(sender) if isinstance(sender, str) else sender), F.flatten(pieces)), "\n")


def message_rows(conversations: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """One row per message occurrence, its parts nested in order.

    The sender is linked only to an identity listed in the same conversation of the same
    document, which is an equi join against the distinct roster keys.
    """
    exploded = conversations.select(
        *ORDER,
        "export_root",
        "source_id",
        "conversation_id",
        F.posexplode(F.try_variant_get("conversation", "$.messages", "array<variant>")).alias(
            "message_pos", "message"
        ),
    )
    external = _text("message", "source_message_id")
    sender = _text("message", "sender_id")
    rows = exploded.select(
        *ORDER,
        "message_pos",
        "export_root",
        "source_id",
        "conversation_id",
        stable_id("msg", F.col("source_id"), external).alias("message_id"),
        external.alias("external_message_id"),
        sender.alias("sender_external_id"),
        F.coalesce(_text("message", "sender_name"), sender, F.lit(UNKNOWN_SENDER)).alias("sender_display_name"),
        parse_instant(_text("message", "timestamp")).alias("sent_at"),
        F.coalesce(_text("message", "direction"), F.lit("unknown")).alias("direction"),
        F.transform(F.try_variant_get("message", "$.parts", "array<variant>"), _part).alias("parts"),
        F.to_json("message").alias("raw_json"),
    )
    rows = rows.withColumn("content_sha256", F.sha2("raw_json", 256)).withColumn(
        "search_body", search_body("sender_display_name", "parts")
    )
    if participants is None:
        return rows
    return link_senders(rows, participants)


def link_senders(messages: DataFrame, participants: DataFrame) -> DataFrame:
    keys = ["manifest_sha256", "conversation_pos"]
    roster = participants.select(
        *keys, F.col("external_identity_id").alias("sender_external_id"), F.col("identity_id").alias("sender_identity_id")
    ).distinct()
    return messages.join(roster, [*keys, "sender_external_id"], "left")


def part_rows(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode nested parts to the part table, identifiers included."""
    return (
        messages.select("message_id", *keep, F.explode("parts").alias("part"))
        .select("message_id", *keep, "part.*")
        .withColumn("part_id", stable_id("prt", F.col("message_id"), F.col("part_index")))
        .withColumn(
            "attachment_id",
            F.when(
                ~F.col("part_type").isin(*TEXT_PART_TYPES),
                stable_id("att", F.col("message_id"), F.col("part_index")),
            ),
        )
    )


def flatten_manifests(documents: DataFrame) -> dict[str, DataFrame]:
    """All levels of the documents as positional tables."""
    conversations = conversation_rows(documents)
    participants = participant_rows(conversations)
    messages = message_rows(conversations, participants)
    return {
        "sources": source_rows(documents),
        "conversations": conversation_raw(conversations),
        "participants": participants,
        "messages": messages,
        "parts": part_rows(messages),
    }


def iso_instant(instant: str | Column) -> Column:
    """UTC text of an instant, microseconds kept."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _quoted(text: str | Column) -> Column:
    """JSON string literal of a text column."""
    encoded = F.to_json(F.array(text))
    return encoded.substr(F.lit(2), F.length(encoded) - 2)


def _joined(items: str, field: str) -> Column:
    """JSON array of ready-made JSON texts; empty for a null list."""
    inner = F.array_join(F.transform(items, lambda item: item[field]), ",")
    return F.concat(F.lit("["), F.coalesce(inner, F.lit("")), F.lit("]"))


def build_manifests(
    sources: DataFrame,
    conversations: DataFrame,
    participants: DataFrame,
    messages: DataFrame,
    schema_version: str,
    rows_per_document: int = 5000,
    exported_at: Column | None = None,
) -> DataFrame:
    """Normalised rows back to documents of bounded size, everything in canonical order.

    ``messages`` carries ``raw_json`` per message, ``participants`` ``relation_raw``;
    ``conversations`` may carry ``extra_json`` with further fields and ``participants_complete``.
    A conversation is cut into consecutive chunks, so no group grows with the data. Chunk
    ``k`` is dated ``k`` microseconds after ``exported_at`` and only chunk 0 declares a complete
    roster: importing all chunks replaces the roster once and then merges the rest.
    """
    ranked = ranked_in_slices(messages, ["conversation_id"], ["sent_at", "external_message_id"], "sent_at")
    chunked = ranked.withColumn("chunk", F.floor((F.col("row_rank") - 1) / rows_per_document))
    message_lists = chunked.groupBy("conversation_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("row_rank", "raw_json"))).alias("items")
    )
    members = participants.select(
        "conversation_id", F.struct("external_identity_id", "relation_raw").alias("member")
    )
    sizes = members.groupBy("conversation_id").agg(F.ceil(F.count("*") / rows_per_document).alias("buckets"))
    member_lists = (
        members.join(sizes, "conversation_id")
        .withColumn("chunk", F.pmod(F.xxhash64("member.external_identity_id"), F.col("buckets")))
        .groupBy("conversation_id", "chunk")
        .agg(F.array_sort(F.collect_list("member")).alias("members"))
    )
    keys = ["conversation_id", "chunk"]
    first = conversations.select("conversation_id", F.lit(0).cast("long").alias("chunk")).distinct()
    pieces = message_lists.join(member_lists, keys, "full").join(first, keys, "full")
    absent = {"extra_json": F.lit("{}"), "participants_complete": F.lit(False)}
    head = conversations.select(
        "conversation_id", "source_id", "external_conversation_id", "title", "conversation_type",
        *[(F.col(c) if c in conversations.columns else v).alias(c) for c, v in absent.items()],
    )
    named = pieces.join(head, "conversation_id").join(sources, "source_id")
    extra = F.regexp_extract("extra_json", r"(?s)^\{(.*)\}$", 1)
    complete = F.when(F.col("participants_complete") & (F.col("chunk") == 0), "true").otherwise("false")
    conversation = F.concat(
        F.lit('{"source_conversation_id":'), _quoted("external_conversation_id"),
        F.lit(',"title":'), _quoted("title"),
        F.lit(',"type":'), _quoted("conversation_type"),
        F.lit(',"participants_complete":'), complete,
        F.when(extra != "", F.concat(F.lit(","), extra)).otherwise(""),
        F.lit(',"participants":'), _joined("members", "relation_raw"),
        F.lit(',"messages":'), _joined("items", "raw_json"),
        F.lit("}"),
    )
    dated = F.lit("")
    if exported_at is not None:
        moment = F.timestamp_micros(F.unix_micros(exported_at) + F.col("chunk"))
        dated = F.concat(F.lit(',"exported_at":"'), iso_instant(moment), F.lit('"'))
    document = F.concat(
        F.lit('{"schema_version":'), _quoted(F.lit(schema_version)), dated,
        F.lit(',"source":'),
        F.to_json(F.struct(F.col("kind"), F.col("external_account_id").alias("account_id"), F.col("display_name"))),
        F.lit(',"conversations":['), conversation, F.lit("]}"),
    )
    return named.select(
        "source_id", "conversation_id", F.col("chunk").cast("long").alias("chunk"), canonical_json(document).alias("document")
    )
