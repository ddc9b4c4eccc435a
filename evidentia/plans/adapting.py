"""Platform exports to v1 documents: group exports and the two sharded table layouts.

Each plan resolves senders, directions, rosters and parts with the operators and ends in the
same four inputs of ``build_manifests``. Limits are arguments; ``None`` exports everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import blank_to_null, canonical_json, epoch_auto, stable_id
from evidentia.operators import content as C
from evidentia.operators import resolve as R
from evidentia.operators.attachments import lookup_resources
from evidentia.operators.ordering import latest_per_key
from evidentia.operators.validate import check_agreement, filter_allowlist
from evidentia.sources import group_exports as G
from evidentia.sources import shards as S
from evidentia.sources.manifests import build_manifests, iso_instant

GROUP_SUFFIX = "@chatroom"


@dataclass
class Export:
    """Normalised rows of an export; ``documents`` turns them into v1 documents."""

    sources: DataFrame
    conversations: DataFrame
    participants: DataFrame
    messages: DataFrame
    #: path, external_conversation_id, external_message_id, problem, raw_json: what was left out, row by row.
    problems: DataFrame | None = None

    def documents(self, schema_version: str, exported_at: Column | None = None, rows_per_document: int = 5000) -> DataFrame:
        return build_manifests(
            self.sources, self.conversations, self.participants, self.messages, schema_version, rows_per_document, exported_at
        )

    def summary(self) -> DataFrame:
        return R.adapter_summary(self.messages)


def _source(any_df: DataFrame, kind: str, account: str, display_name: str) -> DataFrame:
    row = [(kind, account, display_name)]
    df = any_df.sparkSession.createDataFrame(row, "kind string, external_account_id string, display_name string")
    return df.withColumn("source_id", stable_id("src", "kind", "external_account_id"))


def _keyed(df: DataFrame, kind: str, account: str) -> DataFrame:
    """Adds source and conversation ids for ``external_conversation_id``."""
    source = stable_id("src", F.lit(kind), F.lit(account))
    return df.withColumn("source_id", source).withColumn(
        "conversation_id", stable_id("con", "source_id", "external_conversation_id")
    )


def _with_raw(messages: DataFrame, metadata: list[str], source: str | None = None) -> DataFrame:
    """Message JSON of the v1 contract; absent fields are left out. The message in ``source`` is kept as it was."""
    shape = F.struct(
        F.col("external_message_id").alias("source_message_id"),
        iso_instant("sent_at").alias("timestamp"),
        "sender_id",
        "sender_name",
        "direction",
        "parts",
        F.struct(*metadata).alias("metadata"),
        *([F.parse_json(source).alias("source_message")] if source else []),
    )
    return messages.withColumn("raw_json", F.to_json(shape))


def _relation(df: DataFrame, *extra: Column) -> DataFrame:
    shape = F.struct(F.col("identity").alias("source_identity_id"), "display_name", "is_self", *extra)
    return df.withColumn("external_identity_id", F.col("identity")).withColumn("relation_raw", F.to_json(shape))


# --- group exports --------------------------------------------------------------------------


def adapt_group_exports(
    documents: DataFrame, allowed: DataFrame, account: str, display_name: str = "Account", since=None, until=None,
    kind: str = "group-export",
) -> Export:
    """Explicitly allowed group exports inside the window; senders plus the own identity.

    ``problems`` names what is not in the export: unusable files, files outside the allowlist, every copy of an id
    whose copies differ, and conversations whose files disagree on title or own ids (the first path's are taken).
    """
    rejected = G.export_problems(documents)
    usable = documents.join(rejected.select("path"), "path", "left_anti")
    chosen = filter_allowlist(usable, allowed, ["peer_uid", "peer_uin"])
    copies = G.group_messages(chosen, since, until)
    clean, conflicting = G.dedupe_group_messages(copies)
    messages = _with_raw(_keyed(clean, kind, account), ["direction_status"], "raw_json")
    heads = latest_per_key(
        chosen.select("external_conversation_id", "title", "self_ids", "self_name", "participant_count", "chat_info", "path"),
        ["external_conversation_id"], [F.col("path").asc()],
    )
    extra = F.to_json(F.struct(F.struct("participant_count").alias("metadata"), F.parse_json("chat_info").alias("chat_info")))
    conversations = _keyed(heads, kind, account).select(
        "source_id", "conversation_id", "external_conversation_id", "title", F.lit("group").alias("conversation_type"),
        extra.alias("extra_json"), "self_ids", "self_name",
    )
    own = conversations.filter(F.size("self_ids") > 0).select(
        "conversation_id", F.col("self_ids")[0].alias("identity"), F.coalesce("self_name", F.lit(display_name)).alias("display_name"), F.lit(True).alias("is_self")
    )
    senders = messages.filter("sender_id IS NOT NULL").groupBy("conversation_id", F.col("sender_id").alias("identity")).agg(
        F.min_by("sender_name", F.struct("sent_at", "external_message_id")).alias("display_name"),
        F.max(F.col("direction") == "outgoing").alias("is_self"),
    )
    others = senders.join(own.select("conversation_id", "identity"), ["conversation_id", "identity"], "left_anti")
    participants = _relation(own.unionByName(others))
    problems = _group_problems(rejected, usable, chosen, copies, conflicting)
    return Export(_source(documents, kind, account, display_name), conversations.drop("self_name"), participants, messages, problems)


def _group_problems(rejected: DataFrame, usable: DataFrame, chosen: DataFrame, copies: DataFrame, conflicting: DataFrame) -> DataFrame:
    """Rejected and skipped files, disagreements and conflicting copies, with the copies' source messages."""
    skipped = usable.select("path", "external_conversation_id").join(chosen.select("path"), "path", "left_anti")
    facts = chosen.select("external_conversation_id", "title", F.array_join("self_ids", "\x1f").alias("self_ids"))
    clashes = check_agreement(facts, "external_conversation_id", ["title", "self_ids"])
    differing = copies.join(conflicting, "external_message_id", "left_semi")
    rows = [
        rejected.select("path", "problem"),
        skipped.withColumn("problem", F.lit("not_allowed")),
        clashes.select("external_conversation_id", F.concat(F.lit("disagrees_on_"), "disagrees_on").alias("problem")),
        differing.select("path", "external_conversation_id", "external_message_id", F.lit("conflicting_content").alias("problem"), "raw_json"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select("path", "external_conversation_id", "external_message_id", "problem", "raw_json")


# --- sharded tables, md5 table names ------------------------------------------------------------


@dataclass
class ShardedTables:
    """Extracted tables of one account. Rooms may be left out."""

    shards: DataFrame  # shard, table_name, local_id, server_id, local_type, sort_seq, sender_row, create_time, message_content, content_type
    sessions: DataFrame  # chat, last_timestamp and the session fields
    session_titles: DataFrame  # chat, session_title
    contacts: DataFrame  # username, member_id, remark, nick_name, alias
    name_map: DataFrame  # shard, sender_row, username
    voices: DataFrame | None = None  # chat, local_id, create_time, row, voice_path
    rooms: DataFrame | None = None  # room_id, chat, owner
    details: DataFrame | None = None  # room_id, room_status, announcement, announcement_editor, announcement_time
    members: DataFrame | None = None  # room_id, member_id
    nicknames: DataFrame | None = None  # chat, identity, chunk_pos, nickname, member_state


NAME_ORDER = ("remark", "nick_name", "alias")


def adapt_sharded(
    tables: ShardedTables, account: str, display_name: str = "Account", profile_name: str | None = None,
    max_conversations: int | None = None, max_messages: int | None = None, all_groups: bool = False,
    kind: str = "sharded-a", platform: str = "Chat",
) -> Export:
    """Chats with a message table, their newest messages, resolved senders and rosters."""
    spark = tables.shards.sparkSession
    accounts = spark.createDataFrame([(account, profile_name)], "account_id string, profile_name string")
    own = R.resolve_self(accounts, tables.contacts).select("self_id")
    # one row, one value: a property of the account
    self_id = F.lit(own.first()["self_id"]).cast("string")

    sessions = tables.sessions
    if max_conversations is not None:
        sessions = R.newest_conversations(sessions, "last_timestamp", max_conversations)
    else:
        sessions = sessions.filter(F.col("last_timestamp") > 0)
    rows = S.scan_shards_md5(tables.shards, sessions)
    if max_messages is not None:
        rows = S.newest_per_conversation(rows, "chat", ["create_time", "local_id"], max_messages)
    decoded = C.decode_content(rows)
    is_group = F.col("chat").endswith(GROUP_SUFFIX)
    split = decoded.withColumn("_split", C.strip_group_prefix("text", is_group))
    split = split.withColumn("prefix_sender", F.col("_split.prefix_sender")).withColumn("text", F.col("_split.body")).drop("_split")
    sent = R.resolve_senders(split, tables.name_map)
    roster = _room_roster(tables, self_id)
    if roster is not None:
        overlay = roster.select("chat", F.col("identity").alias("sender_id"), F.col("display_name").alias("_room_name"))
        sent = sent.join(overlay, ["chat", "sender_id"], "left")
    else:
        sent = sent.withColumn("_room_name", F.lit(None).cast("string"))
    named = R.display_names(sent, tables.contacts, "sender_id", NAME_ORDER, "_room_name", "sender_name")
    directed = R.classify_direction(named.withColumn("self_id", self_id), "resolved")
    if tables.voices is not None:
        directed = lookup_resources(directed, tables.voices, ["chat", "local_id"], "create_time", "row", ["voice_path"])
    else:
        directed = directed.withColumn("voice_path", F.lit(None).cast("string"))
    built = C.parts_from_type_code(directed, voice_path="voice_path", platform=platform)
    messages = built.select(
        F.col("chat").alias("external_conversation_id"), S.message_id_sharded().alias("external_message_id"),
        F.timestamp_seconds("create_time").alias("sent_at"), "sender_id", "sender_name", "direction", "direction_status", "parts",
        "shard", "local_id", "server_id", "local_type", "base_type", F.col("content_type").alias("content_storage"),
    )
    messages = _with_raw(
        _keyed(messages, kind, account),
        ["shard", "local_id", "server_id", "local_type", "base_type", "content_storage", "direction_status"],
    )

    chats = sessions.select("chat", "last_timestamp").join(rows.select("chat").distinct(), "chat", "left_semi")
    if all_groups and tables.rooms is not None:
        extra_rooms = R.metadata_only_groups(tables.rooms.select("chat"), chats)
        chats = chats.unionByName(extra_rooms.join(tables.sessions.select("chat", "last_timestamp"), "chat", "left"))
    titled = R.conversation_titles(chats, tables.contacts, tables.session_titles, NAME_ORDER)
    if tables.rooms is not None:
        ids = tables.contacts.select("member_id", "username")
        groups = R.group_metadata(tables.rooms, tables.details, tables.members, ids).select("chat", "member_count", "announcement", "membership_status")
        titled = titled.join(groups, "chat", "left")
    else:
        titled = titled.withColumns({c: F.lit(None).cast(t) for c, t in (("member_count", "long"), ("announcement", "string"), ("membership_status", "string"))})
    activity = F.when(F.col("last_timestamp") > 0, iso_instant(F.timestamp_seconds("last_timestamp")))
    extra = F.to_json(F.struct(activity.alias("last_activity"), F.struct("member_count", "announcement", "membership_status").alias("group")))
    conversations = _keyed(titled.withColumnRenamed("chat", "external_conversation_id"), kind, account).select(
        "source_id", "conversation_id", "external_conversation_id", "title",
        F.when(F.col("external_conversation_id").endswith(GROUP_SUFFIX), "group").otherwise("single").alias("conversation_type"),
        F.col("membership_status").eqNullSafe("complete").alias("participants_complete"), extra.alias("extra_json"),
    )

    observed = messages.select(F.col("external_conversation_id").alias("chat"), F.col("sender_id").alias("identity"), F.col("sender_name").alias("display_name"))
    singles = titled.filter(~F.col("chat").endswith(GROUP_SUFFIX)).select("chat", F.col("chat").alias("identity"), F.col("title").alias("display_name"))
    selves = R.display_names(singles.select("chat", self_id.alias("identity")).filter("identity IS NOT NULL"), tables.contacts, "identity", NAME_ORDER)
    known = singles.unionByName(selves)
    observed = known.unionByName(observed.distinct().join(known.select("chat", "identity"), ["chat", "identity"], "left_anti"))
    base = roster.join(chats.select("chat"), "chat", "left_semi") if roster is not None else observed.limit(0).withColumn("role", F.lit("member"))
    everyone = R.participants_with_observed(base, observed)
    is_room = F.col("chat").endswith(GROUP_SUFFIX)
    status = F.when(self_id.isNull(), "self_unresolved").when(F.col("identity") == self_id, "verified_self").otherwise("verified_not_self")
    related = _relation(
        everyone.withColumn("is_self", F.coalesce(F.col("identity") == self_id, F.lit(False))),
        F.when(is_room, F.col("role")).alias("role"),
        F.when(is_room, F.struct("current")).alias("membership"),
        status.alias("identity_status"),
    )
    participants = _keyed(related.withColumnRenamed("chat", "external_conversation_id"), kind, account)
    return Export(_source(tables.shards, kind, account, display_name), conversations, participants, messages)


def _room_roster(tables: ShardedTables, self_id: Column) -> DataFrame | None:
    if tables.rooms is None:
        return None
    ids = tables.contacts.select("member_id", "username")
    roster = R.group_members(tables.rooms, tables.members, ids, tables.contacts, NAME_ORDER).drop("is_self", "identity_status")
    return roster if tables.nicknames is None else R.overlay_nicknames(roster, tables.nicknames)


# --- sharded tables, fixed shards -----------------------------------------------------------------


def adapt_keyed(
    shards: DataFrame, conversations: DataFrame, profiles: DataFrame, account: str, self_uid: str, display_name: str = "Account",
    max_conversations: int | None = None, max_messages: int | None = None, kind: str = "sharded-b", platform: str = "Chat",
) -> Export:
    """Conversations by last change, rows from all shards, JSON bodies.

    ``shards``: ``table_name, primaryKey, cid, localId, mid, senderId, createdAt, contentType,
    content, messageStatus, recallStatus, extension``; ``profiles``: ``username, alias, nick, real_name``.
    """
    changed = F.coalesce("lastModify", "createAt", F.lit(0))
    chosen = conversations.filter(F.coalesce("cid", F.lit("")) != "").withColumn("_changed", changed)
    if max_conversations is not None:
        chosen = chosen.orderBy(F.col("_changed").desc(), F.col("cid").asc()).limit(max_conversations)
    rows = S.scan_shards_keyed(shards, chosen)
    if max_messages is not None:
        rows = S.newest_per_conversation(rows, "cid", ["createdAt", "primaryKey"], max_messages)
    precedence = ("alias", "nick", "real_name")
    named = R.display_names(
        rows.withColumn("sender_id", F.nullif(F.col("senderId").cast("string"), F.lit(""))), profiles, "sender_id", precedence,
        None, "sender_name", F.lit(f"Unknown {platform} sender"),
    )
    directed = R.classify_direction(named.withColumn("self_id", F.lit(self_uid)), "uid")
    built = C.parts_from_json_content(directed, "contentType", "content", "localId", platform)
    messages = built.select(
        F.col("cid").alias("external_conversation_id"), S.message_id_keyed().alias("external_message_id"),
        epoch_auto("createdAt").alias("sent_at"), "sender_id", "sender_name", "direction", "parts",
        F.col("messageStatus").alias("message_status"), F.col("recallStatus").alias("recall_status"), F.col("table_name").alias("source_table"),
        canonical_json("extension").alias("source_extension"),
    )
    messages = _with_raw(_keyed(messages, kind, account), ["message_status", "recall_status", "source_table", "source_extension"])
    last = F.when(F.col("_changed") > 0, iso_instant(epoch_auto("_changed")))
    extra = F.to_json(F.struct(last.alias("last_activity"), F.struct(F.col("memberCount").alias("source_member_count"), F.col("unreadCount").alias("unread_count")).alias("metadata")))
    heads = _keyed(chosen.withColumnRenamed("cid", "external_conversation_id"), kind, account).select(
        "source_id", "conversation_id", "external_conversation_id", F.coalesce(blank_to_null("title"), F.lit(f"{platform} conversation")).alias("title"),
        F.when(F.col("type") == 1, "single").otherwise("group").alias("conversation_type"), extra.alias("extra_json"),
    )
    seen = messages.filter("sender_id IS NOT NULL").select("conversation_id", F.col("sender_id").alias("identity"))
    everyone = seen.unionByName(heads.select("conversation_id", F.lit(self_uid).alias("identity"))).distinct()
    labelled = R.display_names(everyone, profiles, "identity", precedence, fallback=F.lit(f"Unknown {platform} user"))
    is_self = F.col("identity") == self_uid
    participants = _relation(
        labelled.withColumn("is_self", is_self), F.when(is_self, "verified_self").otherwise("observed_sender").alias("identity_status")
    )
    return Export(_source(shards, kind, account, display_name), heads, participants, messages)
