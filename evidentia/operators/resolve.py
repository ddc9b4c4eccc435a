"""Identities, senders, rosters, titles and directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.constants import LOW_32_BITS
from evidentia.functions import blank_to_null, md5_table_name
from evidentia.operators.ordering import latest_per_key, top_per_key


def first_non_blank(*columns) -> Column:
    """First column that holds more than blanks."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def resolve_senders(
    messages: DataFrame, name_map: DataFrame, keys: tuple[str, ...] = ("shard", "sender_row"), chat: str = "chat"
) -> DataFrame:
    """Adds ``sender_id``: mapped name, else the content prefix, else ``unknown:<chat>``.

    ``name_map`` is unique per key; whether it is broadcast is left to its size.
    """
    names = name_map.select(*keys, F.col("username").alias("_mapped"))
    prefix = F.col("prefix_sender") if "prefix_sender" in messages.columns else F.lit(None).cast("string")
    unknown = F.concat(F.lit("unknown:"), F.col(chat))
    return (
        messages.join(names, list(keys), "left")
        .withColumn("sender_id", F.coalesce("_mapped", prefix, unknown))
        .drop("_mapped")
    )


def display_names(
    df: DataFrame, contacts: DataFrame, id_column: str, precedence: tuple[str, ...], overlay: str | None = None,
    output: str = "display_name", fallback: Column | None = None,
) -> DataFrame:
    """Adds the display name by precedence over contact columns, an overlay column first."""
    named = contacts.select(
        F.col("username").alias(id_column), first_non_blank(*precedence).alias("_name")
    )
    first = [blank_to_null(overlay)] if overlay else []
    last = F.col(id_column) if fallback is None else fallback
    return (
        df.join(named, id_column, "left")
        .withColumn(output, F.coalesce(*first, "_name", last))
        .drop("_name")
    )


def conversation_titles(chats: DataFrame, contacts: DataFrame, sessions: DataFrame, precedence=("remark", "nick_name", "alias")) -> DataFrame:
    """Contact name, else the session title, else the id itself."""
    named = contacts.select(F.col("username").alias("chat"), first_non_blank(*precedence).alias("_contact"))
    titled = sessions.select("chat", F.nullif("session_title", F.lit("")).alias("_session"))
    contact = F.when(F.col("_contact") != F.col("chat"), F.col("_contact"))
    return (
        chats.join(named, "chat", "left")
        .join(titled, "chat", "left")
        .withColumn("title", F.coalesce(contact, "_session", "chat"))
        .drop("_contact", "_session")
    )


def resolve_self(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """Own identity per account: the account id itself, else the longest matching prefix.

    A user name matches a profile name when equal or followed by ``_``. Instead of comparing
    every pair, each profile name yields its own ``_`` prefixes, which join on equality.
    """
    users = contacts.select(F.col("username").alias("candidate")).distinct()
    exact = accounts.join(users, accounts.account_id == users.candidate, "left_semi").select(
        "account_id", F.col("account_id").alias("self_id"), F.lit("verified_explicit_account_id").alias("self_status")
    )
    others = accounts.join(exact.select("account_id"), "account_id", "left_anti")
    pieces = F.split("profile_name", "_")
    prefixes = others.filter(F.col("profile_name").isNotNull()).select(
        "account_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "_")
            )
        ).alias("candidate"),
    )
    longest = (
        prefixes.join(users, "candidate")
        .groupBy("account_id")
        .agg(F.max_by("candidate", F.length("candidate")).alias("_prefix"))
    )
    rest = others.join(longest, "account_id", "left").select(
        "account_id",
        F.col("_prefix").alias("self_id"),
        F.when(F.col("_prefix").isNotNull(), F.lit("verified_profile_directory"))
        .otherwise(F.lit("unresolved"))
        .alias("self_status"),
    )
    return exact.unionByName(rest)


def resolve_binding(candidates: DataFrame, receipts: DataFrame) -> DataFrame:
    """The candidate whose salted digest equals the stored binding; must be exactly one."""
    hashed = candidates.select(
        "uid", F.sha2(F.concat(F.col("uid"), F.md5("salt")), 256).alias("account_binding_sha256")
    ).distinct()
    return (
        receipts.join(hashed, "account_binding_sha256", "left")
        .groupBy("receipt_id")
        .agg(F.min("uid").alias("_low"), F.max("uid").alias("_high"))
        .select(
            "receipt_id",
            F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("uid"),
            F.when(F.col("_low").isNull(), F.lit("unbound"))
            .when(F.col("_low") == F.col("_high"), F.lit("bound"))
            .otherwise(F.lit("ambiguous"))
            .alias("binding_status"),
        )
    )


def classify_direction(
    df: DataFrame, rule: str, sender: str = "sender_id", own: str = "self_id", is_system: str | None = None
) -> DataFrame:
    """Adds ``direction`` and ``direction_status``.

    ``resolved``: a resolved sender against the own identity. ``aliases``: overlap of the alias
    arrays in ``sender`` and ``own``. ``uid``: plain equality, an empty sender is unknown.
    """
    s, o = F.col(sender), F.col(own)
    if rule == "resolved":
        unresolved = o.isNull() | s.isNull() | s.startswith("unknown:")
        mine = s == o
    elif rule == "aliases":
        unresolved = (F.coalesce(F.size(o), F.lit(0)) <= 0) | (F.coalesce(F.size(s), F.lit(0)) <= 0)
        mine = F.arrays_overlap(s, o)
    elif rule == "uid":
        unresolved = F.coalesce(s, F.lit("")) == ""
        mine = s.eqNullSafe(o)
    else:
        raise ValueError(f"unknown direction rule: {rule}")
    system = F.coalesce(F.col(is_system), F.lit(False)) if is_system else F.lit(False)
    direction = (
        F.when(system, "system").when(unresolved, "unknown").when(mine, "outgoing").otherwise("incoming")
    )
    status = (
        F.when(system, "system_message")
        .when(unresolved, "unresolved_sender_or_self")
        .when(mine, "verified_self_sender")
        .otherwise("verified_nonself_sender")
    )
    return df.withColumn("direction", direction).withColumn("direction_status", status)


# --- rosters ------------------------------------------------------------------------------


def group_members(
    rooms: DataFrame, members: DataFrame, ids: DataFrame, contacts: DataFrame, precedence=("remark", "nick_name", "alias"),
    own_id: str | None = None,
) -> DataFrame:
    """Resolved members of each room with role and self status."""
    own = F.lit(own_id).cast("string")
    resolved = (
        members.select("room_id", "member_id")
        .join(rooms.select("room_id", "chat", "owner"), "room_id")
        .join(ids.select("member_id", F.col("username").alias("identity")), "member_id")
    )
    named = display_names(resolved, contacts, "identity", precedence)
    return named.select(
        "room_id",
        "chat",
        "identity",
        "display_name",
        F.when(F.col("identity") == F.col("owner"), "owner").otherwise("member").alias("role"),
        F.coalesce(F.col("identity") == own, F.lit(False)).alias("is_self"),
        F.when(own.isNull(), "self_unresolved")
        .when(F.col("identity") == own, "verified_self")
        .otherwise("verified_not_self")
        .alias("identity_status"),
    )


def group_metadata(rooms: DataFrame, details: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """Per room: resolved and unresolved members, completeness, announcement fields.

    Member counts are aggregated before they meet the rooms, so a large room stays one row.
    """
    tallies = (
        members.join(ids.select("member_id", F.col("username").alias("_identity")), "member_id", "left")
        .groupBy("room_id")
        .agg(
            F.count_if(F.col("_identity").isNotNull()).alias("member_count"),
            F.count_if(F.col("_identity").isNull()).alias("unresolved_members"),
        )
    )
    announced = F.nullif("announcement", F.lit(""))
    facts = details.select(
        "room_id",
        F.col("room_status").alias("source_status"),
        announced.alias("announcement"),
        F.when(announced.isNotNull(), F.nullif("announcement_editor", F.lit(""))).alias("announcement_editor_id"),
        F.when(announced.isNotNull() & (F.col("announcement_time") > 0), F.col("announcement_time")).alias(
            "announcement_published_epoch"
        ),
    )
    joined = rooms.join(facts, "room_id", "left").join(tallies, "room_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return joined.select(
        "room_id", "chat", F.coalesce("owner", F.lit("")).alias("owner_id"), "source_status", "announcement",
        "announcement_editor_id", "announcement_published_epoch", zero("member_count"), zero("unresolved_members"),
        F.when(F.coalesce("unresolved_members", F.lit(0)) == 0, "complete").otherwise("partial").alias("membership_status"),
    )


def overlay_nicknames(roster: DataFrame, chunks: DataFrame) -> DataFrame:
    """Group nickname of the first chunk per member; it also becomes the display name."""
    first = latest_per_key(chunks, ["chat", "identity"], [F.col("chunk_pos").asc()]).select(
        "chat", "identity", F.col("nickname").alias("_nick"), F.col("member_state").alias("source_member_state")
    )
    nick = F.when((F.col("_nick") != "") & (F.col("_nick") != F.col("identity")), F.col("_nick"))
    return (
        roster.join(first, ["chat", "identity"], "left")
        .withColumn("group_nickname", nick)
        .withColumn("display_name", F.coalesce("group_nickname", "display_name"))
        .withColumn(
            "group_nickname_status",
            F.when(F.col("group_nickname").isNotNull(), "verified_room_buffer").otherwise("not_present"),
        )
        .drop("_nick")
    )


def participants_with_observed(roster: DataFrame, senders: DataFrame) -> DataFrame:
    """Roster plus senders seen outside it, the latter marked as not current."""
    observed = senders.select("chat", "identity", "display_name").dropDuplicates(["chat", "identity"])
    extra = observed.join(roster.select("chat", "identity"), ["chat", "identity"], "left_anti")
    return roster.select("chat", "identity", "display_name", "role", F.lit(True).alias("current")).unionByName(
        extra.select("*", F.lit("observed_sender").alias("role"), F.lit(False).alias("current"))
    )


def metadata_only_groups(groups: DataFrame, exported: DataFrame) -> DataFrame:
    """Groups that no message export covers."""
    return groups.join(exported.select("chat").distinct(), "chat", "left_anti")


def name_variants(messages: DataFrame, keys: list[str], name: str = "sender_name") -> DataFrame:
    """Senders with several names: how many, first and last in order, and one row per name.

    Names stay rows, so a sender with very many of them never becomes one large array.
    """
    distinct = messages.select(*keys, F.col(name).alias("name_variant")).distinct()
    counted = distinct.groupBy(*keys).agg(F.count("*").alias("variants"))
    return distinct.join(counted.filter("variants > 1"), keys)


def session_metadata(df: DataFrame) -> DataFrame:
    """Renamed, masked and cleaned session fields; empty values become null."""

    def instant(column: str) -> Column:
        return F.when(F.col(column) > 0, F.timestamp_seconds(F.col(column).cast("long")))

    def text(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    return df.select(
        "chat",
        F.col("type").cast("long").alias("session_type"),
        F.col("unread_count").cast("long").alias("unread_count"),
        F.col("status").cast("long").alias("source_status"),
        F.col("last_msg_type").cast("long").bitwiseAND(F.lit(LOW_32_BITS)).alias("last_message_type"),
        F.col("last_msg_sub_type").cast("long").alias("last_message_subtype"),
        (F.coalesce("is_hidden", F.lit(0)) != 0).alias("is_hidden"),
        instant("last_timestamp").alias("last_message_at"),
        instant("sort_timestamp").alias("sort_at"),
        text("summary").alias("last_message_preview"),
        text("last_msg_sender").alias("last_message_sender_id"),
        text("last_sender_display_name").alias("last_sender_display_name"),
    )


def contact_metadata(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Renamed contact fields, blanks dropped; ``fields`` maps output to input names."""
    return df.select(
        "username",
        F.lit("resolved").alias("contact_status"),
        *[F.nullif(F.col(source).cast("string"), F.lit("")).alias(target) for target, source in fields.items()],
    )


def session_gaps(sessions: DataFrame, tables: DataFrame) -> DataFrame:
    """Sessions whose message table does not exist in any shard."""
    return sessions.withColumn("table_name", md5_table_name("chat")).join(
        tables.select("table_name").distinct(), "table_name", "left_anti"
    )


def newest_conversations(sessions: DataFrame, activity: str, limit: int, tie: str = "chat") -> DataFrame:
    """Top conversations by last activity; those without activity do not count."""
    return sessions.filter(F.col(activity) > 0).orderBy(F.col(activity).desc(), F.col(tie).asc()).limit(limit)


def newest_messages(messages: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Newest messages per conversation over all shards, cut before they meet, however many are wanted."""
    return top_per_key(messages, [key], [F.col(c).desc() for c in order], limit, "newest_rank")


def adapter_summary(messages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by direction, never contents or identifiers."""
    counts = [F.count_if(F.col("direction") == d).alias(d) for d in ("incoming", "outgoing", "system", "unknown")]
    return messages.groupBy(*(keys or [])).agg(F.count("*").alias("messages"), *counts)
