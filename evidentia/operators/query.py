"""The nine read questions: status, listing, roster, search, context, provenance, digest,
candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import constants as K
from evidentia.functions import (
    compact,
    contains_literal,
    json_keys_without,
    json_type,
    literal_words,
    strict_variant,
)
from evidentia.operators.ordering import ranked_in_slices, top_per_key
from evidentia.operators.validate import ArgumentError, bounded_limit, bounded_offset, one_of, text_argument

MEDIA_TYPES = ("any", "image", "audio", "video", "file")
ATTACHMENT_KEYS = ("type", "path", "file_name", "mime_type", "transcription")
PART_KEYS = ("type", "text", "url", "path", "file_name", "mime_type", "transcription")


# --- paging -----------------------------------------------------------------------------


def keyset_page(
    df: DataFrame, instant: str, row_id: str, after: tuple | None = None, limit: int | None = None
) -> DataFrame:
    """Newest first; rows strictly behind ``after``; one row more than ``limit`` shows that
    there is a next page. ``limit=None`` keeps everything, unsorted."""
    if after is not None:
        moment, last_id = after
        t = F.col(instant)
        bound = F.lit(moment)
        df = df.filter((t < bound) | ((t == bound) & (F.col(row_id) < F.lit(last_id))))
    if limit is None:
        return df
    return df.orderBy(F.col(instant).desc(), F.col(row_id).desc()).limit(limit + 1)


def in_page_order(df: DataFrame, instant: str, row_id: str, size: int | None) -> DataFrame:
    """Newest first again after the page was joined; a page is at most ``size + 1`` rows."""
    return df if size is None else df.orderBy(F.col(instant).desc(), F.col(row_id).desc())


# --- status -----------------------------------------------------------------------------


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and attachment count per status."""
    names = ("sources", "conversations", "messages", "attachments", "import_runs")
    counts = [
        tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("item"), "rows")
        for name in names
        if name in tables
    ]
    statuses = tables["attachments"].groupBy("status").agg(F.count("*").alias("rows"))
    counts.append(statuses.select(F.concat(F.lit("attachment_status:"), F.col("status")).alias("item"), "rows"))
    result = counts[0]
    for item in counts[1:]:
        result = result.unionByName(item)
    return result


def with_freshness(heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``collector_freshness_state``; a missing or stale heartbeat outranks its state."""
    age = F.unix_micros(as_of) - F.unix_micros("worker_heartbeat_at")
    stale = F.col("worker_heartbeat_at").isNull() | F.col("stale_after_seconds").isNull() | (
        age > F.col("stale_after_seconds") * 1_000_000
    )
    return heartbeats.withColumn(
        "collector_freshness_state",
        F.when(stale, "HEARTBEAT_STALE")
        .when(F.col("state") == "RETRYABLE_ERROR", "COLLECTOR_ERROR")
        .when(F.col("state") == "REQUIRES_USER_ACTION", "REQUIRES_USER_ACTION")
        .when(F.col("observation_scope") == "acquisition_readiness", "COLLECTOR_ACTIVE_SOURCE_UNOBSERVED")
        .otherwise("SOURCE_OBSERVED"),
    )


def source_status(tables: dict[str, DataFrame], as_of: Column, source_kind: str | None = None) -> DataFrame:
    """One row per source or unmatched collector. Each side is counted before it is joined."""
    text_argument(source_kind, "source_kind")
    conversations = tables["conversations"].groupBy("source_id").agg(F.count("*").alias("conversation_count"))
    messages = tables["messages"].groupBy("source_id").agg(
        F.count("*").alias("message_count"), F.max("sent_at").alias("latest_message_at")
    )
    done = F.col("status") == "complete"
    runs = tables["import_runs"].groupBy("source_id").agg(
        F.count_if(done).alias("successful_import_count"),
        F.count_if(~done).alias("incomplete_import_count"),
        F.max(F.when(done, F.col("finished_at"))).alias("last_successful_import_at"),
        F.max(F.when(done, F.col("exported_at"))).alias("latest_exported_at"),
    )
    sources = tables["sources"].select(
        "source_id", F.col("kind").alias("source_kind"), "external_account_id", "display_name"
    )
    heartbeats = tables["heartbeats"]
    if source_kind is not None:
        sources = sources.filter(F.col("source_kind") == source_kind)
        heartbeats = heartbeats.filter(F.col("source_kind") == source_kind)
    counted = sources
    for side in (conversations, messages, runs):
        counted = counted.join(side, "source_id", "left")
    collectors = with_freshness(heartbeats, as_of).select(
        "source_kind", "external_account_id", "detector_id", "state", "consecutive_failures", "collector_freshness_state"
    )
    joined = counted.join(collectors, ["source_kind", "external_account_id"], "full")
    counts = ("conversation_count", "message_count", "successful_import_count", "incomplete_import_count")
    filled = joined.select(
        "source_id", "source_kind", "external_account_id", "display_name", "latest_message_at",
        "last_successful_import_at", "latest_exported_at", "detector_id", "state", "consecutive_failures",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce("collector_freshness_state", F.lit("NOT_RECORDED")).alias("collector_freshness_state"),
    )
    return filled.withColumn(
        "availability_state",
        F.when(F.col("incomplete_import_count") > 0, "IMPORT_INCOMPLETE")
        .when(F.col("successful_import_count") > 0, "IMPORTED_EVIDENCE_AVAILABLE")
        .otherwise("NO_SUCCESSFUL_IMPORT"),
    )


# --- conversations ----------------------------------------------------------------------


def list_conversations(
    tables: dict[str, DataFrame],
    source_kind: str | None = None,
    conversation_type: str | None = None,
    query: str | None = None,
    after: tuple | None = None,
    limit: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """Conversations newest first with their counts. The page is cut before anything is
    counted, so only its conversations are joined; ``whole`` lists all of them."""
    text_argument(source_kind, "source_kind", blank_ok=True)
    one_of(conversation_type, K.CONVERSATION_TYPES, "conversation_type")
    text_argument(query, "query", blank_ok=True)
    size = None if whole else bounded_limit(limit, K.LIMIT_LIST)
    sources = tables["sources"].select(
        "source_id", F.col("kind").alias("source_kind"), "external_account_id",
        F.col("display_name").alias("source_display_name"),
    )
    listed = tables["conversations"].join(sources, "source_id")
    if source_kind is not None:
        listed = listed.filter(F.col("source_kind") == source_kind)
    if conversation_type is not None:
        listed = listed.filter(F.col("conversation_type") == conversation_type)
    if query:
        listed = listed.filter(F.lower("title").contains(query.lower()))
    listed = listed.withColumn("_activity", F.coalesce("last_activity", F.timestamp_seconds(F.lit(0))))
    page = keyset_page(listed, "_activity", "conversation_id", after, size)
    keys = page.select("conversation_id")
    counted = page
    for name, alias in (("messages", "message_count"), ("participants", "participant_count")):
        side = tables[name].select("conversation_id")
        side = side if whole else side.join(keys, "conversation_id", "left_semi")
        counted = counted.join(
            side.groupBy("conversation_id").agg(F.count("*").alias(alias)), "conversation_id", "left"
        ).withColumn(alias, F.coalesce(alias, F.lit(0)))
    counted = in_page_order(counted, "_activity", "conversation_id", size).drop("_activity")
    if "raw_json" not in counted.columns:
        return counted
    raw = F.try_parse_json("raw_json")
    field = lambda path, kind: F.try_variant_get(raw, path, kind)
    return counted.select(
        *[c for c in counted.columns if c != "raw_json"],
        field("$.metadata.unread_count", "long").alias("unread_count"),
        field("$.metadata.is_hidden", "boolean").alias("is_hidden"),
        field("$.metadata.last_message_type", "long").alias("last_message_type"),
        field("$.group.member_count", "long").alias("current_member_count"),
        (F.coalesce(field("$.group.announcement", "string"), F.lit("")) != "").alias("has_announcement"),
        F.coalesce(field("$.participants_complete", "boolean"), F.lit(False)).alias("participants_complete"),
    )


def _roster(tables: dict[str, DataFrame], conversation_ids: DataFrame | None) -> DataFrame:
    """Members with their facts and ``_order``: owner, members, others, then by name and id."""
    members = tables["participants"]
    if conversation_ids is not None:
        members = members.join(conversation_ids.select("conversation_id"), "conversation_id", "left_semi")
    fact = lambda column, name: F.get_json_object(column, f"$.{name}")
    people = tables["identities"]
    own = fact("raw_json", "metadata") if "raw_json" in people.columns else F.lit(None).cast("string")
    people = people.select("identity_id", "external_identity_id", "display_name", "is_self", own.alias("_own"))
    joined = members.withColumns({"role": fact("relation_raw", "role"), "membership": fact("relation_raw", "membership")}).join(people, "identity_id")
    role_order = F.when(F.col("role") == "owner", 0).when(F.col("role") == "member", 1).otherwise(2)
    order = F.struct(role_order.alias("role"), F.lower("display_name").alias("name"), F.col("identity_id").alias("id"))
    # what an identity says of itself comes before what its membership says
    return joined.withColumns({"metadata": F.coalesce("_own", fact("relation_raw", "metadata")), "_order": order}).drop("_own")


def conversation_roster(
    tables: dict[str, DataFrame],
    conversation_ids: DataFrame | None = None,
    offset: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A page of each conversation's roster: owner, members, others, then by name and id.

    Each task's rows are cut to ``offset + limit`` per conversation before they meet (`top_per_key`, in two levels for
    deep pages), so one very large roster does not gather in a task.
    """
    start, size = bounded_offset(offset), bounded_limit(limit, K.LIMIT_PARTICIPANTS)
    ranked = top_per_key(_roster(tables, conversation_ids), ["conversation_id"], [F.col("_order")], start + size, "position")
    return ranked.filter(F.col("position") > start).drop("_order")


def whole_roster(tables: dict[str, DataFrame], conversation_ids: DataFrame | None = None, after: tuple | None = None) -> DataFrame:
    """All members, with the three parts of their order, by which a reader may go on behind ``after``.

    ``after`` is (order of the role, name in lower case, identity id). Nothing is ranked, so the size of a roster does
    not matter.
    """
    rows = _roster(tables, conversation_ids).select("*", F.col("_order.role").alias("role_order"), F.col("_order.name").alias("name_order")).drop("_order")
    if after is None:
        return rows
    role, name, last = after
    later_name = (F.col("name_order") > name) | ((F.col("name_order") == name) & (F.col("identity_id") > last))
    return rows.filter((F.col("role_order") > role) | ((F.col("role_order") == role) & later_name))


ROSTER_ITEM = ("identity_id", "external_identity_id", "display_name", "is_self", "role", "membership", "metadata")


def conversation_details(
    tables: dict[str, DataFrame], conversation_ids: DataFrame | None = None, offset: int | None = None, limit: int | None = None
) -> DataFrame:
    """One row per conversation: header with source, counts, exported facts, and a page of its roster nested in order.

    Counts are taken of the wanted conversations only, each by one aggregate that is folded on the map side. The nested
    page has at most ``limit`` members; ``has_more`` tells whether others follow. Unknown ids have no row.
    """
    start, size = bounded_offset(offset), bounded_limit(limit, K.LIMIT_PARTICIPANTS)
    chosen = tables["conversations"]
    if conversation_ids is not None:
        chosen = chosen.join(conversation_ids.select("conversation_id").distinct(), "conversation_id", "left_semi")
    keys = None if conversation_ids is None else conversation_ids
    sources = tables["sources"].select(
        "source_id", F.col("kind").alias("source_kind"), "external_account_id", F.col("display_name").alias("source_display_name")
    )
    raw = F.try_parse_json("raw_json")
    text = lambda path: F.to_json(F.try_variant_get(raw, path, "variant"))
    rows = chosen.join(sources, "source_id").select(
        "conversation_id", "external_conversation_id", "title", "conversation_type", "last_activity", "source_id", "source_kind",
        "external_account_id", "source_display_name", F.coalesce(text("$.metadata"), F.lit("{}")).alias("metadata"),
        text("$.group").alias("group"), F.try_variant_get(raw, "$.participant_scope", "string").alias("participant_scope"),
        F.coalesce(F.try_variant_get(raw, "$.participants_complete", "boolean"), F.lit(False)).alias("participants_complete"),
    )
    for name, alias in (("messages", "message_count"), ("participants", "participant_count")):
        side = tables[name].select("conversation_id")
        side = side if keys is None else side.join(keys.select("conversation_id"), "conversation_id", "left_semi")
        counts = side.groupBy("conversation_id").agg(F.count("*").alias(alias))
        rows = rows.join(counts, "conversation_id", "left").withColumn(alias, F.coalesce(alias, F.lit(0)))
    page = conversation_roster(tables, keys, start, size)
    nested = page.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("position", *ROSTER_ITEM))).alias("participants"))
    found = rows.join(nested, "conversation_id", "left")
    items = F.coalesce("participants", F.array().cast(nested.schema["participants"].dataType))
    return found.withColumns({"participants": items, "has_more": F.lit(start) + F.size(items) < F.col("participant_count")})


# --- messages ---------------------------------------------------------------------------


def with_headers(messages: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Adds conversation title and source columns."""
    titles = tables["conversations"].select("conversation_id", F.col("title").alias("conversation_title"))
    sources = tables["sources"].select("source_id", F.col("kind").alias("source_kind"), "external_account_id")
    return messages.join(titles, "conversation_id").join(sources, "source_id")


def search_messages(
    tables: dict[str, DataFrame],
    query: str = "",
    source_kind: str | None = None,
    conversation_id: str | None = None,
    sender: str | None = None,
    date_after=None,
    date_before=None,
    media_type: str | None = None,
    after: tuple | None = None,
    limit: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """Literal search: all words occur, filters hold, newest first.

    Filters sit on the scan; the search text is read only when there are words. The page is
    cut before titles are joined. ``whole`` returns every hit instead of a page.
    """
    text_argument(query, "query", blank_ok=True)
    for name, value in (("source_kind", source_kind), ("conversation_id", conversation_id), ("sender", sender)):
        text_argument(value, name, blank_ok=True)
    one_of(media_type, MEDIA_TYPES, "media_type")
    size = None if whole else bounded_limit(limit, K.LIMIT_SEARCH)
    hits = tables["messages"]
    words = literal_words(query or "")
    if words:
        hits = hits.filter(contains_literal("search_body", words))
    if conversation_id is not None:
        hits = hits.filter(F.col("conversation_id") == conversation_id)
    if sender is not None:
        hits = hits.filter(F.lower("sender_display_name") == sender.lower())
    if date_after is not None:
        hits = hits.filter(F.col("sent_at") > F.lit(date_after))
    if date_before is not None:
        hits = hits.filter(F.col("sent_at") < F.lit(date_before))
    if source_kind is not None:
        chosen = tables["sources"].filter(F.col("kind") == source_kind).select("source_id")
        hits = hits.join(chosen, "source_id", "left_semi")
    if media_type == "any":
        hits = hits.join(tables["attachments"].select("message_id"), "message_id", "left_semi")
    elif media_type is not None:
        typed = tables["parts"].filter(F.col("part_type") == media_type).select("message_id")
        hits = hits.join(typed, "message_id", "left_semi")
    page = keyset_page(hits.drop("search_body"), "sent_at", "message_id", after, size)
    return in_page_order(with_headers(page, tables), "sent_at", "message_id", size)


def hydrate_messages(messages: DataFrame, parts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Nests ordered parts with attachment and residual fields under each message.

    Call it on a page: the parts are cut to the page's messages before they are grouped.
    """
    keys = messages.select("message_id")
    bodies = attachments.select(
        "attachment_id", "file_name", "mime_type", "status", "size_bytes", "blob_sha256"
    )
    residue = json_keys_without("raw_json", PART_KEYS) if "raw_json" in parts.columns else F.lit(None).cast("string")
    slim = (
        parts.join(keys, "message_id", "left_semi")
        .select("message_id", "part_index", "part_type", "text_content", "attachment_id", residue.alias("source_metadata"))
        .join(bodies, "attachment_id", "left")
    )
    nested = slim.groupBy("message_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "part_index", "part_type", "text_content", "attachment_id", "file_name", "mime_type",
                    "status", "size_bytes", "blob_sha256", "source_metadata",
                )
            )
        ).alias("parts")
    )
    bare = messages.drop("parts")
    if "raw_json" in bare.columns:
        metadata = F.try_variant_get(strict_variant("raw_json"), "$.metadata", "variant")
        shown = F.when(json_type(metadata) == "OBJECT", F.nullif(F.to_json(metadata), F.lit("{}")))
        bare = bare.withColumn("source_metadata", shown)
    return bare.join(nested, "message_id", "left")


def read_context(
    messages: DataFrame, targets: DataFrame, before: int | None = None, after: int | None = None, slice_seconds: float | None = None
) -> DataFrame:
    """Neighbours of many targets at once, by (time, id) inside each conversation.

    Positions come from the sliced ranking. A target names the few position blocks its window
    touches, so the join is on (conversation, block): a conversation is never crossed with
    its targets, and a very long one is spread over its blocks.
    """
    n_before = bounded_limit(before, K.LIMIT_CONTEXT, "before")
    n_after = bounded_limit(after, K.LIMIT_CONTEXT, "after")
    block = n_before + n_after + 1
    wanted = targets.select("message_id").distinct()
    touched = messages.join(wanted, "message_id", "left_semi").select("conversation_id").distinct()
    slim = messages.select("conversation_id", "sent_at", "message_id").join(touched, "conversation_id", "left_semi")
    ranked = ranked_in_slices(slim, ["conversation_id"], ["sent_at", "message_id"], "sent_at", slice_seconds, "position")
    centres = ranked.join(wanted, "message_id", "left_semi").select(
        "conversation_id", F.col("message_id").alias("target_id"), F.col("position").alias("centre")
    )
    first, last = F.col("centre") - n_before, F.col("centre") + n_after
    blocks = F.sequence(F.floor(first / block), F.floor(last / block))
    spread = centres.withColumn("_block", F.explode(blocks))
    rows = ranked.withColumn("_block", F.floor(F.col("position") / block))
    joined = spread.join(rows, ["conversation_id", "_block"]).filter(F.col("position").between(first, last))
    return joined.select(
        "target_id",
        "conversation_id",
        "message_id",
        "sent_at",
        (F.col("position") - F.greatest(first, F.lit(1))).alias("item_index"),
        (F.col("centre") - F.greatest(first, F.lit(1))).alias("target_index"),
    )


def attachment_provenance(tables: dict[str, DataFrame], attachment_ids: DataFrame | None = None) -> DataFrame:
    """Attachment with its message, source and stored body."""
    attachments = tables["attachments"]
    if attachment_ids is not None:
        attachments = attachments.join(attachment_ids.select("attachment_id"), "attachment_id", "left_semi")
    messages = tables["messages"].select("message_id", "conversation_id", "sent_at", "source_id")
    sources = tables["sources"].select("source_id", F.col("kind").alias("source_kind"), "external_account_id")
    blobs = tables["blobs"].select(F.col("sha256").alias("blob_sha256"), "stored_path")
    if "raw_json" in attachments.columns:
        attachments = attachments.withColumn("source_metadata", json_keys_without("raw_json", ATTACHMENT_KEYS))
    return attachments.join(messages, "message_id").join(sources, "source_id").join(blobs, "blob_sha256", "left")


# --- digest -------------------------------------------------------------------------------


def digest_window(
    tables: dict[str, DataFrame], source_kind: str | None = None, date_after=None, date_before=None,
    limit: int | None = None, whole: bool = False,
) -> DataFrame:
    """The newest messages a digest looks at (one look-ahead row removed), or all of them."""
    size = None if whole else bounded_limit(limit, K.LIMIT_DIGEST)
    found = search_messages(
        tables, "", source_kind=source_kind, date_after=date_after, date_before=date_before, limit=size, whole=whole
    )
    return found if whole else found.orderBy(F.col("sent_at").desc(), F.col("message_id").desc()).limit(size)


def digest_counts(window: DataFrame, attachments: DataFrame, top: int = K.TOP_SENDERS) -> DataFrame:
    """``section, name, items``: messages per source, top senders, attachments per status.

    Sources and senders come from one scan with grouping sets.
    """
    sets = window.groupingSets([["source_kind"], ["sender_display_name"]], "source_kind", "sender_display_name").agg(
        F.count("*").alias("items"), F.grouping("source_kind").alias("_by_sender")
    )
    by_source = sets.filter("_by_sender = 0").select(F.lit("source").alias("section"), F.col("source_kind").alias("name"), "items")
    by_sender = (
        sets.filter("_by_sender = 1")
        .orderBy(F.col("items").desc(), F.col("sender_display_name").asc())
        .limit(top)
        .select(F.lit("sender").alias("section"), F.col("sender_display_name").alias("name"), "items")
    )
    by_status = (
        attachments.join(window.select("message_id"), "message_id", "left_semi")
        .groupBy("status")
        .agg(F.count("*").alias("items"))
        .select(F.lit("attachment").alias("section"), F.col("status").alias("name"), "items")
    )
    return by_source.unionByName(by_sender).unionByName(by_status)


def digest_excerpts(window: DataFrame, parts: DataFrame, per_conversation: int = K.EXCERPTS_PER_CONVERSATION) -> DataFrame:
    """Newest messages per conversation with a short text, and how many were left out."""
    totals = window.groupBy("conversation_id").agg(
        F.count("*").alias("_total"), F.max("sent_at").alias("conversation_newest_at")
    )
    kept = top_per_key(
        window, ["conversation_id"], [F.col("sent_at").desc(), F.col("message_id").desc()], per_conversation, "excerpt_rank"
    ).join(totals, "conversation_id")
    texts = parts.filter(F.coalesce("text_content", F.lit("")) != "").join(
        kept.select("message_id"), "message_id", "left_semi"
    )
    first = texts.groupBy("message_id").agg(F.min(F.struct("part_index", "text_content")).alias("_first"))
    excerpt = compact(F.coalesce(F.col("_first.text_content"), F.lit(K.NO_TEXT_EXCERPT)), K.EXCERPT_CHARS)
    return (
        kept.join(first, "message_id", "left")
        .withColumn("excerpt", excerpt)
        .withColumn("omitted", F.greatest(F.col("_total") - per_conversation, F.lit(0)))
        .drop("_first", "_total")
    )


def digest_markdown(counts: DataFrame, excerpts: DataFrame, truncated: bool = False) -> DataFrame:
    """Text blocks of the digest: ``header``, ``sources`` and one per conversation.

    A block holds at most the excerpts of one conversation, so no row grows with the data;
    ``block_order`` gives the order in which the blocks form the document.
    """
    title, note, considered, omitted = K.DIGEST_HEADER
    # one row per source kind, of which there are few
    gathered = counts.filter("section = 'source'").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("items")).alias("k"), "name", "items"))).alias("rows"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("total"),
    )
    header = gathered.select(
        F.lit("header").alias("block"),
        F.lit("").alias("block_order"),
        F.concat(
            F.lit(f"{title}\n\n{note}\n{considered}"), F.col("total").cast("string"),
            F.lit(f"\n{omitted}{'yes' if truncated else 'no'}"),
        ).alias("markdown"),
    )
    source_lines = F.transform(
        "rows", lambda r: F.concat(F.lit("- "), r["name"], F.lit(": "), r["items"].cast("string"))
    )
    sources = gathered.select(
        F.lit("sources").alias("block"),
        F.lit("0").alias("block_order"),
        F.array_join(F.concat(F.array(F.lit("## Source counts")), source_lines), "\n").alias("markdown"),
    )
    # conversations follow the heading: their order begins with "1:"
    heading = gathered.select(F.lit("excerpts").alias("block"), F.lit("1").alias("block_order"), F.lit("## Conversation excerpts").alias("markdown"))
    stamp = F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(
        F.lit("- "), stamp, F.lit(" "), F.col("sender_display_name"), F.lit(": "), F.col("excerpt"),
        F.lit(" (message_id="), F.col("message_id"), F.lit(")"),
    )
    blocks = excerpts.groupBy("conversation_id", "conversation_title", "conversation_newest_at", "omitted").agg(
        F.array_sort(F.collect_list(F.struct("excerpt_rank", line.alias("line")))).alias("rows")
    )
    more = F.when(
        F.col("omitted") > 0,
        F.array(F.concat(F.lit("- … "), F.col("omitted").cast("string"), F.lit(" more in selected window"))),
    ).otherwise(F.array().cast("array<string>"))
    conversations = blocks.select(
        F.col("conversation_id").alias("block"),
        F.concat(
            F.lit("1:"),
            F.lpad((F.lit(10**12) - F.unix_seconds("conversation_newest_at")).cast("string"), 13, "0"),
            F.lit(":"), F.col("conversation_id"),
        ).alias("block_order"),
        F.array_join(
            F.concat(
                F.array(F.concat(F.lit("### "), F.col("conversation_title"))),
                F.transform("rows", lambda r: r["line"]),
                more,
            ),
            "\n",
        ).alias("markdown"),
    )
    return header.unionByName(sources).unionByName(heading).unionByName(conversations)


# --- candidates -----------------------------------------------------------------------------


def list_candidates(
    tables: dict[str, DataFrame], review_status: str | None = None, event_type: str | None = None,
    source_kind: str | None = None, after: tuple | None = None, limit: int | None = None, whole: bool = False,
) -> DataFrame:
    """Event candidates newest first with their evidence count."""
    one_of(review_status, K.REVIEW_STATES, "review_status")
    text_argument(event_type, "event_type")
    text_argument(source_kind, "source_kind")
    size = None if whole else bounded_limit(limit, K.LIMIT_CANDIDATES)
    found = tables["candidates"]
    if review_status is not None:
        found = found.filter(F.col("review_status") == review_status)
    if event_type is not None:
        found = found.filter(F.col("event_type") == event_type)
    if source_kind is not None:
        chosen = tables["sources"].filter(F.col("kind") == source_kind).select("source_id")
        owned = tables["messages"].select("message_id", "source_id").join(chosen, "source_id", "left_semi")
        backed = tables["evidence"].join(owned.select("message_id"), "message_id", "left_semi")
        found = found.join(backed.select("candidate_id"), "candidate_id", "left_semi")
    page = keyset_page(found, "last_seen_at", "candidate_id", after, size)
    evidence = tables["evidence"].select("candidate_id")
    if not whole:
        evidence = evidence.join(page.select("candidate_id"), "candidate_id", "left_semi")
    counts = evidence.groupBy("candidate_id").agg(F.count("*").alias("evidence_count"))
    counted = page.join(counts, "candidate_id", "left").withColumn(
        "evidence_count", F.coalesce("evidence_count", F.lit(0))
    )
    return in_page_order(counted, "last_seen_at", "candidate_id", size)


def candidate_evidence(tables: dict[str, DataFrame], candidate_ids: DataFrame | None = None) -> DataFrame:
    """Evidence rows of candidates with message headers; ordered by the listed columns."""
    found = tables["candidates"]
    if candidate_ids is not None:
        found = found.join(candidate_ids.select("candidate_id"), "candidate_id", "left_semi")
    slim = found.select("candidate_id", "rule_id", "event_type", "title", "review_status")
    evidence = tables["evidence"].join(slim, "candidate_id")
    messages = tables["messages"].select(
        "message_id", "conversation_id", "source_id", "sender_display_name", "sent_at", "direction"
    )
    return with_headers(evidence.join(messages, "message_id"), tables)


__all__ = [
    "ArgumentError", "attachment_provenance", "candidate_evidence", "conversation_roster", "digest_counts",
    "digest_excerpts", "digest_markdown", "digest_window", "hydrate_messages", "keyset_page", "list_candidates",
    "list_conversations", "read_context", "search_messages", "source_status", "store_stats", "with_freshness",
    "with_headers",
]
