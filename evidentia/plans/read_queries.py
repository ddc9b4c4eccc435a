"""Search, listing, roster, context, provenance, digest and candidates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from evidentia.operators import query as Q
from evidentia.operators import resolve, rules
from evidentia.plans.registry import query
from evidentia.plans.views import AS_OF, EPOCH, TEST_RULE, Views, text

def as_of():
    return F.timestamp_seconds(F.lit(AS_OF))


def epoch(column: str):
    return F.unix_seconds(column)


def at(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


_PAGE = """
  JOIN body USING (message_id)
  WHERE contains(lower(search_body), 'en') AND contains(lower(search_body), 'der')"""


@query("message_search_page", "R6 R7 L3 F6", f"""
SELECT message_id, external_message_id, conversation_id, title AS conversation_title, kind AS source_kind,
  sender_display_name, sent_epoch, direction
FROM m {_PAGE} ORDER BY sent_epoch DESC, message_id DESC LIMIT 21""")
def _(v: Views):
    found = Q.search_messages(v.tables, "en DER")
    return found.select(
        "message_id", "external_message_id", "conversation_id", "conversation_title", "source_kind",
        "sender_display_name", epoch("sent_at").alias("sent_epoch"), "direction",
    )


@query("message_search_all", "R6 V4", f"""
SELECT message_id, sender_display_name, sent_epoch, kind AS source_kind
FROM m {_PAGE} AND kind = 'beta' AND lower(sender_display_name) LIKE 'user%' AND sent_epoch > {EPOCH + 60}
  AND sent_epoch < {EPOCH + 9000000}""")
def _(v: Views):
    found = Q.search_messages(
        v.tables, "en der", source_kind="beta", date_after=at(EPOCH + 60), date_before=at(EPOCH + 9000000), whole=True
    ).filter(F.lower("sender_display_name").startswith("user"))
    return found.select("message_id", "sender_display_name", epoch("sent_at").alias("sent_epoch"), "source_kind")


@query("message_search_media", "R6 semi joins", """
SELECT 'any' AS media, message_id FROM m WHERE message_id IN (SELECT message_id FROM a)
UNION ALL
SELECT part_type, message_id FROM p WHERE part_type IN ('image', 'audio', 'video', 'file')""")
def _(v: Views):
    kinds = ("any", "image", "audio", "video", "file")
    found = [
        Q.search_messages(v.tables, "", media_type=k, whole=True).select(F.lit(k).alias("media"), "message_id") for k in kinds
    ]
    result = found[0]
    for item in found[1:]:
        result = result.unionByName(item)
    return result


@query("message_search_sender", "R6", """
SELECT message_id, external_message_id FROM m WHERE lower(sender_display_name) = 'assistant 3'""")
def _(v: Views):
    return Q.search_messages(v.tables, "", sender="Assistant 3", whole=True).select("message_id", "external_message_id")


@query("keyset_next_page", "R7 L1 L3", """
SELECT m.message_id, m.sent_epoch FROM m,
  (SELECT sent_epoch AS t, message_id AS i FROM m ORDER BY sent_epoch DESC, message_id DESC LIMIT 1 OFFSET 19) k
WHERE m.sent_epoch < t OR (m.sent_epoch = t AND m.message_id < i)
ORDER BY m.sent_epoch DESC, m.message_id DESC LIMIT 21""")
def _(v: Views):
    messages = v.tables["messages"].select("sent_at", "message_id")
    # the cursor is the last row of the page before
    first = Q.keyset_page(messages, "sent_at", "message_id", None, 19)
    last = first.orderBy(F.col("sent_at"), F.col("message_id")).first()
    page = Q.keyset_page(messages, "sent_at", "message_id", (last["sent_at"], last["message_id"]), 20)
    return page.select("message_id", epoch("sent_at").alias("sent_epoch"))


@query("message_hydration", "R8", """
SELECT message_id, count(*) AS part_count,
  sha256(string_agg(part_index || '|' || part_type || '|' || coalesce(text_content, '') || '|' || coalesce(a.file_name, '') || '|'
    || coalesce(a.status, '') || '|' || coalesce(a.size_bytes::VARCHAR, '') || '|' || coalesce(a.blob_sha256, ''), chr(10) ORDER BY part_index)) AS parts_digest
FROM (SELECT p.message_id, p.part_index, p.part_type, p.text_content, p.attachment_id FROM p) x
LEFT JOIN (SELECT attachment_id, file_name, status, size_bytes, blob_sha256 FROM a) a USING (attachment_id)
GROUP BY 1""")
def _(v: Views):
    t = v.tables
    full = Q.hydrate_messages(t["messages"].select("message_id"), t["parts"], t["attachments"])

    def line(p):
        cells = [p[c].cast("string") for c in ("part_index", "part_type", "text_content", "file_name", "status", "size_bytes", "blob_sha256")]
        return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cells])

    return full.select(
        "message_id", F.size("parts").cast("long").alias("part_count"),
        F.sha2(F.array_join(F.transform("parts", line), "\n"), 256).alias("parts_digest"),
    )


@query("search_page_hydrated", "R6 R8", """
SELECT message_id, sent_epoch, conversation_id, sender_display_name, count(part_index) AS part_count,
  count(attachment_id) AS attachment_count
FROM (SELECT * FROM m ORDER BY sent_epoch DESC, message_id DESC LIMIT 21) JOIN p USING (message_id)
GROUP BY ALL""")
def _(v: Views):
    t = v.tables
    page = Q.search_messages(t, "")
    full = Q.hydrate_messages(page, t["parts"], t["attachments"])
    return full.select(
        "message_id", epoch("sent_at").alias("sent_epoch"), "conversation_id", "sender_display_name",
        F.size("parts").cast("long").alias("part_count"),
        F.size(F.filter("parts", lambda p: p["attachment_id"].isNotNull())).cast("long").alias("attachment_count"),
    )


@query("context_windows", "R9 L2", """
SELECT t.message_id AS target_id, o.conversation_id, o.message_id, o.n - greatest(t.n - 2, 1) AS item_index,
  t.n - greatest(t.n - 2, 1) AS target_index
FROM (SELECT message_id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_epoch, message_id) AS n, direction FROM m) t
JOIN (SELECT message_id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_epoch, message_id) AS n FROM m) o
  ON o.conversation_id = t.conversation_id AND o.n BETWEEN t.n - 2 AND t.n + 3
WHERE t.direction = 'outgoing'""")
def _(v: Views):
    m = v.tables["messages"]
    found = Q.read_context(m, m.filter("direction = 'outgoing'"), 2, 3)
    return found.drop("sent_at")


@query("context_windows_corpus", "R9 hot conversations", """
SELECT t.message_id AS target_id, o.message_id, o.n - greatest(t.n - 5, 1) AS item_index
FROM (SELECT d1.*, row_number() OVER (PARTITION BY source_kind ORDER BY sent_epoch, message_id) AS n FROM d1) t
JOIN (SELECT message_id, source_kind, row_number() OVER (PARTITION BY source_kind ORDER BY sent_epoch, message_id) AS n FROM d1) o
  ON o.source_kind = t.source_kind AND o.n BETWEEN t.n - 5 AND t.n + 5
WHERE contains(t.body, 'hand')""")
def _(v: Views):
    # the language is the conversation: a few very long ones
    m = v.corpus.select(F.col("source_kind").alias("conversation_id"), "sent_at", "message_id", "body")
    targets = m.filter(F.col("body").contains("hand"))
    return Q.read_context(m, targets, 5, 5).select("target_id", "message_id", "item_index")


@query("store_statistics", "R1", """
SELECT 'sources' AS item, count(*) AS rows FROM s UNION ALL SELECT 'conversations', count(*) FROM c
UNION ALL SELECT 'messages', count(*) FROM m UNION ALL SELECT 'attachments', count(*) FROM a
UNION ALL SELECT 'import_runs', count(*) FROM r
UNION ALL SELECT 'attachment_status:' || status, count(*) FROM a GROUP BY status""")
def _(v: Views):
    return Q.store_stats(v.tables)


_STATUS_FIELDS = [
    "source_id", "source_kind", "external_account_id", "display_name", "detector_id", "state", "consecutive_failures",
    "conversation_count", "message_count", "successful_import_count", "incomplete_import_count",
    "collector_freshness_state", "availability_state",
]


@query("source_status_report", "R2 R3 full outer", f"""
SELECT s.source_id, coalesce(s.kind, hb.source_kind) AS source_kind, coalesce(s.account, hb.external_account_id) AS external_account_id,
  s.display_name, hb.detector_id, hb.state, hb.consecutive_failures,
  coalesce(cc.n, 0) AS conversation_count, coalesce(mc.n, 0) AS message_count, coalesce(rc.ok, 0)::BIGINT AS successful_import_count,
  coalesce(rc.bad, 0)::BIGINT AS incomplete_import_count,
  CASE WHEN hb.d IS NULL THEN 'NOT_RECORDED' WHEN {AS_OF}::BIGINT * 1000000 - hb.t > hb.stale_after_seconds * 1000000 THEN 'HEARTBEAT_STALE'
    WHEN hb.state = 'RETRYABLE_ERROR' THEN 'COLLECTOR_ERROR' WHEN hb.state = 'REQUIRES_USER_ACTION' THEN 'REQUIRES_USER_ACTION'
    WHEN hb.observation_scope = 'acquisition_readiness' THEN 'COLLECTOR_ACTIVE_SOURCE_UNOBSERVED' ELSE 'SOURCE_OBSERVED' END AS collector_freshness_state,
  CASE WHEN coalesce(rc.bad, 0) > 0 THEN 'IMPORT_INCOMPLETE' WHEN coalesce(rc.ok, 0) > 0 THEN 'IMPORTED_EVIDENCE_AVAILABLE'
    ELSE 'NO_SUCCESSFUL_IMPORT' END AS availability_state,
  mc.latest AS latest_message_epoch, rc.done AS last_import_epoch, rc.exported AS latest_exported_epoch
FROM s LEFT JOIN (SELECT source_id, count(*) AS n FROM c GROUP BY 1) cc USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS n, max(sent_epoch) AS latest FROM m GROUP BY 1) mc USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) FILTER (status = 'complete') AS ok, count(*) FILTER (status <> 'complete') AS bad,
      max(finished_epoch) FILTER (status = 'complete') AS done, max(exported_epoch) FILTER (status = 'complete') AS exported
    FROM r GROUP BY 1) rc USING (source_id)
  FULL JOIN hb ON hb.source_kind = s.kind AND hb.external_account_id = s.account""")
def _(v: Views):
    return Q.source_status(v.tables, as_of()).select(
        *_STATUS_FIELDS, epoch("latest_message_at").alias("latest_message_epoch"),
        epoch("last_successful_import_at").alias("last_import_epoch"), epoch("latest_exported_at").alias("latest_exported_epoch"),
    )


@query("collector_freshness", "R3", """
SELECT detector_id, CASE WHEN (1706659000::BIGINT * 1000000 - t) > stale_after_seconds * 1000000 THEN 'HEARTBEAT_STALE'
    WHEN state = 'RETRYABLE_ERROR' THEN 'COLLECTOR_ERROR' WHEN state = 'REQUIRES_USER_ACTION' THEN 'REQUIRES_USER_ACTION'
    WHEN observation_scope = 'acquisition_readiness' THEN 'COLLECTOR_ACTIVE_SOURCE_UNOBSERVED' ELSE 'SOURCE_OBSERVED' END AS freshness
FROM hb""")
def _(v: Views):
    fresh = Q.with_freshness(v.heartbeats, F.timestamp_seconds(F.lit(1706659000)))
    return fresh.select("detector_id", F.col("collector_freshness_state").alias("freshness"))


_LISTING = """
SELECT c.conversation_id, c.title, c.conversation_type, c.kind AS source_kind, last_epoch,
  (SELECT count(*) FROM m WHERE m.conversation_id = c.conversation_id) AS message_count,
  (SELECT count(DISTINCT identity_id) FROM m WHERE m.conversation_id = c.conversation_id) AS participant_count,
  (conv_id % 7)::BIGINT AS unread_count, conv_id % 5 = 0 AS is_hidden, conv_id % 2 = 1 AS participants_complete, false AS has_announcement
FROM c"""
_LISTED = ["conversation_id", "title", "conversation_type", "source_kind", "message_count", "participant_count",
           "unread_count", "is_hidden", "participants_complete", "has_announcement"]


@query("conversation_listing", "R4 R7", _LISTING + " WHERE conversation_type = 'group' AND contains(lower(title), 'topic 1')")
def _(v: Views):
    found = Q.list_conversations(v.tables, conversation_type="group", query="Topic 1", whole=True)
    return found.select(*_LISTED, epoch("last_activity").alias("last_epoch"))


@query("conversation_listing_page", "R4 L1 L3", _LISTING + " WHERE c.kind = 'alpha' ORDER BY last_epoch DESC, conversation_id DESC LIMIT 11")
def _(v: Views):
    found = Q.list_conversations(v.tables, source_kind="alpha", limit=10)
    return found.select(*_LISTED, epoch("last_activity").alias("last_epoch"))


@query("conversation_roster_page", "R5 L4 L5", """
SELECT conversation_id, position, identity_id, sender_display_name AS display_name, role = 'assistant' AS is_self,
  CASE role WHEN 'user' THEN 'owner' WHEN 'assistant' THEN 'member' ELSE 'observed' END AS member_role
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END,
    lower(sender_display_name), identity_id) AS position
  FROM (SELECT DISTINCT conversation_id, identity_id, role, sender_display_name FROM m))
WHERE position BETWEEN 2 AND 3""")
def _(v: Views):
    page = Q.conversation_roster(v.tables, None, 1, 2)
    return page.select(
        "conversation_id", F.col("position").cast("long").alias("position"), "identity_id", "display_name", "is_self",
        F.col("role").alias("member_role"),
    )


@query("conversation_roster_large", "R5 hot conversations", """
SELECT chat, position, username FROM (
  SELECT rm.chat, ct.username, row_number() OVER (PARTITION BY rm.chat ORDER BY CASE WHEN ct.username = rm.owner THEN 0 ELSE 1 END, lower(ct.username), ct.username) AS position
  FROM mb JOIN rm USING (room_id) JOIN ct USING (member_id)) WHERE position BETWEEN 6 AND 25""")
def _(v: Views):
    page = Q.conversation_roster(_large_roster(v), None, 5, 20)
    return page.select(
        F.col("conversation_id").alias("chat"), F.col("position").cast("long").alias("position"), F.col("identity_id").alias("username")
    )


_MEMBERS = """
SELECT rm.chat, ct.username, row_number() OVER (PARTITION BY rm.chat ORDER BY CASE WHEN ct.username = rm.owner THEN 0 ELSE 1 END, lower(ct.username), ct.username) AS position
FROM mb JOIN rm USING (room_id) JOIN ct USING (member_id)"""


def _large_roster(v: Views):
    members = resolve.group_members(v.rooms, v.members, v.contacts.select("member_id", "username"), v.contacts)
    return {
        "participants": members.select(
            F.col("chat").alias("conversation_id"), F.col("identity").alias("identity_id"),
            F.concat(F.lit('{"role":"'), F.col("role"), F.lit('"}')).alias("relation_raw"),
        ),
        "identities": v.contacts.select(
            F.col("username").alias("identity_id"), F.col("username").alias("external_identity_id"),
            F.col("username").alias("display_name"), F.lit(False).alias("is_self"),
        ),
    }


@query("conversation_roster_deep", "R5 L4 deep pages in two levels", """
SELECT position, username, member_role FROM (
  SELECT c_name AS username, CASE c_custkey % 50 WHEN 0 THEN 'owner' WHEN 1 THEN 'guest' ELSE 'member' END AS member_role,
    row_number() OVER (ORDER BY CASE c_custkey % 50 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, lower(c_name), c_name) AS position FROM customer)
WHERE position BETWEEN 601 AND 1100""")
def _(v: Views):
    # one conversation of all customers
    rest = F.col("c_custkey") % 50
    role = F.when(rest == 0, "owner").when(rest == 1, "guest").otherwise("member")
    name = F.col("c_name")
    tables = {
        "participants": v.table("customer").select(F.lit("all").alias("conversation_id"), name.alias("identity_id"), text('{"role":"', role, '"}').alias("relation_raw")),
        "identities": v.table("customer").select(name.alias("identity_id"), name.alias("external_identity_id"), name.alias("display_name"), F.lit(False).alias("is_self")),
    }
    page = Q.conversation_roster(tables, None, 600, 500)
    return page.select(F.col("position").cast("long").alias("position"), F.col("identity_id").alias("username"), F.col("role").alias("member_role"))


@query("conversation_roster_whole", "R5 R7 whole rosters behind a key", f"""
SELECT chat, username FROM ({_MEMBERS}) JOIN rm USING (chat) WHERE username <> owner AND lower(username) > 'customer#000000700'""")
def _(v: Views):
    rows = Q.whole_roster(_large_roster(v), after=(1, "customer#000000700", "~"))
    return rows.select(F.col("conversation_id").alias("chat"), F.col("identity_id").alias("username"))


@query("conversation_details", "R5 header, counts, facts and members", """,
people AS (
  SELECT conversation_id, identity_id, sender_external_id, sender_display_name, role,
    row_number() OVER (PARTITION BY conversation_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END,
      lower(sender_display_name), identity_id) AS position
  FROM (SELECT DISTINCT conversation_id, identity_id, sender_external_id, sender_display_name, role FROM m))
SELECT c.conversation_id, title, last_epoch, c.kind AS source_kind, 'Source ' || c.kind AS source_display_name,
  '{"is_hidden":' || (conv_id % 5 = 0) || ',"unread_count":' || (conv_id % 7) || '}' AS metadata,
  CASE WHEN conv_id % 3 = 0 THEN '{"member_count":' || (conv_id % 11) || '}' END AS "group",
  CASE WHEN conv_id % 2 = 0 THEN 'members' END AS participant_scope, conv_id % 2 = 1 AS participants_complete,
  (SELECT count(*) FROM m WHERE m.conversation_id = c.conversation_id) AS message_count,
  (SELECT count(*) FROM people p WHERE p.conversation_id = c.conversation_id) AS participant_count,
  (SELECT string_agg(concat_ws('|', position, identity_id, sender_external_id, sender_display_name, role = 'assistant',
      CASE role WHEN 'user' THEN 'owner' WHEN 'assistant' THEN 'member' ELSE 'observed' END, 'active', '{"level":' || position_of || '}'), ',' ORDER BY position)
    FROM (SELECT *, length(role) AS position_of FROM people) p WHERE p.conversation_id = c.conversation_id AND position <= 2) AS participants,
  (SELECT count(*) FROM people p WHERE p.conversation_id = c.conversation_id) > 2 AS has_more
FROM c""")
def _(v: Views):
    n = F.split("external_conversation_id", "-")[1].cast("long")
    tables = dict(v.tables)
    tables["conversations"] = tables["conversations"].withColumn(
        "raw_json",
        F.to_json(
            F.struct(
                F.struct((n % 7).alias("unread_count"), (n % 5 == 0).alias("is_hidden")).alias("metadata"),
                F.when(n % 3 == 0, F.struct((n % 11).alias("member_count"))).alias("group"),
                F.when(n % 2 == 0, "members").alias("participant_scope"), (n % 2 == 1).alias("participants_complete"),
            )
        ),
    )
    role = F.get_json_object("relation_raw", "$.role")
    level = F.when(role == "owner", 4).when(role == "member", 9).otherwise(F.lit(6))
    tables["participants"] = tables["participants"].withColumn(
        "relation_raw", F.to_json(F.struct(role.alias("role"), F.lit("active").alias("membership"), F.struct(level.alias("level")).alias("metadata")))
    )
    found = Q.conversation_details(tables, None, 0, 2)
    item = lambda x: F.concat_ws("|", *[x[c].cast("string") for c in ("position", *Q.ROSTER_ITEM)])
    return found.select(
        "conversation_id", "title", epoch("last_activity").alias("last_epoch"), "source_kind", "source_display_name", "metadata", "group",
        "participant_scope", "participants_complete", "message_count", "participant_count",
        F.array_join(F.transform("participants", item), ",").alias("participants"), "has_more",
    )


@query("attachment_provenance", "R10", """
SELECT a.attachment_id, a.message_id, a.status, a.file_name, a.source_relative_path, a.size_bytes, a.blob_sha256, b.stored_path,
  m.conversation_id, m.sent_epoch, m.kind AS source_kind, m.account AS external_account_id
FROM a JOIN m USING (message_id) LEFT JOIN b ON b.sha256 = a.blob_sha256""")
def _(v: Views):
    found = Q.attachment_provenance(v.tables)
    return found.select(
        "attachment_id", "message_id", "status", "file_name", "source_relative_path", "size_bytes", "blob_sha256",
        "stored_path", "conversation_id", epoch("sent_at").alias("sent_epoch"), "source_kind", "external_account_id",
    )


_WINDOW = "(SELECT * FROM m ORDER BY sent_epoch DESC, message_id DESC LIMIT 100)"


def _digest_counts_sql(window: str) -> str:
    return f"""
SELECT 'source' AS section, kind AS name, count(*) AS items FROM {window} w GROUP BY kind
UNION ALL (SELECT 'sender', sender_display_name, count(*) AS n FROM {window} w GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
UNION ALL SELECT 'attachment', status, count(*) FROM a WHERE message_id IN (SELECT message_id FROM {window} w) GROUP BY status"""


@query("digest_counts_page", "R11", _digest_counts_sql(_WINDOW))
def _(v: Views):
    return Q.digest_counts(Q.digest_window(v.tables), v.tables["attachments"])


@query("digest_counts_all", "R11 grouping sets", _digest_counts_sql("m"))
def _(v: Views):
    return Q.digest_counts(Q.digest_window(v.tables, whole=True), v.tables["attachments"])


_EXCERPT = """
SELECT message_id, conversation_id, excerpt_rank, greatest(total - 10, 0) AS omitted, newest AS newest_epoch,
  substr(trim(regexp_replace(coalesce(txt, '[attachment-only message]'), '\\s+', ' ', 'g')), 1, 240) AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sent_epoch DESC, message_id DESC) AS excerpt_rank,
    count(*) OVER (PARTITION BY {key}) AS total, max(sent_epoch) OVER (PARTITION BY {key}) AS newest FROM m)
LEFT JOIN (SELECT message_id, arg_min(text_content, part_index) AS txt FROM p WHERE coalesce(text_content, '') <> '' GROUP BY 1) USING (message_id)
WHERE excerpt_rank <= 10"""


@query("digest_excerpts", "R12 F5", _EXCERPT.format(key="conversation_id"))
def _(v: Views):
    found = Q.digest_excerpts(Q.digest_window(v.tables, whole=True), v.parts)
    return found.select(
        "message_id", "conversation_id", F.col("excerpt_rank").cast("long").alias("excerpt_rank"), "omitted",
        epoch("conversation_newest_at").alias("newest_epoch"), "excerpt",
    )


@query("digest_markdown_blocks", "R13", """
SELECT block, markdown FROM (
  SELECT 'header' AS block, '# Deterministic inbox digest packet' || chr(10) || chr(10) || 'This packet is derived from normalized evidence; it is not an AI summary.'
    || chr(10) || 'Messages considered: ' || count(*) || chr(10) || 'Additional messages omitted by limit: no' AS markdown FROM m
  UNION ALL
  SELECT 'sources' AS block, '## Source counts' || chr(10) || string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, kind) AS markdown
  FROM (SELECT kind, count(*) AS n FROM m GROUP BY 1)
  UNION ALL
  SELECT 'excerpts' AS block, '## Conversation excerpts' AS markdown
  UNION ALL
  SELECT conversation_id, '### ' || title || chr(10) || string_agg('- ' || strftime(to_timestamp(sent_epoch) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || ' ' || sender_display_name
      || ': ' || excerpt || ' (message_id=' || message_id || ')', chr(10) ORDER BY k)
      || CASE WHEN max(total) > 10 THEN chr(10) || '- … ' || (max(total) - 10) || ' more in selected window' ELSE '' END
  FROM (SELECT m.*, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_epoch DESC, message_id DESC) AS k,
      count(*) OVER (PARTITION BY conversation_id) AS total,
      substr(trim(regexp_replace(coalesce(txt, '[attachment-only message]'), '\\s+', ' ', 'g')), 1, 240) AS excerpt
    FROM m LEFT JOIN (SELECT message_id, arg_min(text_content, part_index) AS txt FROM p WHERE coalesce(text_content, '') <> '' GROUP BY 1) USING (message_id))
  WHERE k <= 10 GROUP BY conversation_id, title)""")
def _(v: Views):
    window = Q.digest_window(v.tables, whole=True)
    blocks = Q.digest_markdown(Q.digest_counts(window, v.tables["attachments"]), Q.digest_excerpts(window, v.parts))
    return blocks.select("block", "markdown")


@query("digest_whole_conversations", "R12 hot conversations", """
SELECT message_id, source_kind, excerpt_rank, total FROM (
  SELECT message_id, source_kind, row_number() OVER (PARTITION BY source_kind ORDER BY sent_epoch DESC, message_id DESC) AS excerpt_rank,
    count(*) OVER (PARTITION BY source_kind) AS total FROM d1) WHERE excerpt_rank <= 10""")
def _(v: Views):
    window = v.corpus.withColumn("conversation_id", F.col("source_kind"))
    parts = v.corpus.select("message_id", F.lit(0).alias("part_index"), F.col("body").alias("text_content"))
    found = Q.digest_excerpts(window, parts)
    return found.select(
        "message_id", "source_kind", F.col("excerpt_rank").cast("long").alias("excerpt_rank"),
        (F.col("omitted") + 10).alias("total"),
    )


# --- candidates -----------------------------------------------------------------------------


def _candidate_tables(v: Views) -> dict:
    """Candidates of the scan; the labels say what a reviewer decided."""
    reviewed = v.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    d = F.col("doc_id")
    rows = v.matched.filter("event_type IS NOT NULL").join(reviewed, "doc_id", "left")
    candidates = rows.select(
        "candidate_id", F.lit(TEST_RULE.id).alias("rule_id"), "event_type", "title",
        F.when(F.col("toxic") == 1, "DISMISSED").when(F.col("quality") == 0, "APPROVED").otherwise("REVIEW_REQUIRED").alias("review_status"),
        F.timestamp_seconds(1705000000 + (d % 1000) * 3600).alias("last_seen_at"),
    )
    evidence = rules.evidence_rows(v.matched)
    sources = v.corpus.select("source_id", F.col("source_kind").alias("kind"), F.col("source_kind").alias("external_account_id")).distinct()
    messages = v.corpus.select(
        "message_id", "source_id", "sent_at", F.lit("incoming").alias("direction"), F.col("chat").alias("sender_display_name"),
        F.col("chat").alias("conversation_id"),
    )
    conversations = v.corpus.select(F.col("chat").alias("conversation_id"), F.col("chat").alias("title")).distinct()
    return {"candidates": candidates, "evidence": evidence, "sources": sources, "messages": messages, "conversations": conversations}


_CANDIDATES = """
FROM (SELECT mt.*, CASE WHEN toxic = 1 THEN 'DISMISSED' WHEN quality = 0 THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS review_status,
    1705000000 + (doc_id % 1000) * 3600 AS seen_epoch
  FROM mt LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WHERE event_type IS NOT NULL) x"""


@query("candidate_listing", "R14", f"""
SELECT candidate_id, event_type, title, review_status, seen_epoch, 1::BIGINT AS evidence_count {_CANDIDATES}
WHERE review_status = 'APPROVED' AND source_kind = 'en'""")
def _(v: Views):
    found = Q.list_candidates(_candidate_tables(v), review_status="APPROVED", source_kind="en", whole=True)
    return found.select("candidate_id", "event_type", "title", "review_status", epoch("last_seen_at").alias("seen_epoch"), "evidence_count")


@query("candidate_listing_page", "R14 R7", f"""
SELECT candidate_id, event_type, seen_epoch, 1::BIGINT AS evidence_count {_CANDIDATES}
WHERE event_type = 'deadline' ORDER BY seen_epoch DESC, candidate_id DESC LIMIT 51""")
def _(v: Views):
    found = Q.list_candidates(_candidate_tables(v), event_type="deadline")
    return found.select("candidate_id", "event_type", epoch("last_seen_at").alias("seen_epoch"), "evidence_count")


@query("candidate_evidence", "R15", f"""
SELECT candidate_id, message_id, event_type, review_status, chat AS conversation_title, source_kind, sent_epoch, 'trigger' AS evidence_role {_CANDIDATES}""")
def _(v: Views):
    found = Q.candidate_evidence(_candidate_tables(v))
    return found.select(
        "candidate_id", "message_id", "event_type", "review_status", "conversation_title", "source_kind",
        epoch("sent_at").alias("sent_epoch"), "evidence_role",
    )


# --- sort and limit ---------------------------------------------------------------------------


@query("newest_conversations", "L1", """
SELECT chat, last_timestamp FROM (SELECT 'user-' || p_partkey AS chat, p_size::BIGINT * 1000 AS last_timestamp FROM part)
WHERE last_timestamp > 0 ORDER BY last_timestamp DESC, chat LIMIT 20""")
def _(v: Views):
    sessions = v.table("part").select(
        F.concat(F.lit("user-"), F.col("p_partkey")).alias("chat"), (F.col("p_size").cast("long") * 1000).alias("last_timestamp")
    )
    return resolve.newest_conversations(sessions, "last_timestamp", 20)


@query("newest_messages_per_conversation", "L2", """
SELECT chat, create_time, local_id, l_orderkey, newest_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY chat ORDER BY create_time DESC, local_id DESC, l_orderkey DESC, l_suppkey DESC) AS newest_rank FROM sh)
WHERE newest_rank <= 5""")
def _(v: Views):
    found = resolve.newest_messages(v.shards, "chat", ["create_time", "local_id", "l_orderkey", "l_suppkey"], 5)
    return found.select("chat", "create_time", "local_id", "l_orderkey", F.col("newest_rank").cast("long").alias("newest_rank"))


@query("newest_thousand_per_conversation", "L2 deep ranks in two levels", """
SELECT chat, create_time, local_id, l_orderkey, newest_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey % 5 ORDER BY create_time DESC, local_id DESC, l_orderkey DESC, l_suppkey DESC) AS newest_rank, FROM sh)
WHERE newest_rank <= 1000""")
def _(v: Views):
    # five busy conversations, each with a fifth of all messages
    rows = v.shards.withColumn("busy", F.col("l_suppkey") % 5)
    found = resolve.newest_messages(rows, "busy", ["create_time", "local_id", "l_orderkey", "l_suppkey"], 1000)
    return found.select("chat", "create_time", "local_id", "l_orderkey", F.col("newest_rank").cast("long").alias("newest_rank"))
