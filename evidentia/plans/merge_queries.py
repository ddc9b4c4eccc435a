"""Reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import merge as M
from evidentia.plans.importing import import_documents, import_into
from evidentia.plans.registry import query
from evidentia.plans.views import EPOCH, Views, text
from evidentia.session import scratch_path
from evidentia.sources import manifests
from evidentia.sources.store import Store

T1, T2 = 1788100000, 1788200000


def _batch(v: Views):
    """Two exports of every conversation: the second repeats all turns, changes the even ones
    and adds a tail."""
    c, t = F.col("conv_id"), F.col("turn")
    base = v.messages.select("conv_id", "turn", "source_id", "conversation_id", "external_message_id", "message_id", "sent_at", "raw_json")

    def shaped(df, sequence, seconds, content):
        return df.select(
            F.timestamp_seconds(F.lit(seconds)).alias("exported_at"), text(f"man-{sequence}-", c).alias("manifest_sha256"),
            F.lit(0).alias("conversation_pos"), t.alias("message_pos"), "conv_id", "turn", "source_id", "conversation_id",
            "external_message_id", "message_id", "sent_at", F.sha2(content, 256).alias("content_sha256"),
        )

    first = shaped(base, 1, T1, F.col("raw_json"))
    again = shaped(base, 2, T2, F.when(t % 2 == 0, F.concat("raw_json", F.lit("!"))).otherwise(F.col("raw_json")))
    tail = base.filter(t % 3 == 0).withColumn("turn", t + 1000).withColumn(
        "message_id", F.concat("message_id", F.lit("-tail"))
    ).withColumn("external_message_id", F.concat("external_message_id", F.lit("-tail")))
    return first.unionByName(again).unionByName(shaped(tail, 2, T2, F.col("raw_json")))


def _stored(v: Views):
    c, t = F.col("conv_id"), F.col("turn")
    content = F.when(t % 5 == 0, F.concat("raw_json", F.lit("?"))).otherwise(F.col("raw_json"))
    return v.messages.filter(c % 4 == 0).select("message_id", F.sha2(content, 256).alias("content_sha256"))


_BATCH = f""",
raw AS (SELECT *, role || '|' || text AS raw FROM m),
batch AS (
  SELECT 1 AS seq, 'man-1-' || conv_id AS manifest, turn AS pos, message_id, external_message_id, conversation_id, sha256(raw) AS sha FROM raw
  UNION ALL SELECT 2, 'man-2-' || conv_id, turn, message_id, external_message_id, conversation_id, sha256(CASE WHEN turn % 2 = 0 THEN raw || '!' ELSE raw END) FROM raw
  UNION ALL SELECT 2, 'man-2-' || conv_id, turn + 1000, message_id || '-tail', external_message_id || '-tail', conversation_id, sha256(raw) FROM raw WHERE turn % 3 = 0),
stored AS (SELECT message_id, sha256(CASE WHEN turn % 5 = 0 THEN raw || '?' ELSE raw END) AS ssha FROM raw WHERE conv_id % 4 = 0),
lab0 AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq, manifest, pos) AS k,
    first_value(sha) OVER (PARTITION BY message_id ORDER BY seq, manifest, pos) AS fsha FROM batch),
lab AS (SELECT lab0.*, CASE WHEN ssha IS NULL AND k = 1 THEN 'inserted' ELSE 'reused' END AS outcome, sha <> coalesce(ssha, fsha) AS conflict
  FROM lab0 LEFT JOIN stored USING (message_id))"""


@query("message_merge", "M2 first write wins", f"{_BATCH} SELECT manifest, message_id, outcome, conflict FROM lab")
def _(v: Views):
    labelled = M.label_messages(_batch(v), _stored(v))
    return labelled.select(F.col("manifest_sha256").alias("manifest"), "message_id", "outcome", "conflict")


@query("message_conflicts", "M3", f"""{_BATCH}
SELECT manifest, 'SOURCE_MESSAGE_CONFLICT' AS code, message_id, external_message_id AS source_message_id FROM lab WHERE outcome = 'reused' AND conflict""")
def _(v: Views):
    _, _, conflicts = M.merge_messages(_batch(v), _stored(v))
    return conflicts.withColumnRenamed("manifest_sha256", "manifest")


@query("message_merge_copies", "M2 hot ids", """
SELECT id, doc_id, outcome FROM (SELECT sha256(text) AS id, doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1
  THEN 'inserted' ELSE 'reused' END AS outcome FROM documents)""")
def _(v: Views):
    # exact copies share an id, so ids may be very hot
    batch = v.table("documents").select(
        F.lit(None).cast("timestamp").alias("exported_at"), F.lit("man").alias("manifest_sha256"), F.lit(0).alias("conversation_pos"),
        F.col("doc_id").alias("message_pos"), F.sha2("text", 256).alias("message_id"), F.sha2("text", 256).alias("content_sha256"),
    )
    return M.label_messages(batch).select(F.col("message_id").alias("id"), F.col("message_pos").alias("doc_id"), "outcome")


@query("manifest_idempotency", "M1", """
SELECT 'conv-' || conv_id AS manifest, CASE WHEN conv_id % 11 = 0 AND conv_id % 3 = 1 THEN 'new' ELSE 'already_imported' END AS decision
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def _(v: Views):
    runs = v.tables["import_runs"]
    for name in ("inserted_messages", "reused_messages", "present_attachments", "missing_attachments"):
        runs = runs.withColumn(name, F.lit(0))
    batch = v.messages.select(F.col("external_conversation_id").alias("manifest_sha256"))
    new, known = M.split_new_manifests(batch, runs)
    return new.select(F.col("manifest_sha256").alias("manifest"), F.lit("new").alias("decision")).unionByName(
        known.select(F.col("manifest_sha256").alias("manifest"), F.col("status").alias("decision"))
    )


def _conversation_batch(v: Views):
    """Conversation occurrences from orders: customer as conversation, order date as export."""
    o = F.col("o_orderkey")
    return v.table("orders").select(
        F.col("o_orderdate").cast("timestamp").alias("exported_at"), F.lpad(o.cast("string"), 12, "0").alias("manifest_sha256"),
        F.lit(0).alias("conversation_pos"), F.col("o_custkey").alias("conversation_id"), text("Title ", o).alias("title"),
        F.when(o % 3 == 0, F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (o % 100) * 86400)).alias("explicit_last_activity"),
    )


@query("attribute_upsert", "M4 last write wins", """
SELECT conversation_id, title FROM (
  SELECT o_custkey AS conversation_id, 'Title ' || o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1
UNION ALL SELECT c_custkey, 'Old title' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(v: Views):
    store = v.table("customer").select(F.col("c_custkey").alias("conversation_id"), F.lit("Old title").alias("title"))
    batch = _conversation_batch(v).drop("explicit_last_activity")
    return M.upsert_latest(batch, ["conversation_id"], M.MANIFEST_ORDER, store)


@query("last_activity", "M5 monotone maximum", """
SELECT c_custkey AS conversation_id, nullif(greatest(coalesce(st, -1), coalesce(nw, -1), CASE WHEN c_custkey % 2 = 0 THEN 1200000000 ELSE -1 END), -1) AS last_epoch
FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate)::BIGINT + (o_orderkey % 100) * 86400 END) AS st,
  max(epoch(o_orderdate)::BIGINT) AS nw FROM orders GROUP BY 1) USING (c_custkey)
WHERE c_custkey % 2 = 0 OR nw IS NOT NULL""")
def _(v: Views):
    store = v.table("customer").filter(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("conversation_id"), F.timestamp_seconds(F.lit(1200000000)).alias("last_activity")
    )
    messages = v.table("orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))
    found = M.last_activity(_conversation_batch(v), messages, store)
    return found.select("conversation_id", F.unix_seconds("last_activity").alias("last_epoch"))


@query("roster_merge", "M6 replace or merge", """,
ev AS (SELECT DISTINCT c_nationkey AS n, year(o_orderdate) AS y, c_custkey AS k FROM orders JOIN customer ON c_custkey = o_custkey),
cut AS (SELECT n, max(y) AS cy FROM ev WHERE (n + y) % 6 = 0 AND n % 5 <> 0 GROUP BY 1),
fresh AS (SELECT ev.n, k, max(y) AS y FROM ev LEFT JOIN cut USING (n) WHERE cy IS NULL OR y >= cy GROUP BY 1, 2)
SELECT n AS conversation_id, k AS identity_id, '{"role":"y' || y || '"}' AS relation_raw FROM fresh
UNION ALL SELECT c_nationkey, c_custkey, '{"role":"old"}' FROM customer WHERE c_acctbal < 0 AND c_nationkey NOT IN (SELECT n FROM cut)
  AND (c_nationkey, c_custkey) NOT IN (SELECT (n, k) FROM fresh)""".replace("(SELECT (n, k) FROM fresh)", "(SELECT n, k FROM fresh)"))
def _(v: Views):
    year = F.year("o_orderdate")
    events = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("exported_at"),
        text("man-", year).alias("manifest_sha256"), F.lit(0).alias("conversation_pos"), F.lit(0).alias("participant_pos"),
        F.col("c_nationkey").alias("conversation_id"), F.col("c_custkey").alias("identity_id"),
        text('{"role":"y', year, '"}').alias("relation_raw"),
        (((F.col("c_nationkey") + year) % 6 == 0) & (F.col("c_nationkey") % 5 != 0)).alias("participants_complete"),
    ).distinct()
    conversations = events.select(*M.MANIFEST_ORDER, "conversation_id", "participants_complete").distinct()
    store = v.table("customer").filter("c_acctbal < 0").select(
        F.col("c_nationkey").alias("conversation_id"), F.col("c_custkey").alias("identity_id"), F.lit('{"role":"old"}').alias("relation_raw")
    )
    return M.merge_roster(conversations, events, store)


@query("blob_merge", "M7", """
SELECT sha256(text) AS sha256, max(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) = 1 AS was_stored,
  CASE WHEN max(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) = 1 THEN min('docs/' || doc_id) FILTER (doc_id % 5 = 0) ELSE min('docs/' || doc_id) END AS stored_path,
  min(strlen(text))::BIGINT AS size_bytes FROM documents GROUP BY 1""")
def _(v: Views):
    d = F.col("doc_id")
    files = v.table("documents").select(
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), text("docs/", d).alias("path"), d
    )
    store = M.merge_blobs(files.filter(d % 5 == 0))
    merged = M.merge_blobs(files, store)
    known = store.select("sha256", F.lit(True).alias("was_stored"))
    return merged.join(known, "sha256", "left").withColumn("was_stored", F.coalesce("was_stored", F.lit(False)))


@query("export_dedupe", "M8", """
SELECT k AS export_key, CASE WHEN count(DISTINCT fp) > 1 THEN 'conflicting' ELSE 'kept' END AS verdict
FROM (SELECT l_orderkey || '-' || l_linenumber AS k, l_returnflag || '-' || l_linestatus AS fp FROM lineitem) GROUP BY 1""")
def _(v: Views):
    rows = v.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("export_key"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("fp")
    )
    clean, conflicting = M.dedupe_exports(rows, "export_key", "fp")
    return clean.select("export_key", F.lit("kept").alias("verdict")).unionByName(
        conflicting.select("export_key", F.lit("conflicting").alias("verdict"))
    )


def _attachments(v: Views):
    owner = v.messages.select("message_id", text("man-1-", F.col("conv_id")).alias("manifest_sha256"))
    return v.attachments.join(owner, "message_id")


@query("import_ledger", "M9", f"""{_BATCH}
SELECT lab.manifest, count(*) FILTER (outcome = 'inserted') AS inserted_messages, count(*) FILTER (outcome = 'reused') AS reused_messages,
  count(*) FILTER (outcome = 'reused' AND conflict) AS conflicts,
  coalesce((SELECT count(*) FROM a JOIN m USING (message_id) WHERE 'man-1-' || conv_id = lab.manifest AND status = 'present'), 0) AS present_attachments,
  coalesce((SELECT count(*) FROM a JOIN m USING (message_id) WHERE 'man-1-' || conv_id = lab.manifest AND status = 'missing'), 0) AS missing_attachments
FROM lab GROUP BY lab.manifest""")
def _(v: Views):
    labelled = M.label_messages(_batch(v), _stored(v))
    return M.import_run_metrics(_batch(v), labelled, _attachments(v)).withColumnRenamed("manifest_sha256", "manifest")


@query("import_warning_counts", "M10 M3 C7", f"""{_BATCH}
SELECT code, count(*) AS warnings FROM (
  SELECT 'SOURCE_MESSAGE_CONFLICT' AS code FROM lab WHERE outcome = 'reused' AND conflict
  UNION ALL SELECT 'ATTACHMENT_MISSING' FROM a WHERE status = 'missing') GROUP BY 1""")
def _(v: Views):
    _, _, conflicts = M.merge_messages(_batch(v), _stored(v))
    return M.warning_counts(M.import_warnings(conflicts, _attachments(v)), [])


@query("warning_code_defaults", "M10", """
SELECT user_id AS run, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'UNKNOWN') AS code, count(*) AS warnings FROM events GROUP BY 1, 2""")
def _(v: Views):
    rows = v.table("events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("code"))
    return M.warning_counts(rows, ["run"])


@query("resume_decisions", "M11", """
SELECT k AS output_id, CASE WHEN k % 13 = 0 THEN 'ORPHAN_RECEIPT' WHEN k % 7 = 0 AND k % 2 = 0 THEN 'REJECT_UNTRUSTED_EXPORT' WHEN k % 7 = 0 THEN 'NEW'
  WHEN k % 11 = 1 THEN 'REJECT_SCHEMA' WHEN k % 11 = 2 THEN 'REJECT_GENERATION' WHEN k % 11 = 3 THEN 'REJECT_FINGERPRINT'
  WHEN k % 11 = 4 THEN 'REJECT_CONFIGURATION' WHEN k % 11 = 5 THEN 'REJECT_MANIFEST' ELSE 'RESUME' END AS decision
FROM (SELECT o_orderkey AS k FROM orders) WHERE NOT (k % 13 = 0 AND k % 7 = 0)""")
def _(v: Views):
    k = F.col("o_orderkey")
    orders = v.table("orders")

    def check(name: str, rest: int):
        return F.when(k % 11 == rest, F.lit("other")).otherwise(text(f"{name}-", k))

    receipts = orders.filter(k % 7 != 0).select(
        k.alias("output_id"), F.when(k % 11 == 1, "old").otherwise("v1").alias("schema"),
        check("gen", 2).alias("generation_id"), check("fp", 3).alias("fingerprint_token"),
        check("cfg", 4).alias("configuration_sha256"), check("man", 5).alias("manifest_sha256"),
    )
    current = orders.filter(k % 13 != 0).select(
        k.alias("output_id"), text("gen-", k).alias("generation_id"), text("fp-", k).alias("fingerprint_token"),
        text("cfg-", k).alias("configuration_sha256"),
        F.when((k % 7 != 0) | (k % 2 == 0), text("man-", k)).alias("manifest_sha256"),
    )
    return M.resume_decisions(receipts, current, schema="v1")


# --- documents ------------------------------------------------------------------------------


def raw_documents(v: Views, sequence: int = 1, damaged: bool = False, per_document: int = 1, renamed: bool = False):
    """Nested export documents built from the conversations, at most 200 turns each.

    The second sequence repeats the even conversations with changed even turns. ``damaged``
    plants one defect per group of conversations. ``renamed`` gives other titles, and rosters of users only.
    """
    c, t = F.col("conv_id"), F.col("turn")
    m = v.messages
    if sequence == 2:
        m = m.filter(c % 2 == 0)

    def part(p):
        is_text = p["part_type"] == "text"
        body = F.when((t % 2 == 0) & F.lit(sequence == 2), F.concat(p["text_content"], F.lit("!"))).otherwise(p["text_content"])
        kind, path = p["part_type"], p["path"]
        if damaged:
            kind = F.when((c % 10 == 5) & is_text, "hologram").otherwise(kind)
            path = F.when((c % 10 == 4) & path.isNotNull(), F.concat(F.lit("../"), path)).otherwise(path)
        return F.struct(
            kind.alias("type"), F.when(is_text, body).alias("text"), path.alias("path"), p["file_name"].alias("file_name"),
            p["mime_type"].alias("mime_type"), F.when(~is_text, p["text_content"]).alias("transcription"),
        )

    stamp = F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when((c % 10 == 1) & (t == 0), "").otherwise("Z") if damaged else F.lit("Z")
    direction = F.when(c % 10 == 2, "sideways").otherwise(F.col("direction")) if damaged else F.col("direction")
    message = F.struct(
        t.alias("pos"),
        F.struct(
            F.col("external_message_id").alias("source_message_id"), F.concat(stamp, zone).alias("timestamp"),
            F.col("sender_external_id").alias("sender_id"), F.col("sender_display_name").alias("sender_name"),
            direction.alias("direction"), F.transform("parts", part).alias("parts"),
        ).alias("body"),
    )
    member = F.struct(
        F.col("sender_external_id").alias("source_identity_id"), F.col("sender_display_name").alias("display_name"),
        (F.col("role") == "assistant").alias("is_self"),
    )
    chunks = m.groupBy("conv_id", F.floor(t / 200).alias("chunk"), "kind", "account", "external_conversation_id").agg(
        F.array_sort(F.collect_list(message)).alias("items"), F.array_sort(F.collect_set(member)).alias("members")
    )
    title = text("Topic ", c % 50)
    title = F.when(c % 10 == 3, " ").otherwise(title) if damaged else title
    title = text("Renamed ", c % 50) if renamed else title
    members = F.filter("members", lambda x: x["source_identity_id"].startswith("user")) if renamed else F.col("members")
    version = F.when(c % 10 == 6, "bad").otherwise("evidence-import/v1") if damaged else F.lit("evidence-import/v1")
    conversation = F.struct(
        F.col("external_conversation_id").alias("source_conversation_id"), title.alias("title"),
        F.when(c % 2 == 0, "single").otherwise("group").alias("type"), (c % 4 == 0).alias("participants_complete"),
        members.alias("participants"), F.transform("items", lambda x: x["body"]).alias("messages"),
    )
    # conversations of one source (ids that agree modulo 3) share a document, chunk by chunk
    doc = F.concat_ws("-", F.lit(sequence), "kind", F.floor(c / (3 * per_document)), "chunk") if per_document > 1 else F.concat_ws(
        "-", F.lit(sequence), "conv_id", "chunk"
    )
    rows = chunks.select(
        doc.alias("doc"), "kind", "account", version.alias("version"), F.struct("conv_id", conversation.alias("body")).alias("item")
    )
    if per_document > 1:
        rows = rows.groupBy("doc", "kind", "account", "version").agg(F.array_sort(F.collect_list("item")).alias("items"))
    else:
        rows = rows.withColumn("items", F.array("item"))
    document = F.to_json(
        F.struct(
            F.col("version").alias("schema_version"), F.lit(f"2026-09-0{sequence}T00:00:00Z").alias("exported_at"),
            F.struct(F.col("kind"), F.col("account").alias("account_id"), F.concat(F.lit("Source "), F.col("kind")).alias("display_name")).alias("source"),
            F.transform("items", lambda x: x["body"]).alias("conversations"),
        )
    )
    return rows.select("doc", text("/export/", F.col("doc"), ".json").alias("path"), document.alias("content"))


def documents(v: Views, sequence: int = 1, damaged: bool = False, renamed: bool = False):
    return manifests.parse_documents(raw_documents(v, sequence, damaged, renamed=renamed).select("path", "content"))


_IMPORT = f"""
SELECT conv_id || '-' || 1 AS document, count(*) AS inserted_messages, 0::BIGINT AS reused_messages, 0::BIGINT AS conflicts FROM m GROUP BY conv_id
UNION ALL SELECT conv_id || '-' || 2, 0, count(*), count(*) FILTER (turn % 2 = 0) FROM m WHERE conv_id % 2 = 0 GROUP BY conv_id"""


@query("import_end_to_end", "S1 S2 V1 M1-M9 plan", f"""
SELECT inserted_messages, reused_messages, conflicts, count(*) AS documents FROM ({_IMPORT}) GROUP BY ALL""")
def _(v: Views):
    docs = documents(v, 1).unionByName(documents(v, 2))
    result = import_documents(docs, v.files, F.timestamp_seconds(F.lit(EPOCH)))
    return result.runs.groupBy("inserted_messages", "reused_messages", "conflicts").agg(F.count("*").alias("documents"))


def _stored_rows(tables):
    """Rows of the store's tables in one shape: name, id, owner, label, body, number."""
    none = F.lit(None).cast("string")
    shapes = {
        "messages": ("message_id", "conversation_id", F.concat_ws("|", "sender_display_name", "direction", "external_message_id"), F.sha2("search_body", 256), F.unix_seconds("sent_at")),
        "conversations": ("conversation_id", "source_id", "title", F.concat_ws("|", "conversation_type", "external_conversation_id"), F.unix_seconds("last_activity")),
        "participants": ("conversation_id", "identity_id", none, none, F.lit(0)),
        "identities": ("identity_id", "source_id", "display_name", "external_identity_id", F.col("is_self").cast("int")),
        "blobs": ("sha256", none, "stored_path", none, "size_bytes"),
        "sources": ("source_id", "kind", "external_account_id", "display_name", F.lit(0)),
    }
    names = ("id", "owner", "label", "body", "number")
    rows = None
    for name, columns in shapes.items():
        columns = [(F.col(x) if isinstance(x, str) else x) for x in columns]
        columns[-1] = columns[-1].cast("long")
        part = tables[name].select(F.lit(name).alias("name"), *[x.alias(n) for x, n in zip(columns, names, strict=True)])
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("import_second_batch", "M2 M4 M5 M6 M7 S8 into a store", """
SELECT 'messages' AS name, message_id AS id, conversation_id AS owner, concat_ws('|', sender_display_name, direction, external_message_id) AS label,
  sha256(search_body) AS body, sent_epoch::BIGINT AS number FROM m JOIN body USING (message_id)
UNION ALL SELECT 'conversations', conversation_id, source_id, CASE WHEN conv_id % 2 = 0 THEN 'Renamed ' ELSE 'Topic ' END || (conv_id % 50),
  conversation_type || '|' || external_conversation_id, last_epoch FROM c
UNION ALL SELECT DISTINCT 'participants', conversation_id, identity_id, NULL, NULL, 0 FROM m WHERE conv_id % 4 <> 0 OR role = 'user'
UNION ALL SELECT DISTINCT 'identities', identity_id, source_id, sender_display_name, sender_external_id, (role = 'assistant')::INT FROM m
UNION ALL SELECT 'blobs', sha256, NULL, stored_path, NULL, size_bytes FROM b WHERE sha256 IN (SELECT blob_sha256 FROM a)
UNION ALL SELECT 'sources', source_id, kind, account, display_name, 0 FROM s""")
def _(v: Views):
    root = scratch_path(v.spark, "store")
    as_of = F.timestamp_seconds(F.lit(EPOCH))
    import_into(v.spark, root, documents(v, 1), v.files, as_of)
    import_into(v.spark, root, documents(v, 2, renamed=True), v.files, as_of)
    return _stored_rows(Store(v.spark, root))


@query("imported_attachments", "C7 S2 M7", """
SELECT attachment_id, message_id, part_index, file_name, mime_type, source_relative_path, status, size_bytes, blob_sha256 FROM a""")
def _(v: Views):
    result = import_documents(documents(v, 1), v.files, F.timestamp_seconds(F.lit(EPOCH)))
    return result.tables["attachments"].drop("raw_json")


@query("sender_links", "J14", "SELECT message_id, identity_id AS sender_identity_id FROM m")
def _(v: Views):
    flat = manifests.flatten_manifests(documents(v, 1))
    return flat["messages"].select("message_id", "sender_identity_id")
