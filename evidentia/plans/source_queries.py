"""Scans, sinks and contract checks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from evidentia.operators import validate
from evidentia.operators.resolve import adapter_summary, session_gaps
from evidentia.plans import adapting
from evidentia.plans.content_queries import json_bodies
from evidentia.plans.merge_queries import documents, raw_documents
from evidentia.plans.registry import query
from evidentia.plans.views import TEST_RULE, Views, text
from evidentia.session import scratch_path, stage
from evidentia.sources import files, group_exports, manifests, shards, store
from evidentia.streaming import heartbeats, jobs


def _written_documents(v: Views, sequence: int = 1) -> str:
    """Documents of at most 20 conversations as files, one text file per document."""
    path = scratch_path(v.spark, "exports")
    raw = raw_documents(v, sequence, per_document=20)
    raw.select("doc", "content").repartition("doc").write.partitionBy("doc").text(path)
    return path


@query("manifest_scan", "S1", "SELECT conv_id, count(*) AS messages FROM m GROUP BY 1")
def _(v: Views):
    docs = manifests.read_manifests(v.spark, _written_documents(v), "*.txt")
    conversations = manifests.conversation_rows(docs)
    return conversations.select(
        F.substring("external_conversation_id", 6, 20).cast("long").alias("conv_id"),
        F.size(F.try_variant_get("conversation", "$.messages", "array<variant>")).cast("long").alias("messages"),
    )


@query("manifest_flatten_messages", "S2 C6 F1 F3", """
SELECT m.message_id, m.conversation_id, m.source_id, sender_display_name, direction, sent_epoch, sha256(search_body) AS body_sha256 FROM m JOIN body USING (message_id)""")
def _(v: Views):
    flat = manifests.flatten_manifests(documents(v))
    return flat["messages"].select(
        "message_id", "conversation_id", "source_id", "sender_display_name", "direction",
        F.unix_seconds("sent_at").alias("sent_epoch"), F.sha2("search_body", 256).alias("body_sha256"),
    )


@query("manifest_flatten_parts", "S2 posexplode", """
SELECT message_id, part_index, part_type, text_content, file_name, path, attachment_id,
  'prt_' || substr(sha256(message_id || chr(0) || part_index), 1, 24) AS part_id FROM p""")
def _(v: Views):
    flat = manifests.flatten_manifests(documents(v))
    return flat["parts"].select("message_id", "part_index", "part_type", "text_content", "file_name", "path", "attachment_id", "part_id")


@query("manifest_flatten_participants", "S2", """
SELECT DISTINCT conversation_id, identity_id, sender_external_id AS external_identity_id, sender_display_name AS display_name, role = 'assistant' AS is_self FROM m""")
def _(v: Views):
    flat = manifests.flatten_manifests(documents(v))
    return flat["participants"].select("conversation_id", "identity_id", "external_identity_id", "display_name", "is_self")


@query("manifest_export", "S1 S9 L6 round trip", """
SELECT m.message_id, m.conversation_id, sent_epoch, sha256(search_body) AS body_sha256 FROM m JOIN body USING (message_id)""")
def _(v: Views):
    flat = manifests.flatten_manifests(documents(v))
    sources = flat["sources"].select("source_id", "kind", "external_account_id", "display_name").distinct()
    conversations = flat["conversations"].dropDuplicates(["conversation_id"])
    written = manifests.build_manifests(
        sources, conversations, flat["participants"], flat["messages"], "evidence-import/v1", rows_per_document=3
    )
    path = scratch_path(v.spark, "lines")
    manifests.write_manifest_lines(written, path)
    again = manifests.read_manifest_lines(v.spark, path)
    rows = manifests.flatten_manifests(again)["messages"]
    return rows.select(
        "message_id", "conversation_id", F.unix_seconds("sent_at").alias("sent_epoch"), F.sha2("search_body", 256).alias("body_sha256")
    )


@query("contract_validation", "V1 V2", """
SELECT problem, n AS found FROM (
  SELECT 'timestamp_not_instant' AS problem, count(*) AS n FROM m WHERE conv_id % 10 = 1 AND turn = 0
  UNION ALL SELECT 'direction_unsupported', count(*) FROM m WHERE conv_id % 10 = 2
  UNION ALL SELECT 'title_missing', count(DISTINCT conv_id) FROM m WHERE conv_id % 10 = 3
  UNION ALL SELECT 'path_unsafe', count(*) FROM p JOIN m USING (message_id) WHERE m.conv_id % 10 = 4 AND path IS NOT NULL
  UNION ALL SELECT 'part_type_unsupported', count(*) FROM p JOIN m USING (message_id) WHERE m.conv_id % 10 = 5 AND part_type = 'text'
  UNION ALL SELECT 'schema_version_unsupported', count(DISTINCT conv_id) FROM m WHERE conv_id % 10 = 6) WHERE n > 0""")
def _(v: Views):
    return validate.manifest_problems(documents(v, 1, True)).groupBy("problem").agg(F.count("*").alias("found"))


@query("contract_rejection", "V1 whole document", """
SELECT external_conversation_id FROM c WHERE NOT (conv_id % 10 IN (2, 3, 6) OR (conv_id % 10 = 1 AND conv_id IN (SELECT conv_id FROM m WHERE turn = 0))
  OR (conv_id % 10 = 4 AND conv_id IN (SELECT m.conv_id FROM p JOIN m USING (message_id) WHERE path IS NOT NULL))
  OR (conv_id % 10 = 5))""")
def _(v: Views):
    good, _ = validate.split_valid(documents(v, 1, True))
    return manifests.conversation_rows(good).select("external_conversation_id")


# --- group exports --------------------------------------------------------------------------


def _group_documents(v: Views):
    """Group exports from the conversations; the user of each is the exporting account."""
    c, t = F.col("conv_id"), F.col("turn")
    resource = F.struct(
        F.when(t % 3 == 0, "image").when(t % 3 == 1, "file").otherwise("sticker").alias("type"),
        text("pic ", t, "?.jpg").alias("filename"), F.when(t % 4 == 0, text("res/", t, ".jpg")).alias("localPath"),
    )
    message = F.struct(
        t.alias("pos"),
        F.struct(
            text("m", t).alias("id"), ((1788048000 + (c % 10000) * 3600 + t * 60) * 1000).alias("timestamp"),
            F.struct(text("uid-", F.col("role")).alias("uid"), F.col("role").alias("name")).alias("sender"),
            (F.col("role") == "system").alias("system"),
            F.struct(
                F.when(t % 5 != 4, F.col("text")).alias("text"), F.when(t % 2 == 0, F.array(resource)).otherwise(F.array().cast("array<struct<type:string,filename:string,localPath:string>>")).alias("resources")
            ).alias("content"),
        ).alias("body"),
    )
    grouped = v.table("conversations").groupBy("conv_id", F.floor(t / 200).alias("chunk")).agg(F.array_sort(F.collect_list(message)).alias("items"))
    return grouped.select(
        text("/export/", c, ".json").alias("path"),
        F.to_json(
            F.struct(
                F.struct(
                    F.when(c % 9 == 8, "private").otherwise("group").alias("type"), text("Group ", c).alias("name"),
                    text("peer-", c).alias("peerUid"), (c + 5000).alias("peerUin"), F.lit("uid-user").alias("selfUid"),
                ).alias("chatInfo"),
                F.transform("items", lambda x: x["body"]).alias("messages"),
            )
        ).alias("content"),
    )


_GROUP = """
SELECT 'group:peer-' || conv_id || ':m' || turn AS external_message_id, 'group:peer-' || conv_id AS external_conversation_id,
  1788048000 + (conv_id % 10000) * 3600 + turn * 60 AS sent_epoch,
  CASE WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'outgoing' ELSE 'incoming' END AS direction,
  greatest(CASE WHEN turn % 5 <> 4 AND text <> '' THEN 1 ELSE 0 END + CASE WHEN turn % 2 = 0 AND turn % 3 <> 2 THEN 1 ELSE 0 END, 1)::BIGINT AS part_count
FROM conversations WHERE conv_id % 9 <> 8"""


@query("group_export_scan", "S3 C5 J7", _GROUP)
def _(v: Views):
    docs = group_exports.parse_group_exports(_group_documents(v))
    bad = group_exports.export_problems(docs).select("path")
    rows = group_exports.group_messages(docs.join(bad, "path", "left_anti"))
    return rows.select(
        "external_message_id", "external_conversation_id", F.unix_seconds("sent_at").alias("sent_epoch"), "direction",
        F.size("parts").cast("long").alias("part_count"),
    )


@query("group_export_problems", "S3 V3", "SELECT '/export/' || conv_id || '.json' AS path, 'not_a_group_export' AS problem FROM c WHERE conv_id % 9 = 8")
def _(v: Views):
    return group_exports.export_problems(group_exports.parse_group_exports(_group_documents(v)))


@query("group_export_window", "V4 half-open", _GROUP + """
  AND 1788048000 + (conv_id % 10000) * 3600 + turn * 60 >= 1788055200 AND 1788048000 + (conv_id % 10000) * 3600 + turn * 60 < 1788141600""")
def _(v: Views):
    docs = group_exports.parse_group_exports(_group_documents(v)).filter("chat_type = 'group'")
    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    rows = group_exports.group_messages(docs, at(1788055200), at(1788141600))
    return rows.select(
        "external_message_id", "external_conversation_id", F.unix_seconds("sent_at").alias("sent_epoch"), "direction",
        F.size("parts").cast("long").alias("part_count"),
    )


@query("group_export_dedupe", "M8 S3", _GROUP.replace("SELECT 'group:peer-' || conv_id || ':m' || turn AS external_message_id, ", "SELECT DISTINCT 'group:peer-' || conv_id || ':m' || turn AS external_message_id, "))
def _(v: Views):
    docs = group_exports.parse_group_exports(_group_documents(v)).filter("chat_type = 'group'")
    clean, _ = group_exports.dedupe_group_messages(group_exports.group_messages(docs.unionByName(docs)))
    return clean.select(
        "external_message_id", "external_conversation_id", F.unix_seconds("sent_at").alias("sent_epoch"), "direction",
        F.size("parts").cast("long").alias("part_count"),
    )


@query("allowlist_filter", "V3", """
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_name IN (SELECT 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier)""")
def _(v: Views):
    ids = v.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("allowed_id")).unionByName(
        v.table("supplier").select(text("Customer#", F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("allowed_id"))
    )
    rows = v.table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("uin"), "c_name")
    return validate.filter_allowlist(rows, ids, ["uin", "c_name"]).select("c_custkey")


@query("time_window", "V4 pushdown", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'")
def _(v: Views):
    at = lambda y, m: datetime(y, m, 1, tzinfo=timezone.utc)
    return validate.filter_window(v.table("orders"), "o_orderdate", at(1996, 1), at(1997, 7)).select("o_orderkey")


@query("file_agreement", "V5", """
SELECT c_nationkey, 'c_mktsegment' AS disagrees_on FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def _(v: Views):
    return validate.check_agreement(v.table("customer"), "c_nationkey", ["c_mktsegment", "c_nationkey"])


@query("path_safety", "V2", """
SELECT page_id, page_id % 6 IN (1, 3) AS escapes_root, page_id % 6 IN (1, 2, 3, 4, 5) AS unsafe_path FROM pages""")
def _(v: Views):
    n = F.col("page_id")
    path = (
        F.when(n % 6 == 0, text("media/./", n, ".bin")).when(n % 6 == 1, text("/abs/", n)).when(n % 6 == 2, text("a/../b/", n))
        .when(n % 6 == 3, text("a/../../b/", n)).when(n % 6 == 4, text("a\\", n)).otherwise(F.lit("./"))
    )
    return validate.with_path_safety(v.table("pages").select("page_id", path.alias("path")), "path").drop("path")


@query("store_audit", "V6", """
SELECT 'fk:parts.message_id' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'fk:attachments.message_id', 0 UNION ALL SELECT 'fk:attachments.blob_sha256', 0
UNION ALL SELECT 'fk:parts.attachment_id', 0 UNION ALL SELECT 'fk:messages.source_id', 0 UNION ALL SELECT 'fk:messages.conversation_id', (SELECT count(*) FROM m WHERE conv_id % 13 = 0)
UNION ALL SELECT 'fk:conversations.source_id', 0 UNION ALL SELECT 'fk:import_runs.source_id', 0 UNION ALL SELECT 'fk:identities.source_id', 0
UNION ALL SELECT 'fk:participants.identity_id', 0 UNION ALL SELECT 'fk:participants.conversation_id', (SELECT count(*) FROM (SELECT DISTINCT conversation_id, identity_id FROM m WHERE conv_id % 13 = 0))
UNION ALL SELECT 'unique:sources(kind,external_account_id)', 0 UNION ALL SELECT 'unique:identities(source_id,external_identity_id)', 0
UNION ALL SELECT 'unique:conversations(source_id,external_conversation_id)', 0 UNION ALL SELECT 'unique:participants(conversation_id,identity_id)', 0
UNION ALL SELECT 'unique:messages(source_id,external_message_id)', 0 UNION ALL SELECT 'unique:attachments(message_id,part_index)', 0
UNION ALL SELECT 'unique:parts(message_id,part_index)', (SELECT count(*) FROM p WHERE part_index = 1) UNION ALL SELECT 'unique:blobs(sha256)', 0
UNION ALL SELECT 'values:conversations.conversation_type', 0 UNION ALL SELECT 'values:messages.direction', 0 UNION ALL SELECT 'values:attachments.status', 0
UNION ALL SELECT 'values:parts.part_type', 0""")
def _(v: Views):
    t = {name: v.tables[name] for name in v.tables if name != "heartbeats"}
    gone = F.col("external_conversation_id").substr(6, 20).cast("long") % 13 == 0
    t["conversations"] = t["conversations"].filter(~gone)
    t["parts"] = t["parts"].unionByName(t["parts"].filter("part_index = 1"))
    t["messages"] = t["messages"].drop("sender_identity_id")
    return validate.audit_store(t)


# --- adapters -----------------------------------------------------------------------------------


@query("group_export_adapter", "S3 V3 J7 J10 H19 adapter", """
SELECT 'group:peer-' || conv_id AS external_conversation_id, count(*) AS messages, count(*) FILTER (role = 'user') AS outgoing, count(*) FILTER (role = 'assistant') AS incoming,
  count(*) FILTER (role = 'system') AS system, (SELECT count(DISTINCT r) FROM (SELECT role AS r FROM conversations i WHERE i.conv_id = o.conv_id UNION ALL SELECT 'user')) AS participants
FROM conversations o WHERE conv_id % 9 <> 8 AND conv_id % 2 = 0 GROUP BY conv_id""")
def _(v: Views):
    docs = group_exports.parse_group_exports(_group_documents(v))
    c = F.col("conv_id")
    allowed = v.table("conversations").filter(c % 2 == 0).select(text("peer-", c).alias("allowed_id"))
    export = adapting.adapt_group_exports(docs, allowed, "acct", "Own account")
    people = export.participants.groupBy("conversation_id").agg(F.count("*").alias("participants"))
    counts = adapter_summary(export.messages, ["conversation_id", "external_conversation_id"])
    return counts.join(people, "conversation_id").select(
        "external_conversation_id", "messages", "outgoing", "incoming", "system", "participants"
    )


@query("group_export_rejections", "S3 V3", """
SELECT DISTINCT '/export/' || conv_id || '.json' AS path, CASE WHEN conv_id % 9 = 8 THEN 'not_a_group_export' ELSE 'not_allowed' END AS problem
FROM conversations WHERE conv_id % 9 = 8 OR conv_id % 2 = 1""")
def _(v: Views):
    docs = group_exports.parse_group_exports(_group_documents(v))
    c = F.col("conv_id")
    allowed = v.table("conversations").filter(c % 2 == 0).select(text("peer-", c).alias("allowed_id"))
    return adapting.adapt_group_exports(docs, allowed, "acct", "Own account").problems.select("path", "problem").distinct()


@query("group_export_conflicts", "S3 M8 V3", """
SELECT 'group:peer-' || conv_id || ':m' || turn AS external_message_id, '/export/' || conv_id || s AS path, CASE WHEN s = '.json' THEN 'uid-assistant' ELSE 'uid-other' END AS sender
FROM conversations, (VALUES ('.json'), ('.json-2')) AS f(s) WHERE conv_id % 9 <> 8 AND role = 'assistant'""")
def _(v: Views):
    """A second file of each group names another sender for the assistant's messages."""
    raw = _group_documents(v)
    edited = raw.select(
        F.concat("path", F.lit("-2")).alias("path"), F.replace(F.col("content").cast("string"), F.lit('"uid-assistant"'), F.lit('"uid-other"')).alias("content")
    )
    docs = group_exports.parse_group_exports(raw.select("path", F.col("content").cast("string")).unionByName(edited))
    allowed = v.table("conversations").select(text("peer-", F.col("conv_id")).alias("allowed_id"))
    found = adapting.adapt_group_exports(docs, allowed, "acct", "Own account").problems.filter("problem = 'conflicting_content'")
    return found.select("external_message_id", "path", F.get_json_object("raw_json", "$.sender.uid").alias("sender"))


@query("sharded_export_adapter", "S4 J1 J3 J5 J7 J10 C1 C2 adapter", """
SELECT chat AS external_conversation_id, count(*) AS messages, count(*) FILTER (username = 'Supplier#000000007') AS outgoing,
  count(*) FILTER (username <> 'Supplier#000000007') AS incoming, count(*) FILTER (username IS NULL) AS unknown,
  count(*) FILTER (local_type & 4294967295 = 1) AS texts, count(*) FILTER (local_type & 4294967295 IN (3, 47)) AS images
FROM sh LEFT JOIN nm USING (shard, sender_row) WHERE chat IN (SELECT 'user-' || p_partkey FROM part WHERE p_size > 5) GROUP BY 1""")
def _(v: Views):
    rows = v.shards.drop("chat").withColumns(
        {"sort_seq": F.lit(0), "message_content": F.encode(text("body ", F.col("l_orderkey")), "UTF-8"), "content_type": F.lit(0)}
    )
    sessions = v.table("part").filter("p_size > 5").select(
        text("user-", F.col("p_partkey")).alias("chat"), (F.col("p_size").cast("long") * 1000).alias("last_timestamp")
    )
    contacts = v.table("supplier").select(
        F.col("s_name").alias("username"), F.col("s_suppkey").alias("member_id"), F.lit("").alias("remark"),
        F.col("s_name").alias("nick_name"), F.lit(None).cast("string").alias("alias"),
    )
    titles = sessions.select("chat", F.lit("").alias("session_title"))
    tables = adapting.ShardedTables(rows, sessions, titles, contacts, v.name_map)
    messages = adapting.adapt_sharded(tables, "Supplier#000000007").messages
    kind = F.col("parts")[0]["type"]
    counts = messages.groupBy("external_conversation_id").agg(
        F.count("*").alias("messages"), *[F.count_if(F.col("direction") == d).alias(d) for d in ("outgoing", "incoming", "unknown")],
        F.count_if(kind == "text").alias("texts"), F.count_if(kind == "image").alias("images"),
    )
    return counts


@query("keyed_export_adapter", "S5 J7 C4 F4 adapter", """
SELECT 'c' || o_custkey AS external_conversation_id, count(*) AS messages, count(*) FILTER (o_orderkey % 7 = 3) AS outgoing,
  count(*) FILTER (o_orderkey % 7 NOT IN (0, 3)) AS incoming, count(*) FILTER (o_orderkey % 7 = 0) AS unknown,
  count(*) FILTER (o_orderkey % 5 IN (0, 3)) AS texts, max(epoch(o_orderdate))::BIGINT AS newest_epoch
FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1""")
def _(v: Views):
    k = F.col("o_orderkey")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    bodies = json_bodies(v).select(F.col("local_id").alias("o_orderkey"), F.col("content_type").alias("contentType"), "content")
    rows = v.table("orders").join(bodies, "o_orderkey").select(
        text("tbmsg_", F.lpad((k % 128).cast("string"), 3, "0")).alias("table_name"), text("p", k).alias("primaryKey"),
        text("c", F.col("o_custkey")).alias("cid"), k.alias("localId"), F.when(k % 2 == 0, text("m", k)).alias("mid"),
        F.when(k % 7 != 0, (k % 7).cast("string")).alias("senderId"), F.when(k % 2 == 0, seconds).otherwise(seconds * 1000).alias("createdAt"),
        "contentType", "content", F.lit(1).alias("messageStatus"), F.lit(0).alias("recallStatus"), F.lit("{}").alias("extension"),
    )
    c = F.col("c_custkey")
    conversations = v.table("customer").filter(c % 3 != 0).select(
        text("c", c).alias("cid"), F.lit(2).alias("type"), F.col("c_name").alias("title"), F.lit(3).alias("memberCount"),
        c.alias("lastModify"), c.alias("createAt"), F.lit(0).alias("unreadCount"),
    )
    profiles = v.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("username"), F.col("s_name").alias("alias"), F.lit("").alias("nick"), F.lit("").alias("real_name")
    )
    messages = adapting.adapt_keyed(rows, conversations, profiles, "acct", "3").messages
    kind = F.col("parts")[0]["type"]
    return messages.groupBy("external_conversation_id").agg(
        F.count("*").alias("messages"), *[F.count_if(F.col("direction") == d).alias(d) for d in ("outgoing", "incoming", "unknown")],
        F.count_if(kind == "text").alias("texts"), F.max(F.unix_seconds("sent_at")).alias("newest_epoch"),
    )


# --- shards -----------------------------------------------------------------------------------


@query("shard_scan_md5", "S4 F7 F8", """
SELECT shard, chat, count(*) AS rows, sum(local_type & 4294967295)::BIGINT AS type_sum FROM sh WHERE chat IN (SELECT 'user-' || p_partkey FROM part WHERE p_size % 2 = 0) GROUP BY 1, 2""")
def _(v: Views):
    sessions = v.table("part").filter("p_size % 2 = 0").select(text("user-", F.col("p_partkey")).alias("chat"))
    rows = shards.scan_shards_md5(v.shards.drop("chat"), sessions)
    return rows.groupBy("shard", "chat").agg(F.count("*").alias("rows"), F.sum("base_type").alias("type_sum"))


@query("shard_missing_tables", "S4 anti join", "SELECT 'user-' || p_partkey AS chat FROM part WHERE 'user-' || p_partkey NOT IN (SELECT chat FROM sh)")
def _(v: Views):
    sessions = v.table("part").select(text("user-", F.col("p_partkey")).alias("chat"))
    return session_gaps(sessions, v.shards.select("table_name")).select("chat")


@query("shard_scan_keyed", "S5", "SELECT chat AS cid, shard, count(*) AS rows FROM sh WHERE chat IN (SELECT 'user-' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2")
def _(v: Views):
    chosen = v.table("orders").filter("o_orderpriority = '1-URGENT'").select(text("user-", F.col("o_custkey")).alias("cid")).distinct()
    rows = shards.scan_shards_keyed(v.shards.withColumnRenamed("chat", "cid"), chosen)
    return rows.groupBy("cid", "shard").agg(F.count("*").alias("rows"))


@query("sharded_message_ids", "F1 ids of shards", """
SELECT shard || ':' || table_name || ':' || local_id || ':' || server_id || ':' || create_time AS sharded_id,
  chat || ':' || CASE WHEN l_suppkey % 3 = 0 THEN 'tbmsg:' || l_orderkey || ':' || local_id ELSE 'mid' || l_orderkey END AS keyed_id, count(*) AS rows FROM sh GROUP BY 1, 2""")
def _(v: Views):
    a = v.shards.select(shards.message_id_sharded().alias("sharded_id"), "*")
    b = a.withColumn("cid", F.col("chat")).withColumn("table_name", F.lit("tbmsg")).withColumn("primaryKey", F.col("l_orderkey")).withColumn(
        "localId", F.col("local_id")
    ).withColumn("mid", F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise(text("mid", F.col("l_orderkey"))))
    return b.select("sharded_id", shards.message_id_keyed().alias("keyed_id")).groupBy("sharded_id", "keyed_id").agg(F.count("*").alias("rows"))


@query("shard_partition_read", "S4 S5 partition columns", "SELECT shard, count(*) AS rows, max(create_time) AS newest FROM sh WHERE shard IN ('message_1.db', 'message_3.db') GROUP BY 1")
def _(v: Views):
    path = scratch_path(v.spark, "shards")
    v.shards.write.partitionBy("shard").parquet(path)
    rows = shards.read_shards(v.spark, path).filter(F.col("shard").isin("message_1.db", "message_3.db"))
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.max("create_time").alias("newest"))


# --- files ------------------------------------------------------------------------------------


def _written_pages(v: Views) -> str:
    """Bodies as files: one text file per block of 25 pages, so files grow in number, not size."""
    path = scratch_path(v.spark, "bodies")
    pages = v.table("pages").select(F.floor(F.col("page_id") / 25).alias("block"), "page_id", F.regexp_replace("html", "[\r\n]+", " ").alias("body"))
    ordered = pages.repartition("block").sortWithinPartitions("block", "page_id")
    ordered.select("block", "body").write.partitionBy("block").option("lineSep", "\n").text(path)
    return path


_FILES = """
SELECT b AS block, strlen(t)::BIGINT AS size_bytes, sha256(t) AS sha256
FROM (SELECT page_id // 25 AS b, string_agg(regexp_replace(html, '[\r\n]+', ' ', 'g') || chr(10), '' ORDER BY page_id) AS t FROM pages GROUP BY 1)"""


def _block():
    return F.regexp_extract("relative_path", r"block=(\d+)", 1).cast("long").alias("block")


@query("binary_file_scan", "S6", _FILES)
def _(v: Views):
    scanned = files.scan_files(v.spark, _written_pages(v), "*.txt")
    return scanned.select(_block(), "size_bytes", "sha256")


@query("file_inventory", "S7 column pruning", f"SELECT block, size_bytes FROM ({_FILES})")
def _(v: Views):
    return files.scan_inventory(v.spark, _written_pages(v), "*.txt").select(_block(), "size_bytes")


@query("store_snapshot", "S8 versions, touched buckets, compaction", """
SELECT 'v1' AS name, conversation_id, title, sum(n)::BIGINT AS messages FROM (SELECT conversation_id, title, count(*) AS n FROM m WHERE turn % 2 = 0 GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT 'v3', conversation_id, CASE WHEN conv_id % 5 = 0 THEN 'Changed' ELSE title END, count(*) FROM m
  WHERE conversation_id IN (SELECT conversation_id FROM m WHERE turn % 2 = 0) OR conv_id % 5 = 0 GROUP BY conv_id, conversation_id, title""")
def _(v: Views):
    root = scratch_path(v.spark, "store")
    even = F.split("external_message_id", ":")[1].cast("int") % 2 == 0
    messages, conversations = v.tables["messages"], v.tables["conversations"]
    known = conversations.join(messages.filter(even).select("conversation_id").distinct(), "conversation_id", "left_semi")
    store.write_store({"messages": messages.filter(even), "conversations": known}, root, buckets=16)
    opened = store.Store(v.spark, root)
    changed = conversations.filter(F.split("external_conversation_id", "-")[1].cast("int") % 5 == 0).withColumn("title", F.lit("Changed"))
    old = opened.touching("conversations", changed.select("conversation_id"))
    merged = changed.unionByName(old.join(changed.select("conversation_id"), "conversation_id", "left_anti"))
    opened.commit({"messages": messages.filter(~even), "conversations": merged})
    store.Store(v.spark, root).compact()

    def counted(name: str, version: int):
        tables = store.Store(v.spark, root, version)
        sizes = tables["messages"].groupBy("conversation_id").agg(F.count("*").alias("messages"))
        return tables["conversations"].join(sizes, "conversation_id").select(F.lit(name).alias("name"), "conversation_id", "title", "messages")

    return counted("v1", 1).unionByName(counted("v3", 3))


# --- streams ----------------------------------------------------------------------------------


@query("stream_manifest_source", "S10", "SELECT message_id, conversation_id FROM m")
def _(v: Views):
    out, checkpoint = scratch_path(v.spark, "stream"), scratch_path(v.spark, "checkpoint")
    stream = jobs.stream_manifests(v.spark, _written_documents(v), "*.txt", 200)

    def each(batch, number):
        rows = manifests.message_rows(manifests.conversation_rows(batch))
        rows.select("message_id", "conversation_id").write.mode("overwrite").parquet(jobs.batch_path(out, number))

    jobs.run_batches(stream, each, checkpoint).awaitTermination()
    return jobs.read_batches(v.spark, out, "message_id string, conversation_id string, batch long").drop("batch")


def _replay(v: Views, df, label: str, order: str, start, batches: int = 3, again=None) -> None:
    """Let a table arrive in parts by time; the stream is drained after each arrival.

    Every part keeps its own partitioning, and the stream resumes from its checkpoint. Rows for which ``again`` holds
    come once more with each later part.
    """
    path = scratch_path(v.spark, label)
    steps = [i / batches for i in range(1, batches)]
    bounds = df.select(F.percentile_approx(F.col(order).cast("double"), steps).alias("b")).first()["b"]
    piece = F.lit(0)
    for bound in bounds:
        piece = piece + (F.col(order).cast("double") > bound).cast("int")
    for number in range(batches):
        part = piece == number if again is None else (piece == number) | (again & (piece < number))
        df.filter(part).write.mode("append").parquet(path)
        start(v.spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query("stream_rule_scan", "E11 E1-E7", """
SELECT 'state' AS kind, message_id AS id, (event_type IS NOT NULL)::VARCHAR AS value, 1::BIGINT AS number FROM mt
UNION ALL SELECT 'candidate', candidate_id, event_type || '|' || title || '|REVIEW_REQUIRED', 1 FROM mt WHERE event_type IS NOT NULL
UNION ALL SELECT 'evidence', candidate_id, message_id, 0 FROM mt WHERE event_type IS NOT NULL
UNION ALL SELECT 'scanned', 'complete', count(event_type)::VARCHAR, count(*) FROM mt""")
def _(v: Views):
    # every message arrives twice, and some were scanned before the stream started
    arriving = v.corpus.select("message_id", "sent_at", "body", "source_kind")
    root, checkpoint = scratch_path(v.spark, "scan"), scratch_path(v.spark, "checkpoint")
    before = F.lit("before")
    done = v.scan_state.withColumn("monitor_run_id", before)
    store.write_store({"scan_state": done}, root)
    _replay(v, arriving.unionByName(arriving), "messages", "sent_at", lambda stream: jobs.stream_scan(stream, TEST_RULE, root, checkpoint, folders=1))
    tables = store.Store(v.spark, root)
    shape = lambda name, kind, key, value, number: tables[name].select(F.lit(kind).alias("kind"), F.col(key).alias("id"), value.alias("value"), number.alias("number"))
    one = F.lit(1).cast("long")
    states = shape("scan_state", "state", "message_id", F.col("matched").cast("string"), one)
    states = states.join(tables["scan_state"].filter(F.col("monitor_run_id") == before).select(F.col("message_id").alias("id")), "id", "left_anti")
    candidates = shape("candidates", "candidate", "candidate_id", F.concat_ws("|", "event_type", "title", "review_status"), one)
    evidence = shape("evidence", "evidence", "candidate_id", F.col("message_id"), F.col("evidence_order"))
    runs = tables["monitor_runs"].groupBy("status").agg(F.sum("candidate_count").cast("string").alias("value"), F.sum("scanned_messages").alias("number"))
    runs = runs.select(F.lit("scanned").alias("kind"), F.col("status").alias("id"), "value", "number")
    return states.select("kind", "id", "value", "number").unionByName(candidates).unionByName(evidence).unionByName(runs)


@query("stream_heartbeats", "H14 H1-H7", """
SELECT probe_id, state, effective_token, consecutive_failures, transition FROM ps""")
def _(v: Views):
    out, checkpoint = scratch_path(v.spark, "hearts"), scratch_path(v.spark, "checkpoint")
    _replay(v, stage(v.probes, "probes"), "probes", "observed_at", lambda stream: heartbeats.stream_heartbeats(stream, out, checkpoint))
    schema = "probe_id long, state string, effective_token string, consecutive_failures long, transition boolean, batch long"
    return jobs.read_batches(v.spark, f"{out}/states", schema).drop("batch")


@query("stream_stale_detectors", "H14 stale timer, late probes, restart", """
SELECT 'stale' AS kind, detector_id, t + (stale_after_seconds * 1000000)::BIGINT AS at_us, NULL AS state, NULL AS token FROM (
  SELECT detector_id, t, stale_after_seconds, lead(t) OVER (PARTITION BY d ORDER BY t, probe_id) AS following, max(t) OVER () AS newest FROM pr)
WHERE following > t + stale_after_seconds * 1000000
  OR following IS NULL AND newest // 1000 > (t + (stale_after_seconds * 1000000)::BIGINT) // 1000
UNION ALL SELECT 'heartbeat', detector_id, t, state, effective_token FROM hb""")
def _(v: Views):
    # every seventh probe is delivered again with each later part: it is late then and changes nothing
    out, checkpoint = scratch_path(v.spark, "hearts"), scratch_path(v.spark, "checkpoint")

    def start(stream):
        return heartbeats.stream_heartbeats(stream, out, checkpoint)

    _replay(v, stage(v.probes, "probes"), "probes", "observed_at", start, again=F.col("probe_id") % 7 == 0)
    stale = jobs.read_batches(v.spark, f"{out}/stale", "detector_id string, stale_at timestamp, batch long")
    none = F.lit(None).cast("string")
    silent = stale.select(F.lit("stale").alias("kind"), "detector_id", F.unix_micros("stale_at").alias("at_us"), none.alias("state"), none.alias("token"))
    hearts = heartbeats.heartbeats_now(v.spark, out)
    return silent.unionByName(
        hearts.select(F.lit("heartbeat").alias("kind"), "detector_id", F.unix_micros("worker_heartbeat_at").alias("at_us"), "state", F.col("source_token").alias("token"))
    )


@query("stream_watermark_fold", "H11 stream", """
SELECT substr(sha256(shard || chr(0) || table_name), 1, 24) AS stream_id, count(*) AS rows, max(local_id) AS max_local_id, max(create_time) AS max_create_time FROM sh GROUP BY shard, table_name""")
def _(v: Views):
    out, checkpoint = scratch_path(v.spark, "marks"), scratch_path(v.spark, "checkpoint")
    slim = v.shards.select("shard", "table_name", "local_id", "create_time")
    _replay(v, slim, "rows", "create_time", lambda stream: jobs.stream_watermarks(stream, out, checkpoint))
    schema = "stream_id string, rows long, max_local_id long, max_create_time long, batch long"
    return jobs.fold_watermarks(jobs.read_batches(v.spark, out, schema))


@query("stream_quiet_captures", "H13 stream", """
SELECT detector_id, first_us, last_us + 1800000000 AS fires_us, n AS changes FROM (
  SELECT detector_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n, max(max(t)) OVER () AS newest FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY detector_id ORDER BY t, probe_id ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, t - lag(t) OVER (PARTITION BY detector_id ORDER BY t, probe_id) > 1800000000 AS gap FROM ps WHERE state = 'CHANGE_OBSERVED'))
  GROUP BY detector_id, g) WHERE last_us + 1800000000 <= newest""")
def _(v: Views):
    changes = v.states.filter("state = 'CHANGE_OBSERVED'").select("detector_id", F.col("observed_at").alias("changed_at"))
    out, checkpoint = scratch_path(v.spark, "bursts"), scratch_path(v.spark, "checkpoint")
    _replay(
        v, stage(changes, "bursts"), "changes", "changed_at",
        lambda stream: jobs.stream_quiet_captures(stream, 1800, "0 seconds", out, checkpoint),
    )
    rows = v.spark.read.schema("detector_id string, first_change_at timestamp, fires_at timestamp, changes long").parquet(out)
    return rows.select("detector_id", F.unix_micros("first_change_at").alias("first_us"), F.unix_micros("fires_at").alias("fires_us"), "changes")


