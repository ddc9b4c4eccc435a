"""Scalar expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import functions as X
from evidentia.plans.registry import query
from evidentia.plans.views import Views, text


@query("stable_ids", "F1", "SELECT DISTINCT source_id, conversation_id, message_id, identity_id FROM m")
def _(v: Views):
    return v.messages.select("source_id", "conversation_id", "message_id", "identity_id").distinct()


@query("canonical_json", "F2", """
SELECT event_id, '{"a":[1,2],"k":' || json_extract_string(props, '$.k') || ',"z":"' || event_type || '"}' AS canonical FROM events""")
def _(v: Views):
    k = F.get_json_object("props", "$.k")
    loose = text('{ "z" : "', F.col("event_type"), '",  "k": ', k, ' , "a": [ 1, 2 ]}')
    return v.table("events").select("event_id", X.canonical_json(loose).alias("canonical"))


@query("zoned_instants", "F3", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN s WHEN 1 THEN s - 8 * 3600 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE s + 5400 END AS instant_epoch
FROM (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)""")
def _(v: Views):
    n = F.col("event_id")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    given = (
        F.when(n % 5 == 0, F.concat(iso, F.lit("Z"))).when(n % 5 == 1, F.concat(iso, F.lit("+08:00"))).when(n % 5 == 2, iso)
        .when(n % 5 == 3, F.concat(F.lit("x"), iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("-01:30")))
    )
    return v.table("events").select("event_id", F.unix_seconds(X.parse_instant(given)).alias("instant_epoch"))


@query("epoch_units", "F4", """
SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS instant_ms FROM events""")
def _(v: Views):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    number = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(seconds * 1000)
    return v.table("events").select("event_id", F.unix_millis(X.epoch_auto(number)).alias("instant_ms"))


@query("text_compaction", "F5 F9", """
SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS compact_sha256, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS head,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS label FROM documents""")
def _(v: Views):
    padded = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("\n "), F.col("lang"), F.lit("  ")))
    return v.table("documents").select(
        "doc_id", F.sha2(X.compact("text"), 256).alias("compact_sha256"), X.compact("text", 240).alias("head"), X.blank_to_null(padded).alias("label")
    )


@query("literal_contains", "F6", """
SELECT doc_id, contains(lower(text), 'der') AND contains(lower(text), 'ung') AS both_words, contains(lower(text), '%') AS wildcard FROM documents""")
def _(v: Views):
    return v.table("documents").select(
        "doc_id", X.contains_literal("text", X.literal_words("DER  Ung")).alias("both_words"), X.contains_literal("text", ["%"]).alias("wildcard")
    )


@query("md5_table_names", "F7", "SELECT c_name, 'Msg_' || md5(c_name) AS table_name FROM customer")
def _(v: Views):
    return v.table("customer").select("c_name", X.md5_table_name("c_name").alias("table_name"))


@query("low_bits", "F8", "SELECT local_type & 4294967295 AS base_type, count(*) AS rows FROM sh GROUP BY 1")
def _(v: Views):
    return v.shards.groupBy(F.col("local_type").bitwiseAND(F.lit(0xFFFFFFFF)).alias("base_type")).agg(F.count("*").alias("rows"))


@query("http_urls", "F10", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE upper(url) END AS accepted FROM pages""")
def _(v: Views):
    n, url = F.col("page_id"), F.col("url")
    given = F.when(n % 4 == 0, url).when(n % 4 == 1, F.concat(F.lit("ftp://"), url)).when(n % 4 == 2, F.lit("https:///path")).otherwise(F.upper(url))
    return v.table("pages").select("page_id", X.http_url(given).alias("accepted"))


@query("safe_file_names", "F11", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'r_p_' || page_id || '.txt' WHEN 1 THEN 'é' || page_id || ' (1).jpg' WHEN 2 THEN 'fall' || page_id || '.bin' ELSE 'attachment' END AS safe_name FROM pages""")
def _(v: Views):
    n = F.col("page_id")
    name = (
        F.when(n % 4 == 0, text("a/b/r?p*", n, ".txt")).when(n % 4 == 1, text(" é", n, " (1).jpg ")).when(n % 4 == 2, F.lit("  ")).otherwise(F.lit("..."))
    )
    return v.table("pages").select("page_id", X.safe_file_name(name, text("x/fall", n, ".bin")).alias("safe_name"))


@query("media_types", "F12", """
SELECT p_partkey, ['image/jpeg', 'application/pdf', NULL, NULL, 'text/plain', 'application/x-tar', 'application/x-tar', NULL, 'image/webp', 'image/svg+xml',
  'video/quicktime', 'audio/mpeg', 'text/csv', NULL, 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'][(p_partkey % 15 + 1)::INT] AS mime FROM part""")
def _(v: Views):
    endings = [".JPG", ".tar.pdf", ".unknownext", "", ".txt", ".tar.gz", ".TGZ", ".gz", ".webp", ".svgz", ".mov", ".mp3", ".csv.bz2", ".tar.Zz", ".docx"]
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("p_partkey") % 15 + 1).cast("int"))
    return v.table("part").select("p_partkey", X.mime_type(F.concat(F.lit("f "), F.col("p_name"), ending)).alias("mime"))


@query("json_fields", "F13", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def _(v: Views):
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    return v.table("events").select("event_id", X.json_field(given, "$.k", "long").alias("k"))


@query("month_folders", "F14", """
SELECT o_orderkey, strftime(t - INTERVAL 1 MONTH, '%Y-%m') || ',' || strftime(t, '%Y-%m') || ',' || strftime(t + INTERVAL 1 MONTH, '%Y-%m') AS months
FROM (SELECT o_orderkey, date_trunc('month', o_orderdate + INTERVAL 8 HOUR) AS t FROM orders)""")
def _(v: Views):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return v.table("orders").select(
        "o_orderkey", F.array_join(X.month_candidates(seconds, time_zone="Asia/Shanghai"), ",").alias("months")
    )


@query("unicode_forms", "F15", "SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents")
def _(v: Views):
    # decomposed first, so that composing has work to do
    decomposed = v.table("documents").select("doc_id", X.normal_form("text", "NFD").alias("text"))
    return decomposed.select("doc_id", F.sha2(X.normal_form("text", "NFC"), 256).alias("nfc_sha256"))


@query("masked_identifiers", "F16", "SELECT c_custkey, 'profile_' || substr(sha256(c_name), 1, 12) AS profile_id FROM customer")
def _(v: Views):
    return v.table("customer").select("c_custkey", X.masked_id("c_name", 12, "profile_").alias("profile_id"))


@query("value_kinds", "F17", """
SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'BIGINT' WHEN event_id % 4 = 1 THEN 'STRING' WHEN event_id % 4 = 2 THEN 'OBJECT' END, 'ABSENT') AS kind FROM events""")
def _(v: Views):
    n = F.col("event_id") % 4
    doc = F.when(n == 0, F.lit('{"x": 5}')).when(n == 1, text('{"x": "', F.col("event_type"), '"}')).when(n == 2, F.concat(F.lit('{"x": '), F.col("props"), F.lit("}"))).otherwise(F.lit("{}"))
    kind = X.json_type(F.try_variant_get(F.try_parse_json(doc), "$.x", "variant"))
    return v.table("events").select("event_id", F.coalesce(kind, F.lit("ABSENT")).alias("kind"))
