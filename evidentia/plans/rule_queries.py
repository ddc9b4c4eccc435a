"""Rule scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import rules
from evidentia.plans.registry import query
from evidentia.plans.views import TEST_RULE, Views

def as_of():
    return F.timestamp_seconds(F.lit(1706000000))


@query("unscanned_messages", "E1 anti join", "SELECT message_id, doc_id FROM d1 WHERE message_id NOT IN (SELECT message_id FROM st)")
def _(v: Views):
    return rules.select_unscanned(v.corpus, v.scan_state, TEST_RULE.id).select("message_id", "doc_id")


@query("scan_capped", "E1 L3", """
SELECT message_id, sent_epoch FROM d1 WHERE message_id NOT IN (SELECT message_id FROM st) ORDER BY sent_epoch, message_id LIMIT 300""")
def _(v: Views):
    found = rules.select_unscanned(v.corpus, v.scan_state, TEST_RULE.id, 300)
    return found.select("message_id", F.unix_seconds("sent_at").alias("sent_epoch"))


@query("scan_progress", "E1 E8", """
SELECT least(n, 300) AS scanned_messages, n - least(n, 300) AS remaining_messages, CASE WHEN n > 300 THEN 'partial' ELSE 'complete' END AS status
FROM (SELECT count(*) AS n FROM d1 WHERE message_id NOT IN (SELECT message_id FROM st))""")
def _(v: Views):
    return rules.scan_progress(v.corpus, v.scan_state, TEST_RULE.id, 300)


@query("message_body_assembly", "E2 F5", """
SELECT message_id, sha256(string_agg(text_content, chr(10) ORDER BY part_index)) AS body_sha256 FROM p WHERE text_content IS NOT NULL GROUP BY 1""")
def _(v: Views):
    return rules.message_bodies(v.parts).select("message_id", F.sha2("body", 256).alias("body_sha256"))


@query("message_body_nested", "E2", """
SELECT message_id, sha256(string_agg(text_content, chr(10) ORDER BY part_index)) AS body_sha256 FROM p WHERE text_content IS NOT NULL GROUP BY 1""")
def _(v: Views):
    return v.messages.select("message_id", F.sha2(rules.body_of_parts("parts"), 256).alias("body_sha256"))


@query("keyword_matches", "E3", """
SELECT message_id, reg AS registration_hits, dead AS deadline_hits FROM mt WHERE event_type IS NOT NULL""")
def _(v: Views):
    hits = lambda kind: F.array_join(F.coalesce(F.try_element_at("matches", F.lit(kind)), F.array().cast("array<string>")), ",")
    found = v.matched.filter("event_type IS NOT NULL")
    return found.select("message_id", hits("registration").alias("registration_hits"), hits("deadline").alias("deadline_hits"))


@query("event_types", "E4 E10", "SELECT message_id, event_type, title, candidate_id, dedup_key FROM mt WHERE event_type IS NOT NULL")
def _(v: Views):
    return v.matched.filter("event_type IS NOT NULL").select("message_id", "event_type", "title", "candidate_id", "dedup_key")


@query("event_type_counts", "E3 E4", "SELECT event_type, source_kind, count(*) AS candidates FROM mt WHERE event_type IS NOT NULL GROUP BY ALL")
def _(v: Views):
    found = v.matched.filter("event_type IS NOT NULL")
    return found.groupBy("event_type", "source_kind").agg(F.count("*").alias("candidates"))


@query("candidate_merge", "E5 full outer", """
SELECT candidate_id, CASE WHEN old THEN 1700000000 ELSE 1706000000 END AS first_epoch, CASE WHEN hit THEN 1706000000 ELSE 1700000000 END AS last_epoch,
  CASE WHEN hit THEN title ELSE 'old title' END AS title, CASE WHEN old THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS review_status
FROM (SELECT candidate_id, title, doc_id % 3 = 0 AS old, doc_id % 2 = 0 AS hit FROM mt WHERE event_type IS NOT NULL) WHERE old OR hit""")
def _(v: Views):
    found = v.matched
    old_at = F.timestamp_seconds(F.lit(1700000000))
    stored = rules.candidate_rows(found.filter(F.col("doc_id") % 3 == 0), TEST_RULE, old_at)
    stored = stored.withColumn("review_status", F.lit("APPROVED")).withColumn("title", F.lit("old title"))
    fresh = rules.candidate_rows(found.filter(F.col("doc_id") % 2 == 0), TEST_RULE, as_of())
    merged = rules.merge_candidates(stored, fresh)
    return merged.select(
        "candidate_id", F.unix_seconds("first_seen_at").alias("first_epoch"), F.unix_seconds("last_seen_at").alias("last_epoch"),
        "title", "review_status",
    )


@query("evidence_merge", "E6", """
SELECT candidate_id, message_id, 'trigger' AS evidence_role, 0::BIGINT AS evidence_order FROM mt WHERE event_type IS NOT NULL""")
def _(v: Views):
    links = rules.evidence_rows(v.matched)
    return rules.merge_evidence(rules.evidence_rows(v.matched.filter(F.col("doc_id") % 3 == 0)), links.unionByName(links))


@query("scan_state_append", "E7", "SELECT message_id, event_type IS NOT NULL AS matched, 'run-1' AS monitor_run_id FROM mt")
def _(v: Views):
    return rules.scan_state_rows(v.matched, TEST_RULE, as_of(), "run-1").select("message_id", "matched", "monitor_run_id")


@query("monitor_run_record", "E8", """
SELECT 'run-1' AS monitor_run_id, 'complete' AS status, count(*) AS scanned_messages, count(event_type) AS candidate_count, 0::BIGINT AS remaining_messages FROM mt""")
def _(v: Views):
    state = rules.scan_state_rows(v.matched, TEST_RULE, as_of(), "run-1")
    progress = rules.scan_progress(v.corpus, v.scan_state, TEST_RULE.id, 1 << 60)
    run = rules.monitor_run(state, progress, TEST_RULE, as_of(), "run-1")
    return run.select("monitor_run_id", "status", "scanned_messages", "candidate_count", "remaining_messages")


@query("monitor_source_snapshot", "E8", """
SELECT s.source_id, s.kind AS source_kind, count(*) AS message_count, max(sent_epoch) AS latest_epoch,
  (SELECT max(finished_epoch) FROM r WHERE r.source_id = s.source_id AND r.status = 'complete') AS last_import_epoch
FROM s JOIN m USING (source_id) GROUP BY s.source_id, s.kind""")
def _(v: Views):
    snap = rules.source_snapshot(v.tables)
    return snap.select(
        "source_id", "source_kind", "message_count", F.unix_seconds("latest_message_at").alias("latest_epoch"),
        F.unix_seconds("last_successful_import_at").alias("last_import_epoch"),
    )


@query("rule_version_guard", "E9", """
SELECT 'rule-' || p_partkey AS rule_id, CASE WHEN p_partkey % 4 = 0 THEN 'NEW' WHEN p_partkey % 4 = 1 THEN 'DEFINITION_DIFFERS'
  WHEN p_partkey % 4 = 2 AND p_size % 2 = 0 THEN 'DISABLED' ELSE 'READY' END AS verdict FROM part""")
def _(v: Views):
    k, n = F.col("p_partkey"), F.col("p_partkey") % 4
    rule = F.concat(F.lit("rule-"), k).alias("rule_id")
    part = v.table("part")
    current = part.select(rule, F.lit("1").alias("rule_version"), F.concat(F.lit('{"b": 1, "a": "'), F.col("p_type"), F.lit('"}')).alias("definition_json"))
    stored = part.filter(n != 0).select(
        rule, F.when((n == 1) & (F.col("p_size") % 2 == 0), "0").otherwise("1").alias("rule_version"),
        (~((n == 2) & (F.col("p_size") % 2 == 0))).alias("enabled"),
        F.concat(F.lit('{"a":"'), F.when((n == 1) & (F.col("p_size") % 2 == 1), "other").otherwise(F.col("p_type")), F.lit('","b":1}')).alias("definition_json"),
    )
    return rules.rule_verdicts(stored, current)


@query("rule_table_matches", "E3 E4 many rules in one pass", """,
kw AS (
  SELECT 'rule-' || (item_id % 20) AS rule_id, 'type-' || (item_id // 20 % 2) AS event_type, min(item_id) AS place, substr(text, 10, 4) AS keyword
  FROM benchmark GROUP BY 1, 2, 4),
kinds AS (SELECT rule_id, count(DISTINCT event_type) AS kinds FROM kw GROUP BY 1),
hit AS (
  SELECT message_id, rule_id, event_type, string_agg(keyword, ',' ORDER BY place, keyword) AS words
  FROM d1 JOIN kw ON contains(body, keyword) GROUP BY 1, 2, 3)
SELECT message_id, rule_id, CASE WHEN count(*) = kinds AND kinds > 1 THEN rule_id || '-all' ELSE min(event_type) END AS event_type,
  string_agg(event_type || ':' || words, ';' ORDER BY event_type) AS found
FROM hit JOIN kinds USING (rule_id) GROUP BY message_id, rule_id, kinds""")
def _(v: Views):
    item = F.col("item_id")
    rows = v.table("benchmark").select(
        F.concat(F.lit("rule-"), item % 20).alias("rule_id"), F.floor(item / 20 % 2).cast("int").alias("type_position"), item,
        F.substring("text", 10, 4).alias("keyword"),
    )
    table = rows.groupBy("rule_id", "type_position", "keyword").agg(F.min("item_id").cast("int").alias("keyword_position"))
    table = table.withColumns({"event_type": F.concat(F.lit("type-"), "type_position"), "combined": F.concat("rule_id", F.lit("-all"))})
    found = rules.match_rule_table(v.corpus, table)
    types = F.array_sort(F.map_keys("matches"))
    shown = F.transform(types, lambda t: F.concat(t, F.lit(":"), F.array_join(F.element_at("matches", t), ",")))
    return found.select("message_id", "rule_id", "event_type", F.array_join(shown, ";").alias("found"))
