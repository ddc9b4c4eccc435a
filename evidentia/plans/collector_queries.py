"""Collector, watermark, generation and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import masked_id
from evidentia.operators import collector, snapshots, validate
from evidentia.plans.registry import query
from evidentia.plans.views import Views


def micros(column: str):
    return F.unix_micros(column)


@query("effective_tokens", "H1", "SELECT probe_id, detector_id, effective_token, previous_token, n = 1 AS is_first FROM pe")
def _(v: Views):
    return collector.effective_tokens(v.probes).select("probe_id", "detector_id", "effective_token", "previous_token", "is_first")


@query("probe_states", "H2", "SELECT probe_id, detector_id, state FROM ps")
def _(v: Views):
    return v.states.select("probe_id", "detector_id", "state")


@query("consecutive_failures", "H3", "SELECT probe_id, consecutive_failures FROM ps")
def _(v: Views):
    return v.states.select("probe_id", "consecutive_failures")


@query("retry_backoff", "H4", """
SELECT probe_id, retry_delay_seconds::BIGINT AS delay_seconds, CASE WHEN failed THEN t + (retry_delay_seconds * 1000000)::BIGINT END AS next_retry_us FROM ps""")
def _(v: Views):
    return v.states.select(
        "probe_id", F.col("retry_delay_seconds").cast("long").alias("delay_seconds"), micros("next_retry_at").alias("next_retry_us")
    )


@query("carried_instants", "H5", "SELECT probe_id, source_observed_us, last_change_us FROM ps")
def _(v: Views):
    return v.states.select(
        "probe_id", micros("source_observed_at").alias("source_observed_us"), micros("last_change_at").alias("last_change_us")
    )


@query("transition_log", "H6", """
SELECT detector_id, t AS occurred_us, state, effective_token AS source_token, error_code FROM ps WHERE transition""")
def _(v: Views):
    return collector.transitions(v.states).select(
        "detector_id", micros("occurred_at").alias("occurred_us"), "state", "source_token", "error_code"
    )


@query("current_heartbeats", "H7", """
SELECT detector_id, source_kind, external_account_id, observation_scope, state, t AS heartbeat_us, source_observed_us, last_change_us,
  effective_token AS source_token, consecutive_failures, error_code FROM hb""")
def _(v: Views):
    return v.heartbeats.select(
        "detector_id", "source_kind", "external_account_id", "observation_scope", "state",
        micros("worker_heartbeat_at").alias("heartbeat_us"), micros("source_observed_at").alias("source_observed_us"),
        micros("last_change_at").alias("last_change_us"), "source_token", "consecutive_failures", "error_code",
    )


@query("heartbeats_incremental", "H1-H7 carried state", """
SELECT detector_id, state, source_observed_us, last_change_us, effective_token AS source_token, consecutive_failures, error_code FROM hb""")
def _(v: Views):
    # two runs, the second continuing from the heartbeats of the first
    split = F.timestamp_seconds(F.lit(1705300000))
    first = collector.current_heartbeats(collector.probe_states(v.probes.filter(F.col("observed_at") < split)))
    states = collector.probe_states(v.probes.filter(F.col("observed_at") >= split), first)
    hearts = collector.merge_heartbeats(first, collector.current_heartbeats(states))
    return hearts.select(
        "detector_id", "state", micros("source_observed_at").alias("source_observed_us"),
        micros("last_change_at").alias("last_change_us"), "source_token", "consecutive_failures", "error_code",
    )


_IMPORTS = """
(SELECT d % 30 AS d, 'det-' || (d % 30) AS detector_id, 'gen-' || (k % 4) AS generation_id, t FROM (
   SELECT user_id AS d, json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'))"""


def _imports(v: Views):
    d, k = F.col("user_id") % 30, F.get_json_object("props", "$.k").cast("long")
    return v.table("events").filter("event_type = 'purchase'").select(
        F.when(d % 4 == 3, "delta").when(d % 3 == 0, "alpha").when(d % 3 == 1, "beta").otherwise("gamma").alias("source_kind"),
        F.concat(F.lit("acct-"), d).alias("external_account_id"),
        F.concat(F.lit("gen-"), k % 4).alias("generation_id"),
        F.col("ts").cast("timestamp").alias("completed_at"),
    )


@query("lifecycle_events", "H8", f"""
SELECT detector_id, t AS occurred_us, generation_id FROM (
  SELECT *, lag(generation_id) OVER (PARTITION BY d ORDER BY t, generation_id) AS before FROM {_IMPORTS} WHERE d < 25)
WHERE before IS DISTINCT FROM generation_id""")
def _(v: Views):
    _, events = collector.merge_lifecycle(v.heartbeats, _imports(v))
    return events.select("detector_id", micros("occurred_at").alias("occurred_us"), "generation_id")


@query("lifecycle_heartbeats", "H8", f"""
SELECT hb.detector_id, x.generation_id AS last_generation_id, x.t AS last_import_us FROM hb LEFT JOIN (
  SELECT detector_id, generation_id, t FROM (SELECT *, lag(generation_id) OVER (PARTITION BY d ORDER BY t, generation_id) AS before FROM {_IMPORTS})
  WHERE before IS DISTINCT FROM generation_id QUALIFY row_number() OVER (PARTITION BY detector_id ORDER BY t DESC, generation_id DESC) = 1) x USING (detector_id)""")
def _(v: Views):
    hearts, _ = collector.merge_lifecycle(v.heartbeats, _imports(v))
    return hearts.select("detector_id", "last_generation_id", micros("last_import_at").alias("last_import_us"))


# --- inventories --------------------------------------------------------------------------


def _inventory(v: Views):
    """File inventory per source from the pages; every third main file has a twin."""
    n = F.col("page_id")
    base = v.table("pages").select(
        F.concat(F.lit("src-"), n % 7).alias("source"), n.alias("n"),
        F.concat(F.lit("db/f"), n, F.lit(".db")).alias("relative_path"), F.octet_length("html").cast("long").alias("size_bytes"),
    )
    twins = base.filter(n % 3 == 0).select(
        "source", "n", F.concat("relative_path", F.lit("-wal")).alias("relative_path"), (F.col("size_bytes") + 1).alias("size_bytes")
    )
    return base.unionByName(twins)


_INV = """
inv AS (SELECT 'src-' || (page_id % 7) AS source, page_id AS n, 'db/f' || page_id || '.db' AS relative_path, strlen(html)::BIGINT AS size_bytes FROM pages
  UNION ALL SELECT 'src-' || (page_id % 7), page_id, 'db/f' || page_id || '.db-wal', strlen(html)::BIGINT + 1 FROM pages WHERE page_id % 3 = 0)"""


@query("source_fingerprints", "H9", f""", {_INV},
leaf AS (SELECT source, sha256(relative_path || '|' || size_bytes) AS h FROM inv),
node AS (SELECT source, substr(h, 1, 3) AS k, substr(h, 1, 3) || ':' || sha256(string_agg(h, ',' ORDER BY h)) AS node, count(*) AS n FROM leaf GROUP BY 1, 2)
SELECT source, sha256(string_agg(node, ',' ORDER BY node)) AS fingerprint_token, sum(n)::BIGINT AS files FROM node GROUP BY 1""")
def _(v: Views):
    return snapshots.fingerprint(_inventory(v), ["source"], ["relative_path", "size_bytes"])


@query("wal_twins", "H9", f""", {_INV}
SELECT x.source, x.relative_path, x.size_bytes, w.size_bytes AS wal_size_bytes
FROM inv x LEFT JOIN inv w ON w.relative_path = x.relative_path || '-wal' AND w.source = x.source WHERE x.relative_path NOT LIKE '%-wal'""")
def _(v: Views):
    return snapshots.with_wal_twin(_inventory(v), ["source"]).drop("n")


@query("inventory_verdicts", "H9 S7", f""", {_INV}
SELECT source, n AS files, CASE WHEN source IN ('src-5') THEN 'required_files_unavailable' WHEN n > 47 THEN 'file_limit_exceeded' ELSE 'usable' END AS verdict
FROM (SELECT source, count(*) AS n FROM inv GROUP BY 1)""")
def _(v: Views):
    inv = _inventory(v)
    required = inv.select("source").distinct().select(
        "source", F.when(F.col("source") == "src-5", "db/absent.db").otherwise(
            F.concat(F.lit("db/f"), F.substring("source", 5, 1), F.lit(".db"))).alias("relative_path")
    )
    return snapshots.inventory_verdicts(inv, required, ["source"], 47)


@query("changed_files", "H10", f""", {_INV}
SELECT source, relative_path, size_bytes FROM inv WHERE n % 10 = 0 OR n % 7 = 1""")
def _(v: Views):
    current = _inventory(v)
    n = F.col("n")
    previous = current.filter(n % 10 != 0).withColumn("size_bytes", F.col("size_bytes") + F.when(n % 7 == 1, 5).otherwise(0))
    return snapshots.changed_files(previous, current, ["source", "relative_path"], ["size_bytes"]).select("source", "relative_path", "size_bytes")


_WM = """
SELECT substr(sha256(shard || chr(0) || table_name), 1, 24) AS stream_id, count(*) AS rows, max(local_id) AS max_local_id, max(create_time) AS max_create_time
FROM {src} GROUP BY shard, table_name"""


@query("stream_watermarks", "H11", _WM.format(src="sh"))
def _(v: Views):
    return snapshots.stream_watermarks(v.shards)


@query("watermark_change_summary", "H12 full outer", f""",
old AS ({_WM.format(src="(SELECT * FROM sh WHERE l_orderkey % 3 <> 0 AND l_partkey % 11 <> 0)")}),
new AS ({_WM.format(src="(SELECT * FROM sh WHERE l_orderkey % 4 <> 0 AND l_partkey % 13 <> 0)")}),
j AS (SELECT o.rows AS orows, n.rows AS nrows, (o.rows, o.max_local_id, o.max_create_time) IS DISTINCT FROM (n.rows, n.max_local_id, n.max_create_time) AS differs
  FROM old o FULL JOIN new n USING (stream_id))
SELECT false AS baseline, count(*) FILTER (orows IS NULL) AS new_streams, count(*) FILTER (nrows IS NULL) AS removed_streams,
  count(*) FILTER (nrows IS NOT NULL AND differs) AS changed_streams,
  coalesce(sum(CASE WHEN nrows IS NULL THEN 0 WHEN nrows >= coalesce(orows, 0) THEN nrows - coalesce(orows, 0) ELSE 0 END), 0)::BIGINT AS row_increase_estimate,
  count(*) FILTER (nrows IS NULL OR nrows < orows) AS regressions FROM j""")
def _(v: Views):
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    old = snapshots.stream_watermarks(v.shards.filter((k % 3 != 0) & (p % 11 != 0)))
    new = snapshots.stream_watermarks(v.shards.filter((k % 4 != 0) & (p % 13 != 0)))
    return snapshots.watermark_diff(old, new)


@query("quiet_captures", "H13", """
SELECT detector_id, first_us, last_us + 1800000000 AS fires_us, n AS changes FROM (
  SELECT detector_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY detector_id ORDER BY t, probe_id ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, t - lag(t) OVER (PARTITION BY detector_id ORDER BY t, probe_id) > 1800000000 AS gap FROM ps WHERE state = 'CHANGE_OBSERVED'))
  GROUP BY detector_id, g)""")
def _(v: Views):
    changes = v.states.filter("state = 'CHANGE_OBSERVED'").select("detector_id", F.col("observed_at").alias("changed_at"))
    bursts = collector.quiet_captures(changes, 1800)
    return bursts.select("detector_id", micros("first_change_at").alias("first_us"), micros("fires_at").alias("fires_us"), "changes")


# --- generations ---------------------------------------------------------------------------


def _generation(v: Views):
    """Receipt rows and scanned files with planted deviations, from the pages."""
    n = F.col("page_id")
    generation = F.concat(F.lit("gen-"), F.floor(n / 40).cast("long")).alias("generation_id")
    path = F.concat(F.lit("raw/f"), n, F.lit(".json"))
    sha, size = F.sha2("html", 256), F.octet_length("html").cast("long")
    pages = v.table("pages")
    listed = pages.filter(n % 23 != 0).select(
        generation, F.when(n % 31 == 5, F.concat(F.lit("../"), path)).otherwise(path).alias("relative_path"),
        F.when(n % 29 == 3, F.lit("0")).otherwise(sha).alias("sha256"), size.alias("size_bytes"),
    )
    repeated = pages.filter(n % 37 == 4).select(generation, path.alias("relative_path"), sha.alias("sha256"), size.alias("size_bytes"))
    files = pages.filter(n % 19 != 7).select(generation, path.alias("relative_path"), sha.alias("sha256"), size.alias("size_bytes"))
    return listed.unionByName(repeated), files


_GEN = """
pg AS (SELECT page_id AS n, 'gen-' || (page_id // 40) AS generation_id, 'raw/f' || page_id || '.json' AS path, sha256(html) AS sha, strlen(html)::BIGINT AS size FROM pages),
rc AS (SELECT generation_id, CASE WHEN n % 31 = 5 THEN '../' || path ELSE path END AS relative_path, CASE WHEN n % 29 = 3 THEN '0' ELSE sha END AS sha, size FROM pg WHERE n % 23 <> 0
  UNION ALL SELECT generation_id, path, sha, size FROM pg WHERE n % 37 = 4),
fl AS (SELECT generation_id, path AS relative_path, sha AS fsha, size AS fsize FROM pg WHERE n % 19 <> 7),
rq AS (SELECT generation_id, relative_path, count(*) AS n, min(sha) AS sha, min(size) AS size FROM rc GROUP BY 1, 2),
bad AS (
  SELECT generation_id, relative_path, 'unsafe_path' AS problem FROM rc WHERE contains(relative_path, '..')
  UNION ALL SELECT generation_id, relative_path, 'duplicate_entry' FROM rq WHERE n > 1
  UNION ALL SELECT generation_id, relative_path, CASE WHEN n IS NULL THEN 'uninventoried_file' WHEN fsize IS NULL THEN 'missing_file' ELSE 'digest_or_size_changed' END
  FROM rq FULL JOIN fl USING (generation_id, relative_path) WHERE n IS NULL OR fsize IS NULL OR sha <> fsha OR size <> fsize
  UNION ALL SELECT g.generation_id, 'raw/f1.json', 'required_not_inventoried' FROM (SELECT DISTINCT generation_id FROM rc) g
  WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.generation_id = g.generation_id AND rc.relative_path = 'raw/f1.json'))"""


@query("generation_verification", "H15 full outer", f", {_GEN} SELECT generation_id, relative_path, problem FROM bad")
def _(v: Views):
    receipts, files = _generation(v)
    return snapshots.verify_generations(receipts, files, ["raw/f1.json"])


@query("generation_verdicts", "H15", f""", {_GEN}
SELECT g.generation_id, g.n AS files, coalesce(x.n, 0) AS problems, coalesce(x.n, 0) = 0 AS verified
FROM (SELECT generation_id, count(*) AS n FROM rc GROUP BY 1) g LEFT JOIN (SELECT generation_id, count(*) AS n FROM bad GROUP BY 1) x USING (generation_id)""")
def _(v: Views):
    receipts, files = _generation(v)
    return snapshots.generation_verdicts(receipts, snapshots.verify_generations(receipts, files, ["raw/f1.json"]))


@query("pending_generations", "H16", """
SELECT source_id, generation_id FROM (
  SELECT o_custkey AS source_id, 'g' || o_orderkey AS generation_id, o_orderkey FROM orders WHERE o_orderstatus <> 'P'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'g' || o_orderkey DESC) = 1) WHERE o_orderkey % 3 <> 0""")
def _(v: Views):
    orders = v.table("orders")
    name = F.concat(F.lit("g"), F.col("o_orderkey")).alias("generation_id")
    generations = orders.select(
        F.col("o_custkey").alias("source_id"), name, F.col("o_orderdate").alias("captured_at"),
        F.when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("COMPLETE").alias("status"),
    )
    runs = orders.filter(F.col("o_orderkey") % 3 == 0).select(name, F.lit("complete").alias("status"))
    return snapshots.pending_generations(generations, runs).select("source_id", "generation_id")


# --- profiles ------------------------------------------------------------------------------


@query("snapshot_profile", "H17 F8 grouping sets", """
SELECT 'type' AS facet, (local_type & 4294967295)::VARCHAR AS value, count(*) AS rows, min(create_time) AS min_time, max(create_time) AS max_time FROM sh GROUP BY 2
UNION ALL SELECT 'storage', content_type::VARCHAR, count(*), min(create_time), max(create_time) FROM sh GROUP BY 2
UNION ALL SELECT 'all', '', count(*), min(create_time), max(create_time) FROM sh""")
def _(v: Views):
    return snapshots.profile_snapshot(v.shards)


@query("directory_profiles", "H18 F16 C15", """
SELECT 'profile_' || substr(sha256('prof-' || p), 1, 12) AS profile_id, count(*) AS files, sum(size)::BIGINT AS total_bytes,
  count(*) FILTER (db) AS databases, count(*) FILTER (db AND plain) AS sqlite_plain, count(*) FILTER (db AND NOT plain) AS encrypted_or_custom,
  CASE WHEN count(*) FILTER (db AND NOT plain) = 0 AND count(*) FILTER (db AND plain) > 0 THEN 'PARTIAL_EXPORT' ELSE 'REQUIRES_USER_ACTION' END AS capability,
  CASE WHEN count(*) FILTER (db) = 0 THEN 'no_local_profile_database_found' WHEN count(*) FILTER (db AND NOT plain) > 0 THEN 'encrypted_or_custom_business_databases'
    ELSE 'plain_database_detected_but_no_accepted_parser' END AS reason
FROM (SELECT page_id % 9 AS p, strlen(html)::BIGINT AS size, page_id % 2 = 0 AND page_id % 9 <> 5 AS db, page_id % 4 = 0 OR page_id % 9 = 2 AS plain FROM pages) GROUP BY p""")
def _(v: Views):
    n = F.col("page_id")
    db = (n % 2 == 0) & (n % 9 != 5)
    plain = (n % 4 == 0) | (n % 9 == 2)
    files = v.table("pages").select(
        F.concat(F.lit("prof-"), n % 9).alias("profile"),
        F.concat(F.lit("f"), n, F.when(db, ".db").otherwise(".bin")).alias("relative_path"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.when(plain, F.concat(F.lit(b"SQLite format 3\x00"), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8")).alias("header"),
    )
    return snapshots.profile_directories(files).drop("unreadable")


@query("probe_normalisation", "H20", """
SELECT event_id, CASE WHEN NOT xb THEN 'source_profile_metadata' WHEN root THEN 'explicit_export_metadata' ELSE 'acquisition_readiness' END AS observation_scope,
  CASE WHEN err THEN 'RETRYABLE_ERROR' WHEN xb AND NOT ready THEN 'REQUIRES_USER_ACTION' END AS probe_state,
  CASE WHEN err THEN 'OSError' WHEN xb AND NOT ready THEN 'reason-' || event_type END AS error_code,
  NOT err AND (NOT xb OR root) AS source_observed, CASE WHEN NOT err AND (NOT xb OR root) THEN 'tok-' || event_id END AS source_token
FROM (SELECT event_id, event_type, user_id % 3 = 0 AS xb, user_id % 2 = 0 AS root, event_type = 'error' AS err, event_type = 'click' AS ready FROM events)""")
def _(v: Views):
    kind, user = F.col("event_type"), F.col("user_id")
    raw = v.table("events").select(
        "event_id", (user % 3 == 0).alias("export_based"), (user % 2 == 0).alias("has_root"),
        F.when(kind == "error", "OSError").alias("failed_with"),
        F.when(kind == "click", "PARTIAL_EXPORT").otherwise("REQUIRES_USER_ACTION").alias("capability"),
        F.concat(F.lit("reason-"), kind).alias("reason"), F.concat(F.lit("tok-"), F.col("event_id")).alias("token"),
    )
    return collector.normalise_probes(raw).select(
        "event_id", "observation_scope", "probe_state", "error_code", "source_observed", "source_token"
    )


@query("binding_violations", "V7", """
SELECT 'detector_rebound' AS problem, detector_id AS subject FROM x GROUP BY detector_id HAVING count(DISTINCT (kind, acct)) > 1
UNION ALL SELECT 'account_shared', kind || '/' || acct FROM x GROUP BY kind, acct HAVING count(DISTINCT detector_id) > 1""".replace(
    " FROM x", " FROM (SELECT 'det-' || (user_id % 25) AS detector_id, 'k' || (user_id % 5) AS kind, 'a' || CASE WHEN user_id % 25 < 10 THEN (user_id % 25) // 2 ELSE user_id % 50 END AS acct FROM events) x"))
def _(v: Views):
    u = F.col("user_id")
    probes = v.table("events").select(
        F.concat(F.lit("det-"), u % 25).alias("detector_id"), F.concat(F.lit("k"), u % 5).alias("source_kind"),
        F.concat(F.lit("a"), F.when(u % 25 < 10, F.floor((u % 25) / 2)).otherwise(u % 50)).alias("external_account_id"),
    )
    return validate.check_bindings(probes)


@query("masked_accounts", "F16", """
SELECT detector_id, substr(sha256(detector_id), 1, 12) AS masked, count(*) AS probes FROM pr GROUP BY detector_id""")
def _(v: Views):
    return v.probes.groupBy("detector_id").agg(F.count("*").alias("probes")).withColumn("masked", masked_id("detector_id"))
