"""The data model over the given tables, once as DataFrames and once as SQL.

Both sides derive the same rows from whole tables; the registered queries run the operators on
the DataFrame side and are compared with plain SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import stable_id
from evidentia.operators import collector, rules
from evidentia.session import configure
from evidentia.sources.manifests import search_body

EPOCH = 1788048000
AS_OF = 1706659200  # the day after the last probe

TEST_RULE = rules.Rule(
    id="terms-v1",
    version="1",
    event_types={"registration": ["tion", "hand"], "deadline": ["ung", "ment", "ring"]},
    combined="registration_deadline",
)


def _kind(number: Column) -> Column:
    return F.when(number % 3 == 0, "alpha").when(number % 3 == 1, "beta").otherwise("gamma")


def text(*pieces) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in pieces])


class LazyTables(Mapping):
    """Tables built on first use, so that a plan only contains what it reads."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class Views:
    """Lazily built views for one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    # --- messages -------------------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        """Messages with nested parts, from ``conversations``."""
        c, t = F.col("conv_id"), F.col("turn")
        number = c * 8 + t
        path = F.when(~((t % 8 == 7) & (c % 2 == 0)), text("media/p", number, ".bin"))
        kind = F.when(t % 8 == 1, "image").when(t % 8 == 3, "audio").when(t % 8 == 5, "video").otherwise("file")
        absent = F.lit(None).cast("string")

        def row(index, part_type, body, name, location, mime):
            return F.struct(
                index.cast("long").alias("part_index"), part_type.alias("part_type"), body.alias("text_content"),
                name.alias("file_name"), location.alias("path"), mime.alias("mime_type"),
            )

        lines = F.split("text", "\n")
        texts = F.transform(lines, lambda x, i: row(i, F.lit("text"), x, absent, absent, absent))
        body = row(
            F.size(lines), kind, F.when(t % 8 == 3, text("voice note ", c)),
            F.when(path.isNotNull(), text("p", number, ".bin")).otherwise("unknown"), path,
            F.when(t % 8 == 1, "image/jpeg"),
        )
        parts = F.when(t % 2 == 1, F.concat(texts, F.array(body))).otherwise(texts)
        direction = (
            F.when(F.col("role") == "user", "incoming").when(F.col("role") == "assistant", "outgoing")
            .when(F.col("role") == "system", "system").otherwise("unknown")
        )
        base = self.table("conversations").select(
            "conv_id", "turn", "role", "text",
            _kind(c).alias("kind"),
            text("acct-", c % 3).alias("account"),
            text("conv-", c).alias("external_conversation_id"),
            text(c, ":", t).alias("external_message_id"),
            text(F.col("role"), "-", c % 10).alias("sender_external_id"),
            text(F.col("role"), " ", c % 10).alias("sender_display_name"),
            F.timestamp_seconds(EPOCH + (c % 10000) * 3600 + t * 60).alias("sent_at"),
            direction.alias("direction"),
            parts.alias("parts"),
        )
        base = base.withColumn("source_id", stable_id("src", "kind", "account"))
        return base.select(
            "*",
            stable_id("con", "source_id", "external_conversation_id").alias("conversation_id"),
            stable_id("msg", "source_id", "external_message_id").alias("message_id"),
            stable_id("idn", "source_id", "sender_external_id").alias("identity_id"),
            search_body("sender_display_name", "parts").alias("search_body"),
            F.concat(F.col("role"), F.lit("|"), F.col("text")).alias("raw_json"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        rows = self.messages.select("message_id", F.explode("parts").alias("p")).select("message_id", "p.*")
        return rows.select(
            "*",
            stable_id("prt", "message_id", "part_index").alias("part_id"),
            F.when(F.col("part_type") != "text", stable_id("att", "message_id", "part_index")).alias("attachment_id"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """Bodies found by a scan, from ``pages``."""
        return self.table("pages").select(
            text("/export/media/p", F.col("page_id") * 3, ".bin").alias("path"),
            F.sha2("html", 256).alias("sha256"),
            F.octet_length("html").cast("long").alias("size_bytes"),
        )

    @cached_property
    def attachments(self) -> DataFrame:
        from evidentia.operators.attachments import resolve_attachments

        bodies = self.parts.filter("attachment_id IS NOT NULL").withColumn("export_root", F.lit("/export"))
        return resolve_attachments(bodies, self.files).drop("export_root", "text_content", "part_id")

    @cached_property
    def tables(self) -> Mapping[str, DataFrame]:
        """The normalised store."""
        m, c = self.messages, F.col("conv_id")

        def sources():
            found = m.select("source_id", "kind", F.col("account").alias("external_account_id")).distinct()
            return found.withColumn("display_name", F.concat(F.lit("Source "), F.col("kind")))

        def conversations():
            grouped = m.groupBy("conv_id", "source_id", "conversation_id", "external_conversation_id").agg(
                F.max("sent_at").alias("last_activity")
            )
            return grouped.select(
                "source_id", "conversation_id", "external_conversation_id", "last_activity",
                text("Topic ", c % 50).alias("title"),
                F.when(c % 2 == 0, "single").otherwise("group").alias("conversation_type"),
                F.concat(
                    F.lit('{"metadata":{"unread_count":'), (c % 7).cast("string"),
                    F.lit(',"is_hidden":'), F.when(c % 5 == 0, "true").otherwise("false"),
                    F.lit('},"participants_complete":'), F.when(c % 2 == 1, "true").otherwise("false"), F.lit("}"),
                ).alias("raw_json"),
            )

        def participants():
            role = F.when(F.col("role") == "user", "owner").when(F.col("role") == "assistant", "member").otherwise("observed")
            return m.select("conversation_id", "identity_id", text('{"role":"', role, '"}').alias("relation_raw")).distinct()

        def identities():
            return m.select(
                "identity_id", "source_id", F.col("sender_external_id").alias("external_identity_id"),
                F.col("sender_display_name").alias("display_name"), (F.col("role") == "assistant").alias("is_self"),
            ).distinct()

        def blobs():
            return self.files.groupBy("sha256").agg(
                F.min("size_bytes").alias("size_bytes"), F.min("path").alias("stored_path")
            )

        def import_runs():
            return m.select("conv_id", "source_id", "kind").distinct().select(
                stable_id("imp", text("conv-", c)).alias("import_run_id"),
                text("conv-", c).alias("manifest_sha256"),
                "source_id",
                F.when((c % 11 == 0) & (F.col("kind") == "beta"), "rejected").otherwise("complete").alias("status"),
                F.timestamp_seconds(EPOCH + (c % 10000) * 3600 + 7200).alias("finished_at"),
                F.timestamp_seconds(EPOCH + (c % 10000) * 3600 + 3600).alias("exported_at"),
            )

        return LazyTables(
            {
                "sources": sources,
                "conversations": conversations,
                "participants": participants,
                "identities": identities,
                "messages": lambda: m.drop("parts", "kind", "account", "text"),
                "parts": lambda: self.parts,
                "attachments": lambda: self.attachments,
                "blobs": blobs,
                "import_runs": import_runs,
                "heartbeats": lambda: self.heartbeats,
            }
        )

    # --- collector ------------------------------------------------------------------

    @cached_property
    def probes(self) -> DataFrame:
        """Probe results, from ``events``."""
        d, k = F.col("user_id") % 25, F.get_json_object("props", "$.k").cast("long")
        kind = F.col("event_type")
        healthy = ~kind.isin("error", "signup")
        return self.table("events").select(
            F.col("event_id").alias("probe_id"),
            text("det-", d).alias("detector_id"),
            F.when(d % 4 == 3, "delta").otherwise(_kind(d)).alias("source_kind"),
            text("acct-", d).alias("external_account_id"),
            F.col("ts").cast("timestamp").alias("observed_at"),
            F.when(kind == "error", "RETRYABLE_ERROR").when(kind == "signup", "REQUIRES_USER_ACTION").alias("probe_state"),
            F.when(healthy, text("t", k % 3)).alias("source_token"),
            F.when(kind == "error", text("E", k % 3)).when(kind == "signup", "needs_login").alias("error_code"),
            kind.isin("click", "view").alias("source_observed"),
            F.when(d % 3 == 0, "source_profile_metadata").when(d % 3 == 1, "explicit_export_metadata")
            .otherwise("acquisition_readiness").alias("observation_scope"),
            (30 + (d % 4) * 30).cast("double").alias("interval_seconds"),
            (600 + d * 10).cast("double").alias("stale_after_seconds"),
            k.alias("k"),
        )

    @cached_property
    def states(self) -> DataFrame:
        return collector.probe_states(self.probes)

    @cached_property
    def heartbeats(self) -> DataFrame:
        return collector.current_heartbeats(self.states)

    # --- corpus and rules -----------------------------------------------------------

    @cached_property
    def corpus(self) -> DataFrame:
        """One message per document."""
        d = F.col("doc_id")
        base = self.table("documents").select(
            "doc_id", F.col("text").alias("body"), F.col("lang").alias("source_kind"), F.col("source").alias("chat"),
            F.timestamp_seconds(1700000000 + (d % 1000000) * 60).alias("sent_at"), "n_chars",
        )
        return base.withColumn("source_id", stable_id("src", "source_kind", "source_kind")).withColumn(
            "message_id", stable_id("msg", "source_id", "doc_id")
        )

    @cached_property
    def scan_state(self) -> DataFrame:
        """Documents a former scan has seen."""
        done = self.table("labels").filter("quality = 1").select("doc_id").distinct()
        return self.corpus.join(done, "doc_id", "left_semi").select(F.lit(TEST_RULE.id).alias("rule_id"), "message_id")

    @cached_property
    def matched(self) -> DataFrame:
        return rules.scan_messages(self.corpus, self.scan_state, TEST_RULE, cap=None)

    # --- shards ---------------------------------------------------------------------

    @cached_property
    def shards(self) -> DataFrame:
        """Sharded message tables, from ``lineitem``."""
        chat = text("user-", F.col("l_partkey") % 1000)
        return self.table("lineitem").select(
            text("message_", F.col("l_suppkey") % 8, ".db").alias("shard"),
            chat.alias("chat"),
            F.concat(F.lit("Msg_"), F.md5(chat)).alias("table_name"),
            F.col("l_linenumber").cast("long").alias("local_id"),
            F.col("l_orderkey").alias("server_id"),
            (F.col("l_quantity").cast("long") + F.col("l_linenumber").cast("long") * F.lit(4294967296)).alias("local_type"),
            F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("create_time"),
            F.col("l_suppkey").alias("sender_row"),
            F.when(F.col("l_returnflag") == "A", 4).otherwise(0).alias("content_type"),
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        )

    @cached_property
    def name_map(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").filter(s % 5 != 0).select(
            text("message_", s % 8, ".db").alias("shard"), s.alias("sender_row"), F.col("s_name").alias("username")
        )

    @cached_property
    def contacts(self) -> DataFrame:
        """Contacts with partly blank name fields, from ``customer``."""
        n = F.col("c_nationkey")
        return self.table("customer").select(
            F.col("c_custkey").alias("member_id"),
            F.col("c_name").alias("username"),
            F.when(n % 3 == 0, text("Remark ", F.col("c_custkey"))).otherwise(" ").alias("remark"),
            F.when(n % 3 == 1, text("Nick ", F.col("c_custkey"))).otherwise("").alias("nick_name"),
            F.when(n % 5 == 2, F.col("c_mktsegment")).alias("alias"),
        )

    @cached_property
    def rooms(self) -> DataFrame:
        """Rooms from ``nation``; the owner is the customer with the nation's number."""
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.alias("room_id"), text("room-", n).alias("chat"), text("Customer#", F.lpad(n.cast("string"), 9, "0")).alias("owner")
        )

    @cached_property
    def members(self) -> DataFrame:
        """Memberships from ``customer``; some point at ids that no contact has."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.col("c_nationkey").alias("room_id"), F.when(k % 17 == 0, k + 1000000000).otherwise(k).alias("member_id")
        )


# --- the same views as SQL --------------------------------------------------------------

COMMON = f"""
WITH m0 AS (
  SELECT conv_id, turn, role, text,
    CASE conv_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS kind,
    'acct-' || (conv_id % 3) AS account,
    'conv-' || conv_id AS external_conversation_id,
    conv_id || ':' || turn AS external_message_id,
    role || '-' || (conv_id % 10) AS sender_external_id,
    role || ' ' || (conv_id % 10) AS sender_display_name,
    {EPOCH} + (conv_id % 10000) * 3600 + turn * 60 AS sent_epoch,
    CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' WHEN 'system' THEN 'system' ELSE 'unknown' END AS direction
  FROM conversations),
m1 AS (SELECT *, 'src_' || substr(sha256(kind || chr(0) || account), 1, 24) AS source_id FROM m0),
m AS (
  SELECT *,
    'con_' || substr(sha256(source_id || chr(0) || external_conversation_id), 1, 24) AS conversation_id,
    'msg_' || substr(sha256(source_id || chr(0) || external_message_id), 1, 24) AS message_id,
    'idn_' || substr(sha256(source_id || chr(0) || sender_external_id), 1, 24) AS identity_id,
    'Topic ' || (conv_id % 50) AS title,
    CASE conv_id % 2 WHEN 0 THEN 'single' ELSE 'group' END AS conversation_type
  FROM m1),
p0 AS (
  SELECT message_id, conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS lines FROM m),
p AS (
  SELECT message_id, i::BIGINT AS part_index, 'text' AS part_type, lines[i + 1] AS text_content,
    NULL::VARCHAR AS file_name, NULL::VARCHAR AS path, NULL::VARCHAR AS mime_type, NULL::VARCHAR AS attachment_id
  FROM p0
  UNION ALL
  SELECT message_id, len(string_split(text, chr(10)))::BIGINT,
    CASE turn % 8 WHEN 1 THEN 'image' WHEN 3 THEN 'audio' WHEN 5 THEN 'video' ELSE 'file' END,
    CASE WHEN turn % 8 = 3 THEN 'voice note ' || conv_id END,
    CASE WHEN turn % 8 = 7 AND conv_id % 2 = 0 THEN 'unknown' ELSE 'p' || (conv_id * 8 + turn) || '.bin' END,
    CASE WHEN turn % 8 = 7 AND conv_id % 2 = 0 THEN NULL ELSE 'media/p' || (conv_id * 8 + turn) || '.bin' END,
    CASE WHEN turn % 8 = 1 THEN 'image/jpeg' END,
    'att_' || substr(sha256(message_id || chr(0) || len(string_split(text, chr(10)))), 1, 24)
  FROM m WHERE turn % 2 = 1),
f AS (
  SELECT '/export/media/p' || (page_id * 3) || '.bin' AS path, sha256(html) AS sha256, strlen(html)::BIGINT AS size_bytes FROM pages),
b AS (SELECT sha256, min(size_bytes) AS size_bytes, min(path) AS stored_path FROM f GROUP BY 1),
a AS (
  SELECT p.attachment_id, p.message_id, p.part_index, p.part_type, p.file_name, p.mime_type, p.path AS source_relative_path,
    f.sha256 AS blob_sha256, f.size_bytes, CASE WHEN f.sha256 IS NULL THEN 'missing' ELSE 'present' END AS status
  FROM p LEFT JOIN f ON f.path = '/export/' || p.path
  WHERE p.attachment_id IS NOT NULL),
c AS (
  SELECT conv_id, source_id, kind, account, conversation_id, external_conversation_id, title, conversation_type, max(sent_epoch) AS last_epoch
  FROM m GROUP BY ALL),
s AS (SELECT DISTINCT source_id, kind, account, 'Source ' || kind AS display_name FROM m),
body AS (
  SELECT m.message_id, m.sender_display_name || coalesce(chr(10) || string_agg(
      concat_ws(chr(10), p.text_content, p.file_name), chr(10) ORDER BY p.part_index), '') AS search_body
  FROM m LEFT JOIN p USING (message_id) GROUP BY m.message_id, m.sender_display_name),
r AS (
  SELECT DISTINCT conv_id, source_id,
    CASE WHEN conv_id % 11 = 0 AND kind = 'beta' THEN 'rejected' ELSE 'complete' END AS status,
    {EPOCH} + (conv_id % 10000) * 3600 + 7200 AS finished_epoch,
    {EPOCH} + (conv_id % 10000) * 3600 + 3600 AS exported_epoch
  FROM m),
pr0 AS (
  SELECT event_id AS probe_id, user_id % 25 AS d, epoch_us(ts) AS t, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
pr AS (
  SELECT probe_id, d, t, k, 'det-' || d AS detector_id,
    CASE WHEN d % 4 = 3 THEN 'delta' WHEN d % 3 = 0 THEN 'alpha' WHEN d % 3 = 1 THEN 'beta' ELSE 'gamma' END AS source_kind,
    'acct-' || d AS external_account_id,
    CASE event_type WHEN 'error' THEN 'RETRYABLE_ERROR' WHEN 'signup' THEN 'REQUIRES_USER_ACTION' END AS probe_state,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN 't' || (k % 3) END AS token,
    CASE event_type WHEN 'error' THEN 'E' || (k % 3) WHEN 'signup' THEN 'needs_login' END AS error_code,
    event_type IN ('click', 'view') AS source_observed,
    CASE d % 3 WHEN 0 THEN 'source_profile_metadata' WHEN 1 THEN 'explicit_export_metadata' ELSE 'acquisition_readiness' END AS observation_scope,
    30.0 + (d % 4) * 30 AS interval_seconds, 600.0 + d * 10 AS stale_after_seconds
  FROM pr0),
pe0 AS (
  SELECT *, last_value(CASE WHEN NOT (token IS NULL AND coalesce(probe_state, '') = 'RETRYABLE_ERROR') THEN {{'v': token}} END IGNORE NULLS)
    OVER (PARTITION BY d ORDER BY t, probe_id ROWS UNBOUNDED PRECEDING) AS eff FROM pr),
pe AS (
  SELECT * EXCLUDE (eff), eff.v AS effective_token,
    lag(eff.v) OVER (PARTITION BY d ORDER BY t, probe_id) AS previous_token,
    row_number() OVER (PARTITION BY d ORDER BY t, probe_id) AS n
  FROM pe0),
ps0 AS (
  SELECT *, CASE WHEN probe_state IS NOT NULL THEN probe_state WHEN effective_token IS NULL THEN 'OK_UNCHANGED'
      WHEN n = 1 OR previous_token IS NULL THEN 'BASELINE_ESTABLISHED'
      WHEN previous_token = effective_token THEN 'OK_UNCHANGED' ELSE 'CHANGE_OBSERVED' END AS state FROM pe),
ps1 AS (
  SELECT *, state IN ('RETRYABLE_ERROR', 'REQUIRES_USER_ACTION') AS failed,
    sum(CASE WHEN state IN ('RETRYABLE_ERROR', 'REQUIRES_USER_ACTION') THEN 0 ELSE 1 END)
      OVER (PARTITION BY d ORDER BY t, probe_id ROWS UNBOUNDED PRECEDING) AS island,
    lag(state) OVER (PARTITION BY d ORDER BY t, probe_id) AS previous_state,
    lag(error_code) OVER (PARTITION BY d ORDER BY t, probe_id) AS previous_error,
    max(CASE WHEN source_observed THEN t END) OVER (PARTITION BY d ORDER BY t, probe_id ROWS UNBOUNDED PRECEDING) AS source_observed_us,
    max(CASE WHEN state = 'CHANGE_OBSERVED' THEN t END) OVER (PARTITION BY d ORDER BY t, probe_id ROWS UNBOUNDED PRECEDING) AS last_change_us
  FROM ps0),
ps2 AS (
  SELECT *, CASE WHEN failed THEN (row_number() OVER (PARTITION BY d, island ORDER BY t, probe_id))
      - (CASE WHEN island = 0 THEN 0 ELSE 1 END) ELSE 0 END::BIGINT AS consecutive_failures,
    (n = 1 OR previous_state IS DISTINCT FROM state OR previous_token IS DISTINCT FROM effective_token
      OR previous_error IS DISTINCT FROM error_code) AS transition
  FROM ps1),
ps AS (
  SELECT *, CASE WHEN failed THEN least(interval_seconds * pow(2, least(greatest(consecutive_failures - 1, 0), 10)),
      greatest(interval_seconds, stale_after_seconds / 2), 900.0) ELSE interval_seconds END AS retry_delay_seconds FROM ps2),
hb AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY d ORDER BY t DESC, probe_id DESC) = 1),
d0 AS (
  SELECT doc_id, text AS body, lang AS source_kind, source AS chat, n_chars, 1700000000 + (doc_id % 1000000) * 60 AS sent_epoch,
    'src_' || substr(sha256(lang || chr(0) || lang), 1, 24) AS source_id FROM documents),
d1 AS (SELECT *, 'msg_' || substr(sha256(source_id || chr(0) || doc_id), 1, 24) AS message_id FROM d0),
st AS (SELECT message_id FROM d1 WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
mt0 AS (
  SELECT *, concat_ws(',', CASE WHEN contains(body, 'tion') THEN 'tion' END, CASE WHEN contains(body, 'hand') THEN 'hand' END) AS reg,
    concat_ws(',', CASE WHEN contains(body, 'ung') THEN 'ung' END, CASE WHEN contains(body, 'ment') THEN 'ment' END,
      CASE WHEN contains(body, 'ring') THEN 'ring' END) AS dead
  FROM d1 WHERE message_id NOT IN (SELECT message_id FROM st)),
mt1 AS (
  SELECT *, CASE WHEN reg <> '' AND dead <> '' THEN 'registration_deadline' WHEN reg <> '' THEN 'registration'
      WHEN dead <> '' THEN 'deadline' END AS event_type,
    coalesce(nullif(substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 160), ''), '[无可提取文本]') AS title
  FROM mt0),
mt AS (
  SELECT *, sha256(message_id || chr(0) || event_type) AS dedup_key,
    'evt_' || substr(sha256(message_id || chr(0) || event_type), 1, 32) AS candidate_id FROM mt1),
sh AS (
  SELECT 'message_' || (l_suppkey % 8) || '.db' AS shard, 'user-' || (l_partkey % 1000) AS chat,
    'Msg_' || md5('user-' || (l_partkey % 1000)) AS table_name, l_linenumber::BIGINT AS local_id, l_orderkey AS server_id,
    l_quantity::BIGINT + l_linenumber::BIGINT * 4294967296 AS local_type, epoch(l_shipdate)::BIGINT AS create_time,
    l_suppkey AS sender_row, CASE WHEN l_returnflag = 'A' THEN 4 ELSE 0 END AS content_type,
    l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem),
nm AS (SELECT 'message_' || (s_suppkey % 8) || '.db' AS shard, s_suppkey AS sender_row, s_name AS username FROM supplier WHERE s_suppkey % 5 <> 0),
ct AS (
  SELECT c_custkey AS member_id, c_name AS username, CASE WHEN c_nationkey % 3 = 0 THEN 'Remark ' || c_custkey ELSE ' ' END AS remark,
    CASE WHEN c_nationkey % 3 = 1 THEN 'Nick ' || c_custkey ELSE '' END AS nick_name,
    CASE WHEN c_nationkey % 5 = 2 THEN c_mktsegment END AS alias FROM customer),
rm AS (SELECT n_nationkey AS room_id, 'room-' || n_nationkey AS chat, 'Customer#' || lpad(n_nationkey::VARCHAR, 9, '0') AS owner FROM nation),
mb AS (SELECT c_nationkey AS room_id, CASE WHEN c_custkey % 17 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS member_id FROM customer)
"""


def sql(body: str) -> str:
    return COMMON.strip() + "\n" + body.strip()
