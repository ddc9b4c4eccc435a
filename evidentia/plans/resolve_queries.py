"""Identity, sender, roster and direction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import content as C
from evidentia.operators import resolve as R
from evidentia.plans.registry import query
from evidentia.plans.views import Views, text

NAMES = ("remark", "nick_name", "alias")
_NAME = "coalesce(nullif(trim({p}remark), ''), nullif(trim({p}nick_name), ''), nullif(trim({p}alias), ''), {id})"


def _senders(v: Views):
    prefix = F.when(F.col("l_suppkey") % 10 == 5, text("pre-", F.col("l_suppkey")))
    return R.resolve_senders(v.shards.withColumn("prefix_sender", prefix), v.name_map)


_SENDER = """coalesce(username, CASE WHEN l_suppkey % 10 = 5 THEN 'pre-' || l_suppkey END, 'unknown:' || chat)"""
_SENT = f"(SELECT sh.*, {_SENDER} AS sender_id FROM sh LEFT JOIN nm USING (shard, sender_row))"


@query("sender_resolution", "J1", f"SELECT sender_id, chat, count(*) AS rows FROM {_SENT} GROUP BY 1, 2")
def _(v: Views):
    return _senders(v).groupBy("sender_id", "chat").agg(F.count("*").alias("rows"))


@query("group_prefix", "J2", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'user' || doc_id END AS prefix_sender, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'two words:' || chr(10) || text ELSE 'user:' || chr(10) || text END) AS body_sha256 FROM documents""")
def _(v: Views):
    d = F.col("doc_id")
    body = F.when(d % 3 == 0, text("user", d, ":\n", F.col("text"))).when(d % 3 == 1, F.concat(F.lit("two words:\n"), "text")).otherwise(F.concat(F.lit("user:\n"), "text"))
    rows = v.table("documents").select("doc_id", body.alias("t"), (d % 3 != 2).alias("is_group"))
    split = rows.select("doc_id", C.strip_group_prefix("t", "is_group").alias("s"))
    return split.select("doc_id", "s.prefix_sender", F.sha2("s.body", 256).alias("body_sha256"))


@query("display_names", "J3", f"SELECT o_orderkey, {_NAME.format(p='ct.', id='x.id')} AS display_name FROM (SELECT o_orderkey, 'Customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0') AS id FROM orders) x LEFT JOIN ct ON ct.username = x.id")
def _(v: Views):
    rows = v.table("orders").select("o_orderkey", text("Customer#", F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("id"))
    return R.display_names(rows, v.contacts, "id", NAMES).select("o_orderkey", "display_name")


@query("conversation_titles", "J4", """
SELECT chat, coalesce(nullif(trim(remark), ''), nullif(trim(nick_name), ''), nullif(trim(alias), ''), CASE WHEN k % 3 <> 1 THEN nullif('Session ' || k, '') END, chat) AS title
FROM (SELECT 'Customer#' || lpad(p_partkey::VARCHAR, 9, '0') AS chat, p_partkey AS k FROM part) LEFT JOIN ct ON ct.username = chat""")
def _(v: Views):
    k = F.col("p_partkey")
    chats = v.table("part").select(text("Customer#", F.lpad(k.cast("string"), 9, "0")).alias("chat"), k.alias("k"))
    sessions = chats.select("chat", F.when(F.col("k") % 3 == 1, "").otherwise(text("Session ", F.col("k"))).alias("session_title"))
    return R.conversation_titles(chats.select("chat"), v.contacts, sessions)


@query("self_resolution", "J5 prefix join", """
SELECT p_partkey AS account_id, CASE WHEN p_partkey % 4 = 0 THEN 'verified_explicit_account_id' WHEN p_partkey % 4 = 3 THEN 'unresolved' WHEN k IS NULL THEN 'unresolved' ELSE 'verified_profile_directory' END AS self_status,
  CASE WHEN p_partkey % 4 = 0 THEN 'acct_' || p_partkey WHEN p_partkey % 4 = 3 THEN NULL ELSE k END AS self_id
FROM part LEFT JOIN (SELECT n AS j, CASE WHEN n % 2 = 0 THEN 'user_' || n || '_x' ELSE 'user_' || n END AS k FROM (SELECT c_custkey AS n FROM customer)) ON j = p_partkey""")
def _(v: Views):
    k, c = F.col("p_partkey"), F.col("c_custkey")
    accounts = v.table("part").select(
        k.alias("n"), text("acct_", k).alias("account_id"), F.when(k % 4 != 3, text("user_", k, "_x_", F.col("p_size"))).alias("profile_name")
    )
    users = v.table("customer").select(text("user_", c).alias("username")).unionByName(
        v.table("customer").filter(c % 2 == 0).select(text("user_", c, "_x").alias("username"))
    ).unionByName(accounts.filter(F.col("n") % 4 == 0).select(F.col("account_id").alias("username")))
    found = R.resolve_self(accounts, users)
    return found.select(F.substring("account_id", 6, 20).cast("long").alias("account_id"), "self_status", "self_id")


@query("hashed_bindings", "J6", """
SELECT c_custkey AS receipt_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS uid, CASE WHEN c_custkey % 5 = 0 THEN 'unbound' ELSE 'bound' END AS binding_status FROM customer""")
def _(v: Views):
    c = F.col("c_custkey")
    candidates = v.table("customer").select(F.col("c_name").alias("uid"), F.col("c_mktsegment").alias("salt"))
    receipts = v.table("customer").select(
        c.alias("receipt_id"),
        F.when(c % 5 == 0, F.lit("none")).otherwise(F.sha2(F.concat("c_name", F.md5("c_mktsegment")), 256)).alias("account_binding_sha256"),
    )
    return R.resolve_binding(candidates, receipts)


@query("direction_resolved", "J7", f"""
SELECT direction, direction_status, count(*) AS rows FROM (
  SELECT CASE WHEN sender_id LIKE 'unknown:%' THEN 'unknown' WHEN sender_id = 'Supplier#000000007' THEN 'outgoing' ELSE 'incoming' END AS direction,
    CASE WHEN sender_id LIKE 'unknown:%' THEN 'unresolved_sender_or_self' WHEN sender_id = 'Supplier#000000007' THEN 'verified_self_sender' ELSE 'verified_nonself_sender' END AS direction_status FROM {_SENT}) GROUP BY 1, 2""")
def _(v: Views):
    rows = R.classify_direction(_senders(v).withColumn("self_id", F.lit("Supplier#000000007")), "resolved")
    return rows.groupBy("direction", "direction_status").agg(F.count("*").alias("rows"))


@query("direction_aliases", "J7", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'system' WHEN user_id % 5 = 0 OR user_id % 7 = 0 THEN 'unknown' WHEN user_id % 3 = 0 THEN 'outgoing' ELSE 'incoming' END AS direction FROM events""")
def _(v: Views):
    u = F.col("user_id")
    none = F.array().cast("array<string>")
    rows = v.table("events").select(
        "event_id", F.when(u % 5 == 0, none).otherwise(F.array(text("u", u), F.when(u % 3 == 0, "me").otherwise("you"))).alias("ids"),
        F.when(u % 7 == 0, none).otherwise(F.array(F.lit("me"))).alias("own"), (F.col("event_type") == "signup").alias("sys"),
    )
    return R.classify_direction(rows, "aliases", "ids", "own", "sys").select("event_id", "direction")


@query("direction_uid", "J7", """
SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'unknown' WHEN user_id % 4 = 1 THEN 'outgoing' ELSE 'incoming' END AS direction FROM events""")
def _(v: Views):
    u = F.col("user_id") % 4
    rows = v.table("events").select("event_id", F.when(u == 0, "").otherwise(u.cast("string")).alias("uid"), F.lit("1").alias("own"))
    return R.classify_direction(rows, "uid", "uid", "own").select("event_id", "direction")


def _details(v: Views):
    n = F.col("n_nationkey")
    return v.table("nation").filter(n % 4 != 3).select(
        n.alias("room_id"), n.cast("long").alias("room_status"), F.when(n % 2 == 0, text("Notice ", n)).otherwise("").alias("announcement"),
        F.when(n % 3 == 0, "").otherwise("editor").alias("announcement_editor"), (n * 1000).cast("long").alias("announcement_time"),
    )


@query("group_metadata", "J8", """
SELECT rm.chat, owner AS owner_id, CASE WHEN n % 4 <> 3 THEN n END::BIGINT AS source_status, CASE WHEN n % 4 <> 3 AND n % 2 = 0 THEN 'Notice ' || n END AS announcement,
  CASE WHEN n % 4 <> 3 AND n % 2 = 0 AND n % 3 <> 0 THEN 'editor' END AS announcement_editor_id,
  CASE WHEN n % 4 <> 3 AND n % 2 = 0 AND n > 0 THEN n * 1000 END::BIGINT AS announcement_published_epoch,
  count(ct.username) AS member_count, count(mb.member_id) - count(ct.username) AS unresolved_members,
  CASE WHEN count(mb.member_id) = count(ct.username) THEN 'complete' ELSE 'partial' END AS membership_status
FROM (SELECT *, room_id AS n FROM rm) rm LEFT JOIN mb USING (room_id) LEFT JOIN ct USING (member_id) GROUP BY rm.chat, owner, n""")
def _(v: Views):
    ids = v.contacts.select("member_id", "username")
    return R.group_metadata(v.rooms, _details(v), v.members, ids).drop("room_id")


def _roster(v: Views):
    return R.group_members(v.rooms, v.members, v.contacts.select("member_id", "username"), v.contacts, NAMES, "Customer#000000003")


_ROSTER = f"""
(SELECT rm.chat, ct.username AS identity, {_NAME.format(p='ct.', id='ct.username')} AS display_name, CASE WHEN ct.username = owner THEN 'owner' ELSE 'member' END AS role,
  ct.username = 'Customer#000000003' AS is_self, ct.member_id AS k FROM mb JOIN rm USING (room_id) JOIN ct USING (member_id))"""


@query("group_members", "J8", f"SELECT chat, identity, display_name, role, is_self, CASE WHEN is_self THEN 'verified_self' ELSE 'verified_not_self' END AS identity_status FROM {_ROSTER}")
def _(v: Views):
    return _roster(v).drop("room_id")


@query("member_nicknames", "J9", f"""
SELECT chat, identity, CASE WHEN k % 3 = 0 THEN 'N1-' || k ELSE display_name END AS display_name, CASE WHEN k % 3 = 0 THEN 'N1-' || k END AS group_nickname,
  CASE WHEN k % 3 = 0 THEN 'verified_room_buffer' ELSE 'not_present' END AS group_nickname_status FROM {_ROSTER}""")
def _(v: Views):
    c = F.col("c_custkey")
    base = v.table("customer").select(text("room-", F.col("c_nationkey")).alias("chat"), F.col("c_name").alias("identity"), c.alias("k"))
    k = F.col("k")
    first = base.filter(k % 3 != 1).select("chat", "identity", F.lit(1).alias("chunk_pos"), F.when(k % 3 == 0, text("N1-", k)).otherwise(F.col("identity")).alias("nickname"), F.lit(0).alias("member_state"))
    second = base.filter(k % 3 == 0).select("chat", "identity", F.lit(2).alias("chunk_pos"), text("N2-", k).alias("nickname"), F.lit(1).alias("member_state"))
    return R.overlay_nicknames(_roster(v), first.unionByName(second)).select("chat", "identity", "display_name", "group_nickname", "group_nickname_status")


def _observed(v: Views):
    """Customers who ordered appear as senders in their nation's room and in the next one."""
    n = F.col("c_nationkey")
    buyers = v.table("customer").join(v.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return buyers.select(
        F.explode(F.array(text("room-", n), text("room-", (n + 1) % 25))).alias("chat"), F.col("c_name").alias("identity"), F.col("c_name").alias("display_name")
    )


@query("roster_with_observed", "J10 anti join and union", f""",
ros AS (SELECT * FROM {_ROSTER}),
obs AS (SELECT DISTINCT 'room-' || ((c_nationkey + i) % 25) AS chat, c_name AS identity FROM customer, (SELECT 0 AS i UNION ALL SELECT 1) WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT chat, identity, display_name, role, true AS current FROM ros
UNION ALL SELECT chat, identity, identity, 'observed_sender', false FROM obs WHERE NOT EXISTS (SELECT 1 FROM ros WHERE ros.chat = obs.chat AND ros.identity = obs.identity)""")
def _(v: Views):
    return R.participants_with_observed(_roster(v), _observed(v))


@query("metadata_only_groups", "J11", "SELECT chat FROM rm WHERE room_id NOT IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 3 <> 0)")
def _(v: Views):
    exported = v.table("orders").join(v.table("customer").filter("c_nationkey % 3 <> 0"), F.col("o_custkey") == F.col("c_custkey"))
    return R.metadata_only_groups(v.rooms, exported.select(text("room-", F.col("c_nationkey")).alias("chat"))).select("chat")


@query("name_variants", "J12", """
SELECT DISTINCT user_id, event_type AS name_variant, variants FROM events JOIN (SELECT user_id, count(DISTINCT event_type) AS variants FROM events GROUP BY 1) USING (user_id) WHERE variants > 1""")
def _(v: Views):
    return R.name_variants(v.table("events"), ["user_id"], "event_type")


@query("session_metadata", "J13", """
SELECT 'user-' || p_partkey AS chat, p_size::BIGINT AS unread_count, (p_partkey % 60)::BIGINT AS last_message_type, p_partkey % 3 = 0 AS is_hidden,
  CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 1000 END AS last_message_epoch, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS last_message_preview FROM part""")
def _(v: Views):
    k = F.col("p_partkey")
    rows = v.table("part").select(
        text("user-", k).alias("chat"), F.lit(1).alias("type"), F.col("p_size").alias("unread_count"), F.lit(0).alias("status"),
        (k % 60 + F.lit(4294967296) * (k % 7)).alias("last_msg_type"), F.lit(0).alias("last_msg_sub_type"), F.when(k % 3 == 0, 1).otherwise(0).alias("is_hidden"),
        F.when(k % 4 != 0, k * 1000).otherwise(0).alias("last_timestamp"), F.lit(0).alias("sort_timestamp"),
        F.when(k % 5 != 0, F.col("p_name")).otherwise("").alias("summary"), F.lit("").alias("last_msg_sender"), F.lit("").alias("last_sender_display_name"),
    )
    found = R.session_metadata(rows)
    return found.select("chat", "unread_count", "last_message_type", "is_hidden", F.unix_seconds("last_message_at").alias("last_message_epoch"), "last_message_preview")


@query("contact_metadata", "J13 contacts", """
SELECT username, 'resolved' AS contact_status, nullif(remark, '') AS remark, nullif(nick_name, '') AS nickname, alias FROM ct""")
def _(v: Views):
    return R.contact_metadata(v.contacts, {"remark": "remark", "nickname": "nick_name", "alias": "alias"})


@query("adapter_summary", "H19", """
SELECT conversation_id, count(*) AS messages, count(*) FILTER (direction = 'incoming') AS incoming, count(*) FILTER (direction = 'outgoing') AS outgoing,
  count(*) FILTER (direction = 'system') AS system, count(*) FILTER (direction = 'unknown') AS unknown FROM m GROUP BY 1""")
def _(v: Views):
    return R.adapter_summary(v.messages, ["conversation_id"])
