import hashlib
import json

from pyspark.sql import functions as F

from evidentia.operators.validate import manifest_problems
from evidentia.plans.adapting import ShardedTables, adapt_group_exports, adapt_keyed, adapt_sharded
from evidentia.plans.importing import import_documents
from evidentia.session import stage
from evidentia.sources.manifests import parse_documents
from tests.helpers import VERSION
from tests.test_adapters import group_document, parsed


def imported(spark, export):
    written = export.documents(VERSION, F.timestamp_seconds(F.lit(1788100000)))
    raw = written.select(F.concat_ws("/", F.lit("/x"), "conversation_id", "chunk").alias("path"), F.col("document").alias("content"))
    documents = parse_documents(stage(raw, "documents"))
    assert manifest_problems(documents).collect() == []
    files = spark.createDataFrame([], "path string, sha256 string, size_bytes long")
    return import_documents(documents, files, F.timestamp_seconds(F.lit(1788100001)))


def table_name(chat):
    return "Msg_" + hashlib.md5(chat.encode()).hexdigest()


def sharded(spark):
    room = "team@chatroom"
    make = spark.createDataFrame
    rows = [
        ("m0.db", table_name("ann"), 1, 11, 1, 0, 1, 1788000000, b"hello", 0),
        ("m0.db", table_name("ann"), 2, 12, 34, 0, 2, 1788000060, b"", 0),
        ("m1.db", table_name(room), 1, 13, 1, 0, 9, 1788000120, b"bob:\nhi all", 0),
        ("m1.db", table_name(room), 2, 14, 1 + (5 << 32), 0, 2, 1788000180, b"mine", 0),
    ]
    shards = make(
        rows,
        "shard string, table_name string, local_id long, server_id long, local_type long, sort_seq long, sender_row long, "
        "create_time long, message_content binary, content_type int",
    )
    return ShardedTables(
        shards=shards,
        sessions=make([("ann", 1788000060), (room, 1788000180), ("quiet", 1788000000), ("none", 0)], "chat string, last_timestamp long"),
        session_titles=make([(room, "Team chat")], "chat string, session_title string"),
        contacts=make(
            [("ann", 1, "Annie", "", None), ("me", 2, " ", "Me", None), ("bob", 3, "", "Bob", None)],
            "username string, member_id long, remark string, nick_name string, alias string",
        ),
        name_map=make([("m0.db", 1, "ann"), ("m0.db", 2, "me"), ("m1.db", 2, "me")], "shard string, sender_row long, username string"),
        voices=make([("ann", 2, 1788000060, 1, "attachments/voice/v.silk")], "chat string, local_id long, create_time long, row long, voice_path string"),
        rooms=make([(1, room, "me"), (2, "empty@chatroom", "ann")], "room_id long, chat string, owner string"),
        details=make([(1, 0, "Notice", "me", 1788000000)], "room_id long, room_status long, announcement string, announcement_editor string, announcement_time long"),
        members=make([(1, 2), (1, 3), (2, 1), (2, 77)], "room_id long, member_id long"),
        nicknames=make([(room, "bob", 1, "Bobby", 0), (room, "me", 1, "me", 0)], "chat string, identity string, chunk_pos int, nickname string, member_state int"),
    )


def test_sharded_export_imports(spark):
    export = adapt_sharded(sharded(spark), "me", "My account")
    row = export.summary().first()
    assert (row.messages, row.incoming, row.outgoing, row.unknown) == (4, 2, 2, 0)
    result = imported(spark, export)
    t = result.tables
    assert {(r.title, r.conversation_type) for r in t["conversations"].collect()} == {("Annie", "single"), ("Team chat", "group")}
    assert {r.sender_display_name for r in t["messages"].collect()} == {"Annie", "Me", "Bobby"}
    assert {r.text_content for r in t["parts"].filter("part_type = 'text'").collect()} == {"hello", "hi all", "mine"}
    assert t["attachments"].first().file_name == "v.silk"
    roles = t["participants"].join(t["identities"], "identity_id").join(t["conversations"].select("conversation_id", "title"), "conversation_id")
    found = {(r.title, r.external_identity_id, json.loads(r.relation_raw).get("role")) for r in roles.collect()}
    assert found == {("Team chat", "me", "owner"), ("Team chat", "bob", "member"), ("Annie", "ann", None), ("Annie", "me", None)}


def test_sharded_export_limits_and_groups(spark):
    assert adapt_sharded(sharded(spark), "me", max_messages=1).messages.count() == 2
    assert adapt_sharded(sharded(spark), "me", max_conversations=1).conversations.count() == 1
    every = adapt_sharded(sharded(spark), "me", all_groups=True).conversations
    assert {r.external_conversation_id for r in every.collect()} == {"ann", "team@chatroom", "empty@chatroom"}
    partial = every.filter("external_conversation_id = 'empty@chatroom'").first()
    assert not partial.participants_complete and '"membership_status":"partial"' in partial.extra_json
    unresolved = adapt_sharded(sharded(spark), "stranger").summary().first()
    assert unresolved.unknown == 4


def test_keyed_export_imports(spark):
    make = spark.createDataFrame
    columns = (
        "table_name string, primaryKey string, cid string, localId string, mid string, senderId string, createdAt long, contentType int, "
        "content string, messageStatus int, recallStatus int, extension string"
    )
    rows = [
        ("tbmsg_000", "p1", "c1", "l1", "m1", "10", 1788000000, 1, '{"text":"hey"}', 1, 0, '{"a":1}'),
        ("tbmsg_001", "p2", "c1", "l2", None, "20", 1788000060000, 2, '{"url":"https://h/i"}', 1, 0, "{}"),
        ("tbmsg_127", "p3", "c2", "l3", "m3", "20", 1788000120, 500, '{"attachments":[{"extension":"{\\"f_name\\":\\"a.pdf\\"}"}]}', 1, 0, None),
        ("tbmsg_127", "p4", "c2", "l4", "m4", "10", 1788000180, 1200, '{"attachments":[{"extension":{"title":"Card"}}]}', 1, 0, None),
    ]
    conversations = make(
        [("c1", 1, "Ann", 2, 1788000060000, 0, 0), ("c2", 2, " ", 3, None, 1788000000000, 4), ("", 1, "x", 0, 1, 1, 0)],
        "cid string, type int, title string, memberCount int, lastModify long, createAt long, unreadCount int",
    )
    profiles = make([("10", "", "Me", ""), ("20", "Ann A", "", "")], "username string, alias string, nick string, real_name string")
    export = adapt_keyed(make(rows, columns), conversations, profiles, "acct", "10")
    row = export.summary().first()
    assert (row.messages, row.incoming, row.outgoing) == (4, 2, 2)
    t = imported(spark, export).tables
    assert {r.title for r in t["conversations"].collect()} == {"Ann", "Chat conversation"}
    ids = {r.external_message_id for r in t["messages"].collect()}
    assert ids == {"c1:m1", "c1:tbmsg_001:p2:l2", "c2:m3", "c2:m4"}
    assert {r.file_name for r in t["attachments"].collect()} == {"Chat-image-l2.dat".lower(), "a.pdf"}
    assert {r.text_content for r in t["parts"].collect()} == {"hey", "Card", None}


def test_group_export_imports(spark):
    allowed = spark.createDataFrame([("peer-1",)], "allowed_id string")
    export = adapt_group_exports(parsed(spark, group_document(), group_document(peerUid="peer-2")), allowed, "me", "Me myself")
    row = export.summary().first()
    assert (row.messages, row.incoming, row.outgoing, row.system) == (3, 1, 1, 1)
    t = imported(spark, export).tables
    assert t["messages"].count() == 3 and t["conversations"].first().title == "Team"
    people = {(r.external_identity_id, r.display_name, r.is_self) for r in t["identities"].collect()}
    assert people == {("u-me", "Me myself", True), ("u-ann", "Ann", False)}
