import json
import os
import random
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia import functions as X
from evidentia.operators import content as C
from evidentia.operators import resolve as R
from evidentia.operators import rules
from evidentia.operators.validate import ArgumentError, filter_window
from evidentia.sources import group_exports as G
from evidentia.sources.store import Store, write_store
from evidentia.streaming import jobs


def group_document(**changes):
    info = {"name": "Team", "type": "group", "selfUid": "u-me", "peerUid": "peer-1", "participantCount": 3}
    info.update(changes)
    return {
        "chatInfo": info,
        "messages": [
            {
                "id": "1", "timestamp": 1787965200000, "sender": {"uid": "u-ann", "name": "Ann"}, "system": False,
                "content": {"text": "hi", "resources": [{"type": "image", "filename": "a b?.jpg", "localPath": "img/a.jpg"}]},
            },
            {
                "id": "2", "timestamp": 1787965300000, "sender": {"uid": "u-me", "name": "Me"}, "system": False,
                "content": {"text": "", "resources": [{"type": "file", "filename": "x.pdf"}, {"type": "sticker"}]},
            },
            {
                "id": "3", "timestamp": 1788105600000, "sender": {"name": "Nobody"}, "system": True, "content": {"resources": []},
            },
        ],
    }


def parsed(spark, *documents):
    rows = [(f"/x/{i}.json", json.dumps(d)) for i, d in enumerate(documents)]
    return G.parse_group_exports(spark.createDataFrame(rows, "path string, content string"))


def test_group_window_and_directions(spark):
    since = datetime(2026, 8, 29, 1, tzinfo=timezone.utc)
    until = datetime(2026, 8, 30, 16, tzinfo=timezone.utc)
    rows = G.group_messages(parsed(spark, group_document()), since, until).orderBy("sent_at").collect()
    assert [r.direction for r in rows] == ["incoming", "outgoing"]
    assert [p.type for p in rows[0].parts] == ["text", "image"] and rows[0].parts[1].file_name == "a b_.jpg"
    assert rows[1].parts[0].path.startswith("attachments/missing/") and rows[1].parts[0].mime_type == "application/pdf"
    everything = G.group_messages(parsed(spark, group_document())).orderBy("sent_at").collect()
    assert everything[2].direction == "system" and everything[2].parts[0].subtype == "derived_placeholder"
    with pytest.raises(ArgumentError):
        filter_window(parsed(spark, group_document()), "x", until, since)


def test_group_export_problems(spark):
    found = G.export_problems(parsed(spark, group_document(type="private"), group_document(peerUid=None), group_document()))
    assert {r.path: r.problem for r in found.collect()} == {"/x/0.json": "not_a_group_export", "/x/1.json": "no_stable_group_id"}


def test_group_duplicates(spark):
    changed = group_document()
    changed["messages"][0]["content"]["text"] = "other"
    clean, conflicting = G.dedupe_group_messages(G.group_messages(parsed(spark, group_document(), changed)))
    assert {r[0] for r in conflicting.collect()} == {"group:peer-1:1"}
    assert {r.external_message_id for r in clean.collect()} == {"group:peer-1:2", "group:peer-1:3"}


def test_decode_zstd_and_plain(spark):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write("zażółć".encode())
    rows = [(1, bytearray(sink.getvalue().to_pybytes()), 4), (2, bytearray(b"plain\x00\x00"), 0), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, message_content binary, content_type int")
    assert {r.id: r.text for r in C.decode_content(df).collect()} == {1: "zażółć", 2: "plain", 3: ""}


@pytest.mark.parametrize(
    "text, prefix, body",
    [
        ("ann:\nhello\nthere", "ann", "hello\nthere"),
        ("two words:\nx", None, "two words:\nx"),
        (":\nx", None, ":\nx"),
        ("a:b:\nrest", "a:b", "rest"),
        ("ann:\nx:\ny", "ann", "x:\ny"),
        ("none", None, "none"),
    ],
)
def test_group_prefix(spark, text, prefix, body):
    row = spark.createDataFrame([(text, True)], "t string, g boolean").select(C.strip_group_prefix("t", "g").alias("s")).first().s
    assert (row.prefix_sender, row.body) == (prefix, body)


@pytest.mark.parametrize(
    "text, kind, shown",
    [
        ("<msg><appmsg><title>Doc</title><type>6</type></appmsg></msg>", "file", "Doc"),
        ("noise <appmsg><title>T</title><type>5</type><url>http://x</url></appmsg>", "link", "T"),
        ("<msg><x><appmsg><title>T</title></appmsg></x></msg>", "text", "T"),
        ("<msg><appmsg><title>T</title></msg>", "system", "[Chat app message]"),
        ("<msg><appmsg><title>T</title></appmsg></msg> tail", "system", "[Chat app message]"),
        ("<appmsg><title></title></appmsg>", "text", "Chat app message"),
        ("no markup", "system", "[Chat app message]"),
    ],
)
def test_app_markup(spark, text, kind, shown):
    df = spark.createDataFrame([(49, text, 1)], "base_type int, text string, local_id int")
    part = C.parts_from_type_code(df).first().parts[0]
    assert (part.type, part.file_name or part.text) == (kind, shown)


def test_location_prefers_place_name(spark):
    rows = [(48, '<msg><location poiname="P" label="L"/></msg>', 1), (48, '<location label="L"/>', 2), (48, "<location/>", 3)]
    df = spark.createDataFrame(rows, "base_type int, text string, local_id int")
    assert [r.parts[0].text for r in C.parts_from_type_code(df).orderBy("local_id").collect()] == ["P", "L", "[Chat location]"]


def test_resource_key_prefers_marker(spark):
    key, other = b"A" * 32, b"b" * 32
    rows = [
        (1, bytearray(b"\x00" + other + b"\x12\x22\x0a\x20" + key)), (2, bytearray(b"\x12\x22\x0a\x20zz" + other)), (3, bytearray(b"abc")),
    ]
    df = spark.createDataFrame(rows, "id int, b binary").select("id", X.extract_resource_key("b").alias("k"))
    assert {r.id: r.k for r in df.collect()} == {1: "a" * 32, 2: "b" * 32, 3: None}


def test_safe_names_and_urls(spark):
    df = spark.createDataFrame([(" a/b/c?.txt ", "https://h/x"), (None, "https:///x"), ("...", "ftp://h")], "n string, u string")
    rows = df.select(X.safe_file_name("n", "d/e.bin").alias("n"), X.http_url("u").alias("u")).collect()
    assert [(r.n, r.u) for r in rows] == [("c_.txt", "https://h/x"), ("e.bin", None), ("attachment", None)]


def test_instants_need_a_zone(spark):
    values = ["2026-08-29T09:00:00+08:00", "2026-08-29T01:00:00.5Z", "2026-08-29T09:00:00", "junk"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.unix_millis(X.parse_instant("v")).alias("ms"))
    assert [r.ms for r in df.collect()] == [1787965200000, 1787965200500, None, None]


def test_self_resolution(spark):
    accounts = spark.createDataFrame([("ann", "x"), ("q", "bob_b_99"), ("z", "zed")], "account_id string, profile_name string")
    contacts = spark.createDataFrame([("ann",), ("bob",), ("bob_b",), ("bo",)], "username string")
    found = {r.account_id: (r.self_id, r.self_status) for r in R.resolve_self(accounts, contacts).collect()}
    assert found == {
        "ann": ("ann", "verified_explicit_account_id"), "q": ("bob_b", "verified_profile_directory"), "z": (None, "unresolved"),
    }


def messages(spark, *texts):
    rows = [(f"m{i}", datetime(2026, 8, 1, 0, i, tzinfo=timezone.utc), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "message_id string, sent_at timestamp, body string")


def test_scan_is_incremental(spark):
    rule = rules.default_rule()
    corpus = messages(spark, "社团报名今晚截止", "hello", "开始申请", "  ")
    empty = spark.createDataFrame([], "rule_id string, message_id string")
    first = rules.scan_messages(corpus, empty, rule)
    rows = {r.message_id: r for r in first.collect()}
    assert rows["m0"].event_type == "registration_deadline" and rows["m2"].event_type == "registration"
    assert rows["m1"].event_type is None and rows["m3"].title == "[无可提取文本]"
    assert rows["m0"].candidate_id == "evt_" + rows["m0"].dedup_key[:32]
    state = rules.scan_state_rows(first, rule, F.current_timestamp(), "r1")
    assert state.count() == 4 and rules.scan_messages(corpus, state, rule).count() == 0
    capped = rules.scan_messages(corpus, empty, rule, cap=2)
    assert {r.message_id for r in capped.collect()} == {"m0", "m1"}
    with pytest.raises(rules.RuleError):
        rules.scan_messages(corpus, empty, rule, cap=0)


def test_rule_guard(spark):
    rule = rules.default_rule()
    rules.check_rule(rule.row(spark), rule)
    with pytest.raises(rules.RuleError):
        rules.check_rule(rule.row(spark, enabled=False), rule)
    with pytest.raises(rules.RuleError):
        rules.check_rule(rule.row(spark).withColumn("definition_json", F.lit("{}")), rule)


def test_candidates_refresh_but_keep_review(spark):
    rule = rules.default_rule()
    empty = spark.createDataFrame([], "rule_id string, message_id string")
    matched = rules.scan_messages(messages(spark, "报名", "截止"), empty, rule)
    old = rules.candidate_rows(matched.filter("message_id = 'm0'"), rule, F.timestamp_seconds(F.lit(1)))
    old = old.withColumn("review_status", F.lit("APPROVED"))
    new = rules.candidate_rows(matched, rule, F.timestamp_seconds(F.lit(9)))
    merged = {r.title: r for r in rules.merge_candidates(old, new).collect()}
    assert merged["报名"].review_status == "APPROVED" and merged["截止"].review_status == "REVIEW_REQUIRED"
    seconds = lambda r: (r.first_seen_at.timestamp() % 60, r.last_seen_at.timestamp() % 60)
    assert seconds(merged["报名"]) == (1, 9) and seconds(merged["截止"]) == (9, 9)


def drained(spark, root, schema, rule, files=1000, **options):
    """One query over what has arrived: a restart between any two calls."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    jobs.stream_scan(stream, rule, f"{root}/store", f"{root}/checkpoint", **options).awaitTermination()
    return Store(spark, f"{root}/store")


def test_stream_scan_scans_once(spark, tmp_path):
    rule, root = rules.default_rule(), str(tmp_path)
    first, late = messages(spark, "报名", "x"), messages(spark, "报名", "x", "截止")
    first.write.parquet(f"{root}/in")
    store = drained(spark, root, first.schema, rule)
    assert {(r.message_id, r.matched) for r in store["scan_state"].collect()} == {("m0", True), ("m1", False)}
    late.write.mode("append").parquet(f"{root}/in")
    store = drained(spark, root, first.schema, rule)
    assert sorted((r.message_id, r.matched) for r in store["scan_state"].collect()) == [("m0", True), ("m1", False), ("m2", True)]
    found = {r.candidate_id: r.event_type for r in store["candidates"].collect()}
    links = {(r.message_id, found[r.candidate_id]) for r in store["evidence"].collect()}
    assert links == {("m0", "registration"), ("m2", "deadline")} and len(found) == 2
    assert sum(r.scanned_messages for r in store["monitor_runs"].collect()) == 3
    assert rules.select_unscanned(late, store["scan_state"], rule.id).count() == 0


def test_stream_scan_of_many_batches_keeps_its_state_small(spark, tmp_path):
    """Twenty batches that repeat most ids: one row an id, few folders a bucket, the same result as one batch scan."""
    rule, root = rules.Rule("r", "1", {"a": ["alpha"], "b": ["beta"]}, "both"), str(tmp_path)
    types = "message_id string, sent_at timestamp, body string"
    rows = [(f"m{i}", datetime(2026, 1, 1), ["alpha", "beta", "alpha beta", "x"][i % 4]) for i in range(40)]
    every = spark.createDataFrame(rows, types)
    write_store({"scan_state": spark.createDataFrame([("r", "m39")], "rule_id string, message_id string")}, f"{root}/store", buckets=2)
    for i in range(20):
        part = [rows[j] for j in range(40) if j <= 2 * i + 1 and (j >= 2 * i or j % 3 == 0)]
        spark.createDataFrame(part, types).coalesce(1).write.mode("append").parquet(f"{root}/in")
    store = drained(spark, root, every.schema, rule, folders=3, files=1)
    assert store.version > 20
    assert store["scan_state"].count() == store["scan_state"].select("message_id").distinct().count() == 40
    assert all(len(x) <= 4 for x in store.layers("scan_state").values())
    scan = rules.scan_messages(every, spark.createDataFrame([("r", "m39")], "rule_id string, message_id string"), rule)
    want = {(r.candidate_id, r.event_type) for r in rules.candidate_rows(scan, rule, F.current_timestamp()).collect()}
    assert {(r.candidate_id, r.event_type) for r in store["candidates"].collect()} == want
    assert {(r.candidate_id, r.message_id) for r in store["evidence"].collect()} == {(r.candidate_id, r.message_id) for r in rules.evidence_rows(scan).collect()}
    runs = store["monitor_runs"].agg(F.count("*"), F.sum("scanned_messages"), F.sum("candidate_count")).first()
    assert tuple(runs) == (20, 39, len(want))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rule, root = rules.default_rule(), str(tmp_path)
    seen = messages(spark, "报名", "x", "截止")
    seen.coalesce(1).write.parquet(f"{root}/in")
    before = drained(spark, root, seen.schema, rule)
    # the stream forgets that it has finished its batch
    for name in os.listdir(f"{root}/checkpoint/commits"):  # and their checksums
        os.remove(f"{root}/checkpoint/commits/{name}")
    after = drained(spark, root, seen.schema, rule)
    assert after.version == before.version
    assert after["monitor_runs"].count() == 1 and after["scan_state"].count() == 3


def test_many_rules_equal_each_rule_alone(spark):
    """Twenty rules with 500 keywords: one pass finds what each rule's own scan finds, with a plan of the same size."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abc报名") for _ in range(draw.randrange(1, 4)))
    many = [
        rules.Rule(f"r{i}", "1", {f"t{j}": sorted({word() for _ in range(9)}) for j in range(i % 3 + 1)}, f"all{i}") for i in range(20)
    ]
    rows = [(f"m{i}", "".join(draw.choice("abc报名 ") for _ in range(draw.randrange(30)))) for i in range(60)] + [("none", None), ("empty", "")]
    bodies = spark.createDataFrame(rows, "message_id string, body string")
    got = {(r.message_id, r.rule_id): (r.event_type, r.matches) for r in rules.match_rule_table(bodies, rules.rule_table(spark, many)).collect()}
    want = {}
    for rule in many:
        for key, body in rows:
            hits = {t: [w for w in words if body and w in body] for t, words in rule.event_types.items()}
            hits = {t: found for t, found in hits.items() if found}
            if hits:
                every = len(rule.event_types) > 1 and len(hits) == len(rule.event_types)
                want[key, rule.id] = (rule.combined if every else next(iter(hits)), hits)
    assert got == want and len(want) > 100
    one = rules.match_rule_table(bodies, rules.rule_table(spark, many[:1]))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(one) - size(rules.match_rule_table(bodies, rules.rule_table(spark, many)))) < 50
    plain = {r.message_id: r.event_type for r in rules.match_rules(bodies.withColumn("sent_at", F.current_timestamp()), many[2]).collect() if r.event_type}
    assert plain == {key: found[0] for (key, rule), found in got.items() if rule == "r2"}


def test_rule_table_is_checked(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_KEYWORDS", 2)
    bodies = spark.createDataFrame([("m", "a")], "message_id string, body string")
    with pytest.raises(rules.RuleError):
        rules.match_rule_table(bodies, rules.rule_table(spark, [rules.Rule("r", "1", {"t": ["a", "b", "c"]}, "x")]))
    always = rules.match_rule_table(bodies, rules.rule_table(spark, [rules.Rule("r", "1", {"t": [""]}, "x")])).first()
    assert always.matches == {"t": [""]}
