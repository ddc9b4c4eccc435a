import copy
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from evidentia.operators import query as Q
from evidentia.operators.validate import ArgumentError, manifest_problems
from evidentia.plans.importing import import_documents
from evidentia.sources.files import scan_files
from evidentia.sources.manifests import (
    build_manifests,
    flatten_manifests,
    parse_documents,
    read_manifest_lines,
    read_manifests,
    write_manifest_lines,
)
from evidentia.sources.store import current_version, read_store, write_store
from tests.helpers import VERSION, manifest, write

def as_of():
    return F.timestamp_seconds(F.lit(1788100000))



def run(spark, folder, store=None):
    return import_documents(read_manifests(spark, folder), scan_files(spark, folder), as_of(), store)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = write(tmp_path_factory.mktemp("first"), manifest())
    result = run(spark, folder)
    root = str(tmp_path_factory.mktemp("store"))
    write_store(result.tables, root)
    return {"folder": folder, "result": result, "root": root, "tables": read_store(spark, root, list(result.tables))}


def test_first_import_counts(stored):
    row = stored["result"].runs.first()
    assert (row.inserted_messages, row.reused_messages, row.present_attachments, row.missing_attachments) == (4, 0, 1, 1)
    codes = [r.code for r in stored["result"].warnings.collect()]
    assert codes == ["ATTACHMENT_MISSING"]


def test_second_import_is_known(spark, stored):
    again = run(spark, stored["folder"], stored["tables"])
    assert again.runs.count() == 0
    known = again.already_imported.first()
    assert known.status == "already_imported" and known.inserted_messages == 4
    assert again.tables["messages"].count() == 4


def test_conflict_keeps_first_text(spark, stored, tmp_path):
    changed = manifest()
    changed["conversations"][0]["messages"][0]["parts"][0]["text"] = "Rewritten"
    changed["conversations"][0]["title"] = "Renamed room"
    result = run(spark, write(tmp_path / "b", changed), stored["tables"])
    row = result.runs.first()
    assert (row.inserted_messages, row.reused_messages, row.conflicts) == (0, 4, 1)
    texts = {r.text_content for r in result.tables["parts"].collect()}
    assert "Rewritten" not in texts and "Meeting at 50% capacity_A" in texts
    titles = {r.title for r in result.tables["conversations"].collect()}
    assert titles == {"Renamed room", "Ann"}


@pytest.mark.parametrize(
    "path, rejected", [("../x", True), ("/etc/x", True), ("files/../files/plan.txt", False), ("a/../../x", True)]
)
def test_path_escape_rejects_document(spark, tmp_path, path, rejected):
    document = manifest()
    document["conversations"][0]["messages"][1]["parts"][0]["path"] = path
    result = run(spark, write(tmp_path / "p", document))
    assert (result.problems.count() > 0) is rejected
    assert result.tables["messages"].count() == (0 if rejected else 4)
    if not rejected:
        assert result.runs.first().present_attachments == 1


def problems(spark, text):
    raw = spark.createDataFrame([("/x/a.json", text)], "path string, content string")
    return {(r.location, r.problem) for r in manifest_problems(parse_documents(raw)).collect()}


def broken(change):
    import json

    document = copy.deepcopy(manifest())
    change(document)
    return json.dumps(document)


def _set(path, value):
    def change(document):
        node = document
        for key in path[:-1]:
            node = node[key]
        node[path[-1]] = value

    return change


@pytest.mark.parametrize(
    "path, value, problem",
    [
        (["schema_version"], "other", "schema_version_unsupported"),
        (["exported_at"], "2026-08-30T10:00:00", "exported_at_not_instant"),
        (["source", "kind"], " ", "source_kind_missing"),
        (["source", "account_id"], 12, "source_account_missing"),
        (["conversations", 0, "title"], "", "title_missing"),
        (["conversations", 0, "type"], "channel", "type_unsupported"),
        (["conversations", 0, "participants"], {}, "participants_not_array"),
        (["conversations", 0, "participants_complete"], "yes", "participants_complete_not_boolean"),
        (["conversations", 0, "messages"], None, "messages_not_array"),
        (["conversations", 0, "last_activity"], 5, "last_activity_not_instant"),
        (["conversations", 0, "participants", 0, "display_name"], None, "display_name_missing"),
        (["conversations", 0, "messages", 0, "timestamp"], "yesterday", "timestamp_not_instant"),
        (["conversations", 0, "messages", 0, "direction"], "sideways", "direction_unsupported"),
        (["conversations", 0, "messages", 0, "sender_name"], None, "sender_name_not_string"),
        (["conversations", 0, "messages", 0, "parts"], [], "parts_not_array"),
        (["conversations", 0, "messages", 0, "parts", 0, "type"], "hologram", "part_type_unsupported"),
        (["conversations", 0, "messages", 0, "parts", 0, "text"], 7, "text_missing"),
        (["conversations", 0, "messages", 2, "parts", 0, "transcription"], 7, "transcription_not_string"),
    ],
)
def test_each_contract_rule(spark, path, value, problem):
    found = problems(spark, broken(_set(path, value)))
    assert {p for _, p in found} == {problem}


def test_valid_document_has_no_problem(spark):
    import json

    assert problems(spark, json.dumps(manifest())) == set()


@pytest.mark.parametrize("text", ["nope", "[1]", '{"a":1} trailing', '{"a":1}}', '{"a":1}]', "5"])
def test_non_objects_are_named(spark, text):
    assert "document_not_object" in {p for _, p in problems(spark, text)}


def test_search_and_paging(spark, stored):
    t = stored["tables"]
    assert [r.external_message_id for r in Q.search_messages(t, "50% capacity_A").collect()] == ["g1"]
    assert Q.search_messages(t, "5% capacity").count() == 0
    assert [r.external_message_id for r in Q.search_messages(t, "SPOKEN words").collect()] == ["g3"]
    assert Q.search_messages(t, "", media_type="any").count() == 2
    assert [r.external_message_id for r in Q.search_messages(t, "", sender="zoe").collect()] == ["g3", "g1"]
    seen, after = [], None
    while True:
        rows = Q.search_messages(t, "", after=after, limit=1).collect()
        seen.append(rows[0].external_message_id)
        if len(rows) < 2:
            break
        after = (rows[0].sent_at, rows[0].message_id)
    assert seen == ["d1", "g3", "g2", "g1"]


def test_date_bounds_are_exclusive(stored):
    edge = datetime(2026, 8, 30, 1, 1, tzinfo=timezone.utc)
    t = stored["tables"]
    assert [r.external_message_id for r in Q.search_messages(t, "", date_after=edge).collect()] == ["d1", "g3"]
    assert [r.external_message_id for r in Q.search_messages(t, "", date_before=edge).collect()] == ["g1"]


@pytest.mark.parametrize("arguments", [{"limit": 0}, {"limit": 501}, {"limit": True}, {"media_type": "gif"}, {"query": 5}])
def test_bad_search_arguments(stored, arguments):
    with pytest.raises(ArgumentError):
        Q.search_messages(stored["tables"], **arguments)


def test_hydration_keeps_residue(stored):
    t = stored["tables"]
    page = Q.search_messages(t, "capacity_A")
    row = Q.hydrate_messages(page, t["parts"], t["attachments"]).first()
    assert row.parts[0].source_metadata == '{"tone":"calm"}'
    assert row.source_metadata == '{"seq":1}'


def test_digest_document(stored):
    t = stored["tables"]
    window = Q.digest_window(t)
    blocks = Q.digest_markdown(Q.digest_counts(window, t["attachments"]), Q.digest_excerpts(window, t["parts"]))
    text = "\n\n".join(r.markdown for r in blocks.orderBy("block_order").collect())
    assert text.startswith("# Deterministic") and "Messages considered: 4" in text
    assert text.index("### Ann") < text.index("### Club room")
    assert "2026-08-30T01:02:00Z Zoe: spoken words (message_id=msg_" in text


def test_context_and_roster(spark, stored):
    t = stored["tables"]
    target = t["messages"].filter("external_message_id = 'g2'")
    rows = Q.read_context(t["messages"], target, 1, 1).orderBy("item_index").collect()
    names = {r.message_id: r.external_message_id for r in t["messages"].collect()}
    assert [names[r.message_id] for r in rows] == ["g1", "g2", "g3"] and rows[0].target_index == 1
    roster = Q.conversation_roster(t).filter("role IS NOT NULL").orderBy("position").collect()
    assert [(r.display_name, r.role) for r in roster] == [("Me", "owner"), ("Zoe", "member")]


def test_listing_flags(stored):
    rows = {r.title: r for r in Q.list_conversations(stored["tables"]).collect()}
    club = rows["Club room"]
    assert (club.message_count, club.participant_count, club.unread_count) == (3, 2, 3)
    assert club.has_announcement and club.participants_complete and club.current_member_count == 2
    assert rows["Ann"].conversation_type == "single" and not rows["Ann"].has_announcement


def test_status_and_digest(stored):
    t = dict(stored["tables"])
    t["heartbeats"] = t["sources"].sparkSession.createDataFrame(
        [],
        "source_kind string, external_account_id string, detector_id string, state string, observation_scope string, "
        "consecutive_failures long, worker_heartbeat_at timestamp, stale_after_seconds double",
    )
    row = Q.source_status(t, as_of()).first()
    assert (row.message_count, row.conversation_count, row.availability_state) == (4, 2, "IMPORTED_EVIDENCE_AVAILABLE")
    assert row.collector_freshness_state == "NOT_RECORDED"
    window = Q.digest_window(t)
    counts = {(r.section, r.name): r["items"] for r in Q.digest_counts(window, t["attachments"]).collect()}
    assert counts[("sender", "Zoe")] == 2 and counts[("attachment", "missing")] == 1
    excerpts = {r.excerpt for r in Q.digest_excerpts(window, t["parts"]).collect()}
    assert "[attachment-only message]" in excerpts and "https://example.org/x" in excerpts


def test_roster_replace_and_merge(spark, stored, tmp_path):
    late = manifest(exported_at="2026-09-01T00:00:00Z")
    late["conversations"] = [
        {
            "source_conversation_id": "room-1", "title": "Club room", "type": "group", "participants_complete": True,
            "participants": [{"source_identity_id": "u-new", "display_name": "New"}], "messages": [],
        },
        {
            "source_conversation_id": "dm-1", "title": "Ann",
            "participants": [{"source_identity_id": "u-bob", "display_name": "Bob"}], "messages": [],
        },
    ]
    result = run(spark, write(tmp_path / "late", late), stored["tables"])
    names = result.tables["identities"].select("identity_id", "display_name")
    titles = result.tables["conversations"].select("conversation_id", "title")
    rows = result.tables["participants"].join(names, "identity_id").join(titles, "conversation_id").collect()
    assert {(r.title, r.display_name) for r in rows} == {("Club room", "New"), ("Ann", "Ann"), ("Ann", "Bob")}


def test_order_of_files_does_not_matter(spark, tmp_path):
    first, second = manifest(), manifest(exported_at="2026-08-31T10:00:00+08:00")
    second["conversations"][0]["messages"][0]["parts"][0]["text"] = "Later text"
    second["conversations"][0]["title"] = "Later title"
    outcomes = []
    for names in (("a.json", "z.json"), ("z.json", "a.json")):
        folder = tmp_path / names[0]
        write(folder, first, names[0])
        result = run(spark, write(folder, second, names[1]))
        parts = sorted(r.text_content or "" for r in result.tables["parts"].collect())
        titles = sorted(r.title for r in result.tables["conversations"].collect())
        outcomes.append((parts, titles, sorted(r.inserted_messages for r in result.runs.collect())))
    assert outcomes[0] == outcomes[1]
    assert "Later text" not in outcomes[0][0] and "Later title" in outcomes[0][1] and outcomes[0][2] == [0, 4]


def test_export_round_trip(spark, stored):
    flat = flatten_manifests(read_manifests(spark, stored["folder"]))
    sources = flat["sources"].select("source_id", "kind", "external_account_id", "display_name").distinct()
    documents = build_manifests(sources, flat["conversations"], flat["participants"], flat["messages"], VERSION, 2)
    raw = documents.select(F.lit("/x/y.json").alias("path"), F.col("document").alias("content"))
    again = parse_documents(raw)
    assert manifest_problems(again).count() == 0
    back = flatten_manifests(again)
    key = ["message_id", "conversation_id", "search_body"]
    assert sorted(back["messages"].select(*key).collect()) == sorted(flat["messages"].select(*key).collect())
    members = ["conversation_id", "identity_id"]
    assert sorted(back["participants"].select(*members).collect()) == sorted(flat["participants"].select(*members).collect())


def test_documents_as_lines(spark, stored, tmp_path):
    flat = flatten_manifests(read_manifests(spark, stored["folder"]))
    sources = flat["sources"].select("source_id", "kind", "external_account_id", "display_name").distinct()
    documents = build_manifests(sources, flat["conversations"], flat["participants"], flat["messages"], VERSION, 2)
    path = str(tmp_path / "lines")
    write_manifest_lines(documents, path)
    back = read_manifest_lines(spark, path)
    assert back.count() == documents.count() and manifest_problems(back).count() == 0


def test_store_versions(spark, stored, tmp_path):
    root = str(tmp_path / "s")
    assert current_version(spark, root) == 0
    assert write_store({"messages": stored["tables"]["messages"]}, root) == 1
    assert write_store({"messages": stored["tables"]["messages"].limit(1)}, root) == 2
    assert read_store(spark, root, ["messages"])["messages"].count() == 1
    assert read_store(spark, root, ["messages"], 1)["messages"].count() == 4


def test_large_bodies_are_hashed_in_chunks(spark, tmp_path):
    import hashlib

    from evidentia.operators.merge import import_warnings
    from evidentia.sources import files

    bodies = {"large one.bin": bytes(range(256)) * 70_000, "small.bin": b"small"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = {r.relative_path: r for r in scan_files(spark, str(tmp_path), max_bytes=1000).collect()}
    for name, body in bodies.items():
        assert (rows[name].sha256, bytes(rows[name].header)) == (hashlib.sha256(body).hexdigest(), body[:16])
        assert rows[name].size_bytes == len(body)
    assert files.digest_in_chunks("unknown://store/a") == (None, None)
    with pytest.raises(OSError):
        files.digest_in_chunks(str(tmp_path / "gone.bin"))
    columns = "manifest_sha256 string, message_id string, part_index long, source_relative_path string, status string, blob_sha256 string"
    found = [("d", "m1", 0, "a", "present", None), ("d", "m2", 0, "b", "present", "x"), ("d", "m3", 0, "c", "missing", None)]
    none = spark.createDataFrame([], "manifest_sha256 string, code string, message_id string, source_message_id string, part_index long, path string")
    codes = {(r.message_id, r.code) for r in import_warnings(none, spark.createDataFrame(found, columns)).collect()}
    assert codes == {("m1", "ATTACHMENT_NOT_HASHED"), ("m3", "ATTACHMENT_MISSING")}


def test_documents_are_read_once(spark, tmp_path):
    """Checks and all levels come from one pass: a counter in the scan sees each document once."""
    from evidentia.operators.validate import checked_documents, split_valid

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    folder = write(tmp_path / "a", manifest())
    (tmp_path / "a" / "bad.json").write_text('{"schema_version": 1}')
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "content")
    documents = parse_documents(raw.mapInArrow(count, "path string, content binary"))
    result = import_documents(documents, scan_files(spark, folder), as_of())
    assert {name: df.count() for name, df in result.tables.items()}["messages"] == 4 and result.problems.count() > 3
    assert result.warnings.count() == 1 and seen.value == 2
    good, problems = split_valid(checked_documents(parse_documents(raw)))
    assert good.count() == 1 and {r.problem for r in problems.collect()} >= {"conversations_not_array", "source_kind_missing"}


def test_one_schema_version(spark, tmp_path):
    folder = write(tmp_path / "a", manifest())
    documents = read_manifests(spark, folder)
    assert manifest_problems(documents).count() == 0 == manifest_problems(documents, VERSION).count()
    assert [r.problem for r in manifest_problems(documents, "other-import/v1").collect()] == ["schema_version_unsupported"]
    result = import_documents(documents, scan_files(spark, folder), as_of(), version="other-import/v1")
    assert result.runs.count() == 0 and result.problems.count() == 1
