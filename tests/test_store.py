"""The store's log of file sets: what a commit writes, what it leaves alone, what each version holds."""

import os

import pytest
from pyspark.sql import functions as F

from evidentia.plans.importing import import_into
from evidentia.sources.files import scan_files
from evidentia.sources.manifests import read_manifests
from evidentia.sources.store import ConcurrentCommit, Store, bucket_of, current_version, write_store
from tests.helpers import manifest, write


def files_of(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            found[path] = (os.stat(path).st_mtime_ns, os.path.getsize(path))
    return found


def people(spark, rows):
    columns = "conversation_id string, identity_id string, relation_raw string"
    return spark.createDataFrame(rows, columns)


def bring_in(spark, root, folder):
    return import_into(spark, root, read_manifests(spark, folder), scan_files(spark, folder), F.timestamp_seconds(F.lit(1788048000)))


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    """Two imports: the second renames one conversation and brings one message more, and nothing of the other."""
    base = tmp_path_factory.mktemp("imports")
    root = str(base / "store")
    first = manifest()
    assert bring_in(spark, root, write(base / "a", first))[0] == 1
    before = files_of(root)
    room = dict(first["conversations"][1])
    message = dict(room["messages"][0], source_message_id="d2", parts=[{"type": "text", "text": "second"}])
    room.update(title="Ann B", messages=[room["messages"][0], message])
    second = manifest(exported_at="2026-08-31T10:00:00+08:00", conversations=[room])
    version, result = bring_in(spark, root, write(base / "b", second))
    return {"root": root, "before": before, "version": version, "result": result, "folder": str(base / "b")}


def test_second_import_writes_beside_the_first(spark, imported):
    root, before, after = imported["root"], imported["before"], files_of(imported["root"])
    assert imported["version"] == 2
    assert before.items() <= after.items()
    first, second = Store(spark, root, 1), Store(spark, root)
    assert first["messages"].count() == 4 and second["messages"].count() == 5
    # only the message that is new is written
    added = set(second.folders("messages")) - set(first.folders("messages"))
    assert [r.external_message_id for r in spark.read.parquet(*added).collect()] == ["d2"]
    titles = {s.version: {r.external_conversation_id: r.title for r in s["conversations"].collect()} for s in (first, second)}
    assert titles == {1: {"room-1": "Club room", "dm-1": "Ann"}, 2: {"room-1": "Club room", "dm-1": "Ann B"}}
    # the bucket of the other conversation is still the first import's
    other = spark.createDataFrame([(r.conversation_id,) for r in second["conversations"].filter("title = 'Club room'").collect()], "conversation_id string")
    bucket = other.select(bucket_of("conversation_id", second.buckets("conversations"))).first()[0]
    mine = spark.createDataFrame([(r.conversation_id,) for r in second["conversations"].filter("title = 'Ann B'").collect()], "conversation_id string")
    if mine.select(bucket_of("conversation_id", second.buckets("conversations"))).first()[0] != bucket:
        assert second.folders("conversations", {bucket}) == first.folders("conversations", {bucket})
    assert {r.external_identity_id for r in second["identities"].collect()} == {"u-zoe", "u-me", "u-ann"}
    assert second["participants"].count() == 3 and second["import_runs"].count() == 2


def test_repeated_import_adds_nothing(spark, imported):
    store = Store(spark, imported["root"])
    rows = {name: store[name].count() for name in store}
    version, result = bring_in(spark, imported["root"], imported["folder"])
    again = Store(spark, imported["root"])
    assert version == 3 and {name: again[name].count() for name in again} == rows
    assert result.already_imported.count() == 1


def test_touching_reads_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = [(f"c{i}", f"p{j}", "{}") for i in range(40) for j in range(2)]
    write_store({"participants": people(spark, rows)}, root, buckets=8)
    store = Store(spark, root)
    keys = spark.createDataFrame([("c3",), ("c9",), ("new",)], "conversation_id string")
    read = store.touching("participants", keys)
    wanted = {r[0] for r in keys.select(bucket_of("conversation_id", 8)).collect()}
    assert store.touched == {"participants": wanted}
    assert len(store.folders("participants", wanted)) <= len(wanted) and all("bucket=" in f for f in read.inputFiles())
    assert {r.conversation_id for r in read.collect()} >= {"c3", "c9"} and read.count() < 80
    assert store.touching("messages", keys) is None


def test_a_bucket_without_rows_is_replaced_too(spark, tmp_path):
    root = str(tmp_path / "s")
    write_store({"participants": people(spark, [("c1", "p1", "{}")])}, root, buckets=4)
    store = Store(spark, root)
    store.touching("participants", spark.createDataFrame([("c1",)], "conversation_id string"))
    store.commit({"participants": people(spark, [])})
    assert Store(spark, root)["participants"].count() == 0 and Store(spark, root, 1)["participants"].count() == 1


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "s")
    write_store({"participants": people(spark, [("c1", "p1", "{}")])}, root)
    one, two = Store(spark, root), Store(spark, root)
    for store in (one, two):
        store.touching("participants", spark.createDataFrame([("c1",)], "conversation_id string"))
    assert one.commit({"participants": people(spark, [("c1", "p2", "{}")])}) == 2
    with pytest.raises(ConcurrentCommit):
        two.commit({"participants": people(spark, [("c1", "p3", "{}")])})
    assert [r.identity_id for r in Store(spark, root)["participants"].collect()] == ["p2"]


def test_compaction_keeps_every_version(spark, tmp_path):
    root = str(tmp_path / "s")
    write_store({"participants": people(spark, [("c1", "p1", "{}")])}, root, buckets=4)
    for i in range(2, 6):
        store = Store(spark, root)
        keys = spark.createDataFrame([(f"c{i}",)], "conversation_id string")
        old = store.touching("participants", keys)
        run = spark.createDataFrame([(f"m{i}",)], "manifest_sha256 string")
        store.commit({"participants": old.unionByName(people(spark, [(f"c{i}", "p", "{}")])), "import_runs": run})
    assert len(Store(spark, root).folders("import_runs")) == 4
    assert Store(spark, root).compact(buckets=2) == 6 == current_version(spark, root)
    now = Store(spark, root)
    assert len(now.folders("import_runs")) == 1 and now.buckets("participants") == 2
    assert {r.conversation_id for r in now["participants"].collect()} == {f"c{i}" for i in range(1, 6)}
    assert {r.manifest_sha256 for r in now["import_runs"].collect()} == {f"m{i}" for i in range(2, 6)}
    assert [Store(spark, root, v)["participants"].count() for v in range(1, 6)] == [1, 2, 3, 4, 5]


def test_a_column_unknown_to_the_writer_is_null(spark, tmp_path):
    root = str(tmp_path / "s")
    write_store({"blobs": spark.createDataFrame([("d", 3)], "sha256 string, size_bytes long")}, root)
    assert [tuple(r) for r in Store(spark, root)["blobs"].collect()] == [("d", 3, None)]


def test_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert (store.version, len(store), "messages" in store) == (0, 0, False)
    with pytest.raises(KeyError):
        store["messages"]
