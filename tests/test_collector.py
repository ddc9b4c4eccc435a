import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidentia.operators import collector as C
from evidentia.operators import query as Q
from evidentia.operators import snapshots as S
from evidentia.operators.ordering import ranked_in_slices, sliced, top_per_key

START = datetime(2026, 8, 1, tzinfo=timezone.utc)
SCHEMA = (
    "probe_id long, detector_id string, source_kind string, external_account_id string, observed_at timestamp, "
    "probe_state string, source_token string, error_code string, source_observed boolean, observation_scope string, "
    "interval_seconds double, stale_after_seconds double"
)


def probe(number, detector, seconds, state=None, token=None, error=None, observed=None):
    seen = (token is not None) if observed is None else observed
    return (
        number, detector, "kind", f"acct-{detector}", START + timedelta(seconds=seconds), state, token, error, seen,
        "source_profile_metadata", 60.0, 600.0,
    )


def replay(rows):
    """Brute force: one probe at a time against the stored heartbeat."""
    stored, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        old = stored.get(r[1])
        token = old["token"] if r[6] is None and r[5] == "RETRYABLE_ERROR" and old else r[6]
        if r[5]:
            state = r[5]
        elif token is None:
            state = "OK_UNCHANGED"
        elif old is None or old["token"] is None:
            state = "BASELINE_ESTABLISHED"
        else:
            state = "OK_UNCHANGED" if old["token"] == token else "CHANGE_OBSERVED"
        failed = state in ("RETRYABLE_ERROR", "REQUIRES_USER_ACTION")
        failures = (old["failures"] if old else 0) + 1 if failed else 0
        new = {
            "token": token, "state": state, "error": r[7], "failures": failures,
            "observed": r[4] if r[8] else (old or {}).get("observed"),
            "change": r[4] if state == "CHANGE_OBSERVED" else (old or {}).get("change"),
        }
        moved = old is None or any(old[k] != new[k] for k in ("state", "token", "error"))
        stored[r[1]] = new
        out[r[0]] = (state, token, failures, moved, new["observed"], new["change"])
    return out


def random_probes(seed, count=300):
    rng, rows, clock = random.Random(seed), [], 0
    for number in range(count):
        clock += rng.choice([0, 5, 400, 4000, 90000])
        kind = rng.random()
        detector = rng.choice(["hot"] * 6 + ["a", "b"])
        if kind < 0.25:
            row = probe(number, detector, clock, "RETRYABLE_ERROR", rng.choice([None, None, "t1"]), rng.choice(["E1", "E2"]))
        elif kind < 0.4:
            row = probe(number, detector, clock, "REQUIRES_USER_ACTION", None, "login")
        elif kind < 0.5:
            row = probe(number, detector, clock, None, None)
        else:
            row = probe(number, detector, clock, None, rng.choice(["t1", "t2"]))
        rows.append(row)
    return rows


def as_utc(value):
    return None if value is None else value.replace(tzinfo=timezone.utc)


def outcome(states):
    return {
        r.probe_id: (
            r.state, r.effective_token, r.consecutive_failures, r.transition, as_utc(r.source_observed_at), as_utc(r.last_change_at)
        )
        for r in states.collect()
    }


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("slice_seconds", [100, 86400])
def test_state_machine_matches_replay(spark, seed, slice_seconds):
    rows = random_probes(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert outcome(C.probe_states(df, slice_seconds=slice_seconds)) == replay(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_continuing_from_heartbeats_matches_replay(spark, seed):
    rows = sorted(random_probes(seed), key=lambda r: (r[4], r[0]))
    cut = next(i for i in range(150, 300) if rows[i][4] > rows[i - 1][4])
    first, second = rows[:cut], rows[cut:]
    hearts = C.current_heartbeats(C.probe_states(spark.createDataFrame(first, SCHEMA)))
    states = C.probe_states(spark.createDataFrame(second, SCHEMA), hearts)
    expected = replay(rows)
    assert outcome(states) == {r[0]: expected[r[0]] for r in second}


def test_three_detectors_twice(spark):
    rows = [probe(i, f"d{i % 3}", i * 60, None, f"tok{i % 3}") for i in range(6)]
    states = C.probe_states(spark.createDataFrame(rows, SCHEMA))
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    assert counts == {"BASELINE_ESTABLISHED": 3, "OK_UNCHANGED": 3}
    assert C.transitions(states).count() == 6


def test_error_keeps_token_and_stale_wins(spark):
    rows = [probe(1, "d", 0, None, "token-a"), probe(2, "d", 60, "RETRYABLE_ERROR", None, "OSError")]
    hearts = C.current_heartbeats(C.probe_states(spark.createDataFrame(rows, SCHEMA)))
    assert hearts.first().source_token == "token-a"
    at = lambda s: F.timestamp_seconds(F.lit(int(START.timestamp()) + s))
    assert Q.with_freshness(hearts, at(100)).first().collector_freshness_state == "COLLECTOR_ERROR"
    assert Q.with_freshness(hearts, at(5000)).first().collector_freshness_state == "HEARTBEAT_STALE"


def test_backoff_is_bounded(spark):
    rows = [probe(i, "d", i, "RETRYABLE_ERROR", None, "E") for i in range(8)]
    delays = [r.retry_delay_seconds for r in C.probe_states(spark.createDataFrame(rows, SCHEMA)).orderBy("probe_id").collect()]
    assert delays == [60.0, 120.0, 240.0, 300.0, 300.0, 300.0, 300.0, 300.0]


def test_lifecycle_ignores_repeats_and_strangers(spark):
    hearts = C.current_heartbeats(C.probe_states(spark.createDataFrame([probe(1, "d", 0, None, "t")], SCHEMA)))
    rows = [("kind", "acct-d", g, START + timedelta(days=i)) for i, g in enumerate(["g1", "g1", "g2", "g1"])]
    rows.append(("kind", "nobody", "g9", START))
    imports = spark.createDataFrame(rows, "source_kind string, external_account_id string, generation_id string, completed_at timestamp")
    updated, events = C.merge_lifecycle(hearts, imports)
    assert [r.generation_id for r in events.orderBy("occurred_at").collect()] == ["g1", "g2", "g1"]
    assert updated.first().last_generation_id == "g1"
    again, more = C.merge_lifecycle(updated, imports.filter("generation_id = 'g1'"))
    assert more.count() == 0


def watermark(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, rows long, max_local_id long, max_create_time long")


def test_watermark_regression_and_baseline(spark):
    one, two = watermark(spark, [("s", 4, 4, 9)]), watermark(spark, [("s", 3, 4, 9)])
    row = S.watermark_diff(one, two).first()
    assert (row.row_increase_estimate, row.regressions, row.changed_streams) == (0, 1, 1)
    base = S.watermark_diff(watermark(spark, []), one).first()
    assert base.baseline and base.row_increase_estimate is None and base.new_streams == 1 and base.regressions == 0
    grown = S.watermark_diff(one, watermark(spark, [("s", 6, 6, 9), ("n", 5, 5, 9)])).first()
    assert (grown.row_increase_estimate, grown.new_streams, grown.changed_streams) == (7, 1, 2)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("s", f"f{i}", i) for i in range(50)]
    columns = "source string, relative_path string, size_bytes long"
    token = lambda data: S.fingerprint(spark.createDataFrame(data, columns), ["source"], ["relative_path", "size_bytes"]).first()
    first = token(rows)
    assert token(rows[::-1]) == first and first.files == 50
    assert token(rows[:-1] + [("s", "f49", 50)]).fingerprint_token != first.fingerprint_token


def test_generation_tamper(spark):
    columns = "generation_id string, relative_path string, sha256 string, size_bytes long"
    receipts = spark.createDataFrame([("g", "raw/a", "1", 1), ("g", "raw/b", "2", 2)], columns)
    good = spark.createDataFrame([("g", "raw/a", "1", 1), ("g", "raw/b", "2", 2)], columns)
    assert S.verify_generations(receipts, good).count() == 0
    bad = spark.createDataFrame([("g", "raw/a", "x", 1), ("g", "raw/c", "3", 3)], columns)
    assert {r.problem for r in S.verify_generations(receipts, bad).collect()} == {
        "digest_or_size_changed", "missing_file", "uninventoried_file",
    }


def test_generations_are_verified_with_one_read_of_each_side(spark):
    columns = "generation_id string, relative_path string, sha256 string, size_bytes long"
    receipts = spark.createDataFrame([("g", "raw/a", "1", 1), ("g", "raw/a", "1", 1), ("g", "../b", "2", 2), ("g", "../b", "2", 2), ("h", "raw/a", "1", 1)], columns)
    files = spark.createDataFrame([("g", "raw/a", "1", 1), ("g", "../b", "2", 3), ("h", "raw/a", "1", 1), ("x", "raw/z", "1", 1)], columns)
    found = S.verify_generations(receipts, files, ["raw/a", "raw/needed"])
    assert sorted(map(tuple, found.collect())) == sorted([
        ("g", "../b", "unsafe_path"), ("g", "../b", "unsafe_path"), ("g", "../b", "duplicate_entry"), ("g", "../b", "digest_or_size_changed"),
        ("g", "raw/a", "duplicate_entry"), ("g", "raw/needed", "required_not_inventoried"), ("h", "raw/needed", "required_not_inventoried"),
        ("x", "raw/z", "uninventoried_file"),
    ])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 2


def test_sliced_ranks_equal_plain_ranks(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaab"), START + timedelta(seconds=rng.randrange(20000))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, at timestamp")
    got = {r.id: r.row_rank for r in ranked_in_slices(df, ["key"], ["at", "id"], "at", 700).collect()}
    expected = {}
    for key in "ab":
        for rank, row in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), 1):
            expected[row[0]] = rank
    assert got == expected


def depths(df, keys=("key",)):
    return sorted(r["count"] for r in df.groupBy(*keys, "_slice").count().collect())


def test_slices_follow_the_fullest_hour(spark):
    dense = spark.range(7200).select(F.lit("d").alias("key"), "id", F.timestamp_seconds(F.col("id")).alias("at"))
    assert depths(sliced(dense, ["key"], ["at", "id"], "at", rows=3600)) == [3600, 3600]
    assert depths(sliced(dense, ["key"], ["at", "id"], "at", rows=8000)) == [7200]
    assert depths(sliced(dense, ["key"], ["at", "id"], "at")) == [7200]
    assert sliced(dense.limit(0), ["key"], ["at", "id"], "at").count() == 0


def test_a_burst_is_cut_between_equal_instants(spark):
    """One instant holds nearly all rows of a key: no slice has twice the median, and ranks are as ever."""
    draw = random.Random(5)
    rows = [("burst", i, START) for i in range(6000)] + [("calm", i, START + timedelta(hours=i)) for i in range(300)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, id long, at timestamp").repartition(8)
    cut = sliced(df, ["key"], ["at", "id"], "at", rows=500)
    counts = depths(cut.filter("key = 'burst'"))
    assert len(counts) > 8 and counts[-1] < 2 * counts[len(counts) // 2]
    ends = cut.groupBy("key", "_slice").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("key = 'burst'").orderBy("_slice").collect()
    assert all(a.high < b.low for a, b in zip(ends, ends[1:]))
    ranks = ranked_in_slices(df, ["key"], ["at", "id"], "at", rows=500).collect()
    assert {(r.key, r.id, r.row_rank) for r in ranks} == {(k, i, i + 1) for k, i, _ in rows}


def test_state_machine_over_a_burst(spark, monkeypatch):
    from evidentia.operators import ordering

    rows = random_probes(9, 200)
    rows = [(*r[:4], START, *r[5:]) if r[1] == "hot" else r for r in rows]
    cut = ordering.sliced
    monkeypatch.setattr(C, "sliced", lambda *a: cut(*a, rows=20))
    assert outcome(C.probe_states(spark.createDataFrame(rows, SCHEMA))) == replay(rows)


def test_deep_ranks_are_cut_in_two_levels(spark):
    draw = random.Random(6)
    rows = [(draw.choice("aaaaab"), draw.randrange(50), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, score long, id long")
    order = [F.col("score").desc(), F.col("id")]
    for size in (10, 1000, 1600):
        got = {(r.key, r.id): r.row_rank for r in top_per_key(df, ["key"], order, size).collect()}
        want = {}
        for key in "ab":
            line = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:size]
            want |= {(key, r[2]): n for n, r in enumerate(line, 1)}
        assert got == want
    # no task of the last rank is sent more than the parts' survivors
    plan = top_per_key(df, ["key"], order, 1600)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number") >= 2 and "_salt" in plan


def test_context_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"m{i:03}", rng.choice("xxxy"), START + timedelta(seconds=rng.randrange(9000))) for i in range(200)]
    df = spark.createDataFrame(rows, "message_id string, conversation_id string, sent_at timestamp")
    targets = df.filter(F.col("message_id").endswith("7"))
    got = {}
    for r in Q.read_context(df, targets, 3, 4, 500).collect():
        got.setdefault(r.target_id, {})[r.item_index] = r.message_id
    for target, items in got.items():
        conversation = next(r[1] for r in rows if r[0] == target)
        line = [r[0] for r in sorted((r for r in rows if r[1] == conversation), key=lambda r: (r[2], r[0]))]
        at = line.index(target)
        assert [items[i] for i in sorted(items)] == line[max(0, at - 3): at + 5]
    assert len(got) == 20


def test_import_survives_a_probe(spark):
    """Completion, probe, the same completion again: one event."""
    at = lambda minute: datetime(2024, 1, 1, 0, minute, tzinfo=timezone.utc)
    types = "detector_id string, source_kind string, external_account_id string, observation_scope string, state string, worker_heartbeat_at timestamp"
    heart = lambda minute: spark.createDataFrame([("d", "k", "a", "s", "QUIET", at(minute))], types)
    done = spark.createDataFrame([("k", "a", at(1), "g1")], "source_kind string, external_account_id string, completed_at timestamp, generation_id string")
    stored, events = C.merge_lifecycle(heart(0), done)
    assert events.count() == 1
    merged = C.merge_heartbeats(stored, heart(2))
    row = merged.first()
    assert (row["last_generation_id"], row["worker_heartbeat_at"].minute) == ("g1", 2)
    again, more = C.merge_lifecycle(merged, done.withColumn("completed_at", F.lit(at(3))))
    assert more.count() == 0


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from evidentia.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
