"""The state machine over a stream against the row-by-row replay: silences, late probes, restarts, lost state."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import collector as C
from evidentia.streaming import heartbeats as H
from evidentia.streaming.jobs import read_batches
from tests.test_collector import SCHEMA, START, as_utc, outcome, probe, random_probes, replay, utc  # noqa: F401

STATES = (
    "probe_id long, detector_id string, state string, effective_token string, consecutive_failures long, transition boolean, "
    "source_observed_at timestamp, last_change_at timestamp, batch long"
)


def feed(spark, root, parts, lateness="0 seconds", stored=None):
    """Each part arrives as a file, and a new query drains what is there: a restart between any two parts."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        query = H.stream_heartbeats(stream, f"{root}/out", f"{root}/checkpoint", lateness=lateness, stored=stored)
        query.awaitTermination()


def silences(rows, until):
    """What a detector's own limit of silence says of all gaps, and of the time after its last probe."""
    found, last = [], {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        if r[1] in last and r[4] - last[r[1]][4] > timedelta(seconds=r[-1]):
            found.append((r[1], last[r[1]][4] + timedelta(seconds=r[-1])))
        last[r[1]] = r
    return sorted(found + [(d, r[4] + timedelta(seconds=r[-1])) for d, r in last.items() if until - r[4] > timedelta(seconds=r[-1])])


def told(spark, root):
    rows = read_batches(spark, f"{root}/out/stale", "detector_id string, stale_at timestamp, batch long").collect()
    return sorted((r.detector_id, as_utc(r.stale_at)) for r in rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_stream_equals_replay_and_tells_each_silence_once(spark, tmp_path, seed):
    rows = sorted(random_probes(seed, 120), key=lambda r: (r[4], r[0]))
    draw = random.Random(seed)
    # parts end where time moves on; within a part the rows come in any order
    cuts = sorted(draw.sample([i for i in range(20, 120) if rows[i][4] > rows[i - 1][4]], 2))
    parts = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]]
    for part in parts:
        draw.shuffle(part)
    root = str(tmp_path)
    feed(spark, root, parts)
    assert outcome(read_batches(spark, f"{root}/out/states", STATES)) == replay(rows)
    assert told(spark, root) == silences(rows, rows[-1][4])
    hearts = {r.detector_id: (r.state, r.source_token, r.consecutive_failures) for r in H.heartbeats_now(spark, f"{root}/out").collect()}
    batch = C.current_heartbeats(C.probe_states(spark.createDataFrame(rows, SCHEMA)))
    assert hearts == {r.detector_id: (r.state, r.source_token, r.consecutive_failures) for r in batch.collect()}


def test_late_probes_change_nothing(spark, tmp_path):
    rows = [probe(1, "d", 0, None, "t1"), probe(3, "d", 100, None, "t2"), probe(4, "e", 100, None, "x")]
    late = [probe(2, "d", 50, None, "t9"), probe(3, "d", 100, None, "t2"), probe(5, "d", 120, None, "t2")]
    root = str(tmp_path)
    feed(spark, root, [rows, late], lateness="1 hour")
    assert outcome(read_batches(spark, f"{root}/out/states", STATES)) == replay([*rows, late[2]])
    found = read_batches(spark, f"{root}/out/late", "detector_id string, probe_id long, batch long").collect()
    assert sorted((r.detector_id, r.probe_id) for r in found) == [("d", 2), ("d", 3)]
    assert told(spark, root) == []


def test_a_silent_detector_is_stale_once(spark, tmp_path):
    """The timer tells it; the probe that ends the silence does not tell it again."""
    one = [probe(1, "quiet", 0, None, "t"), probe(2, "busy", 0, None, "t")]
    two = [probe(3, "busy", 5000, None, "t")]
    three = [probe(4, "quiet", 9000, None, "t"), probe(5, "busy", 9001, None, "t")]
    root = str(tmp_path)
    feed(spark, root, [one, two])
    assert told(spark, root) == [("busy", START + timedelta(seconds=600)), ("quiet", START + timedelta(seconds=600))]
    feed(spark, root, [three])
    assert told(spark, root) == silences([*one, *two, *three], three[1][4])


def test_lost_state_is_not_a_baseline(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, root, [[probe(1, "d", 0, None, "t1")]])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    with pytest.raises(H.LostState):
        H.stream_heartbeats(stream, f"{root}/out", f"{root}/another-checkpoint")


def test_stored_heartbeats_begin_the_state(spark, tmp_path):
    rows = sorted(random_probes(21, 60), key=lambda r: (r[4], r[0]))
    cut = next(i for i in range(30, 60) if rows[i][4] > rows[i - 1][4])
    hearts = C.current_heartbeats(C.probe_states(spark.createDataFrame(rows[:cut], SCHEMA)))
    root = str(tmp_path)
    hearts.write.parquet(f"{root}/stored")
    feed(spark, root, [rows[cut:]], stored=spark.read.parquet(f"{root}/stored"))
    expected = replay(rows)
    assert outcome(read_batches(spark, f"{root}/out/states", STATES)) == {r[0]: expected[r[0]] for r in rows[cut:]}
