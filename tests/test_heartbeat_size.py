"""A detector's probes of one batch: what they take in memory, and that whole columns say what probe after probe says."""

import tracemalloc

import pandas as pd
import pytest

from evidentia.streaming import heartbeats as H
from tests.test_collector import SCHEMA, probe, random_probes, replay, utc  # noqa: F401

NAMES = [field.split()[0] for field in SCHEMA.split(", ")]


class Handle:
    """State and timers of one detector."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)


def processor():
    made = H.HeartbeatProcessor([*NAMES, *H.ADDED])
    made.init(Handle())
    return made


def arriving(rows, size=1000):
    frame = pd.DataFrame(rows, columns=NAMES)
    frame["at_us"] = [int(r[4].timestamp()) * 1_000_000 for r in rows]
    return [frame.iloc[i : i + size] for i in range(0, len(frame), size)]


def test_memory_of_a_probe_and_size_of_a_frame():
    parts = arriving([probe(n, "d", 7 * n, None if n % 3 else "RETRYABLE_ERROR", f"t{n % 2}" if n % 3 else None) for n in range(30_000)])
    tracemalloc.start()
    told = 0
    for frame in processor().handleInputRows(("d",), iter(parts), None):
        assert len(frame) <= 10_000
        told += len(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == 30_000
    assert peak < 30_000 * 1024


@pytest.mark.parametrize("seed", [31, 32, 33])
def test_batches_with_repeated_probes_equal_replay(seed):
    rows = [r for r in random_probes(seed, 400) if r[1] == "hot"]
    rows.sort(key=lambda r: (r[4], r[0]))
    made, frames = processor(), []
    for start in range(0, len(rows), 60):
        # the batch before comes again, and the batch itself twice and backwards
        parts = arriving([*rows[max(start - 60, 0) : start + 60], *rows[start : start + 60]][::-1], 25)
        frames += list(made.handleInputRows(("hot",), iter(parts), None))
    told = pd.concat([f.astype(object) for f in frames], ignore_index=True)
    none = lambda x: None if pd.isna(x) else x
    states = told[told["kind"] == "state"]
    fields = ["state", "effective_token", "consecutive_failures", "transition", "observed_us", "changed_us"]
    found = {r.probe_id: tuple(none(getattr(r, f)) for f in fields) for r in states.itertuples()}
    micros = lambda at: None if at is None else int(at.timestamp()) * 1_000_000
    assert found == {n: (*r[:4], micros(r[4]), micros(r[5])) for n, r in replay(rows).items()}
    assert len(states) == len(rows) and states["newest"].sum() == -(-len(rows) // 60)
    gaps = [a for a, b in zip(rows, rows[1:], strict=False) if (b[4] - a[4]).total_seconds() > 600]
    silences = told[told["kind"] == "stale"]
    assert list(silences["probe_id"]) == [r[0] for r in gaps]
    assert list(silences["at_us"]) == [micros(r[4]) + 600_000_000 for r in gaps]


def test_an_unusable_limit_of_silence_is_an_error():
    rows = [(*probe(n, "d", n, None, "t")[:-1], limit) for n, limit in enumerate([600.0, None])]
    with pytest.raises(ValueError, match="stale_after_seconds"):
        list(processor().handleInputRows(("d",), iter(arriving(rows)), None))
