"""The collector's state machine over a stream: one heartbeat a detector in keyed state, with a timer for silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from evidentia import constants as K
from evidentia.operators import collector
from evidentia.operators.collector import KEY
from evidentia.operators.ordering import latest_per_key

#: What is kept of a detector; instants are microseconds.
STATE = (
    "token string, state string, error_code string, failures long, observed_us long, changed_us long, at_us long, "
    "probe_id long, stale_after_seconds double, silent boolean"
)
STATE_NAMES = [field.split()[0] for field in STATE.split(", ")]
#: What the machine adds to a probe's own columns. ``kind`` is state, late or stale; ``newest`` marks a detector's last state of a batch.
ADDED = {
    "kind": "string", "at_us": "long", "effective_token": "string", "previous_token": "string", "is_first": "boolean", "state": "string",
    "consecutive_failures": "long", "observed_us": "long", "changed_us": "long", "transition": "boolean",
    "newest": "boolean",
}
#: Rows of a frame that a processor hands back at once.
CHUNK = 10_000
#: Seconds of silence that fit an instant in microseconds.
LONGEST = 2.0**42


class LostState(RuntimeError):
    """Results exist but the checkpoint that carries their state does not: going on would start from a baseline."""


class HeartbeatProcessor(StatefulProcessor):
    """Probes of one detector in order of instant and id; what is not after the kept heartbeat is late and changes nothing.

    A detector is stale once it has been silent for longer than its own limit. A gap between two probes shows that as
    well as the timer does, whichever is seen first; each silence is told once.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("heartbeat", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = dict(zip(STATE_NAMES, self.kept.get(), strict=True)) if self.kept.exists() else None
        now, told = advance(key, now, pd.concat(list(rows), ignore_index=True))
        self.kept.update(tuple(now[c] for c in STATE_NAMES))
        self._set_timer(now)
        for frame in told:
            for start in range(0, len(frame), CHUNK):
                yield self._frame(frame.iloc[start : start + CHUNK])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = dict(zip(STATE_NAMES, self.kept.get(), strict=True))
        if now["silent"]:
            return
        self.kept.update(tuple((now | {"silent": True})[c] for c in STATE_NAMES))
        yield self._frame(pd.DataFrame([silence(key, now)]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.astype(object).where(initialState.notna(), None).to_dict("records")[0]
        self.kept.update(tuple(row[c] for c in STATE_NAMES))
        self._set_timer(row)

    def close(self) -> None:
        pass

    def _set_timer(self, now: dict) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not now["silent"]:
            # the first millisecond after the deadline
            self.handle.registerTimer(deadline(now) // 1000 + 1)

    def _frame(self, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.Series([None] * len(rows), dtype=object)
        frame = pd.DataFrame({c: rows[c].reset_index(drop=True) if c in rows else none for c in self.columns})
        for c in ("at_us", "consecutive_failures", "observed_us", "changed_us", "probe_id"):
            frame[c] = frame[c].astype("Int64")
        return frame


def deadline(now: dict) -> int:
    return now["at_us"] + int(now["stale_after_seconds"] * 1_000_000)


def silence(key, now: dict) -> dict:
    return {
        KEY: key[0], "kind": "stale", "at_us": deadline(now), "probe_id": now["probe_id"], "effective_token": now["token"],
        "state": now["state"], "consecutive_failures": now["failures"],
    }


def advance(key, now: dict | None, probes: pd.DataFrame) -> tuple[dict, list[pd.DataFrame]]:
    """The state after a detector's probes of a batch, and frames of the probes and silences with what the machine says of them.

    The probes are taken in order of instant and id, whole columns at a time: what a probe needs of those before it is a
    running maximum, of a position or of an instant.
    """
    at, ids = probes["at_us"].astype("Int64").to_numpy("int64"), known_ids(probes["probe_id"])
    order = np.lexsort((ids, at))
    probes, at, ids = probes.iloc[order], at[order], ids[order]
    late = np.append(False, (at[1:] == at[:-1]) & (ids[1:] == ids[:-1]))
    if now is not None:
        late |= (at < now["at_us"]) | ((at == now["at_us"]) & (ids <= known_ids(pd.Series([now["probe_id"]]))[0]))
    told = [probes[late].assign(kind="late")]
    probes, at = probes[~late], at[~late]
    if not len(probes):
        return now, told
    before = now or dict.fromkeys(STATE_NAMES)
    position = np.arange(len(probes))

    explicit, error = objects(probes["probe_state"]), objects(probes["error_code"])
    own = objects(probes["source_token"])
    set_at = np.maximum.accumulate(np.where(pd.isna(own) & (explicit == "RETRYABLE_ERROR"), -1, position))
    token = np.where(set_at >= 0, own[set_at], before["token"])
    previous = shifted(token, before["token"])
    derived = np.where(token == previous, "OK_UNCHANGED", np.where(pd.isna(previous), "BASELINE_ESTABLISHED", "CHANGE_OBSERVED"))
    derived = np.where(pd.isna(token), "OK_UNCHANGED", derived).astype(object)
    state = np.where(pd.isna(explicit), derived, explicit)

    well = np.maximum.accumulate(np.where(pd.Series(state).isin(K.FAILURE_STATES), -1, position))
    failures = position - well + np.where(well < 0, before["failures"] or 0, 0)
    observed = newest(at, probes["source_observed"].eq(True).to_numpy(bool), before["observed_us"])
    changed = newest(at, state == "CHANGE_OBSERVED", before["changed_us"])
    moved = (state != shifted(state, before["state"])) | (token != previous) | (error != shifted(error, before["error_code"]))
    first = (position == 0) & (now is None)

    stale_after = probes["stale_after_seconds"].to_numpy("float64")
    if not (np.abs(stale_after) < LONGEST).all():
        raise ValueError(f"a probe of {key[0]} has no usable stale_after_seconds")
    # the same rounding as deadline()
    ends = at + (stale_after * 1_000_000).astype("int64")
    said = {"effective_token": token, "state": state, "consecutive_failures": failures}
    told.append(
        probes.assign(
            kind="state", previous_token=previous, is_first=first, observed_us=observed, changed_us=changed,
            transition=moved | first, newest=position == len(probes) - 1, **said,
        )
    )
    if now is not None and not now["silent"] and at[0] > deadline(now):
        told.append(pd.DataFrame([silence(key, now)]))
    gap = np.flatnonzero(at[1:] > ends[:-1])
    silent = pd.DataFrame({name: values[gap] for name, values in said.items()})
    told.append(silent.assign(**{KEY: key[0], "kind": "stale", "at_us": ends[gap], "probe_id": probes["probe_id"].to_numpy()[gap]}))

    last = probes.iloc[-1]
    after = {
        "token": token[-1], "state": state[-1], "error_code": error[-1], "failures": int(failures[-1]),
        "observed_us": whole(observed[-1]), "changed_us": whole(changed[-1]), "at_us": int(at[-1]), "probe_id": whole(last["probe_id"]),
        "stale_after_seconds": float(last["stale_after_seconds"]), "silent": False,
    }
    return after, told


def known_ids(ids: pd.Series) -> np.ndarray:
    """Ids to sort and compare by; a missing one comes first, as in the batch operator."""
    return ids.astype("Int64").fillna(np.iinfo("int64").min).to_numpy("int64")


def objects(values: pd.Series) -> np.ndarray:
    return values.astype(object).where(values.notna(), None).to_numpy()


def shifted(values: np.ndarray, head) -> np.ndarray:
    """For each row the value of the row before it."""
    moved = np.roll(values, 1)
    moved[0] = head
    return moved


def newest(at: np.ndarray, holds: np.ndarray, before: int | None) -> pd.arrays.IntegerArray:
    """For each row the newest instant so far at which ``holds``."""
    none = np.iinfo("int64").min
    found = np.maximum(np.maximum.accumulate(np.where(holds, at, none)), none if before is None else before)
    return pd.arrays.IntegerArray(found, found == none)


def whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def readable(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, asked through Spark, so that any store it reads will do."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(1).isEmpty()
    except AnalysisException:
        return False


def machine(probes: DataFrame, lateness: str, stored: DataFrame | None = None) -> DataFrame:
    """``probes`` with ADDED: one row for each probe (kind state or late) and one for each silence (kind stale).

    ``stored`` are heartbeats to begin with. Probes that are older than the watermark are not seen at all.
    """
    timed = probes.withWatermark("observed_at", lateness).withColumn("at_us", F.unix_micros("observed_at"))
    fields = {f.name: f.dataType.simpleString() for f in probes.schema} | ADDED
    columns = list(fields)
    types = ", ".join(f"`{c}` {t}" for c, t in fields.items())
    initial = None
    if stored is not None:
        initial = stored.select(
            KEY, F.col("source_token").alias("token"), "state", "error_code", F.col("consecutive_failures").alias("failures"),
            F.unix_micros("source_observed_at").alias("observed_us"), F.unix_micros("last_change_at").alias("changed_us"),
            F.unix_micros("worker_heartbeat_at").alias("at_us"), F.lit(-1).cast("long").alias("probe_id"), "stale_after_seconds",
            F.lit(False).alias("silent"),
        ).groupBy(KEY)
    return timed.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=HeartbeatProcessor(columns), outputStructType=types, outputMode="Append", timeMode="EventTime", initialState=initial
    )


def stream_heartbeats(
    probes: DataFrame, out: str, checkpoint: str, continuous: str | None = None, lateness: str = "0 seconds", stored: DataFrame | None = None
) -> StreamingQuery:
    """Probe states, heartbeats, silences and late probes, each under ``out`` and the number of its batch.

    The heartbeat of a detector is a value in the state store, so a batch costs the detectors it names. The state is
    part of the checkpoint; where results exist without it, the stream does not start (`LostState`). ``stored`` seeds
    the state of a stream that has none yet. A batch that is replayed replaces itself.
    """
    from evidentia.streaming.jobs import batch_path, run_batches

    spark = probes.sparkSession
    if readable(spark, out) and not readable(spark, f"{checkpoint}/metadata"):
        raise LostState(f"{out} has results, {checkpoint} has no state")

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(batch_path(f"{out}/rows", number))
        rows = session.read.schema(batch.schema).parquet(batch_path(f"{out}/rows", number))
        states = states_of(rows)
        hearts = collector.current_heartbeats(states_of(rows.filter("newest")))
        made = {
            "states": states, "heartbeats": hearts, "late": rows.filter("kind = 'late'").select(KEY, "probe_id", "observed_at"),
            "stale": rows.filter("kind = 'stale'").select(KEY, "probe_id", F.timestamp_micros("at_us").alias("stale_at"), "state"),
        }
        for name, df in made.items():
            df.write.mode("overwrite").parquet(batch_path(f"{out}/{name}", number))

    return run_batches(machine(probes, lateness, stored), each, checkpoint, continuous)


def states_of(rows: DataFrame) -> DataFrame:
    """Rows of kind state with the columns of the batch operator."""
    instants = {"source_observed_at": F.timestamp_micros("observed_us"), "last_change_at": F.timestamp_micros("changed_us")}
    return collector.with_backoff(rows.filter("kind = 'state'").withColumns(instants).drop("kind", "at_us", "observed_us", "changed_us", "newest"))


def heartbeats_now(spark: SparkSession, out: str) -> DataFrame:
    """The newest heartbeat of each detector over all batches, one row a task before the shuffle."""
    from evidentia.streaming.jobs import read_batches

    columns = ", ".join(f"{c} {t}" for c, t in HEARTBEAT_TYPES.items())
    rows = read_batches(spark, f"{out}/heartbeats", columns + ", batch long")
    return latest_per_key(rows, [KEY], [F.col("batch").desc()]).drop("batch")


HEARTBEAT_TYPES = {
    KEY: "string", "source_kind": "string", "external_account_id": "string", "observation_scope": "string", "state": "string",
    "worker_heartbeat_at": "timestamp", "source_observed_at": "timestamp", "last_change_at": "timestamp", "source_token": "string",
    "consecutive_failures": "long", "next_retry_at": "timestamp", "error_code": "string", "stale_after_seconds": "double",
}
