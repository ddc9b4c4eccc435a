"""Collector monitoring: probe states, heartbeats, transitions, lifecycle, debounce.

A detector may have a very long or very dense probe history. Its timeline is cut into slices;
windows run inside (detector, slice) and one summary row per slice is carried over the slices.
A stored heartbeat is simply one more summary, placed before the first slice, so the same code
serves batch, incremental and streaming runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import constants as K
from evidentia.operators.ordering import latest_per_key, sliced, time_slice

KEY = "detector_id"
_BEFORE_ALL = -(2**62)


def is_failure(state: str | Column) -> Column:
    c = F.col(state) if isinstance(state, str) else state
    return F.coalesce(c.isin(*K.FAILURE_STATES), F.lit(False))


def with_backoff(df: DataFrame, failures: str = "consecutive_failures", state: str = "state") -> DataFrame:
    """Adds retry delay and next retry: doubling per failure, bounded by half the stale time
    and by the fixed cap."""
    doubled = F.col("interval_seconds") * F.pow(
        F.lit(2.0), F.least(F.greatest(F.col(failures) - 1, F.lit(0)), F.lit(K.BACKOFF_MAX_DOUBLINGS))
    )
    ceiling = F.greatest(F.col("interval_seconds"), F.col("stale_after_seconds") / 2)
    failed = is_failure(state)
    delay = F.when(failed, F.least(doubled, ceiling, F.lit(K.BACKOFF_CAP_SECONDS))).otherwise(F.col("interval_seconds"))
    retry = F.timestamp_micros((F.unix_micros("observed_at") + delay * 1_000_000).cast("long"))
    return df.withColumns({"retry_delay_seconds": delay, "next_retry_at": F.when(failed, retry)})


def _derived_state(explicit: Column, token: Column, before: Column, first: Column) -> Column:
    return (
        F.when(explicit.isNotNull(), explicit)
        .when(token.isNull(), "OK_UNCHANGED")
        .when(first | before.isNull(), "BASELINE_ESTABLISHED")
        .when(before == token, "OK_UNCHANGED")
        .otherwise("CHANGE_OBSERVED")
    )


def probe_states(
    probes: DataFrame, previous: DataFrame | None = None, order: tuple[str, ...] = ("observed_at", "probe_id"),
    slice_seconds: float | None = None,
) -> DataFrame:
    """The full state machine, one row per probe.

    Adds effective and previous token, state, consecutive failures, carried instants,
    transition flag and backoff. ``previous`` holds stored heartbeats, one per detector.

    A failed retryable probe without a token keeps the token before it; a probe that needs
    user action and has none drops it.

    The rows are shuffled by (detector, slice), never by detector alone. What a slice passes on
    fits in one row, because only its first token-setting probe depends on the slices before. Without
    ``slice_seconds`` slices are of bounded depth, so that a dense detector, or one with a burst of probes at one
    instant, spreads over many tasks.
    """
    columns = probes.columns
    probes = probes.withColumn("_slice", time_slice("observed_at", slice_seconds)) if slice_seconds else sliced(probes, [KEY], list(order), "observed_at")
    within = Window.partitionBy(KEY, "_slice").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carries = F.col("source_token").isNull() & F.col("probe_state").eqNullSafe(F.lit("RETRYABLE_ERROR"))
    cut = probes.withColumns(
        {
            "_set": F.when(~carries, F.struct(F.col("source_token").alias("token"))),
            "_failed": is_failure("probe_state"),
        }
    )
    earlier_rows = within.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns(
        {
            "_position": F.row_number().over(within),
            "_set_now": F.last("_set", ignorenulls=True).over(running),
            "_set_prev": F.last("_set", ignorenulls=True).over(earlier_rows),
            "_observed": F.max(F.when(F.col("source_observed"), F.col("observed_at"))).over(running),
        }
    )
    local = local.withColumns({"_last_ok": F.max(F.when(~F.col("_failed"), F.col("_position"))).over(running)})
    local = local.withColumns({"_run": F.col("_position") - F.coalesce("_last_ok", F.lit(0))})
    decided = _derived_state(F.col("probe_state"), F.col("_set_now.token"), F.col("_set_prev.token"), F.lit(False))
    opens = F.col("_set").isNotNull() & F.col("_set_prev").isNull()
    summary = local.groupBy(KEY, "_slice").agg(
        F.max_by(
            F.struct(
                "probe_state", "error_code", "_set_now", "_set_prev", "_position", "_run", "_observed",
                F.col("_last_ok").isNotNull().alias("_ok"),
            ),
            F.col("_position"),
        ).alias("_end"),
        F.max(
            F.when(F.col("_set_prev").isNotNull() & (decided == "CHANGE_OBSERVED"), F.col("observed_at"))
        ).alias("_changed"),
        F.max(F.when(opens, F.struct("probe_state", "source_token", "_position", "observed_at"))).alias("_opener"),
    ).select(KEY, "_slice", "_end.*", "_changed", "_opener")
    if previous is not None:
        summary = summary.unionByName(
            previous.select(
                KEY,
                F.lit(_BEFORE_ALL).cast("long").alias("_slice"),
                F.col("state").alias("probe_state"),
                "error_code",
                F.struct(F.col("source_token").alias("token")).alias("_set_now"),
                F.col("consecutive_failures").cast("int").alias("_run"),
                F.lit(True).alias("_ok"),
                F.col("source_observed_at").alias("_observed"),
                F.col("last_change_at").alias("_changed"),
            ),
            allowMissingColumns=True,
        )
    carried = _carry_over_slices(summary)
    joined = local.join(carried, [KEY, "_slice"])
    joined = joined.withColumns(
        {
            "effective_token": F.coalesce("_set_now", "_set_in")["token"],
            "previous_token": F.coalesce("_set_prev", "_set_in")["token"],
            "is_first": F.col("_head") & (F.col("_position") == 1),
        }
    )
    joined = joined.withColumns(
        {
            "state": _derived_state(
                F.col("probe_state"), F.col("effective_token"), F.col("previous_token"), F.col("is_first")
            )
        }
    )
    shown = F.struct("state", "error_code")
    joined = joined.withColumns(
        {
            "_before": F.when(F.col("_position") == 1, F.col("_end_in")).otherwise(F.lag(shown).over(within)),
            "_changed": F.max(F.when(F.col("state") == "CHANGE_OBSERVED", F.col("observed_at"))).over(running),
        }
    )
    carried_run = F.when(F.col("_last_ok").isNull(), F.coalesce("_run_in", F.lit(0))).otherwise(0)
    transition = (
        F.col("is_first")
        | ~F.col("_before.state").eqNullSafe(F.col("state"))
        | ~F.col("previous_token").eqNullSafe(F.col("effective_token"))
        | ~F.col("_before.error_code").eqNullSafe(F.col("error_code"))
    )
    failures = F.when(F.col("_failed"), F.col("_run") + carried_run).otherwise(0).cast("long")
    result = joined.select(
        *columns,
        "effective_token",
        "previous_token",
        "is_first",
        "state",
        failures.alias("consecutive_failures"),
        F.greatest("_observed", "_observed_in").alias("source_observed_at"),
        F.greatest("_changed", "_changed_in").alias("last_change_at"),
        transition.alias("transition"),
    )
    return with_backoff(result)


def _carry_over_slices(summary: DataFrame) -> DataFrame:
    """What each slice receives from the slices before it; works on one row per slice."""
    ordered = Window.partitionBy(KEY).orderBy("_slice")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = summary.withColumns(
        {
            "_set_in": F.last("_set_now", ignorenulls=True).over(earlier),
            "_head": F.row_number().over(ordered) == 1,
            # failures add up until the newest slice that contains a success
            "_island": F.sum(F.col("_ok").cast("int")).over(up_to),
        }
    )
    inherited = F.col("_set_in.token")
    end_state = _derived_state(
        F.col("probe_state"),
        F.coalesce("_set_now", "_set_in")["token"],
        F.coalesce("_set_prev", "_set_in")["token"],
        F.col("_head") & F.coalesce(F.col("_position") == 1, F.lit(False)),
    )
    opener = F.col("_opener")
    opener_state = _derived_state(
        opener["probe_state"], opener["source_token"], inherited, F.col("_head") & (opener["_position"] == 1)
    )
    opener_change = F.when(opener.isNotNull() & (opener_state == "CHANGE_OBSERVED"), opener["observed_at"])
    island = Window.partitionBy(KEY, "_island").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "_final": F.struct(end_state.alias("state"), F.col("error_code")),
            "_changed_out": F.greatest("_changed", opener_change),
            "_run_out": F.sum("_run").over(island),
        }
    )
    return rows.select(
        KEY,
        "_slice",
        "_set_in",
        "_head",
        F.last("_final").over(earlier).alias("_end_in"),
        F.last("_run_out").over(earlier).alias("_run_in"),
        F.max("_observed").over(earlier).alias("_observed_in"),
        F.max("_changed_out").over(earlier).alias("_changed_in"),
    )


def effective_tokens(probes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Probes with the token in force and the one before; unused state columns are pruned."""
    states = probe_states(probes, previous)
    return states.select(*probes.columns, "effective_token", "previous_token", "is_first")


def transitions(states: DataFrame) -> DataFrame:
    """The append-only log: first probe, or a change of state, token or error."""
    return states.filter("transition").select(
        KEY, F.col("observed_at").alias("occurred_at"), "state", "observation_scope",
        F.col("effective_token").alias("source_token"), "error_code",
    )


HEARTBEAT_COLUMNS = [
    KEY, "source_kind", "external_account_id", "observation_scope", "state", "worker_heartbeat_at",
    "source_observed_at", "last_change_at", "source_token", "consecutive_failures", "next_retry_at",
    "error_code", "stale_after_seconds",
]


#: What imports, not probes, write.
LIFECYCLE = ["last_generation_id", "last_import_at"]


def current_heartbeats(states: DataFrame, order: tuple[str, ...] = ("observed_at", "probe_id")) -> DataFrame:
    """Newest state per detector, cut to one row per task before the shuffle."""
    newest = latest_per_key(
        states.drop("source_token"), [KEY], [F.col(c).desc() for c in order]
    ).withColumnRenamed("effective_token", "source_token")
    return newest.withColumn("worker_heartbeat_at", F.col("observed_at")).select(*HEARTBEAT_COLUMNS)


def merge_heartbeats(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh heartbeats replace stored ones; silent detectors stay.

    A probe says nothing of imports, so a detector's last generation and import stay as they are stored.
    """
    kept = [c for c in LIFECYCLE if c in stored.columns]
    if kept:
        life = stored.select(F.col(KEY).alias("_key"), *[F.col(c).alias(f"_{c}") for c in kept])
        joined = fresh.join(life, F.col(KEY) == F.col("_key"), "left")
        for c in kept:
            joined = joined.withColumn(c, F.coalesce(c, f"_{c}") if c in fresh.columns else F.col(f"_{c}"))
        renewed = joined.drop("_key", *[f"_{c}" for c in kept])
    else:
        renewed = fresh
    return renewed.unionByName(stored.join(fresh.select(KEY), KEY, "left_anti"), allowMissingColumns=True)


def merge_lifecycle(heartbeats: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply import completions to the bound heartbeats; return heartbeats and events.

    An unbound completion is ignored, and so is one repeating the generation right before it.
    The completions are cut into slices per account so that a busy one spreads.
    """
    imports = sliced(imports, ["source_kind", "external_account_id"], ["completed_at", "generation_id"], "completed_at")
    bound = heartbeats.select(
        KEY, "source_kind", "external_account_id", "observation_scope",
        F.col("last_generation_id").alias("_stored") if "last_generation_id" in heartbeats.columns
        else F.lit(None).cast("string").alias("_stored"),
    )
    rows = imports.join(bound, ["source_kind", "external_account_id"])
    order = F.struct("completed_at", "generation_id")
    ends = rows.groupBy(KEY, "_slice").agg(F.max_by("generation_id", order).alias("_end"))
    earlier = Window.partitionBy(KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(KEY, "_slice", F.last("_end").over(earlier).alias("_end_in"))
    within = Window.partitionBy(KEY, "_slice").orderBy("completed_at", "generation_id")
    before = F.coalesce(F.lag("generation_id").over(within), "_end_in", "_stored")
    applied = (
        rows.join(carried, [KEY, "_slice"]).withColumn("_before", before)
        .filter(~F.col("_before").eqNullSafe(F.col("generation_id")))
    )
    events = applied.select(
        KEY, F.col("completed_at").alias("occurred_at"), F.lit("IMPORT_COMPLETE").alias("state"), "observation_scope", "generation_id"
    )
    newest = applied.groupBy(KEY).agg(F.max(order).alias("_newest"))
    base = heartbeats.join(newest, KEY, "left")
    old = lambda name, kind: F.col(name) if name in heartbeats.columns else F.lit(None).cast(kind)
    updated = (
        base.withColumn("last_generation_id", F.coalesce("_newest.generation_id", old("last_generation_id", "string")))
        .withColumn("last_import_at", F.coalesce("_newest.completed_at", old("last_import_at", "timestamp")))
        .drop("_newest")
    )
    return updated, events


def normalise_probes(raw: DataFrame) -> DataFrame:
    """Probe results to explicit state, error and scope.

    ``raw``: ``detector_id, source_kind, export_based, has_root, failed_with, capability, reason, token``.
    """
    failed = F.col("failed_with").isNotNull()
    ready = ~F.col("export_based") | (F.col("capability") == K.READY_CAPABILITY)
    scope = (
        F.when(~F.col("export_based"), "source_profile_metadata")
        .when(F.col("has_root"), "explicit_export_metadata")
        .otherwise("acquisition_readiness")
    )
    observed = ~failed & (~F.col("export_based") | F.col("has_root"))
    capability_reason = F.coalesce("reason", F.lit("readiness_unknown"))
    return (
        raw.withColumn("observation_scope", scope)
        .withColumn(
            "probe_state", F.when(failed, "RETRYABLE_ERROR").when(~F.coalesce(ready, F.lit(False)), "REQUIRES_USER_ACTION")
        )
        .withColumn(
            "error_code",
            F.when(failed, F.col("failed_with")).when(~F.coalesce(ready, F.lit(False)), capability_reason),
        )
        .withColumn("source_observed", observed)
        .withColumn("source_token", F.when(observed, F.col("token")))
    )


# --- debounce -----------------------------------------------------------------------------


def quiet_captures(changes: DataFrame, quiet_seconds: int, key: str = KEY, instant: str = "changed_at") -> DataFrame:
    """One row per burst of changes that is followed by a quiet time; it fires at its end.

    Sessions merge inside each map task before the shuffle, so a chatty key sends few rows.
    """
    session = F.session_window(instant, f"{quiet_seconds} seconds")
    return (
        changes.groupBy(key, session.alias("burst"))
        .agg(F.count("*").alias("changes"))
        .select(key, F.col("burst.start").alias("first_change_at"), F.col("burst.end").alias("fires_at"), "changes")
    )
