"""Contract checks that yield diagnostics as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.constants import CONVERSATION_TYPES, DIRECTIONS, PART_TYPES, SCHEMA_VERSION_PATTERN, TEXT_PART_TYPES
from evidentia.functions import escapes_root, json_type, parse_instant, strict_object, unsafe_inventory_path


class ArgumentError(ValueError):
    """A call argument is outside its contract."""


# --- call arguments ---------------------------------------------------------------------


def bounded_limit(value, bounds: tuple[int, int], name: str = "limit") -> int:
    default, maximum = bounds
    if value is None:
        return default
    if type(value) is not int or not 1 <= value <= maximum:
        raise ArgumentError(f"{name} must be an integer from 1 to {maximum}")
    return value


def bounded_offset(value, name: str = "offset") -> int:
    if value is None:
        return 0
    if type(value) is not int or value < 0:
        raise ArgumentError(f"{name} must be an integer of at least 0")
    return value


def one_of(value, allowed, name: str):
    if value is not None and value not in allowed:
        raise ArgumentError(f"{name} must be one of {', '.join(allowed)}")
    return value


def text_argument(value, name: str, blank_ok: bool = False):
    if value is not None and (not isinstance(value, str) or not (value or blank_ok)):
        raise ArgumentError(f"{name} must be {'a' if blank_ok else 'a non-empty'} string")
    return value


def ordered_window(since, until):
    for name, value in (("since", since), ("until", until)):
        if value is not None and value.tzinfo is None:
            raise ArgumentError(f"{name} must carry a time zone")
    if since is not None and until is not None and since >= until:
        raise ArgumentError("since must come before until")
    return since, until


# --- documents --------------------------------------------------------------------------


def _field(variant: str | Column, name: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", "variant")


def _kind(variant: str | Column, name: str) -> Column:
    return F.coalesce(json_type(_field(variant, name)), F.lit("ABSENT"))


def _string(variant: str | Column, name: str) -> Column:
    return F.when(_kind(variant, name) == "STRING", F.try_variant_get(variant, f"$.{name}", "string"))


def _array(variant: str | Column, name: str) -> Column:
    """The elements of a list, none where it is absent or something else."""
    return F.coalesce(F.try_variant_get(variant, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _is_array(variant: str | Column, name: str) -> Column:
    """Whether a field holds a list; asked without the schema of what is in it."""
    return F.try_variant_get(variant, f"$.{name}", "array<variant>").isNotNull()


def _not_text(variant: str | Column, name: str) -> Column:
    value = _string(variant, name)
    return value.isNull() | (F.trim(value) == "")


def _bad_optional(variant: str | Column, name: str, kind: str) -> Column:
    return ~_kind(variant, name).isin(kind, "VOID", "ABSENT")


def _bad_enum(variant: str | Column, name: str, allowed) -> Column:
    kind = _kind(variant, name)
    return (kind != "ABSENT") & ~F.coalesce(_string(variant, name).isin(*allowed), F.lit(False))


def _bad_instant(variant: str | Column, name: str) -> Column:
    return (_kind(variant, name) == "STRING") & parse_instant(_string(variant, name)).isNull()


def _found(where: Column, checks: dict[str, Column]) -> Column:
    """The broken rules of one element, as (location, problem)."""
    codes = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks.items()]))
    return F.transform(codes, lambda code: F.struct(where.alias("location"), code.alias("problem")))


def _each(items: Column, where: Column, name: str, look) -> Column:
    """What ``look`` finds in each element, one list for all; the element's place is part of its location."""
    place = lambda i: F.concat(where, F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    return F.flatten(F.transform(items, lambda x, i: look(x, place(i))))


def _part_problems(part: Column, where: Column) -> Column:
    kind, path = _string(part, "type"), _string(part, "path")
    is_text = F.coalesce(kind.isin(*TEXT_PART_TYPES), F.lit(False))
    known = F.coalesce(kind.isin(*PART_TYPES), F.lit(False))
    no_text = (_kind(part, "text") != "STRING") & ((_kind(part, "text") != "ABSENT") | (_kind(part, "url") != "STRING"))
    return _found(
        where,
        {
            "part_type_unsupported": ~known,
            "text_missing": is_text & no_text,
            "path_not_string": known & ~is_text & _bad_optional(part, "path", "STRING"),
            "path_unsafe": known & ~is_text & F.coalesce(escapes_root(path), F.lit(False)),
            "mime_type_not_string": known & ~is_text & _bad_optional(part, "mime_type", "STRING"),
            "transcription_not_string": known & ~is_text & _bad_optional(part, "transcription", "STRING"),
        },
    )


def _message_problems(message: Column, where: Column) -> Column:
    own = _found(
        where,
        {
            "message_id_missing": _not_text(message, "source_message_id"),
            "timestamp_not_instant": _not_text(message, "timestamp") | _bad_instant(message, "timestamp"),
            "sender_name_not_string": ~_kind(message, "sender_name").isin("STRING", "ABSENT"),
            "direction_unsupported": _bad_enum(message, "direction", DIRECTIONS),
            "parts_not_array": ~_is_array(message, "parts") | (F.size(_array(message, "parts")) == 0),
        },
    )
    return F.concat(own, _each(_array(message, "parts"), where, ".parts", _part_problems))


def _participant_problems(participant: Column, where: Column) -> Column:
    checks = {"identity_id_missing": _not_text(participant, "source_identity_id"), "display_name_missing": _not_text(participant, "display_name")}
    return _found(where, checks)


def _conversation_problems(conversation: Column, where: Column) -> Column:
    own = _found(
        where,
        {
            "conversation_id_missing": _not_text(conversation, "source_conversation_id"),
            "title_missing": _not_text(conversation, "title"),
            "type_unsupported": _bad_enum(conversation, "type", CONVERSATION_TYPES),
            "last_activity_not_instant": _bad_optional(conversation, "last_activity", "STRING") | _bad_instant(conversation, "last_activity"),
            "participants_not_array": _field(conversation, "participants").isNotNull() & ~_is_array(conversation, "participants"),
            "participants_complete_not_boolean": ~_kind(conversation, "participants_complete").isin("BOOLEAN", "ABSENT"),
            "messages_not_array": ~_is_array(conversation, "messages"),
        },
    )
    members = _each(_array(conversation, "participants"), where, ".participants", _participant_problems)
    return F.concat(own, members, _each(_array(conversation, "messages"), where, ".messages", _message_problems))


def problems_of_document(version: str | None = None) -> Column:
    """All broken rules of a parsed document (``doc``, ``body``), by one walk through its levels within its row.

    ``version`` is the one schema version that is taken; without it any name of the contract's form is.
    """
    stated = F.when(json_type("doc.schema_version") == "STRING", F.try_variant_get("doc.schema_version", "$", "string"))
    known = stated.rlike(SCHEMA_VERSION_PATTERN) if version is None else stated == version
    exported = F.col("doc.exported_at")
    own = _found(
        F.lit("document"),
        {
            "document_not_object": ~strict_object("body"),
            "schema_version_unsupported": ~F.coalesce(known, F.lit(False)),
            "conversations_not_array": F.col("doc.conversations").isNull(),
            "exported_at_not_instant": exported.isNotNull()
            & (json_type(exported) != "VOID")
            & parse_instant(F.try_variant_get(exported, "$", "string")).isNull(),
            "source_kind_missing": _not_text("doc.source", "kind"),
            "source_account_missing": _not_text("doc.source", "account_id"),
            "source_name_missing": _not_text("doc.source", "display_name"),
        },
    )
    conversations = F.coalesce("doc.conversations", F.array().cast("array<variant>"))
    return F.concat(own, _each(conversations, F.lit(""), "conversations", _conversation_problems))


def checked_documents(documents: DataFrame, version: str | None = None) -> DataFrame:
    """``documents`` with ``problems`` in place of ``body``: parsed once for the checks and for all that follows."""
    return documents.withColumn("problems", problems_of_document(version)).drop("body")


def manifest_problems(documents: DataFrame, version: str | None = None) -> DataFrame:
    """One row per broken rule: ``manifest_sha256, location, problem``."""
    found = F.col("problems") if "problems" in documents.columns else problems_of_document(version)
    return documents.select("manifest_sha256", F.explode(found).alias("_p")).select("manifest_sha256", "_p.location", "_p.problem")


def split_valid(documents: DataFrame, problems: DataFrame | None = None, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents without any problem, and the problems; one bad row rejects its document."""
    if problems is None and "problems" in documents.columns:
        return documents.filter(F.size("problems") == 0).drop("problems"), manifest_problems(documents)
    problems = manifest_problems(documents, version) if problems is None else problems
    return documents.join(problems.select("manifest_sha256").distinct(), "manifest_sha256", "left_anti"), problems


# --- paths, allowlists, windows, agreement -------------------------------------------------


def with_path_safety(df: DataFrame, path: str) -> DataFrame:
    """Adds ``escapes_root`` (documents) and ``unsafe_path`` (inventories)."""
    return df.withColumn("escapes_root", escapes_root(path)).withColumn("unsafe_path", unsafe_inventory_path(path))


def filter_allowlist(df: DataFrame, allowed: DataFrame, id_columns: list[str], key: str = "allowed_id") -> DataFrame:
    """Rows with any of their identifiers allowed; each row once.

    The identifiers are unpivoted, so the match stays an equi semi join per column and the
    optimiser may broadcast the list when its size permits.
    """
    keys = allowed.select(F.trim(F.col(key)).alias("_allowed")).filter("_allowed <> ''").distinct()
    kept = None
    remaining = df
    for column in id_columns:
        hit = F.trim(F.col(column)) == F.col("_allowed")
        matched = remaining.join(keys, hit, "left_semi")
        kept = matched if kept is None else kept.unionByName(matched)
        remaining = remaining.join(keys, hit, "left_anti")
    return kept


def filter_window(df: DataFrame, instant: str, since=None, until=None) -> DataFrame:
    """Half-open ``[since, until)``; plain predicates that reach the scan."""
    ordered_window(since, until)
    if since is not None:
        df = df.filter(F.col(instant) >= F.lit(since))
    if until is not None:
        df = df.filter(F.col(instant) < F.lit(until))
    return df


def check_agreement(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose files disagree on a column. Min against max, so partial aggregation suffices."""
    sides = [
        f(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"{name}_{c}")
        for c in columns
        for name, f in (("min", F.min), ("max", F.max))
    ]
    bounds = df.groupBy(key).agg(*sides)
    clashes = F.array_compact(
        F.array(*[F.when(F.col(f"min_{c}") != F.col(f"max_{c}"), F.lit(c)) for c in columns])
    )
    return bounds.select(key, F.explode(clashes).alias("disagrees_on"))


def check_bindings(probes: DataFrame) -> DataFrame:
    """Detectors bound to several accounts, and accounts bound to several detectors."""
    pair = F.struct("source_kind", "external_account_id")
    rebound = (
        probes.groupBy("detector_id")
        .agg(F.min(pair).alias("low"), F.max(pair).alias("high"))
        .filter("low <> high")
        .select(F.lit("detector_rebound").alias("problem"), F.col("detector_id").alias("subject"))
    )
    shared = (
        probes.groupBy("source_kind", "external_account_id")
        .agg(F.min("detector_id").alias("low"), F.max("detector_id").alias("high"))
        .filter("low <> high")
        .select(
            F.lit("account_shared").alias("problem"),
            F.concat_ws("/", "source_kind", "external_account_id").alias("subject"),
        )
    )
    return rebound.unionByName(shared)


# --- store audit ---------------------------------------------------------------------------

FOREIGN_KEYS = (
    ("import_runs", "source_id", "sources", "source_id"),
    ("identities", "source_id", "sources", "source_id"),
    ("conversations", "source_id", "sources", "source_id"),
    ("participants", "conversation_id", "conversations", "conversation_id"),
    ("participants", "identity_id", "identities", "identity_id"),
    ("messages", "source_id", "sources", "source_id"),
    ("messages", "conversation_id", "conversations", "conversation_id"),
    ("messages", "sender_identity_id", "identities", "identity_id"),
    ("attachments", "message_id", "messages", "message_id"),
    ("attachments", "blob_sha256", "blobs", "sha256"),
    ("parts", "message_id", "messages", "message_id"),
    ("parts", "attachment_id", "attachments", "attachment_id"),
    ("evidence", "candidate_id", "candidates", "candidate_id"),
    ("evidence", "message_id", "messages", "message_id"),
    ("scan_state", "message_id", "messages", "message_id"),
)
UNIQUE_KEYS = (
    ("sources", ("kind", "external_account_id")),
    ("identities", ("source_id", "external_identity_id")),
    ("conversations", ("source_id", "external_conversation_id")),
    ("participants", ("conversation_id", "identity_id")),
    ("messages", ("source_id", "external_message_id")),
    ("attachments", ("message_id", "part_index")),
    ("parts", ("message_id", "part_index")),
    ("blobs", ("sha256",)),
    ("candidates", ("rule_id", "dedup_key")),
    ("evidence", ("candidate_id", "message_id")),
    ("scan_state", ("rule_id", "message_id")),
)
ALLOWED_VALUES = (
    ("conversations", "conversation_type", CONVERSATION_TYPES),
    ("messages", "direction", DIRECTIONS),
    ("attachments", "status", ("present", "missing")),
    ("parts", "part_type", PART_TYPES),
)


def audit_store(tables: dict[str, DataFrame]) -> DataFrame:
    """``check, violations`` for every foreign key, unique key and value list that applies."""
    reports = []

    def report(name: str, bad: DataFrame) -> None:
        reports.append(bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations"))

    for child, column, parent, key in FOREIGN_KEYS:
        if child in tables and parent in tables and column in tables[child].columns:
            keys = tables[parent].select(F.col(key).alias("_key"))
            orphans = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias("_key"))
            report(f"fk:{child}.{column}", orphans.join(keys, "_key", "left_anti"))
    for name, keys in UNIQUE_KEYS:
        if name in tables and set(keys) <= set(tables[name].columns):
            report(f"unique:{name}({','.join(keys)})", tables[name].groupBy(*keys).count().filter("count > 1"))
    for name, column, allowed in ALLOWED_VALUES:
        if name in tables and column in tables[name].columns:
            report(f"values:{name}.{column}", tables[name].filter(~F.col(column).isin(*allowed)))
    result = reports[0]
    for item in reports[1:]:
        result = result.unionByName(item)
    return result
