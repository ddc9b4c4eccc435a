"""Matching message parts with bodies found in file scans.

Every match is made of equi joins against sides reduced to one row per key, so a resource that
very many messages share costs one row on the file side and never produces pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import is_mp4, month_columns, normal_form, normal_path, stable_id
from evidentia.operators.ordering import latest_per_key


def resolve_attachments(parts: DataFrame, files: DataFrame, path: str = "path", root: str = "export_root") -> DataFrame:
    """Attachment rows: present with size and digest, or missing.

    A body that was found is present even where the scan left its digest out for its size.

    ``parts`` are the non-text parts, ``files`` a file scan with unique ``path``.
    """
    found = files.select(
        F.col("path").alias("_full"), F.col("sha256").alias("blob_sha256"), "size_bytes", F.lit(True).alias("_found")
    )
    full = F.concat(F.col(root), F.lit("/"), normal_path(path))
    return (
        parts.withColumn("_full", F.when(F.col(path) != "", full))
        .join(found, "_full", "left")
        .withColumn("status", F.when(F.col("_found"), "present").otherwise("missing"))
        .withColumnRenamed(path, "source_relative_path")
        .withColumn("attachment_id", stable_id("att", F.col("message_id"), F.col("part_index")))
        .drop("_full", "_found")
    )


def lookup_resources(
    messages: DataFrame, resources: DataFrame, keys: list[str], instant: str, row: str, payload: list[str]
) -> DataFrame:
    """Exact instant first, else the newest resource of the key.

    Both candidates are reduced before the join: one row per (key, instant), one per key.
    """
    exact = latest_per_key(resources, [*keys, instant], [F.col(row).desc()]).select(
        *keys, instant, F.struct(*payload).alias("_exact")
    )
    newest = latest_per_key(resources, keys, [F.col(instant).desc(), F.col(row).desc()]).select(
        *keys, F.struct(*payload).alias("_newest")
    )
    joined = messages.join(exact, [*keys, instant], "left").join(newest, keys, "left")
    pick = F.coalesce("_exact", "_newest")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_newest").isNotNull(), "newest").otherwise("none")
    return (
        joined.withColumns({"resource_match": how, "_pick": pick})
        .select("*", *[F.col(f"_pick.{name}").alias(name) for name in payload])
        .drop("_exact", "_newest", "_pick")
    )


def _by_month(files: DataFrame, keys: list[str], payload: list[str], rank: str) -> DataFrame:
    """Best file per (key, month), nested to one small map per key: months bound its size."""
    best = latest_per_key(files, [*keys, "month"], [F.col(rank).asc(), F.col("path").asc()])
    body = F.struct(*payload)
    return best.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("month", body.alias("body")))).alias("_months"),
        F.min_by(body, "month").alias("_earliest"),
    )


def _first_month(wanted: list[Column]) -> list[Column]:
    """Nested files in the order of the wanted months; plain map lookups stay in codegen."""
    return [F.try_element_at("_months", month) for month in wanted]


def pick_variant(messages: DataFrame, files: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Image body per message: month before, same, after, then any; full, high, thumbnail.

    ``messages``: ``chat, resource_key, create_time``; ``files``: ``chat_md5, resource_key,
    month, variant, path``.
    """
    order = F.when(F.col("variant") == "full", 0).when(F.col("variant") == "high", 1).otherwise(2)
    # one digest travels in place of both keys
    key = lambda chat: F.unhex(F.sha2(F.concat(F.length(chat).cast("string"), F.lit("/"), chat, F.col("resource_key")), 256)).alias("_key")
    nested = _by_month(files.select(key(F.col("chat_md5")), "month", "variant", "path", order.alias("_order")), ["_key"], ["variant", "path"], "_order")
    wanted = month_columns("create_time", (-1, 0, 1), time_zone)
    joined = messages.withColumn("_key", key(F.md5("chat"))).join(nested, "_key", "left")
    pick = F.coalesce(*_first_month(wanted), "_earliest")
    return joined.withColumn("_pick", pick).select(
        *messages.columns, F.col("_pick.variant").alias("variant"), F.col("_pick.path").alias("body_path")
    )


def accept_videos(messages: DataFrame, files: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Video body per message: same, previous, next month, else a unique stem; then size and
    signature must hold.

    ``messages``: ``resource_key, create_time, declared_size``; ``files``: ``resource_key,
    month, path, size_bytes, header``.
    """
    listed = files.withColumn("mp4", is_mp4("header"))
    nested = _by_month(listed.withColumn("_order", F.lit(0)), ["resource_key"], ["path", "size_bytes", "mp4"], "_order")
    copies = files.groupBy("resource_key").agg(F.count("*").alias("_copies"))
    wanted = month_columns("create_time", (0, -1, 1), time_zone)
    joined = messages.join(nested, "resource_key", "left").join(copies, "resource_key", "left")
    alone = F.when(F.col("_copies") == 1, F.col("_earliest"))
    pick = F.coalesce(*_first_month(wanted), alone)
    joined = joined.withColumn("_pick", pick)
    chosen = F.col("_pick")
    valid = (F.col("declared_size") > 0) & (chosen["size_bytes"] == F.col("declared_size")) & chosen["mp4"]
    status = (
        F.when(chosen.isNull(), "resource_body_not_local")
        .when(F.coalesce(valid, F.lit(False)), "copied")
        .otherwise("resource_validation_failed")
    )
    return joined.select(
        *messages.columns, status.alias("attachment_status"), F.when(status == "copied", chosen["path"]).alias("body_path")
    )


def safe_source_name(name: str) -> Column:
    """Last component after either separator; null when nothing usable is left."""
    last = F.trim(F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1))
    usable = ~last.isin("", ".", "..") & ~F.col(name).contains("\0") & ~F.col(name).isin("", ".", "..")
    return F.when(usable, last)


def match_files_by_name(messages: DataFrame, files: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """File body by title: month before, same, after, then anywhere; names compared in NFC.

    ``messages``: ``file_name, create_time``; ``files``: ``name, month, path, size_bytes``.
    """
    keyed = files.withColumn("_name", normal_form("name", "NFC")).withColumn("_order", F.lit(0))
    nested = _by_month(keyed, ["_name"], ["path", "size_bytes"], "_order")
    wanted = month_columns("create_time", (-1, 0, 1), time_zone)
    named = messages.withColumn("safe_name", safe_source_name("file_name"))
    joined = named.withColumn("_name", normal_form("safe_name", "NFC")).join(nested, "_name", "left")
    pick = F.coalesce(*_first_month(wanted), "_earliest")
    return joined.withColumn("_pick", pick).select(
        *named.columns, F.col("_pick.path").alias("body_path"), F.col("_pick.size_bytes").alias("size_bytes")
    )


def match_recorded_paths(parts: DataFrame, files: DataFrame, roots: list[str], key: str = "part_id") -> DataFrame:
    """First usable recorded path per part, inside an allowed root.

    ``parts``: ``key, category, expected_size, candidates array<struct<variant, path>>``;
    ``files``: ``path, size_bytes, format``. Relative candidates are tried under each root.
    """
    clean_roots = [root.rstrip("/") for root in roots]
    listed = parts.select(key, "category", "expected_size", F.posexplode("candidates").alias("pos", "candidate"))
    raw = F.col("candidate.path")
    under = F.array(
        *[
            F.struct(
                F.lit(position).alias("root_pos"),
                F.when(raw.startswith("/"), F.concat(F.lit("/"), normal_path(raw)))
                .otherwise(F.concat(F.lit(root + "/"), normal_path(raw)))
                .alias("path"),
                F.lit(root + "/").alias("root"),
            )
            for position, root in enumerate(clean_roots)
        ]
    )
    tried = (
        listed.filter(F.trim(raw) != "")
        .select(key, "category", "expected_size", "pos", "candidate.variant", F.explode(under).alias("try"))
        .select(key, "category", "expected_size", "pos", "variant", "try.*")
        .filter(F.col("path").startswith(F.col("root")))
    )
    sized = F.col("expected_size").isNull() | (F.col("expected_size") < 0) | (F.col("expected_size") == F.col("size_bytes"))
    typed = (F.col("category") != "image") | F.col("format").isNotNull()
    usable = tried.join(files.select("path", "size_bytes", "format"), "path").filter(sized & typed)
    best = latest_per_key(usable, [key], [F.col("pos").asc(), F.col("root_pos").asc()]).select(
        key, F.col("variant").alias("media_variant"), F.col("path").alias("body_path"), F.col("size_bytes").alias("body_size")
    )
    status = F.when(F.col("body_path").isNotNull(), "copied_from_allowlisted_local_path").otherwise(
        "local_resource_not_resolved"
    )
    return parts.join(best, key, "left").withColumn("attachment_status", status)


def audit_attachments(attachments: DataFrame, files: DataFrame, max_bytes: int) -> DataFrame:
    """Re-check stored bodies: presence, size cap, digest."""
    actual = files.select(
        F.col("path").alias("stored_path"), F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size")
    )
    verdict = (
        F.when((F.col("status") != "present") | F.col("stored_path").isNull(), "source_missing")
        .when(F.col("_size").isNull(), "body_unavailable")
        .when(F.col("_size") > max_bytes, "above_size_limit")
        .when(F.col("_sha").eqNullSafe(F.col("blob_sha256")), "verified")
        .otherwise("digest_changed")
    )
    return attachments.join(actual, "stored_path", "left").withColumn("verdict", verdict).drop("_sha", "_size")


def resolve_with_fallback(parts: DataFrame, files: DataFrame, document: str = "document_id", path: str = "path") -> DataFrame:
    """Distinct safe paths per document, found as recorded or below ``resources/``."""
    wanted = parts.filter(F.col(path) != "").select(document, F.col(path).alias("_path")).distinct()
    seen = files.select(F.col("document_id").alias(document), F.col("path").alias("_found"))
    plain = seen.withColumn("_path", F.col("_found")).withColumnRenamed("_found", "_plain")
    nested = seen.filter(F.col("_found").startswith("resources/")).select(
        document, F.substring(F.col("_found"), F.lit(11), F.length("_found")).alias("_path"), F.col("_found").alias("_nested")
    )
    joined = wanted.join(plain, [document, "_path"], "left").join(nested, [document, "_path"], "left")
    usable = F.when(~F.col("_path").startswith("resources/"), F.col("_nested"))
    return joined.select(
        document, F.col("_path").alias("recorded_path"), F.coalesce("_plain", usable).alias("resolved_path")
    )
