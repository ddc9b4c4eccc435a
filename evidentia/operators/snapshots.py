"""File inventories, generations, watermarks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.constants import LOW_32_BITS, READY_CAPABILITY
from evidentia.functions import digest_of, is_sqlite, masked_id, unsafe_inventory_path
from evidentia.operators.ordering import latest_per_key

FANOUT = 4096


def fingerprint(inventory: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One token per source over all its files, independent of their order.

    Built as a two-level digest tree: files hash into ``FANOUT`` buckets, each bucket digests
    its sorted entries, the token digests the sorted buckets. No group holds a whole inventory.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    entry = F.concat_ws("|", *shown)
    leaf = F.sha2(entry, 256)
    bucket = F.substring(leaf, 1, 3)
    leaves = (
        inventory.select(*keys, leaf.alias("_leaf"), bucket.alias("_bucket"))
        .groupBy(*keys, "_bucket")
        .agg(F.array_sort(F.collect_list("_leaf")).alias("_leaves"), F.count("*").alias("_files"))
        .select(*keys, "_files", F.concat("_bucket", F.lit(":"), F.sha2(F.array_join("_leaves", ","), 256)).alias("_node"))
    )
    return leaves.groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_node")), ","), 256).alias("fingerprint_token"),
        F.sum("_files").alias("files"),
    )


def inventory_verdicts(
    inventory: DataFrame, required: DataFrame, keys: list[str], max_files: int | None = None
) -> DataFrame:
    """Per source: required files absent, file limit exceeded (only if one is given), or usable."""
    counts = inventory.groupBy(*keys).agg(F.count("*").alias("files"))
    absent = (
        required.join(inventory.select(*keys, "relative_path"), [*keys, "relative_path"], "left_anti")
        .groupBy(*keys)
        .agg(F.count("*").alias("absent"))
    )
    joined = counts.join(absent, keys, "full")
    verdict = (
        F.when(F.coalesce("absent", F.lit(0)) > 0, "required_files_unavailable")
        .when(F.coalesce("files", F.lit(0)) == 0, "no_regular_files")
        .when(F.col("files") > F.lit(max_files), "file_limit_exceeded")
        .otherwise("usable")
    )
    return joined.select(*keys, F.coalesce("files", F.lit(0)).alias("files"), verdict.alias("verdict"))


def with_wal_twin(inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Each main file with the size of its write-ahead twin (``<path>-wal``), null if absent."""
    suffix = "-wal"
    twins = inventory.filter(F.col("relative_path").endswith(suffix)).select(
        *keys,
        F.expr("left(relative_path, length(relative_path) - 4)").alias("relative_path"),
        F.col("size_bytes").alias("wal_size_bytes"),
    )
    main = inventory.filter(~F.col("relative_path").endswith(suffix))
    return main.join(twins, [*keys, "relative_path"], "left")


def changed_files(previous: DataFrame, current: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Current files that are new or differ in any compared column."""
    old = previous.select(*keys, F.struct(*columns).alias("_old"))
    return (
        current.join(old, keys, "left")
        .filter(~F.col("_old").eqNullSafe(F.struct(*columns)))
        .drop("_old")
    )


# --- watermarks ---------------------------------------------------------------------------


def stream_watermarks(messages: DataFrame, shard: str = "shard", table: str = "table_name") -> DataFrame:
    """Rows, highest local id and newest instant per stream; the stream id is a digest."""
    sums = messages.groupBy(shard, table).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max("local_id"), F.lit(0)).cast("long").alias("max_local_id"),
        F.coalesce(F.max("create_time"), F.lit(0)).cast("long").alias("max_create_time"),
    )
    identity = F.substring(digest_of(F.col(shard).cast("string"), F.col(table).cast("string")), 1, 24)
    return sums.select(identity.alias("stream_id"), "rows", "max_local_id", "max_create_time")


def watermark_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One summary row: new, removed, changed streams, growth and regressions.

    Without any previous stream the result is a baseline.
    """
    values = ("rows", "max_local_id", "max_create_time")
    old = previous.select("stream_id", F.struct(*values).alias("old"))
    new = current.select("stream_id", F.struct(*values).alias("new"))
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    growth = F.coalesce("new.rows", F.lit(0)) - F.coalesce("old.rows", F.lit(0))
    sums = old.join(new, "stream_id", "full").agg(
        F.count_if(F.col("old").isNotNull()).alias("_old"),
        F.count_if(F.col("old").isNull()).alias("_new"),
        F.count_if(F.col("new").isNull()).alias("_removed"),
        F.count_if(both & (F.col("old") != F.col("new"))).alias("_changed"),
        F.sum(F.when(F.col("new").isNotNull() & (growth >= 0), growth).otherwise(0)).alias("_growth"),
        F.count_if(both & (growth < 0)).alias("_shrunk"),
    )
    baseline = F.col("_old") == 0
    return sums.select(
        baseline.alias("baseline"),
        F.col("_new").alias("new_streams"),
        F.col("_removed").alias("removed_streams"),
        (F.col("_changed") + F.col("_new")).alias("changed_streams"),
        F.when(~baseline, F.col("_growth")).alias("row_increase_estimate"),
        F.when(~baseline, F.col("_shrunk") + F.col("_removed")).otherwise(0).alias("regressions"),
    )


# --- generations ---------------------------------------------------------------------------


def verify_generations(receipts: DataFrame, files: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Receipt inventory against the files present, one row per deviation.

    ``receipts``: exploded inventory rows ``generation_id, relative_path, sha256, size_bytes``;
    ``files``: the scan with the same columns, one row a path. ``required`` paths must be in every generation's inventory.

    Both sides are read once and meet in one aggregate by path, folded on the map side: entries, wanted paths and files
    are rows of one kind each, and what a path's rows say together are its problems.
    """
    keys = ["generation_id", "relative_path"]
    none = F.lit(None)

    def row(path: Column, kind: str, sha: Column, size: Column) -> Column:
        return F.struct(path.alias("relative_path"), F.lit(kind).alias("kind"), sha.cast("string").alias("sha"), size.cast("long").alias("size"))

    entry = row(F.col("relative_path"), "entry", F.col("sha256"), F.col("size_bytes"))
    wanted = [row(F.lit(r), "wanted", none, none) for r in required or []]
    listed = receipts.select("generation_id", F.explode(F.array(entry, *wanted)).alias("r")).select("generation_id", "r.*")
    there = files.select("generation_id", row(F.col("relative_path"), "file", F.col("sha256"), F.col("size_bytes")).alias("r")).select("generation_id", "r.*")
    of = lambda kind, column: F.min(F.when(F.col("kind") == kind, F.col(column)))
    # the values of a path that is listed more than once are ambiguous anyway
    paths = listed.unionByName(there).groupBy(*keys).agg(
        F.count_if(F.col("kind") == "entry").alias("_entries"), F.count_if(F.col("kind") == "file").alias("_files"),
        F.count_if(F.col("kind") == "wanted").alias("_wanted"), of("entry", "sha").alias("_sha"), of("entry", "size").alias("_size"),
        of("file", "sha").alias("_actual"), of("file", "size").alias("_actual_size"),
    )
    same = F.col("_sha").eqNullSafe(F.col("_actual")) & F.col("_size").eqNullSafe(F.col("_actual_size"))
    entries, present = F.col("_entries") > 0, F.col("_files") > 0
    found = F.concat(
        F.when(entries & unsafe_inventory_path("relative_path"), F.array_repeat(F.lit("unsafe_path"), F.col("_entries").cast("int"))).otherwise(F.array()),
        F.array_compact(
            F.array(
                F.when(F.col("_entries") > 1, "duplicate_entry"),
                F.when(present & ~entries, "uninventoried_file").when(entries & ~present, "missing_file").when(entries & ~same, "digest_or_size_changed"),
                F.when((F.col("_wanted") > 0) & ~entries, "required_not_inventoried"),
            )
        ),
    )
    return paths.select(*keys, F.explode(found).alias("problem"))


def generation_verdicts(receipts: DataFrame, problems: DataFrame) -> DataFrame:
    """``generation_id, files, problems, verified``."""
    counts = receipts.groupBy("generation_id").agg(F.count("*").alias("files"))
    bad = problems.groupBy("generation_id").agg(F.count("*").alias("problems"))
    return (
        counts.join(bad, "generation_id", "left")
        .withColumn("problems", F.coalesce("problems", F.lit(0)))
        .withColumn("verified", F.col("problems") == 0)
    )


def pending_generations(generations: DataFrame, runs: DataFrame, key: str = "source_id") -> DataFrame:
    """Newest completed generation per source that no completed run has ingested."""
    complete = generations.filter(F.col("status") == "COMPLETE")
    newest = latest_per_key(complete, [key], [F.col("captured_at").desc(), F.col("generation_id").desc()])
    return newest.join(runs.filter("status = 'complete'").select("generation_id"), "generation_id", "left_anti")


# --- profiles ------------------------------------------------------------------------------


def profile_snapshot(messages: DataFrame, local_type: str = "local_type", storage: str = "content_type") -> DataFrame:
    """Shape of message tables without contents: counts by type and storage, time bounds.

    One pass with grouping sets.
    """
    slim = messages.select(
        F.col(local_type).cast("long").bitwiseAND(F.lit(LOW_32_BITS)).cast("string").alias("base_type"),
        F.coalesce(F.col(storage), F.lit(0)).cast("string").alias("storage"),
        "create_time",
    )
    sets = slim.groupingSets([["base_type"], ["storage"], []], "base_type", "storage").agg(
        F.grouping("base_type").alias("_gt"),
        F.grouping("storage").alias("_gs"),
        F.count("*").alias("rows"),
        F.min("create_time").alias("min_time"),
        F.max("create_time").alias("max_time"),
    )
    facet = F.when(F.col("_gt") == 0, "type").when(F.col("_gs") == 0, "storage").otherwise("all")
    return sets.select(facet.alias("facet"), F.coalesce("base_type", "storage", F.lit("")).alias("value"), "rows", "min_time", "max_time")


def header_kind(header: str | Column) -> Column:
    plain = is_sqlite(header)
    return F.when(plain.isNull(), "unreadable").when(plain, "sqlite_plain").otherwise("encrypted_or_custom")


def profile_directories(files: DataFrame) -> DataFrame:
    """Per masked profile: databases by header kind, other files, bytes, capability.

    ``files``: ``profile, relative_path, size_bytes, header``.
    """
    is_db = F.col("relative_path").endswith(".db")
    kinds = files.withColumn("_kind", F.when(is_db, header_kind("header")))
    sums = kinds.groupBy("profile").agg(
        F.count("*").alias("files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if(is_db).alias("databases"),
        *[F.count_if(F.col("_kind") == k).alias(k) for k in ("sqlite_plain", "encrypted_or_custom", "unreadable")],
    )
    reason = (
        F.when(F.col("databases") == 0, "no_local_profile_database_found")
        .when(F.col("encrypted_or_custom") > 0, "encrypted_or_custom_business_databases")
        .when(F.col("sqlite_plain") > 0, "plain_database_detected_but_no_accepted_parser")
        .otherwise("no_readable_business_database_found")
    )
    capability = F.when(
        (F.col("encrypted_or_custom") == 0) & (F.col("sqlite_plain") > 0), READY_CAPABILITY
    ).otherwise("REQUIRES_USER_ACTION")
    return sums.select(
        masked_id("profile", 12, "profile_").alias("profile_id"),
        "files", "total_bytes", "databases", "sqlite_plain", "encrypted_or_custom", "unreadable",
        capability.alias("capability"), reason.alias("reason"),
    )
