"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import whole
from evidentia.session import stage


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_bytes: int = 256) -> DataFrame:
    """One row per row of ``docs``: the row that stays for its text.

    Rows are grouped by length in bytes; those that share a length, by a hash of the first ``prefix_bytes``; those that
    share that too, by the SHA-256 of the whole text. A row that drops out of a step is alone and takes no part in the
    next. Only lengths and hashes are shuffled, counted inside each task first; a hot length or a hot text is one row
    per task in a count, and a skewed join that adaptive execution can split.

    The SHA-256 is part of the result for every row, so it is taken in the one scan that reads the texts, and the full
    content is never shuffled or read again.

    A null text counts as empty; empty texts are equal. Of equal texts the row with the largest id stays (a null id is
    the smallest); of repeated rows with that id one stays. Other columns are ignored. An empty table gives no rows.

    Columns: the id, keep_id, group_size, kept, text_sha256, and ``row`` (unique, without meaning).
    """
    body = whole(text)
    length = F.octet_length(body)
    rows = docs.select(
        F.col(key).alias("__id"),
        length.alias("__length"),
        F.xxhash64(length, F.substring(body.cast("binary"), 1, prefix_bytes)).alias("__prefix"),
        F.unhex(F.sha2(body, 256)).alias("__full"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "exact-rows")

    def shared(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy(by).agg(F.count("*").alias("__n")).filter("__n > 1").select(by)

    same_length = rows.join(shared(rows, "__length"), "__length", "left_semi")
    same_prefix = same_length.join(shared(same_length, "__prefix"), "__prefix", "left_semi")
    groups = (
        same_prefix.groupBy("__full")
        .agg(F.count("*").alias("__n"), F.max(F.struct("__id", "row")).alias("__keep"))
        .filter("__n > 1")
    )
    out = rows.join(stage(groups, "exact-groups"), "__full", "left")
    alone = F.col("__n").isNull()
    return out.select(
        F.col("__id").alias(key),
        F.when(alone, F.col("__id")).otherwise(F.col("__keep.__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("__full")).alias("text_sha256"),
        "row",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns unchanged.

    The ids that stay are matched null-safely. Only where repeated rows share a staying id are whole rows compared.
    """
    groups = stage(exact_groups(docs, key, text), "exact-kept")
    same = F.col("__id").eqNullSafe(F.col(key))
    ids = groups.groupBy(F.col(key).alias("__id")).agg(
        F.count("*").alias("__rows"), F.sum(F.col("kept").cast("long")).alias("__kept"), F.max(F.when(F.col("kept"), F.col("text_sha256"))).alias("__sha")
    )
    ids = stage(ids.filter("__kept < __rows or __rows > 1"), "exact-drop")
    mixed = ids.filter("__kept > 0")
    rest = docs.join(ids.select("__id"), same, "left_anti")
    # an id with rows that stay and rows that go: one row of each text that stays under this id
    stays = groups.filter("kept").select(F.col(key).alias("__id"), F.col("text_sha256").alias("__sha256")).distinct()
    stays = stays.join(mixed.select("__id"), stays["__id"].eqNullSafe(mixed["__id"]), "left_semi")
    some = docs.join(stays, same & (F.sha2(whole(text), 256) == F.col("__sha256")), "left_semi")
    return rest.unionByName(some.dropDuplicates([key, text]))
