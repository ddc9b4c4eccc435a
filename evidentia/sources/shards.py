"""Sharded message tables as one partitioned DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.constants import LOW_32_BITS
from evidentia.functions import blank_to_null, epoch_auto, md5_table_name
from evidentia.operators.resolve import newest_messages


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Table extracts laid out as ``shard=.../table_name=.../*.parquet``; both are partition
    columns, so a choice of tables prunes directories."""
    return spark.read.parquet(path)


def scan_shards_md5(shards: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of the chats in ``sessions``; a chat's table is named after its md5."""
    chats = sessions.select("chat", md5_table_name("chat").alias("table_name"))
    return shards.join(chats, "table_name").withColumn(
        "base_type", F.col("local_type").cast("long").bitwiseAND(F.lit(LOW_32_BITS))
    )


def scan_shards_keyed(shards: DataFrame, conversations: DataFrame, key: str = "cid") -> DataFrame:
    """Rows of the chosen conversations from all fixed shards."""
    return shards.join(conversations.select(key), key, "left_semi")


def message_id_sharded() -> Column:
    """``shard:table:local_id:server_id:create_time``."""
    server = F.coalesce(F.col("server_id"), F.lit(0)).cast("long")
    return F.concat_ws(":", "shard", "table_name", "local_id", server, "create_time")


def message_id_keyed() -> Column:
    """``cid:mid``, without a message id ``cid:table:primaryKey:localId``."""
    local = F.concat_ws(":", "table_name", "primaryKey", "localId")
    return F.concat(F.col("cid"), F.lit(":"), F.coalesce(blank_to_null(F.col("mid").cast("string")), local))


def newest_per_conversation(messages: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Newest rows per conversation over all shards, in ascending order of ``order`` inside it."""
    return newest_messages(messages, key, order, limit)


def keyed_instant(column: str = "createdAt") -> Column:
    return epoch_auto(column)
