"""Helpers shared by the operators: id folds, texts, global ranks, Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.session import stage

#: A word: a run without ASCII white space, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, so that very long texts do not meet in a Python worker.

    Operators write their steps to tables, so the shuffle files of a step go when it has ended.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{root}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, empty when null."""
    return F.coalesce(F.col(text), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(key: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % folds


def id_fold(value: int | None, folds: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % folds


def ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Number all rows from 0 in ``order``: range partitions are sorted, then shifted by the rows before them.

    No task sees more than its range; only one count per partition is summed in one place. ``order`` should end in a
    unique column, so that a hot key can be split.
    """
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(sort.withColumn("__at", F.monotonically_increasing_id()), "ordinal")
    rows = rows.withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__part").agg((F.max("__row") + 1).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # one row per partition: the broadcast is bounded by the number of tasks
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__first") + F.col("__row")).drop("__at", "__part", "__row", "__first")


#: Bits of a table of wanted keys, as a power of two: 8 MB, whatever the corpus.
BITS = 26


def bit_table(keys: DataFrame, name: str) -> np.ndarray:
    """A bit for the leading bits of each 64-bit key; what has no bit is not among ``keys``.

    The table has a fixed size: with very many keys it lets more of the others through, and drops none of its own.
    """
    bit = F.shiftrightunsigned(name, 64 - BITS)
    words = keys.select(F.shiftright(bit, 5).alias("w"), F.pow(F.lit(2.0), F.pmod(bit, F.lit(32))).cast("long").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (BITS - 5), dtype=np.int64)
    table[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64)
    return table


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) >> np.uint64(64 - BITS)
    return (table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.int64)) & 1 == 1


def perhaps_in(keys: DataFrame, name: str):
    """A predicate that is true for all ``keys`` and for few others, so that a join need not shuffle every row."""
    shared = keys.sparkSession.sparkContext.broadcast(bit_table(keys, name))

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, column.to_numpy(dtype=np.int64)))

    return test


#: A key that holds over one in so many rows is joined by broadcast.
SHARE = 1000


def joined_evenly(rows: DataFrame, unique: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` (staged) with ``unique``: one row a key, whose column ``count`` says how many rows it has.

    Keys with over one in SHARE of all rows would each meet in one task; there are fewer than SHARE of them, which
    bounds what is broadcast. The others are shuffled. ``count`` is dropped; null keys match nothing.
    """
    total = unique.agg(F.sum(count)).first()[0] or 0
    hot = unique.filter(F.col(count) * SHARE > total)
    cold = unique.filter(F.col(count) * SHARE <= total).drop(count)
    if hot.isEmpty():
        return rows.join(cold, key)
    hot = F.broadcast(hot.drop(count))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that low and high bits are both usable."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x
