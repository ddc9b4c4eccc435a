"""Order-dependent work on keys that may hold a large share of all rows.

A window over a hot key sorts that whole key in one task. The helpers here cut each key's
timeline into slices first: rows are windowed per (key, slice), and only one summary row per
slice is carried across the slices of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import stage

HOUR = 3600
DAY = 86400


def time_slice(instant: str | Column, seconds: float = DAY) -> Column:
    return F.floor(F.unix_micros(instant) / F.lit(max(int(seconds * 1_000_000), 1)))


#: Rows of one key that a slice holds at most, but for the unevenness of sampled bounds.
ROWS = 200_000


def sliced(df: DataFrame, keys: list[str], order: list[str], instant: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_slice``, a number that never falls in ``order`` within a key and holds few rows of it.

    ``order`` begins with ``instant`` and ends in a column without ties. A histogram by key and hour, folded on the map
    side, tells the fullest hour. Where it fits a slice, slices are as many hours wide as then surely fit, and the
    number is computed from the instant alone. A fuller hour, a burst at one instant say, is cut by value: rows are
    dealt over ranges of equal depth in (key, order), so that bounds fall between ids at equal instants too; this costs
    one shuffle, and the result is written so that its bounds hold for every reader.
    """
    hour = time_slice(instant, HOUR).alias("_hour")
    hours = df.groupBy(*keys, hour).agg(F.count("*").alias("n"))
    fullest, total = hours.agg(F.max("n"), F.sum("n")).first()
    if not fullest or fullest <= rows:
        hours_wide = min(rows // max(fullest or 1, 1), DAY // HOUR)
        return df.withColumn("_slice", time_slice(instant, HOUR * max(hours_wide, 1)))
    ranges = df.repartitionByRange(-(-total // rows) + 1, *keys, *order)
    return stage(ranges.withColumn("_slice", F.spark_partition_id().cast("long")), "slices")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under ``order``.

    The rank filter becomes a group limit before the shuffle, so each map task sends at most
    one row per key, however many copies a key has.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


#: Ranks from which a key's rows are cut in two levels, and parts of a key in the first of them.
DEEP = 1000
PARTS = 32


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], size: int, rank: str = "row_rank") -> DataFrame:
    """At most ``size`` rows per key, ranked from 1 in ``order``.

    Small bounds become a limit by group on the map side. Spark drops that for larger ones, so a key's rows are first
    dealt over salted parts and ranked there: what is beyond ``size`` in its part is beyond it in the key as well.
    Only the survivors, at most PARTS times ``size`` a key, meet for the second rank.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if size >= DEEP:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= size).drop("_part", "_salt")
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= size)


def ranked_in_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    instant: str,
    seconds: float | None = None,
    rank: str = "row_rank",
    rows: int = ROWS,
) -> DataFrame:
    """``row_number`` per key in ascending order, computed slice by slice.

    ``order`` must start with ``instant``. Slices are ``seconds`` wide, or of bounded depth (`sliced`). The slice
    counts are pre-aggregated on the map side and summed over the slices of a key; rows never meet outside their slice.
    """
    cut = df.withColumn("_slice", time_slice(instant, seconds)) if seconds else sliced(df, keys, order, instant, rows)
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        cut.withColumn("_local", F.row_number().over(within))
        .join(offsets, [*keys, "_slice"])
        .withColumn(rank, F.col("_offset") + F.col("_local"))
        .drop("_slice", "_local", "_offset")
    )
