"""Instants: zone-qualified text, epoch numbers and month folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.constants import MS_THRESHOLD
from evidentia.functions.ids import _col

_ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"


def parse_instant(text) -> Column:
    """Timestamp of zone-qualified ISO text; null when malformed or without a zone."""
    c = _col(text)
    return F.when(c.rlike(_ZONE_SUFFIX), F.try_to_timestamp(c))


def epoch_auto(number) -> Column:
    """Epoch seconds or milliseconds, told apart by size."""
    c = _col(number).cast("long")
    return F.when(c >= F.lit(MS_THRESHOLD), F.timestamp_millis(c)).otherwise(F.timestamp_seconds(c))


def month_columns(epoch_seconds, offsets=(-1, 0, 1), time_zone: str = "UTC") -> list[Column]:
    """``yyyy-MM`` folders around an epoch, one column per offset.

    Months are counted as numbers; formatting dates per row would dominate the join around it.
    """
    instant = F.timestamp_seconds(_col(epoch_seconds).cast("long"))
    local = instant if time_zone == "UTC" else F.from_utc_timestamp(instant, time_zone)
    index = F.year(local) * 12 + F.month(local) - 1

    def folder(number: Column) -> Column:
        year, month = F.floor(number / 12).cast("string"), (F.pmod(number, F.lit(12)) + 1).cast("string")
        return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"))

    return [folder(index + delta) for delta in offsets]


def month_candidates(epoch_seconds, offsets=(-1, 0, 1), time_zone: str = "UTC") -> Column:
    """The same folders as one array."""
    return F.array(*month_columns(epoch_seconds, offsets, time_zone))
