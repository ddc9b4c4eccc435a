"""Magic bytes and keys inside binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.constants import FORMAT_SIGNATURES, MP4_BRAND, RESOURCE_MARKER, SQLITE_HEADER
from evidentia.functions.ids import _col

_KEY = "[0-9A-Fa-f]{32}"


def _has(content, expected: bytes, start: int = 1) -> Column:
    """Whether some bytes, counted from 1, are these."""
    return F.substring(_col(content), start, len(expected)) == F.lit(bytearray(expected))


def detect_format(content) -> Column:
    """Image format by signature, null when unknown."""
    found = F.lit(None).cast("string")
    for name, first, ninth in reversed(FORMAT_SIGNATURES):
        hit = _has(content, first)
        if ninth:
            hit = hit & _has(content, ninth, 9)
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def is_sqlite(content) -> Column:
    return _has(content, SQLITE_HEADER)


def is_mp4(content) -> Column:
    return (F.octet_length(_col(content)) >= 12) & _has(content, MP4_BRAND, 5)


def extract_resource_key(content) -> Column:
    """Key behind the first marker, else the first run of 32 hex digits."""
    text = F.decode(_col(content), "ISO-8859-1")
    at = F.instr(text, RESOURCE_MARKER.decode("latin-1"))
    marked = F.substring(text, at + len(RESOURCE_MARKER), F.lit(32))
    anywhere = F.regexp_extract(text, _KEY, 0)
    key = F.when((at > 0) & marked.rlike(f"^{_KEY}$"), marked).otherwise(anywhere)
    return F.when(key != "", F.lower(key))
