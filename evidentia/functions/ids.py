"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.constants import ID_HEX


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _nul_joined(parts) -> Column:
    pieces = []
    for position, part in enumerate(parts):
        if position:
            pieces.append(F.lit("\0"))
        pieces.append(_col(part).cast("string"))
    # concat, unlike concat_ws, is null as soon as one part is null
    return F.concat(*pieces)


def digest_of(*parts) -> Column:
    """sha256 hex of the NUL-joined parts."""
    return F.sha2(_nul_joined(parts), 256)


def stable_id(prefix: str, *parts, length: int = ID_HEX) -> Column:
    """``prefix_`` + the head of the digest; null when any part is null."""
    return F.concat(F.lit(prefix + "_"), F.substring(digest_of(*parts), 1, length))


def masked_id(part, length: int = 12, prefix: str = "") -> Column:
    """Short one-way label for reports that must not show identifiers."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(_col(part).cast("string"), 256), 1, length))


def md5_table_name(chat) -> Column:
    return F.concat(F.lit("Msg_"), F.md5(_col(chat)))
