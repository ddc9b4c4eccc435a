"""File names and paths."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.constants import MIME_BESIDES
from evidentia.functions.ids import _col


def base_name(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+)/*$", 1)


def escapes_root(path) -> Column:
    """True for absolute paths and for relative ones that climb above their root."""
    c = _col(path)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def step(state, piece):
        move = F.when(piece.isin("", "."), 0).when(piece == "..", -1).otherwise(1)
        depth = state["depth"] + move
        return F.struct(depth.alias("depth"), (state["out"] | (depth < 0)).alias("out"))

    return c.startswith("/") | F.aggregate(F.split(c, "/"), start, step, lambda s: s["out"])


def unsafe_inventory_path(path) -> Column:
    """Stricter form for inventories: no backslash, no root, no ``..`` at all."""
    c = _col(path)
    pieces = F.filter(F.split(c, "/"), lambda piece: ~piece.isin("", "."))
    return (
        c.contains("\\") | c.startswith("/") | (F.size(pieces) == 0) | F.array_contains(pieces, "..")
    )


def safe_file_name(name, fallback="") -> Column:
    """Base name with unusual characters replaced; never empty."""
    given = F.trim(_col(name))
    fall = _col(fallback) if isinstance(fallback, Column) else F.lit(fallback)
    chosen = base_name(F.when(given != "", given).otherwise(fall))
    replaced = F.regexp_replace(chosen, r"(?U)[^\w.()\[\] -]+", "_")
    stripped = F.regexp_replace(replaced, r"^[ .]+|[ .]+$", "")
    return F.when(stripped != "", stripped).otherwise(F.lit("attachment"))


def mime_type(name) -> Column:
    """Media type by extension, null when unknown: the standard library's own table, whatever the machine's files say.

    Endings of compression are not looked at (``a.tar.gz`` is a tar, ``a.gz`` unknown), and short ones stand for two.
    """
    standard = mimetypes.MimeTypes(filenames=())
    types = {ending[1:]: kind for ending, kind in standard.types_map[True].items()}
    table = F.create_map(*[F.lit(x) for pair in sorted((types | MIME_BESIDES).items()) for x in pair])
    plain = _col(name)
    for ending, written_out in standard.suffix_map.items():
        plain = F.regexp_replace(plain, rf"(?i)(?<=[^/.])\{ending}$", written_out)
    packed = "|".join(x[1:] for x in standard.encodings_map)
    plain = F.regexp_replace(plain, rf"(?<=[^/.])\.({packed})$", "")
    extension = F.lower(F.regexp_extract(plain, r"[^/.]\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(table, extension)


def normal_path(path) -> Column:
    """Relative path with ``.`` and ``..`` folded away."""

    def step(state, piece):
        return (
            F.when(piece.isin("", "."), state)
            .when(piece == "..", F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))))
            .otherwise(F.concat(state, F.array(piece)))
        )

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(_col(path), "/"), empty, step), "/")
