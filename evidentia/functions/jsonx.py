"""JSON text through the variant type: canonical form, fields, residue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.ids import _col


def strict_variant(text) -> Column:
    """Variant of a whole JSON text; null when anything follows the first value.

    The parser stops at the end of the first value. Inside an array only ``]`` could end it
    early and inside an object only ``}``, so trailing data fails in at least one wrapping.
    """
    c = _col(text)
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(in_array.isNotNull() & in_object.isNotNull(), F.try_parse_json(c))


def strict_object(text) -> Column:
    """True when a text is exactly one JSON object; skips over its values."""
    c = _col(text)
    in_array = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<struct<_:string>>")
    in_object = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "struct<v:struct<_:string>>")["v"]
    return F.coalesce((F.size(in_array) == 1) & in_object.isNotNull(), F.lit(False))


def canonical_json(text) -> Column:
    """Compact JSON with sorted keys; null when the text is not JSON."""
    return F.to_json(strict_variant(text))


def json_type(variant) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, ARRAY, OBJECT, ...; null for a missing field."""
    return F.regexp_extract(F.schema_of_variant(_col(variant)), r"^([A-Z]+)", 1)


def json_field(text, path: str, kind: str = "string") -> Column:
    """One field of a JSON document, null on any mismatch."""
    return F.try_variant_get(strict_variant(text), path, kind)


def json_keys_without(text, drop) -> Column:
    """What a JSON object holds beyond the ``drop`` keys; null when nothing is left."""
    entries = F.from_json(_col(text), "map<string,variant>")
    kept = F.map_filter(entries, lambda key, _: ~key.isin(*drop))
    return F.when(F.size(kept) > 0, F.to_json(F.try_parse_json(F.to_json(kept))))
