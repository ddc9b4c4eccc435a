"""Column expressions shared by the operators. All but two run inside codegen."""

from evidentia.functions.binary import detect_format, extract_resource_key, is_mp4, is_sqlite
from evidentia.functions.ids import digest_of, masked_id, md5_table_name, stable_id
from evidentia.functions.instants import epoch_auto, month_candidates, month_columns, parse_instant
from evidentia.functions.jsonx import (
    canonical_json,
    json_field,
    json_keys_without,
    json_type,
    strict_object,
    strict_variant,
)
from evidentia.functions.paths import (
    base_name,
    escapes_root,
    mime_type,
    normal_path,
    safe_file_name,
    unsafe_inventory_path,
)
from evidentia.functions.text import blank_to_null, compact, contains_literal, http_url, literal_words, normal_form

__all__ = [
    "base_name", "blank_to_null", "canonical_json", "compact", "contains_literal", "detect_format",
    "digest_of", "epoch_auto", "escapes_root", "extract_resource_key", "http_url", "is_mp4",
    "is_sqlite", "json_field", "json_keys_without", "json_type", "literal_words", "masked_id",
    "md5_table_name", "mime_type", "month_candidates", "month_columns", "normal_form", "normal_path", "parse_instant",
    "safe_file_name", "stable_id", "strict_object", "strict_variant", "unsafe_inventory_path",
]
