"""Message bodies: decoding and typed parts."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.constants import RESOURCE_TYPES, ZSTD_STORAGE
from evidentia.functions import blank_to_null, http_url, mime_type, safe_file_name
from evidentia.functions.ids import _col
from evidentia.functions.jsonx import canonical_json

PART_TYPE = "struct<type:string,text:string,url:string,path:string,file_name:string,mime_type:string,subtype:string,status:string>"


def part(
    kind: str,
    text: Column | None = None,
    url: Column | None = None,
    path: Column | None = None,
    file_name: Column | None = None,
    mime: Column | None = None,
    subtype: Column | None = None,
    status: Column | None = None,
) -> Column:
    """One typed part; absent fields are null so that all builders share a type."""
    absent = F.lit(None).cast("string")
    values = (F.lit(kind), text, url, path, file_name, mime, subtype, status)
    names = ("type", "text", "url", "path", "file_name", "mime_type", "subtype", "status")
    return F.struct(*[(absent if v is None else v.cast("string")).alias(n) for v, n in zip(values, names)])


# --- decoding -------------------------------------------------------------------------


def inflate(body: str | Column) -> Column:
    """zstd bytes to plain bytes, in Arrow batches; Spark has no built-in for a column.

    The function is nested so that it travels to the executors by value.
    """

    @F.pandas_udf("binary")
    def apply(bodies: pd.Series) -> pd.Series:
        def one(packed):
            if packed is None:
                return None
            with pa.CompressedInputStream(pa.BufferReader(packed), "zstd") as stream:
                return stream.read()

        return bodies.map(one)

    return apply(_col(body))


def decode_content(df: DataFrame, content: str = "message_content", storage: str = "content_type") -> DataFrame:
    """Adds ``text``: zstd bodies inflated, bytes read as UTF-8, trailing NULs cut.

    Only compressed rows go through the Arrow function; the plain ones take the other branch
    of the union and stay in the JVM.
    """
    packed = (F.coalesce(F.col(storage), F.lit(0)) == ZSTD_STORAGE) & (F.length(content) > 0)
    packed = F.coalesce(packed, F.lit(False))

    def as_text(body: Column) -> Column:
        return F.regexp_replace(F.coalesce(body.cast("string"), F.lit("")), "\\x00+$", "")

    plain = df.filter(~packed).withColumn("text", as_text(F.col(content)))
    inflated = df.filter(packed).withColumn("text", as_text(inflate(content)))
    return plain.unionByName(inflated)


def strip_group_prefix(text: str | Column, is_group: str | Column) -> Column:
    """``struct(prefix_sender, body)``: splits ``token:\\nrest`` of group messages."""
    c = _col(text)
    pattern = r"(?sU)^(\S+?):\n(.*)$"
    hit = _col(is_group) & c.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(c, pattern, 1)).alias("prefix_sender"),
        F.when(hit, F.regexp_extract(c, pattern, 2)).otherwise(c).alias("body"),
    )


# --- typed parts, numeric type codes -----------------------------------------------------

_MARKERS = ("<msg", "<appmsg", "<location")
_APP_SCHEMA = "struct<title:string,type:string,url:string>"
_LOCATION_SCHEMA = "struct<_poiname:string,_label:string>"
_CHECK_SCHEMA = "struct<_none:string,_bad:string>"


def _from(text: Column, markers: tuple[str, ...]) -> Column:
    """The text from the earliest marker on, null when none occurs."""
    spots = [F.nullif(F.instr(text, marker), F.lit(0)) for marker in markers]
    at = F.least(*spots) if len(spots) > 1 else spots[0]
    return F.when(at.isNotNull(), F.substring(text, at, F.length(text)))


def with_markup(df: DataFrame, text: str, only: Column | None = None) -> DataFrame:
    """Adds ``is_app, app_title, app_type, app_url, place`` of embedded markup; nulls when it
    is absent or malformed.

    Each step is a column of its own, so that every parse happens once per row; ``only``
    limits the rows that are looked at. The parser ignores what follows the root element, so
    the end of the root is checked separately.
    """
    tail = F.regexp_replace(_from(F.col(text), _MARKERS), r"\s+$", "")
    df = df.withColumn("_tail", tail if only is None else F.when(only, tail))
    df = df.withColumn("_check", F.from_xml("_tail", _CHECK_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    tag = F.regexp_extract("_tail", r"^<([\w.:-]+)", 1)
    closed = F.col("_tail").endswith(F.concat(F.lit("</"), tag, F.lit(">"))) | F.col("_tail").rlike(r"^<[^<>]*/>$")
    df = df.withColumn("_markup", F.when(closed & F.col("_check._bad").isNull(), F.col("_tail")))
    df = df.withColumn("_element", _from(F.col("_markup"), ("<appmsg",)))
    df = df.withColumn("_app", F.from_xml("_element", _APP_SCHEMA))
    df = df.withColumn("_location", F.from_xml(_from(F.col("_markup"), ("<location",)), _LOCATION_SCHEMA))
    return (
        df.withColumn("is_app", F.col("_element").isNotNull())
        .withColumn("app_title", blank_to_null("_app.title"))
        .withColumn("app_type", blank_to_null("_app.type"))
        .withColumn("app_url", blank_to_null("_app.url"))
        .withColumn(
            "place",
            F.coalesce(F.nullif("_location._poiname", F.lit("")), F.nullif("_location._label", F.lit(""))),
        )
        .drop("_tail", "_check", "_markup", "_element", "_app", "_location")
    )


def parts_from_type_code(
    df: DataFrame,
    type_code: str = "base_type",
    text: str = "text",
    local_id: str = "local_id",
    voice_path: str | None = None,
    platform: str = "Chat",
    markup: bool = True,
) -> DataFrame:
    """Adds ``parts`` for numeric message types; ``platform`` names the placeholders."""
    code, body = F.col(type_code), F.col(text)
    slug = platform.lower()

    def named(kind: str, extension: str) -> Column:
        return F.concat(F.lit(f"{slug}-{kind}-"), F.col(local_id).cast("string"), F.lit(f".{extension}"))

    octets, not_exported = F.lit("application/octet-stream"), F.lit("resource_not_exported")
    placeholder = F.concat(F.lit(f"[{platform} message type "), code.cast("string"), F.lit("]"))
    voice = F.col(voice_path) if voice_path else F.lit(None).cast("string")
    audio = part(
        "audio",
        path=voice,
        file_name=F.when(voice.isNotNull(), F.regexp_extract(voice, r"([^/]+)$", 1)).otherwise(named("voice", "silk")),
        mime=F.lit("audio/silk"),
        status=F.when(voice.isNull(), F.lit("voice_row_not_resolved")),
    )
    if markup:
        df = with_markup(df, text, code.isin(48, 49))
        is_app, place = F.col("is_app"), F.col("place")
        title = F.coalesce("app_title", F.lit(f"{platform} app message"))
        subtype, url = F.col("app_type"), F.col("app_url")
        app_part = (
            F.when(
                is_app & subtype.eqNullSafe(F.lit("6")),
                part("file", file_name=title, mime=octets, subtype=F.lit("appmsg_file"), status=not_exported),
            )
            .when(is_app & url.isNotNull(), part("link", text=title, url=url, subtype=subtype))
            .when(is_app, part("text", text=title, subtype=subtype))
            .otherwise(part("system", text=F.lit(f"[{platform} app message]")))
        )
        location_part = F.when(
            place.isNotNull(), part("text", text=place, subtype=F.lit("location"))
        ).otherwise(part("system", text=F.lit(f"[{platform} location]")))
    else:
        app_part = part("system", text=F.lit(f"[{platform} app message]"))
        location_part = part("system", text=F.lit(f"[{platform} location]"))
    built = (
        F.when(code == 1, part("text", text=body))
        .when(code == 3, part("image", file_name=named("image", "dat"), mime=octets, status=not_exported))
        .when(code == 34, audio)
        .when(code == 43, part("video", file_name=named("video", "dat"), mime=octets, status=not_exported))
        .when(
            code == 47,
            part("image", file_name=named("sticker", "dat"), mime=octets, subtype=F.lit("sticker"), status=not_exported),
        )
        .when(code == 48, location_part)
        .when(code == 49, app_part)
        .when(code.isin(50, 10000), part("system", text=F.when(body != "", body).otherwise(placeholder)))
        .otherwise(part("system", text=placeholder))
    )
    return df.withColumn("parts", F.array(built)).drop("is_app", "app_title", "app_type", "app_url", "place")


# --- typed parts, JSON content -------------------------------------------------------------


def _variant_text(variant: Column, path: str) -> Column:
    """Non-blank string at a path; numbers and objects do not count."""
    value = F.try_variant_get(variant, path, "variant")
    return blank_to_null(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, path, "string")))


def _extension(attachment: Column) -> Column:
    """``extension`` given as an object or as JSON text."""
    value = F.try_variant_get(attachment, "$.extension", "variant")
    as_text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(attachment, "$.extension", "string"))
    return F.coalesce(F.try_parse_json(as_text), F.when(as_text.isNull(), value))


def parts_from_json_content(
    df: DataFrame,
    content_type: str = "content_type",
    content: str = "content",
    local_id: str = "local_id",
    platform: str = "Chat",
) -> DataFrame:
    """Adds ``parts`` for JSON bodies: 1 text, 2 image, 500 file, else card or placeholder."""
    code = F.col(content_type)
    slug = platform.lower()
    body, first, ext = F.col("_body"), F.col("_first"), F.col("_ext")
    card_keys = ("title", "single_title", "desc", "markdown")
    is_card = ~code.isin(1, 2, 500)

    def card_texts(attachment: Column) -> Column:
        extension = _extension(attachment)
        return F.array(*[_variant_text(extension, f"$.{key}") for key in card_keys])

    cards = F.array_compact(F.flatten(F.transform("_attachments", card_texts)))
    file_name = F.coalesce(
        _variant_text(ext, "$.f_name"), F.concat(F.lit(f"{slug}-file-"), F.col(local_id).cast("string"))
    )
    # one column per step: each parse happens once, and only for the types that need it
    df = (
        df.withColumn("_body", F.try_parse_json(content))
        .withColumn("_attachments", F.when(~code.isin(1, 2), F.try_variant_get("_body", "$.attachments", "array<variant>")))
        .withColumn("_first", F.when(code == 500, F.try_element_at("_attachments", F.lit(1))))
        .withColumn("_ext", _extension(first))
        .withColumn("_file", F.when(code == 500, file_name))
        .withColumn("_card", F.when(is_card, F.try_element_at(cards, F.lit(1))))
    )
    file_name, card = F.col("_file"), F.col("_card")
    image_name = F.coalesce(
        _variant_text(body, "$.filename"),
        F.concat(F.lit(f"{slug}-image-"), F.col(local_id).cast("string"), F.lit(".dat")),
    )
    octets = F.lit("application/octet-stream")
    not_resolved = F.lit("local_resource_not_resolved")
    built = (
        F.when(
            code == 1,
            part("text", text=F.coalesce(_variant_text(body, "$.text"), F.lit(f"[Empty {platform} text]"))),
        )
        .when(
            code == 2,
            part("image", url=http_url(F.try_variant_get(body, "$.url", "string")), file_name=image_name, mime=octets, status=not_resolved),
        )
        .when(
            code == 500,
            part(
                "file",
                url=http_url(F.try_variant_get(first, "$.url", "string")),
                file_name=file_name,
                mime=F.coalesce(mime_type(file_name), octets),
                status=not_resolved,
            ),
        )
        .when(card.isNotNull(), part("text", text=card, subtype=F.lit("card")))
        .otherwise(
            part("system", text=F.concat(F.lit(f"[{platform} content type "), code.cast("string"), F.lit("]")))
        )
    )
    return df.withColumn("parts", F.array(built)).drop("_body", "_attachments", "_first", "_ext", "_file", "_card")


# --- typed parts, text and resources ---------------------------------------------------------


def missing_path(resource: Column, file_name: Column) -> Column:
    """Placeholder path of a body that was not exported."""
    mark = F.substring(F.sha2(canonical_json(resource), 256), 1, 20)
    return F.concat(F.lit("attachments/missing/"), mark, F.lit("-"), file_name)


def parts_from_resources(
    df: DataFrame,
    text: str = "text",
    is_system: str = "is_system",
    resources: str = "resources",
    placeholder: str = "[No textual or supported attachment content in export]",
) -> DataFrame:
    """Adds ``parts``: the text, then each supported resource; never empty.

    ``resources`` is an array of structs with ``type, filename, localPath, raw``.
    """
    kind = F.when(F.col(is_system), F.lit("system")).otherwise(F.lit("text"))
    text_part = part("text", text=F.col(text)).withField("type", kind)
    texts = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.array(text_part)).otherwise(
        F.array().cast(f"array<{PART_TYPE}>")
    )

    def resource_part(resource: Column) -> Column:
        local = F.trim(resource["localPath"])
        name = safe_file_name(resource["filename"], F.coalesce(local, F.lit("")))
        path = F.when(local != "", local).otherwise(missing_path(resource["raw"], name))
        return part("file", path=path, file_name=name, mime=mime_type(name)).withField("type", resource["type"])

    supported = F.filter(resources, lambda r: r["type"].isin(*RESOURCE_TYPES))
    bodies = F.coalesce(F.transform(supported, resource_part), F.array().cast(f"array<{PART_TYPE}>"))
    all_parts = F.concat(texts, bodies)
    empty = F.array(part("system", text=F.lit(placeholder), subtype=F.lit("derived_placeholder")))
    return df.withColumn("parts", F.when(F.size(all_parts) > 0, all_parts).otherwise(empty))
