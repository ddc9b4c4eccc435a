"""Content decoding, typed parts and attachment matching queries."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia import functions as X
from evidentia.operators import attachments as A
from evidentia.operators import content as C
from evidentia.operators.query import PART_KEYS
from evidentia.plans.registry import query
from evidentia.plans.views import Views, text


def _deflated(column: str):
    """zstd bytes of a text column, to have compressed bodies derived from the tables."""

    @F.pandas_udf("binary")
    def apply(values: pd.Series) -> pd.Series:
        def one(value):
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") as out:
                out.write(value.encode())
            return sink.getvalue().to_pybytes()

        return values.map(one)

    return apply(F.col(column))


@query("content_decode", "C1", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def _(v: Views):
    docs = v.table("documents").select("doc_id", "text")
    odd = F.col("doc_id") % 2 == 1
    packed = docs.filter(odd).select("doc_id", _deflated("text").alias("message_content"), F.lit(4).alias("content_type"))
    plain = docs.filter(~odd).select(
        "doc_id", F.encode(F.concat("text", F.lit("\0\0")), "UTF-8").alias("message_content"), F.lit(0).alias("content_type")
    )
    return C.decode_content(packed.unionByName(plain)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def _marked(v: Views):
    """Part rows as app messages: some direct, some nested, some malformed, some without url."""
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, text("<url>http://x.example/", k, "</url>")).otherwise("")
    app = F.concat(F.lit("<appmsg><title>"), F.col("p_name"), F.lit("</title><type>"), (k % 8).cast("string"), F.lit("</type>"), url, F.lit("</appmsg>"))
    markup = F.when(k % 7 == 0, F.concat(F.lit("junk "), app, F.lit("<"))).when(k % 2 == 0, F.concat(F.lit("<msg>"), app, F.lit("</msg>"))).otherwise(app)
    place = text('<msg><location poiname="', F.when(k % 3 == 0, "").otherwise(text("Poi ", k)), '" label="Label ', k, '"/></msg>')
    code = F.when(k % 4 == 0, 49).when(k % 4 == 1, 48).otherwise(k % 60)
    body = F.when(k % 4 == 0, markup).when(k % 4 == 1, place).otherwise(text("body ", k))
    return v.table("part").select(k.alias("local_id"), code.cast("long").alias("base_type"), body.alias("text"), "p_name")


_MARKED = """
mk AS (SELECT p_partkey AS k, p_name, CASE p_partkey % 4 WHEN 0 THEN 49 WHEN 1 THEN 48 ELSE p_partkey % 60 END AS code FROM part)"""


@query("app_markup", "C3", """
SELECT p_partkey AS local_id, app AS is_app, CASE WHEN app THEN p_name END AS title, CASE WHEN app THEN (p_partkey % 8)::VARCHAR END AS app_type,
  CASE WHEN app AND p_partkey % 3 = 0 THEN 'http://x.example/' || p_partkey END AS url,
  CASE WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Label ' ELSE 'Poi ' END || p_partkey END AS place
FROM (SELECT *, p_partkey % 4 = 0 AND p_partkey % 7 <> 0 AS app FROM part)""")
def _(v: Views):
    found = C.with_markup(_marked(v), "text")
    return found.select(
        "local_id", "is_app", F.col("app_title").alias("title"), "app_type", F.col("app_url").alias("url"), "place"
    )


@query("typed_parts_codes", "C2 C3", f""", {_MARKED}
SELECT k AS local_id, CASE WHEN code = 1 THEN 'text' WHEN code IN (3, 47) THEN 'image' WHEN code = 34 THEN 'audio' WHEN code = 43 THEN 'video'
    WHEN code = 48 AND k % 4 = 1 THEN 'text' WHEN code = 49 AND k % 4 = 0 AND k % 7 <> 0 THEN CASE WHEN k % 8 = 6 THEN 'file' WHEN k % 3 = 0 THEN 'link' ELSE 'text' END ELSE 'system' END AS part_type,
  CASE WHEN code = 1 THEN 'body ' || k WHEN code = 48 AND k % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN 'Label ' || k ELSE 'Poi ' || k END WHEN code = 48 THEN '[Chat location]'
    WHEN code = 49 AND k % 4 = 0 AND k % 7 <> 0 THEN CASE WHEN k % 8 <> 6 THEN p_name END WHEN code = 49 THEN '[Chat app message]'
    WHEN code IN (3, 47, 34, 43) THEN NULL WHEN code = 50 THEN 'body ' || k ELSE '[Chat message type ' || code || ']' END AS body,
  CASE WHEN code = 3 THEN 'chat-image-' || k || '.dat' WHEN code = 47 THEN 'chat-sticker-' || k || '.dat' WHEN code = 34 THEN 'chat-voice-' || k || '.silk'
    WHEN code = 43 THEN 'chat-video-' || k || '.dat' WHEN code = 49 AND k % 4 = 0 AND k % 7 <> 0 AND k % 8 = 6 THEN p_name END AS file_name
FROM mk""")
def _(v: Views):
    built = C.parts_from_type_code(_marked(v))
    part = F.element_at("parts", 1)
    return built.select("local_id", part["type"].alias("part_type"), part["text"].alias("body"), part["file_name"].alias("file_name"))


@query("type_histogram", "C2 H19", """
SELECT code AS base_type, count(*) AS rows FROM (SELECT local_type & 4294967295 AS code FROM sh) GROUP BY 1""")
def _(v: Views):
    rows = v.shards.withColumn("base_type", F.col("local_type").bitwiseAND(F.lit(0xFFFFFFFF))).withColumn("text", F.lit("x"))
    return C.parts_from_type_code(rows, markup=False).groupBy("base_type").agg(F.count("*").alias("rows"))


def json_bodies(v: Views):
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, 1).when(k % 5 == 1, 2).when(k % 5 == 2, 500).when(k % 5 == 3, 1200).otherwise(77)
    extension = text('{"f_name":"doc ', k, '.pdf","title":"Card ', k, '"}')
    as_text = F.regexp_replace(extension, '"', '\\\\"')
    quoted = F.when(k % 2 == 0, extension).otherwise(F.concat(F.lit('"'), as_text, F.lit('"')))
    body = (
        F.when(kind == 1, F.when(k % 3 == 0, F.lit('{"text":"  "}')).otherwise(text('{"text":" hello ', k, ' "}')))
        .when(kind == 2, text('{"filename":"pic', k, '.jpg","url":"', F.when(k % 2 == 0, "https").otherwise("file"), '://h/', k, '"}'))
        .when(kind.isin(500, 1200), F.concat(F.lit('{"attachments":[{"url":"http://f/1","extension":'), quoted, F.lit("}]}")))
        .otherwise(F.lit("not json"))
    )
    return v.table("orders").select(k.alias("local_id"), kind.alias("content_type"), body.alias("content"))


@query("typed_parts_json", "C4 F10 F12", """
SELECT o_orderkey AS local_id, CASE o_orderkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'file' WHEN 3 THEN 'text' ELSE 'system' END AS part_type,
  CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '[Empty Chat text]' ELSE 'hello ' || o_orderkey END WHEN 3 THEN 'Card ' || o_orderkey WHEN 4 THEN '[Chat content type 77]' END AS body,
  CASE o_orderkey % 5 WHEN 1 THEN 'pic' || o_orderkey || '.jpg' WHEN 2 THEN 'doc ' || o_orderkey || '.pdf' END AS file_name,
  CASE o_orderkey % 5 WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'https://h/' || o_orderkey END WHEN 2 THEN 'http://f/1' END AS url,
  CASE o_orderkey % 5 WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'application/pdf' END AS mime FROM orders""")
def _(v: Views):
    part = F.element_at("parts", 1)
    return C.parts_from_json_content(json_bodies(v)).select(
        "local_id", part["type"].alias("part_type"), part["text"].alias("body"), part["file_name"].alias("file_name"),
        part["url"].alias("url"), part["mime_type"].alias("mime"),
    )


def _resources(v: Views):
    k = F.col("p_partkey")
    def resource(kind, local):
        name = text("pic ", k, "?.jpg")
        raw = F.to_json(F.struct(kind.alias("type"), name.alias("filename"), local.alias("localPath")))
        return F.struct(kind.alias("type"), name.alias("filename"), local.alias("localPath"), raw.alias("raw"))

    given = resource(F.when(k % 3 == 0, "image").when(k % 3 == 1, "file").otherwise("sticker"), F.when(k % 4 == 0, text("res/", k, ".jpg")))
    return v.table("part").select(
        k.alias("k"), F.when(k % 5 != 4, F.col("p_name")).alias("text"), (k % 6 == 0).alias("is_system"), F.array(given).alias("resources")
    )


@query("typed_parts_resources", "C5 C13 F11", """
SELECT k, i AS part_index, kind, body, path, file_name FROM (
  SELECT p_partkey AS k, 0::BIGINT AS i, CASE WHEN p_partkey % 6 = 0 THEN 'system' ELSE 'text' END AS kind, p_name AS body, NULL AS path, NULL AS file_name FROM part WHERE p_partkey % 5 <> 4
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 3 = 0 THEN 'image' ELSE 'file' END, NULL,
    CASE WHEN p_partkey % 4 = 0 THEN 'res/' || p_partkey || '.jpg' ELSE 'attachments/missing/' || substr(sha256('{"filename":"pic ' || p_partkey || '?.jpg","type":"'
      || CASE WHEN p_partkey % 3 = 0 THEN 'image' ELSE 'file' END || '"}'), 1, 20) || '-pic ' || p_partkey || '_.jpg' END, 'pic ' || p_partkey || '_.jpg'
    FROM part WHERE p_partkey % 3 <> 2
  UNION ALL SELECT p_partkey, 0, 'system', '[No textual or supported attachment content in export]', NULL, NULL FROM part WHERE p_partkey % 5 = 4 AND p_partkey % 3 = 2)""")
def _(v: Views):
    rows = C.parts_from_resources(_resources(v)).select("k", F.posexplode("parts").alias("i", "p"))
    return rows.select("k", F.col("i").cast("long").alias("part_index"), F.col("p.type").alias("kind"), F.col("p.text").alias("body"), "p.path", "p.file_name")


@query("search_bodies", "C6", "SELECT message_id, search_body FROM body")
def _(v: Views):
    return v.messages.select("message_id", "search_body")


@query("attachment_presence", "C7", "SELECT attachment_id, message_id, part_index, source_relative_path, status, size_bytes, blob_sha256 FROM a")
def _(v: Views):
    return v.attachments.select("attachment_id", "message_id", "part_index", "source_relative_path", "status", "size_bytes", "blob_sha256")


@query("resource_lookup", "C8 exact then newest", """,
res AS (SELECT o_custkey % 500 AS chat, o_orderkey % 7 AS local, epoch(o_orderdate)::BIGINT AS t, o_orderkey AS id FROM orders),
ex AS (SELECT chat, local, t, max(id) AS id FROM res GROUP BY ALL),
nw AS (SELECT chat, local, arg_max(id, (t, id)) AS id FROM res GROUP BY ALL)
SELECT coalesce(ex.id, nw.id) AS resource_id, CASE WHEN ex.id IS NOT NULL THEN 'exact' WHEN nw.id IS NOT NULL THEN 'newest' ELSE 'none' END AS resource_match, count(*) AS rows
FROM (SELECT l_partkey % 600 AS chat, l_linenumber AS local, epoch(l_shipdate)::BIGINT AS t FROM lineitem) x
LEFT JOIN ex USING (chat, local, t) LEFT JOIN nw USING (chat, local) GROUP BY 1, 2""".replace("arg_max(id, (t, id))", "arg_max(id, t::HUGEINT * 10000000000 + id)"))
def _(v: Views):
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    resources = v.table("orders").select(
        (F.col("o_custkey") % 500).alias("chat"), (F.col("o_orderkey") % 7).alias("local"), second("o_orderdate").alias("t"), F.col("o_orderkey").alias("row"),
        F.col("o_orderkey").alias("resource_id"),
    )
    messages = v.table("lineitem").select((F.col("l_partkey") % 600).alias("chat"), F.col("l_linenumber").cast("long").alias("local"), second("l_shipdate").alias("t"))
    found = A.lookup_resources(messages, resources, ["chat", "local"], "t", "row", ["resource_id"])
    return found.groupBy("resource_id", "resource_match").agg(F.count("*").alias("rows"))


_MONTHS = """
lm AS (SELECT l_partkey AS k, epoch(l_shipdate)::BIGINT AS t, l_shipdate AS ts FROM lineitem),
fm AS (SELECT p_partkey AS k, i, strftime(TIMESTAMP '1998-01-01' + INTERVAL ((p_partkey % 40 + i * 5)::BIGINT) MONTH, '%Y-%m') AS month,
    CASE (p_partkey + i) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'high' ELSE 'thumbnail' END AS variant, (p_partkey + i) % 3 AS vr,
    'img/' || p_partkey || '/' || i AS path, (100 + p_partkey)::BIGINT AS size
  FROM part, (SELECT unnest(range(3)) AS i) WHERE p_partkey % 3 <> 0)"""


def _monthly(v: Views):
    """Three bodies per part in different months."""
    k, i = F.col("p_partkey"), F.col("i")
    rows = v.table("part").filter(k % 3 != 0).select(k, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    month = F.date_format(F.add_months(F.to_date(F.lit("1998-01-01")), (k % 40 + i * 5).cast("int")), "yyyy-MM")
    variant = F.when((k + i) % 3 == 0, "full").when((k + i) % 3 == 1, "high").otherwise("thumbnail")
    return rows.select(k.alias("k"), "i", month.alias("month"), variant.alias("variant"), text("img/", k, "/", i).alias("path"), (100 + k).alias("size_bytes"))


def _shipped(v: Views):
    return v.table("lineitem").select(F.col("l_partkey").alias("k"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("create_time"))


def _ranked_months(offsets: str) -> str:
    return f"""
pk AS (SELECT d.k, d.t, fm.path, fm.variant, fm.size, row_number() OVER (PARTITION BY d.k, d.t ORDER BY CASE
    WHEN fm.month = strftime(date_trunc('month', d.ts) + INTERVAL ({offsets.split(',')[0]}) MONTH, '%Y-%m') THEN 0
    WHEN fm.month = strftime(date_trunc('month', d.ts) + INTERVAL ({offsets.split(',')[1]}) MONTH, '%Y-%m') THEN 1
    WHEN fm.month = strftime(date_trunc('month', d.ts) + INTERVAL ({offsets.split(',')[2]}) MONTH, '%Y-%m') THEN 2 ELSE 3 END, fm.month, fm.vr, fm.path) AS r
  FROM (SELECT DISTINCT k, t, ts FROM lm) d JOIN fm ON fm.k = d.k)"""


@query("image_variant_pick", "C9 F14 L5", f""", {_MONTHS}, {_ranked_months('-1,0,1')}
SELECT lm.k, variant, path AS body_path, count(*) AS rows FROM lm LEFT JOIN (SELECT * FROM pk WHERE r = 1) USING (k, t) GROUP BY 1, 2, 3""")
def _(v: Views):
    messages = _shipped(v).select("k", "create_time", text("user-", F.col("k")).alias("chat"), F.md5(F.col("k").cast("string")).alias("resource_key"))
    files = _monthly(v).select(
        F.md5(text("user-", F.col("k"))).alias("chat_md5"), F.md5(F.col("k").cast("string")).alias("resource_key"), "month", "variant", "path"
    )
    return A.pick_variant(messages, files).groupBy("k", "variant", "body_path").agg(F.count("*").alias("rows"))


@query("video_acceptance", "C10 C15", f""", {_MONTHS},
f1 AS (SELECT * FROM fm WHERE i < 1 OR k % 4 = 1),
hit AS (SELECT d.k, d.t, f1.path, f1.size, row_number() OVER (PARTITION BY d.k, d.t ORDER BY CASE
    WHEN f1.month = strftime(d.ts, '%Y-%m') THEN 0 WHEN f1.month = strftime(date_trunc('month', d.ts) - INTERVAL 1 MONTH, '%Y-%m') THEN 1 ELSE 2 END) AS r
  FROM (SELECT DISTINCT k, t, ts FROM lm) d JOIN f1 ON f1.k = d.k AND f1.month IN (strftime(d.ts, '%Y-%m'),
    strftime(date_trunc('month', d.ts) - INTERVAL 1 MONTH, '%Y-%m'), strftime(date_trunc('month', d.ts) + INTERVAL 1 MONTH, '%Y-%m'))),
alone AS (SELECT k, min(path) AS path FROM f1 GROUP BY k HAVING count(*) = 1)
SELECT lm.k, CASE WHEN coalesce(h.path, alone.path) IS NULL THEN 'resource_body_not_local' WHEN lm.k % 5 <> 0 AND lm.k % 7 <> 0 THEN 'copied' ELSE 'resource_validation_failed' END AS attachment_status,
  CASE WHEN lm.k % 5 <> 0 AND lm.k % 7 <> 0 THEN coalesce(h.path, alone.path) END AS body_path, count(*) AS rows
FROM lm LEFT JOIN (SELECT * FROM hit WHERE r = 1) h USING (k, t) LEFT JOIN alone ON alone.k = lm.k GROUP BY 1, 2, 3""")
def _(v: Views):
    k = F.col("k")
    messages = _shipped(v).select("k", "create_time", k.cast("string").alias("resource_key"), F.when(k % 5 == 0, 0).otherwise(100 + k).alias("declared_size"))
    good = F.unhex(F.lit("00000018667479706D703432"))
    files = _monthly(v).filter((F.col("i") < 1) | (k % 4 == 1)).select(
        k.cast("string").alias("resource_key"), "month", "path", "size_bytes", F.when(k % 7 == 0, F.unhex(F.lit("000000"))).otherwise(good).alias("header")
    )
    return A.accept_videos(messages, files).groupBy("k", "attachment_status", "body_path").agg(F.count("*").alias("rows"))


@query("file_name_match", "C11 F15", f""", {_MONTHS}, {_ranked_months('-1,0,1').replace('fm.vr, ', '')}
SELECT lm.k, path AS body_path, count(*) AS rows FROM lm LEFT JOIN (SELECT * FROM pk WHERE r = 1) USING (k, t) GROUP BY 1, 2""")
def _(v: Views):
    k = F.col("k")
    # the title is composed, the stored name decomposed; both mean the same file
    messages = _shipped(v).select("k", "create_time", text("C:\\docs\\", "é", k, ".pdf").alias("file_name"))
    files = _monthly(v).select(text("e\u0301", k, ".pdf").alias("name"), "month", "path", "size_bytes")
    return A.match_files_by_name(messages, files).groupBy("k", "body_path").agg(F.count("*").alias("rows"))


@query("recorded_path_match", "C12", """
SELECT o_orderkey AS part_id, CASE WHEN o_orderkey % 4 = 0 THEN 'original' WHEN o_orderkey % 4 = 1 THEN 'thumbnail' END AS media_variant,
  CASE WHEN o_orderkey % 4 = 0 THEN '/media/a/o' || o_orderkey || '.jpg' WHEN o_orderkey % 4 = 1 THEN '/media/b/t' || o_orderkey || '.jpg' END AS body_path,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'copied_from_allowlisted_local_path' ELSE 'local_resource_not_resolved' END AS attachment_status FROM orders""")
def _(v: Views):
    k = F.col("o_orderkey")
    orders = v.table("orders")
    # 0: absolute original; 1: relative thumbnail below the second root; 2: outside the roots; 3: wrong size
    first = F.when(k % 4 == 0, text("/media/a/o", k, ".jpg")).when(k % 4 == 2, text("/secret/o", k, ".jpg")).when(k % 4 == 3, text("/media/a/o", k, ".jpg")).otherwise(" ")
    parts = orders.select(
        k.alias("part_id"), F.lit("image").alias("category"), F.when(k % 4 == 3, 5).alias("expected_size"),
        F.array(
            F.struct(F.lit("original").alias("variant"), first.alias("path")),
            F.struct(F.lit("thumbnail").alias("variant"), F.when(k % 4 == 1, text("x/../t", k, ".jpg")).alias("path")),
        ).alias("candidates"),
    )
    files = orders.select(
        F.when(k % 4 == 1, text("/media/b/t", k, ".jpg")).when(k % 4 == 2, text("/secret/o", k, ".jpg")).otherwise(text("/media/a/o", k, ".jpg")).alias("path"),
        F.lit(9).alias("size_bytes"), F.lit("jpg").alias("format"),
    )
    return A.match_recorded_paths(parts, files, ["/media/a", "/media/b/"]).select("part_id", "media_variant", "body_path", "attachment_status")


@query("missing_placeholders", "C13", """
SELECT c_custkey, 'attachments/missing/' || substr(sha256('{"filename":"' || c_name || '","type":"file"}'), 1, 20) || '-' || c_name AS path FROM customer""")
def _(v: Views):
    raw = F.concat(F.lit('{"type": "file", "filename": "'), F.col("c_name"), F.lit('"}'))
    return v.table("customer").select("c_custkey", C.missing_path(raw, F.col("c_name")).alias("path"))


@query("resource_keys", "C14", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL WHEN 1 THEN md5('first' || url) ELSE md5(url) END AS resource_key FROM pages")
def _(v: Views):
    n, key = F.col("page_id"), F.encode(F.upper(F.md5("url")), "ISO-8859-1")
    marker, other = F.unhex(F.lit("12220A20")), F.encode(F.md5(F.concat(F.lit("first"), "url")), "ISO-8859-1")
    noise = F.unhex(F.lit("00FF8040"))
    packed = (
        F.when(n % 4 == 0, F.concat(noise, other, marker, key, noise)).when(n % 4 == 1, F.concat(noise, other, marker, noise, key))
        .when(n % 4 == 2, F.concat(noise, key, noise)).otherwise(noise)
    )
    return v.table("pages").select("page_id", X.extract_resource_key(packed).alias("resource_key"))


@query("format_detection", "C15", """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'tif' WHEN 5 THEN 'bmp' WHEN 6 THEN 'wxgf' END AS format FROM pages""")
def _(v: Views):
    heads = ["FFD8FF", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "49492A00", "424D", "77786766", "00"]
    n = F.col("page_id")
    head = F.lit(None).cast("binary")
    for position, value in enumerate(heads):
        head = F.when(n % 8 == position, F.unhex(F.lit(value))).otherwise(head)
    return v.table("pages").select("page_id", X.detect_format(F.concat(head, F.encode("html", "UTF-8"))).alias("format"))


@query("attachment_audit", "C16", """
SELECT attachment_id, CASE WHEN status <> 'present' THEN 'source_missing' WHEN n % 9 = 0 THEN 'body_unavailable' WHEN a.size_bytes > 6000 THEN 'above_size_limit'
  WHEN n % 7 = 0 THEN 'digest_changed' ELSE 'verified' END AS verdict
FROM a LEFT JOIN (SELECT sha256, stored_path, regexp_extract(stored_path, 'p(\\d+)', 1)::BIGINT AS n FROM b) b ON b.sha256 = a.blob_sha256""")
def _(v: Views):
    blobs = v.tables["blobs"].select(F.col("sha256").alias("blob_sha256"), "stored_path")
    n = F.regexp_extract("path", r"p(\d+)", 1).cast("long")
    files = v.files.filter(n % 9 != 0).withColumn("sha256", F.when(n % 7 == 0, F.lit("changed")).otherwise(F.col("sha256")))
    return A.audit_attachments(v.attachments.join(blobs, "blob_sha256", "left"), files, 6000).select("attachment_id", "verdict")


@query("metadata_residue", "C17 F2", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"extra":{"k":' || json_extract_string(props, '$.k') || '},"user":' || user_id || '}' END AS source_metadata FROM events""")
def _(v: Views):
    full = text('{"type":"text","text":"', F.col("event_type"), '","user":', F.col("user_id"), ',"extra":', F.col("props"), "}")
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('{"type":"text","text":"x"}')).otherwise(full)
    return v.table("events").select("event_id", X.json_keys_without(raw, PART_KEYS).alias("source_metadata"))


@query("path_fallback", "C18", """
SELECT page_id AS document_id, 'f' || page_id || '.bin' AS recorded_path, CASE page_id % 3 WHEN 0 THEN 'f' || page_id || '.bin' WHEN 1 THEN 'resources/f' || page_id || '.bin' END AS resolved_path FROM pages""")
def _(v: Views):
    n = F.col("page_id")
    parts = v.table("pages").select(n.alias("document_id"), text("f", n, ".bin").alias("path"))
    files = v.table("pages").filter(n % 3 != 2).select(
        n.alias("document_id"), F.when(n % 3 == 0, text("f", n, ".bin")).otherwise(text("resources/f", n, ".bin")).alias("path")
    )
    return A.resolve_with_fallback(parts.unionByName(parts), files)
