"""Scalar rules as column expressions, and as SQL functions that inline in a plan."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The kinds of inputs and the sizes and types that uploads may have.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
ALLOWED_TYPES = ("image/jpeg", "image/png", "image/webp", "application/pdf", "text/plain")
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
REDACTED_HEADERS = ("authorization", "x-api-key", "cookie", "set-cookie")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part, '' without one; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def classify_input(path: Column) -> Column:
    e = extension(path)
    return F.when(e == "pdf", "pdf").when(e.isin(*IMAGE_EXTENSIONS), "image")


def output_stem(path: Column) -> Column:
    name = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), r"^\.+|\.+$", "")
    return F.when(clean == "", "input").otherwise(clean)


def path_tag(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(8))


def sanitize_key(name: Column) -> Column:
    """The first 128 bytes, other characters and each byte of a cut one as '_', without '._-' at the ends."""
    cut = F.make_valid_utf8(F.substring(name.cast("binary"), 1, 128).cast("string"))
    return F.regexp_replace(F.regexp_replace(cut, r"[^A-Za-z0-9._-]", "_"), r"^[._-]+|[._-]+$", "")


def sanitize_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(F.replace(name, F.lit(".."), F.lit("")), r"[^a-zA-Z0-9.-]", "_"), F.lit(100))


def object_key(folder: Column, ts: Column, record_id: Column, name: Column) -> Column:
    record, file = sanitize_key(record_id), sanitize_key(name)
    record = F.when(record == "", F.date_format(ts, "HHmmss")).otherwise(record)
    return F.concat(folder, F.lit("/"), F.date_format(ts, "yyyy-MM"), F.lit("/"), record, F.lit("-"), F.when(file == "", "unnamed_file").otherwise(file))


def page_filename(page: Column) -> Column:
    return F.format_string("page-%04d.txt", page)


def request_id(record: Column, slot: Column) -> Column:
    return F.concat_ws(":", record, slot)


def header_safe(value: Column) -> Column:
    return F.translate(F.regexp_replace(value, "[\r\n]", ""), '"', "'")


def upload_route(category: Column) -> Column:
    return F.when(category.isin("contribution", "contribute"), "contribution").otherwise("feedback")


def transcription_name(name: Column, text_only: Column | bool = False) -> Column:
    base = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.concat(base, F.when(F.lit(text_only) if isinstance(text_only, bool) else text_only, ".txt").otherwise("-transcription.txt"))


def retry_delay(attempt: Column, surface: str = "web") -> Column:
    """Milliseconds before the next try: web grows by 1.5 s, android doubles from 30 s."""
    return attempt * 1500 if surface == "web" else (F.lit(30_000) * F.pow(F.lit(2), attempt - 1)).cast("long")


def sync_badge(surface: str, consent: Column, synced: Column, error: Column, attempts: Column) -> Column:
    if surface == "web":
        return F.when(~consent, None).when(synced, "synced").when(error.isNotNull(), "failed").otherwise("pending")
    return F.when(synced, "synced").when(attempts >= 5, "failed").otherwise("pending")


def summarise_detail(raw: Column) -> Column:
    """struct(summary, full): the first sentence, at most 140 characters; full is null if that is all."""
    text = F.trim(F.regexp_replace(raw, r"\s+", " "))
    sentence = F.regexp_extract(text, r"^(.*?[.!?])(?: |$)", 1)
    sentence = F.when(sentence == "", text).otherwise(sentence)
    summary = F.when(F.length(sentence) > 140, F.concat(F.rtrim(F.left(sentence, F.lit(139))), F.lit("…"))).otherwise(sentence)
    return F.struct(summary.alias("summary"), F.when(summary != text, text).alias("full"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.least(F.floor(done * 100 / total + 0.5), F.lit(100)), F.lit(0))).otherwise(0).cast("int")


def format_megabytes(size: Column) -> Column:
    return F.format_string("%d.%d", F.floor((size + 50_000) / 1_000_000), F.floor((size + 50_000) % 1_000_000 / 100_000))


def xml_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def translate_fallback(value: Column, english: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.nullif(english, F.lit("")), F.lit(""))


def specifier_regex(template: Column) -> Column:
    """Anchored pattern of an interpolated literal: a format specifier for each {slot}."""
    quoted = F.regexp_replace(template, r"([.*+?^$()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{[^}]*\}", r"%(?:[0-9]+\\\$)?(?:lld|@|d)"), F.lit("$"))


def truncate_error(message: Column) -> Column:
    """The first 4096 bytes, cut in front of a character that they split."""
    data = message.cast("binary")
    split = F.hex(F.substring(data, 4097, 1)).rlike("^[89AB]")  # the first byte left out goes on with a character
    begun = F.regexp_extract(F.hex(F.substring(data, 4093, 4)), r"(?:[CDEF].)(?:[89AB].){0,2}$", 0)
    kept = F.lit(4096) - F.when(split, F.length(begun) / 2).otherwise(0).cast("int")
    return F.when(F.octet_length(data) <= 4096, message).otherwise(F.substring(data, F.lit(1), kept).cast("string"))


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*REDACTED_HEADERS), "[REDACTED]").otherwise(v))


def work_digest(content: Column, mode: Column, dpi: Column) -> Column:
    """SHA-256 of length, content (first and last MiB of large ones), mode, dpi and version."""
    n, mib = F.octet_length(content).cast("long"), 1 << 20

    def little(number: Column, digits: int) -> Column:
        return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(number), digits, "0"), F.lit(".."), F.lit(0))), ""))

    body = F.when(n <= 2 * mib, content).otherwise(F.concat(F.substring(content, 1, mib), F.substring(content, -mib, mib)))
    return F.sha2(F.concat(little(n, 16), body, mode.cast("binary"), little(dpi.cast("long"), 8), F.lit(b"v1")), 256)


def natural_key(name: Column) -> Column:
    """Sort key: digit runs as numbers, before text; ASCII letters alike in either case."""
    lowered = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.regexp_extract_all(lowered, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        number = p.rlike("^[0-9]") & (F.length(p) <= 38)
        return F.struct(F.when(number, 0).otherwise(1).alias("k"), F.when(number, p.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("n"), F.when(number, "").otherwise(p).alias("t"))

    return F.transform(parts, part)


def sniff_mime(content: Column) -> Column:
    """Type by leading bytes; anything else is text if its first 3072 bytes are UTF-8 without NUL."""
    head = F.hex(F.substring(content, 1, 12))
    start = F.make_valid_utf8(F.substring(content, 1, 3072).cast("string"))
    text = ~F.regexp_replace(start, "�+$", "").rlike("�|\u0000")
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("25504446"), "application/pdf")
        .when(text, "text/plain").otherwise("application/octet-stream")
    )


SQL_FUNCTIONS = {
    "ink_request_id": ("record STRING, slot STRING", "STRING", "concat_ws(':', record, slot)"),
    "ink_retry_delay": ("attempt BIGINT", "BIGINT", "attempt * 1500"),
    "ink_retry_delay_doubling": ("attempt BIGINT", "BIGINT", "CAST(30000 * pow(2, attempt - 1) AS BIGINT)"),
    "ink_classify_failure": ("status INT, too_large BOOLEAN", "STRING", "CASE WHEN too_large THEN 'permanent' WHEN status IN (408, 429) OR status >= 500 THEN 'transient' WHEN status BETWEEN 400 AND 499 THEN 'permanent' ELSE 'transient' END"),
    "ink_looks_like_line": ("width DOUBLE, height DOUBLE, page_height DOUBLE", "BOOLEAN", "height > 0 AND page_height > 0 AND (width >= 4 * height OR 5 * height <= 2 * page_height)"),
    "ink_format_megabytes": ("size BIGINT", "STRING", "format_string('%d.%d', (size + 50000) div 1000000, (size + 50000) % 1000000 div 100000)"),
    "ink_is_complete": ("expected INT, pages INT", "BOOLEAN", "coalesce(expected > 0 AND pages >= expected, false)"),
    "ink_percent": ("done DOUBLE, total DOUBLE", "INT", "CAST(CASE WHEN total > 0 THEN greatest(least(floor(done * 100 / total + 0.5), 100), 0) ELSE 0 END AS INT)"),
    "ink_page_filename": ("page INT", "STRING", "format_string('page-%04d.txt', page)"),
    "ink_path_tag": ("path STRING", "STRING", "left(sha2(path, 256), 8)"),
    "ink_upload_route": ("category STRING", "STRING", "CASE WHEN category IN ('contribution', 'contribute') THEN 'contribution' ELSE 'feedback' END"),
    "ink_translate_fallback": ("value STRING, english STRING", "STRING", "coalesce(nullif(value, ''), nullif(english, ''), '')"),
    "ink_header_safe": ("value STRING", "STRING", "replace(replace(replace(value, chr(13), ''), chr(10), ''), chr(34), chr(39))"),
    "ink_xml_escape": ("text STRING", "STRING", "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), concat(chr(92), chr(39))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"),
    "ink_transcription_name": ("name STRING, text_only BOOLEAN", "STRING", "concat(regexp_replace(name, '(?<=.)[.][^.]*$', ''), CASE WHEN text_only THEN '.txt' ELSE '-transcription.txt' END)"),
    "ink_sync_badge": ("synced BOOLEAN, attempts BIGINT", "STRING", "CASE WHEN synced THEN 'synced' WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END"),
    "ink_luma": ("r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "0.299D * r + 0.587D * g + 0.114D * b"),
    "ink_invert": ("v INT, dark BOOLEAN", "INT", "CASE WHEN dark THEN 255 - v ELSE v END"),
    "ink_kernel_size": ("height INT", "INT", "greatest(CAST(floor(height / 4) AS INT) | 1, 7)"),
    "ink_corner_patch": ("side INT", "INT", "greatest(CAST(floor(side / 10) AS INT), 3)"),
    "ink_scaled_width": ("width INT, height INT", "INT", "CAST(least(floor(width * 160 / height), 1024) AS INT)"),
    "ink_sanitize_filename": ("name STRING", "STRING", "left(regexp_replace(replace(name, '..', ''), '[^a-zA-Z0-9.-]', '_'), 100)"),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
