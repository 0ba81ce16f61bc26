"""Registered queries of the scalar rules and ordered decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import scalars as S
from inkfold.sources.derived import HISTORY_SQL, PATHS_SQL, TRANSLATIONS_SQL, UPLOADS_SQL, history, paths, table, translations, uploads

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def on_paths(name: str, sql: str, column, alias: str):
    def run(spark, sf):
        return paths(spark, sf).select("arg_no", column(F.col("path")).alias(alias))

    query(name, f"WITH {PATHS_SQL} SELECT arg_no, {sql} AS {alias} FROM paths")(run)


EXT = r"lower(regexp_extract(path, '[^/]\.([^./]*)$', 1))"
STEM = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._-]', '_', 'g'), '^\.+|\.+$', '', 'g')"
on_paths("classify_input", f"CASE WHEN {EXT} = 'pdf' THEN 'pdf' WHEN {EXT} IN ('png','jpg','jpeg','bmp','tif','tiff','webp') THEN 'image' END", S.classify_input, "kind")
on_paths("output_stem", f"CASE WHEN {STEM} = '' THEN 'input' ELSE {STEM} END", S.output_stem, "stem")
on_paths("path_tag", "left(sha256(path), 8)", S.path_tag, "tag")


@query("drop_hidden", f"WITH {PATHS_SQL} SELECT arg_no, path FROM paths WHERE NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.')")
def drop_hidden(spark, sf):
    return paths(spark, sf).filter(~S.basename(F.col("path")).startswith("."))


@query("sanitize_filename", f"WITH {UPLOADS_SQL} SELECT id, left(regexp_replace(replace(name, '..', ''), '[^a-zA-Z0-9.-]', '_', 'g'), 100) AS clean FROM uploads")
def sanitize_filename(spark, sf):
    return uploads(spark, sf).select("id", S.sanitize_filename(F.col("name")).alias("clean"))


LETTERS_SQL = """WITH c AS (SELECT doc_id AS id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents WHERE length(text) > 0),
b AS (SELECT id, ch, i, sum(octet_length(encode(ch))) OVER (PARTITION BY id ORDER BY i) AS upto FROM c)"""


@query("sanitize_key", LETTERS_SQL + r""", k AS (SELECT id, coalesce(string_agg(ch, '' ORDER BY i) FILTER (upto <= 128), '') AS head FROM b GROUP BY id)
SELECT id, regexp_replace(regexp_replace(head, '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS clean FROM k UNION ALL SELECT doc_id, '' FROM documents WHERE coalesce(length(text), 0) = 0""")
def sanitize_key(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.sanitize_key(F.coalesce("text", F.lit(""))).alias("clean"))


@query("object_key", r"""
SELECT event_id AS id, concat(event_type, '/', strftime(ts, '%Y-%m'), '/', CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%H%M%S') ELSE CAST(event_id AS VARCHAR) END, '-',
  CASE WHEN event_id % 4 = 0 THEN 'unnamed_file' ELSE concat('scan_', user_id, '.png') END) AS key FROM events""")
def object_key(spark, sf):
    e = F.col("event_id")
    name = F.when(e % 4 == 0, "__").otherwise(F.concat(F.lit("-scan "), F.col("user_id").cast("string"), F.lit(".png_")))
    return table(spark, sf, "events").select(e.alias("id"), S.object_key(F.col("event_type"), F.col("ts"), F.when(e % 5 == 0, "").otherwise(e.cast("string")), name).alias("key"))


@query("page_filename", "SELECT conv_id, turn, printf('page-%04d.txt', turn) AS file FROM conversations")
def page_filename(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.page_filename(F.col("turn")).alias("file"))


@query("request_id", f"WITH {HISTORY_SQL} SELECT id, concat(id, ':file') AS file_request, concat(id, ':transcription') AS text_request FROM history")
def request_id(spark, sf):
    record = F.col("id").cast("string")
    return history(spark, sf).select("id", S.request_id(record, F.lit("file")).alias("file_request"), S.request_id(record, F.lit("transcription")).alias("text_request"))


@query("header_safe", r"""SELECT page_id, replace(regexp_replace(html, '[\r\n]', '', 'g'), '"', '''') AS safe FROM pages""")
def header_safe(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.header_safe(F.col("html")).alias("safe"))


@query("upload_route", f"WITH {HISTORY_SQL} SELECT id, CASE WHEN category IN ('contribution', 'contribute') THEN 'contribution' ELSE 'feedback' END AS route FROM history")
def upload_route(spark, sf):
    return history(spark, sf).select("id", S.upload_route(F.col("category")).alias("route"))


@query("transcription_name", rf"WITH {HISTORY_SQL} SELECT id, concat(regexp_replace(name, '(.)\.[^.]*$', '\1'), '-transcription.txt') AS file, concat(regexp_replace(name, '(.)\.[^.]*$', '\1'), CASE WHEN size = 0 THEN '.txt' ELSE '-transcription.txt' END) AS ios FROM history")
def transcription_name(spark, sf):
    return history(spark, sf).select("id", S.transcription_name(F.col("name")).alias("file"), S.transcription_name(F.col("name"), F.col("size") == 0).alias("ios"))


@query("retry_delay", f"WITH {HISTORY_SQL} SELECT id, attempts * 1500 AS web, CAST(30000 * pow(2, attempts - 1) AS BIGINT) AS android FROM history WHERE attempts > 0")
def retry_delay(spark, sf):
    return history(spark, sf).filter("attempts > 0").select("id", S.retry_delay(F.col("attempts")).alias("web"), S.retry_delay(F.col("attempts"), "android").alias("android"))


@query("sync_badge", f"""WITH {HISTORY_SQL} SELECT id, CASE WHEN NOT consent THEN NULL WHEN synced THEN 'synced' WHEN attempts > 2 THEN 'failed' ELSE 'pending' END AS web,
 CASE WHEN synced THEN 'synced' WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS ios FROM history""")
def sync_badge(spark, sf):
    h = history(spark, sf)
    args = (F.col("consent"), F.col("synced"), F.when(F.col("attempts") > 2, "e"), F.col("attempts"))
    return h.select("id", S.sync_badge("web", *args).alias("web"), S.sync_badge("ios", *args).alias("ios"))


@query("summarise_detail", r"""
WITH t AS (SELECT doc_id AS id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r\x0B]+', ' ', 'g')) AS text FROM documents),
s AS (SELECT id, text, CASE WHEN regexp_extract(text, '^(.*?[.!?])(?: |$)', 1) = '' THEN text ELSE regexp_extract(text, '^(.*?[.!?])(?: |$)', 1) END AS s FROM t),
m AS (SELECT id, text, CASE WHEN length(s) > 140 THEN concat(rtrim(left(s, 139)), '…') ELSE s END AS summary FROM s)
SELECT id, summary, CASE WHEN summary <> text THEN text END AS "full" FROM m""")
def summarise_detail(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.summarise_detail(F.coalesce("text", F.lit(""))).alias("d"))
    return d.select("id", "d.summary", "d.full")


@query("percent", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_suppkey - 5 > 0 THEN greatest(least(floor(l_quantity * 100 / (l_suppkey - 5) + 0.5::DOUBLE), 100), 0) ELSE 0 END AS INTEGER) AS pct FROM lineitem")
def percent(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.percent(F.col("l_quantity"), F.col("l_suppkey") - 5).alias("pct"))


@query("format_megabytes", f"WITH {HISTORY_SQL} SELECT id, printf('%d.%d', (size + 50000) // 1000000, (size + 50000) % 1000000 // 100000) AS mb FROM history")
def format_megabytes(spark, sf):
    return history(spark, sf).select("id", S.format_megabytes(F.col("size")).alias("mb"))


@query("xml_escape", rf"""WITH {TRANSLATIONS_SQL} SELECT key, mnw, replace(replace(replace(replace(replace(replace(mnw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '\'''), '"', '\"'), chr(10), '\n') AS xml FROM translations""")
def xml_escape(spark, sf):
    return translations(spark, sf).select("key", "mnw", S.xml_escape(F.col("mnw")).alias("xml"))


@query("translate_fallback", f"WITH {TRANSLATIONS_SQL} SELECT key, coalesce(nullif(my, ''), nullif(en, ''), '') AS my FROM translations")
def translate_fallback(spark, sf):
    return translations(spark, sf).select("key", S.translate_fallback(F.col("my"), F.col("en")).alias("my"))


@query("specifier_regex", r"""SELECT p_partkey, concat('^', regexp_replace(regexp_replace(concat(p_name, ' (', '{n}', ') of {total}.'), '([.*+?^$()|\[\]\\])', '\\\1', 'g'), '\{[^}]*\}', '%(?:[0-9]+\\$)?(?:lld|@|d)', 'g'), '$') AS pattern FROM part""")
def specifier_regex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.specifier_regex(F.concat("p_name", F.lit(" ({n}) of {total}."))).alias("pattern"))


@query("format_message", "SELECT conv_id, turn, printf('%d of %d pages have not been read; this reading is incomplete.', turn, conv_id) AS message FROM conversations")
def format_message(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.format_string("%d of %d pages have not been read; this reading is incomplete.", "turn", "conv_id").alias("message"))


@query("to_source_rect", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 400 AS x, l_suppkey % 300 AS y, CAST(l_quantity AS INTEGER) AS w, CAST(l_quantity AS INTEGER) % 7 AS h FROM lineitem),
p AS (SELECT *, least(greatest(CAST(floor(x * 2.5::DOUBLE + 0.5::DOUBLE) AS INTEGER), 0), 799) AS sx, least(greatest(CAST(floor(y * 2.5::DOUBLE + 0.5::DOUBLE) AS INTEGER), 0), 599) AS sy FROM s)
SELECT l_orderkey, l_linenumber, sx, sy, least(greatest(CAST(floor(w * 2.5::DOUBLE + 0.5::DOUBLE) AS INTEGER), 1), 800 - sx) AS sw, least(greatest(CAST(floor(h * 2.5::DOUBLE + 0.5::DOUBLE) AS INTEGER), 1), 600 - sy) AS sh FROM p""")
def to_source_rect(spark, sf):
    from inkfold.operators.contrib import to_source_rect as rect

    t = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    box = rect(F.col("l_partkey") % 400, F.col("l_suppkey") % 300, q, q % 7, 2.5, 800, 600)
    return t.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("truncate_error", LETTERS_SQL + """
SELECT id, coalesce(string_agg(ch, '' ORDER BY i) FILTER (upto <= 4096), '') AS error FROM b GROUP BY id UNION ALL SELECT doc_id, '' FROM documents WHERE coalesce(length(text), 0) = 0""")
def truncate_error(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.truncate_error(F.coalesce("text", F.lit(""))).alias("error"))


@query("redact_headers", """
SELECT page_id, map(['Host', 'X-API-Key', 'cookie', 'Accept'], [url, '[REDACTED]', '[REDACTED]', 'a']) AS headers FROM pages""")
def redact_headers(spark, sf):
    headers = F.create_map(F.lit("Host"), F.col("url"), F.lit("X-API-Key"), F.col("url"), F.lit("cookie"), F.lit("c"), F.lit("Accept"), F.lit("a"))
    return table(spark, sf, "pages").select("page_id", S.redact_headers(headers).alias("headers"))


@query("work_digest", f"""WITH {UPLOADS_SQL}, h AS (SELECT id, content, printf('%016x', octet_length(content)) AS n FROM uploads)
SELECT id, sha256(unhex(concat(n[15:16], n[13:14], n[11:12], n[9:10], n[7:8], n[5:6], n[3:4], n[1:2])) || content || encode('page') || unhex('2C010000') || encode('v1')) AS digest FROM h""")
def work_digest(spark, sf):
    return uploads(spark, sf).select("id", S.work_digest(F.col("content"), F.lit("page"), F.lit(300)).alias("digest"))


@query("natural_sort", rf"""
WITH {PATHS_SQL},
k AS (SELECT arg_no, path, list_transform(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+|[^0-9]+'),
  lambda p: {{'k': CASE WHEN regexp_matches(p, '^[0-9]') THEN 0 ELSE 1 END, 'n': coalesce(TRY_CAST(p AS HUGEINT), 0), 't': CASE WHEN regexp_matches(p, '^[0-9]') THEN '' ELSE p END}}) AS key FROM paths)
SELECT arg_no, path, row_number() OVER (ORDER BY key, arg_no) AS place FROM k""")
def natural_sort(spark, sf):
    from inkfold.operators.corpus import natural_order

    return natural_order(paths(spark, sf))


@query("sniff_mime", rf"""
WITH {UPLOADS_SQL}, h AS (SELECT id, hex(content[1:12]) AS h, content FROM uploads)
SELECT id, CASE WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN h LIKE '52494646%' AND h[17:24] = '57454250' THEN 'image/webp'
  WHEN h LIKE '25504446%' THEN 'application/pdf' WHEN h LIKE '00FF00FE%' THEN 'application/octet-stream' ELSE 'text/plain' END AS mime FROM h""")
def sniff_mime(spark, sf):
    return uploads(spark, sf).select("id", S.sniff_mime(F.col("content")).alias("mime"))


@query("sql_functions", f"""WITH {HISTORY_SQL} SELECT id, CAST(CASE WHEN size > 0 THEN greatest(least(floor(attempts * 100.0 / size + 0.5), 100), 0) ELSE 0 END AS INTEGER) AS pct, left(sha256(name), 8) AS tag,
  CASE WHEN category IN ('contribution', 'contribute') THEN 'contribution' ELSE 'feedback' END AS route, concat(id, ':file') AS request, attempts * 1500 AS delay, CAST(30000 * pow(2, attempts - 1) AS BIGINT) AS doubling,
  CASE WHEN id % 50 = 0 THEN 'permanent' WHEN attempts * 100 + 8 IN (408, 429) OR attempts * 100 + 8 >= 500 THEN 'transient' WHEN attempts * 100 + 8 BETWEEN 400 AND 499 THEN 'permanent' ELSE 'transient' END AS failure,
  attempts > 0 AND size > 0 AND (id >= 4 * attempts OR 5 * attempts <= 2 * size) AS line_shaped, printf('%d.%d', (size + 50000) // 1000000, (size + 50000) % 1000000 // 100000) AS mb, attempts > 0 AND attempts >= 5 AS complete FROM history""")
def sql_functions(spark, sf):
    S.register_sql_functions(spark)
    history(spark, sf).createOrReplaceTempView("ink_history")
    return spark.sql("""SELECT id, ink_percent(attempts, size) AS pct, ink_path_tag(name) AS tag, ink_upload_route(category) AS route, ink_request_id(CAST(id AS STRING), 'file') AS request, ink_retry_delay(attempts) AS delay,
      ink_retry_delay_doubling(attempts) AS doubling, ink_classify_failure(CAST(attempts * 100 + 8 AS INT), id % 50 = 0) AS failure, ink_looks_like_line(id, attempts, size) AS line_shaped, ink_format_megabytes(size) AS mb,
      ink_is_complete(5, CAST(attempts AS INT)) AS complete FROM ink_history""")
