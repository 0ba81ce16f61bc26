"""Registered queries of decoding, assembly and judgement, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import assemble as A
from inkfold.operators import decode as D
from inkfold.sources.derived import LINES_SQL, lines, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH RECURSIVE {sql}" if not sql.lstrip().startswith(("SELECT", "WITH")) else sql
        return f

    return add


BLANK = "trim(coalesce(text, '')) = ''"
PAGES = LINES_SQL + f""",
pages AS (SELECT doc, page, CASE WHEN count(*) FILTER (state = 'failed') = count(*) THEN 'failed' ELSE 'read' END AS status,
  CASE WHEN count(*) FILTER (state = 'failed') < count(*) THEN coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (state = 'read' AND NOT {BLANK}), '') END AS text,
  count(*) AS line_count, count(*) FILTER (state = 'failed') AS failed_line_count FROM lines GROUP BY doc, page)"""
LOGITS = """
logits AS (SELECT vec_id // 50 AS seq, CAST(vec_id % 50 * 8 + k AS INTEGER) AS t, list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: x::DOUBLE) AS scores FROM (SELECT *, unnest(range(len(embedding) // 8)) AS k FROM embeddings)),
best AS (SELECT seq, t, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS idx FROM logits),
steps AS (SELECT seq, t, idx FROM (SELECT *, lag(idx, 1, -1) OVER (PARTITION BY seq ORDER BY t) AS before FROM best) WHERE idx <> 0 AND idx <> before)"""


def _pages(spark, sf):
    return A.assemble_page(lines(spark, sf))


def _logits(spark, sf):
    e = table(spark, sf, "embeddings")
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 8).cast("int") - 1), lambda k: F.transform(F.slice("embedding", k * 8 + 1, 8), lambda x: x.cast("double")))
    rows = e.select("vec_id", F.posexplode(steps).alias("k", "scores"))
    return rows.select(F.floor(F.col("vec_id") / 50).cast("long").alias("seq"), (F.col("vec_id") % 50 * 8 + F.col("k")).cast("int").alias("t"), "scores")


def _charset(spark, sf):
    return D.charset_dim(table(spark, sf, "region").select(F.lit("ABCDEFG\r\n").alias("text")).distinct())


@query("ctc_collapse", LOGITS + " SELECT * FROM steps")
def ctc_collapse(spark, sf):
    return D.ctc_collapse(_logits(spark, sf))


@query("charset_dim", "SELECT doc_id, i + 1 AS idx, unicode(c) AS code FROM (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM (SELECT doc_id, regexp_replace(text, '[\r\n]+$', '') AS t FROM documents WHERE length(text) > 0))")
def charset_dim(spark, sf):
    letters = F.regexp_extract_all(F.regexp_replace("text", "[\r\n]+$", ""), F.lit("(?s)."), F.lit(0))
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(letters).alias("i", "ch"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("idx"), F.ascii("ch").alias("code"))


@query("charset_lookup", LOGITS + " SELECT seq, string_agg(chr(64 + idx), '' ORDER BY t) AS text, CAST(0 AS BIGINT) AS unknown FROM steps GROUP BY seq")
def charset_lookup(spark, sf):
    return D.charset_lookup(D.ctc_collapse(_logits(spark, sf)), _charset(spark, sf))


@query("model_contract", LOGITS + " SELECT seq, t, CASE WHEN len(scores) <> 8 THEN 'classes' WHEN count(*) OVER (PARTITION BY seq) <> 400 OR min(t) OVER (PARTITION BY seq) <> 0 OR max(t) OVER (PARTITION BY seq) <> 399 THEN 'steps' WHEN len(list_filter(scores, lambda x: NOT isfinite(x))) > 0 THEN 'not finite' END AS error FROM logits")
def model_contract(spark, sf):
    return D.model_contract(_logits(spark, sf), 7, 400).select("seq", "t", "error")


@query("recognize_tiles", LOGITS + " SELECT seq AS tile_id, CAST(count(*) AS BIGINT) AS steps, CAST(sum(idx) AS BIGINT) AS total FROM best GROUP BY seq")
def recognize_tiles(spark, sf):
    def fake():
        return lambda b: b.assign(error=None)[["tile_id", "t", "scores", "error"]]

    read = D.recognize_tiles(_logits(spark, sf).withColumnRenamed("seq", "tile_id"), fake)
    best = read.withColumn("idx", F.array_position("scores", F.array_max("scores")) - 1)
    return best.groupBy("tile_id").agg(F.count("*").alias("steps"), F.sum("idx").alias("total"))


@query("assemble_page", PAGES + " SELECT * FROM pages")
def assemble_page(spark, sf):
    return _pages(spark, sf)


def _combined(variant: str, heading: str, rule: str, outer: str = "t"):
    sql = PAGES + f""" SELECT doc, CASE WHEN r > 0 THEN {outer} END AS text, CASE WHEN r = 0 THEN 'No page could be read.' END AS error FROM
    (SELECT doc, coalesce(string_agg(concat({heading}, text), chr(10) || chr(10) ORDER BY page) FILTER (status = 'read' AND {rule}), '') AS t, count(*) FILTER (status = 'read') AS r FROM pages GROUP BY doc)"""
    query(f"combine_pages_{variant}" if variant != "web" else "combine_pages", sql)(lambda spark, sf: A.combine_pages(_pages(spark, sf), variant))


_combined("web", "'--- Page ', page + 1, ' ---', chr(10)", f"NOT {BLANK}")
_combined("android", "'Page ', page + 1, chr(10)", f"NOT {BLANK}")
_combined("ios", "'--- Page ', page + 1, ' ---', chr(10)", "true", r"regexp_replace(t, '^[\s]+|[\s]+$', '', 'g')")
_combined("cli", "''", f"NOT {BLANK}")


@query("combine_totals", PAGES + r""" SELECT doc, count(*) AS pages, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(failed_line_count) AS BIGINT) AS failed_lines,
CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r\x0B]+'))) AS BIGINT) AS words, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, bool_or(failed_line_count > 0) AS partial FROM pages GROUP BY doc""")
def combine_totals(spark, sf):
    return A.combine_totals(_pages(spark, sf))


@query("document_warnings", PAGES + """,
notes AS (SELECT DISTINCT doc, page, line AS position, concat('note ', line % 3) AS note FROM lines WHERE line % 2 = 0),
m AS (SELECT doc, list(page + 1 ORDER BY page) FILTER (status = 'failed') AS missing, list(page + 1 ORDER BY page) FILTER (status = 'read' AND failed_line_count > 0) AS short,
  CAST(sum(failed_line_count) FILTER (status = 'read') AS BIGINT) AS lost, count(*) AS n FROM pages GROUP BY doc),
e AS (SELECT doc, note, list_sort(list(DISTINCT page + 1)) AS pg, min({'page': page, 'position': position}) AS seen FROM notes GROUP BY doc, note),
s AS (SELECT doc, list(concat('Page(s) ', array_to_string(pg, ', '), ': ', note) ORDER BY seen, note) AS said FROM e GROUP BY doc)
SELECT doc, list_concat(list_filter([CASE WHEN missing IS NOT NULL THEN concat('Page(s) ', array_to_string(missing, ', '), ' of ', n, ' could not be read. Their text is missing.') END,
  CASE WHEN short IS NOT NULL THEN concat(lost, ' line(s) on page(s) ', array_to_string(short, ', '), ' could not be read. The text is incomplete; check it against the source.') END], lambda w: w IS NOT NULL), coalesce(said, [])) AS warnings
FROM m LEFT JOIN s USING (doc)""")
def document_warnings(spark, sf):
    ls = lines(spark, sf)
    notes = ls.filter("line % 2 = 0").select("doc", "page", F.col("line").alias("position"), F.concat(F.lit("note "), (F.col("line") % 3).cast("string")).alias("note")).distinct()
    return A.document_warnings(_pages(spark, sf), notes)


@query("page_status", LINES_SQL + f"""
SELECT doc, page, CASE WHEN count(*) FILTER (state = 'failed') = count(*) THEN 'INFERENCE_FAILED' WHEN count(*) FILTER (state = 'failed') > 0 THEN 'PARTIAL'
  WHEN bool_and({BLANK}) THEN 'EMPTY_UNVERIFIED' ELSE 'COMPLETE' END AS status FROM lines GROUP BY doc, page""")
def page_status(spark, sf):
    return A.page_status(lines(spark, sf))


@query("page_status_ios", LINES_SQL + f"""
SELECT doc, page, CASE WHEN f = 0 AND bare THEN 'noRegionsDetected' WHEN f = 0 AND blank THEN 'emptyUnverified' WHEN f = 0 THEN 'completed' WHEN f = n THEN 'inferenceFailed' ELSE 'partial' END AS status
FROM (SELECT doc, page, count(*) FILTER (state = 'failed') AS f, count(*) AS n, bool_and({BLANK}) AS blank, bool_or((doc + line) % 9 = 0) AS bare FROM lines GROUP BY doc, page)""")
def page_status_ios(spark, sf):
    reasons = F.when((F.col("doc") + F.col("line")) % 9 == 0, F.array(F.lit("no_regions_detected"))).otherwise(F.array().cast("array<string>"))
    return A.page_status(lines(spark, sf).withColumn("reasons", reasons), "ios")


@query("page_outcomes", LINES_SQL + f"""
, f AS (SELECT doc, page, count(*) AS n, count(*) FILTER ((doc * 3 + page + line) % 4 = 0) AS f, bool_or((doc + line) % 9 = 0) AS bare, bool_and(coalesce(text, '') = '') AS blank FROM lines GROUP BY doc, page),
p AS (SELECT *, (doc + page) % 7 <> 1 AS attempted, doc % 2 = 0 AS cancelled, (doc + page) % 7 <> 2 AS rendered FROM f),
s AS (SELECT doc, page, CASE WHEN NOT attempted AND cancelled THEN 'cancelled' WHEN NOT attempted THEN 'notAttempted' WHEN NOT rendered THEN 'renderFailed' WHEN f = 0 AND bare THEN 'noRegionsDetected' WHEN f = 0 AND blank THEN 'emptyUnverified'
  WHEN f = 0 THEN 'completed' WHEN f = n THEN 'inferenceFailed' ELSE 'partial' END AS state FROM p)
SELECT *, CASE state WHEN 'inferenceFailed' THEN '{A.LINES_UNREAD}' WHEN 'renderFailed' THEN '{A.RENDER_FAILED}' END AS error, state IN ('completed', 'partial', 'emptyUnverified', 'noRegionsDetected') AS was_read FROM s""")
def page_outcomes(spark, sf):
    ls = lines(spark, sf)
    failed = F.when((F.col("doc") * 3 + F.col("page") + F.col("line")) % 4 == 0, F.array(F.lit("tile_failed"))).otherwise(F.array().cast("array<string>"))
    bare = F.when((F.col("doc") + F.col("line")) % 9 == 0, F.array(F.lit("no_regions_detected"))).otherwise(F.array().cast("array<string>"))
    at = (F.col("doc") + F.col("page")) % 7
    pages = ls.select("doc", "page").distinct().select("doc", "page", (at != 1).alias("attempted"), (F.col("doc") % 2 == 0).alias("cancelled"), (at != 2).alias("rendered"))
    return A.page_outcomes(pages, ls.select("doc", "page", "text", F.concat(failed, bare).alias("reasons")))


@query("review_warnings", LINES_SQL + """,
p AS (SELECT doc, page, CASE (doc + page) % 5 WHEN 0 THEN 'renderFailed' WHEN 1 THEN 'emptyUnverified' WHEN 2 THEN 'notAttempted' ELSE 'completed' END AS status, doc % 7 = 0 AS cancelled, doc % 4 = 1 AS soft FROM (SELECT DISTINCT doc, page FROM lines)),
a AS (SELECT doc, list(page + 1 ORDER BY page) FILTER (status = 'renderFailed') AS u, bool_or(cancelled) AS c, count(*) FILTER (status = 'notAttempted') AS l, count(*) AS n, bool_or(status = 'emptyUnverified') AS e, bool_or(soft) AS s FROM p GROUP BY doc),
b AS (SELECT doc, bool_or((doc + line) % 9 = 0) AS bare, count(*) FILTER (state = 'failed') AS f, count(*) FILTER ((doc + line) % 9 = 1) AS g, count(*) FILTER (line % 6 = 5) AS k FROM lines GROUP BY doc)
SELECT doc, list_filter([CASE WHEN u IS NOT NULL THEN concat('pages_unread:', array_to_string(u, ', ')) END, CASE WHEN c THEN 'cancelled' END, CASE WHEN l > 0 AND NOT c THEN concat('unfinished:', l, ' of ', n) END,
  CASE WHEN e THEN 'empty_unverified' END, CASE WHEN bare THEN 'no_regions_detected' END, CASE WHEN f > 0 THEN concat('lines_unread:', f) END, CASE WHEN g > 0 THEN concat('uncertain_seams:', g) END,
  CASE WHEN s THEN 'soft' END, CASE WHEN k > 0 THEN concat('blocks:', k) END], lambda w: w IS NOT NULL) AS warnings FROM a JOIN b USING (doc)""")
def review_warnings(spark, sf):
    ls = lines(spark, sf)
    k = (F.col("doc") + F.col("page")) % 5
    status = F.when(k == 0, "renderFailed").when(k == 1, "emptyUnverified").when(k == 2, "notAttempted").otherwise("completed")
    pages = ls.select("doc", "page").distinct().select("doc", "page", status.alias("status"), (F.col("doc") % 7 == 0).alias("cancelled"), (F.col("doc") % 4 == 1).alias("soft"))
    m = (F.col("doc") + F.col("line")) % 9
    reasons = F.array_compact(F.array(F.when(m == 0, "no_regions_detected"), F.when(F.col("state") == "failed", "tile_failed"), F.when(m == 1, "empty_tile_between_text")))
    return A.review_warnings(pages, ls.select("doc", reasons.alias("reasons"), (F.col("line") % 6 != 5).alias("line_shaped")))


TILES = LINES_SQL + ", tiles AS (SELECT doc * 3 + page AS line_id, line AS tile, state, text FROM lines)"
FULL = f"(state = 'read' AND NOT {BLANK})"


def _tiles(spark, sf):
    return lines(spark, sf).select((F.col("doc") * 3 + F.col("page")).alias("line_id"), F.col("line").alias("tile"), "state", "text")


@query("assemble_tiles", TILES + f""",
a AS (SELECT line_id, bool_or(state = 'failed') AS failed, coalesce(string_agg(text, '' ORDER BY tile) FILTER {FULL.replace('(', '(', 1)}, '') AS t, min(tile) FILTER {FULL} AS lo, max(tile) FILTER {FULL} AS hi, list(tile) FILTER (NOT {FULL}) AS bare FROM tiles GROUP BY line_id)
SELECT line_id, CASE WHEN failed THEN 'failed' ELSE 'read' END AS state, CASE WHEN NOT failed THEN t END AS text,
  list_filter([CASE WHEN failed THEN 'tile_failed' END, CASE WHEN len(list_filter(coalesce(bare, []), lambda x: x > lo AND x < hi)) > 0 THEN 'empty_tile_between_text' END], lambda r: r IS NOT NULL) AS reasons FROM a""")
def assemble_tiles(spark, sf):
    return A.assemble_tiles(_tiles(spark, sf))


@query("uncertain_seam", TILES + f""" SELECT line_id, tile, state, text FROM (SELECT *, min(tile) FILTER (NOT {BLANK}) OVER (PARTITION BY line_id) AS lo, max(tile) FILTER (NOT {BLANK}) OVER (PARTITION BY line_id) AS hi FROM tiles) WHERE {BLANK} AND tile > lo AND tile < hi""")
def uncertain_seam(spark, sf):
    return A.uncertain_seam(_tiles(spark, sf))


@query("first_failure", LINES_SQL + " SELECT doc, f.page AS page, f.error AS error FROM (SELECT doc, min({'page': page, 'line': line, 'error': error}) AS f FROM lines WHERE state = 'failed' GROUP BY doc)")
def first_failure(spark, sf):
    return A.first_failure(lines(spark, sf))


VERDICT = PAGES + f""",
t AS (SELECT doc, count(*) FILTER (status = 'read') AS r, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'read' AND NOT {BLANK}) AS w, list(page + 1 ORDER BY page) FILTER (status = 'failed') AS bad,
  min(page) FILTER (status = 'failed') AS p FROM pages GROUP BY doc),
v AS (SELECT *, CASE WHEN r = 0 AND f = 0 THEN 'not_started' WHEN r = 0 THEN 'unread' WHEN f = 0 AND w = 0 THEN 'no_text' WHEN f = 0 THEN 'read' ELSE 'partial' END AS verdict FROM t),
verdicts AS (SELECT doc, verdict, CASE verdict WHEN 'no_text' THEN concat('no text found on ', r, ' page(s); this is not an error')
  WHEN 'partial' THEN concat('warning: ', f, ' of ', r + f, ' page(s) could not be read (page ', array_to_string(bad[1:10], ', '), CASE WHEN len(bad) > 10 THEN concat(', and ', len(bad) - 10, ' more') ELSE '' END, ')')
  WHEN 'unread' THEN concat('none of the ', f, ' page(s) could be read; the first error was: page ', p) END AS message FROM v)"""


def _verdicts(spark, sf):
    return A.page_verdict(_pages(spark, sf).withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("page "), F.col("page").cast("string")))))


@query("page_verdict", VERDICT + " SELECT * FROM verdicts")
def page_verdict(spark, sf):
    return _verdicts(spark, sf)


@query("run_end", VERDICT + """ SELECT f = 0 AS success, CASE WHEN f > 0 THEN concat(f, ' of ', n, ' input(s) failed; see manifest.jsonl') WHEN p > 0 THEN concat('warning: ', p, ' of ', n, ' input(s) were only partly read; see manifest.jsonl for the pages that failed') END AS message
FROM (SELECT count(*) FILTER (verdict = 'unread') AS f, count(*) FILTER (verdict = 'partial') AS p, count(*) AS n FROM verdicts)""")
def run_end(spark, sf):
    return A.run_end(_verdicts(spark, sf))


@query("has_text", LINES_SQL + f" SELECT doc, page, bool_or(NOT {BLANK}) AS has_text FROM lines GROUP BY doc, page")
def has_text(spark, sf):
    return lines(spark, sf).groupBy("doc", "page").agg(F.collect_list("text").alias("ts")).select("doc", "page", F.exists("ts", lambda t: F.trim(t) != "").alias("has_text"))


@query("timeout_budget", """SELECT user_id AS doc, event_id AS page, event_type = 'error' AS timed_out, CASE WHEN coalesce(b, 0) >= 2 THEN 'Not attempted' WHEN event_type = 'error' THEN 'timed_out' ELSE 'read' END AS outcome
FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)""")
def timeout_budget(spark, sf):
    e = table(spark, sf, "events")
    return A.timeout_budget(e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("page"), (F.col("event_type") == "error").alias("timed_out")))


@query("latest_run", "SELECT key, seq, cancelled FROM (SELECT user_id AS key, event_id AS seq, event_type = 'view' AS cancelled, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND NOT cancelled")
def latest_run(spark, sf):
    e = table(spark, sf, "events")
    return A.latest_run(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("cancelled")))


@query("text_stats", r"SELECT doc_id AS id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r\x0B]+')) AS words, length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents")
def text_stats(spark, sf):
    return A.text_stats(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("garbage_lines", "SELECT doc_id AS id, count(*) AS lines, count(*) FILTER (length(t) > 3 AND 2 * length(regexp_replace(t, '[^0-9]', '', 'g')) > length(t)) AS garbage FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]')) AS t FROM documents) GROUP BY doc_id")
def garbage_lines(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "[ \n]")).alias("text"))
    return A.garbage_lines(words, digits="0-9")  # the documents have no digits of the default range


@query("sample_report", """SELECT input, len(pages) AS pages, lines, garbage, chars, list_sort(hs)[len(hs) // 2 + 1] AS median_height, list_sum([p.ms for p in pages]) / 1000 / len(pages) AS seconds_per_page FROM
(SELECT conv_id // 3 AS input, list(DISTINCT {'page': CAST(conv_id % 3 AS INTEGER), 'ms': 700 + conv_id * 13 % 900}) AS pages, count(text) AS lines, CAST(0 AS BIGINT) AS garbage, CAST(sum(length(text)) AS BIGINT) AS chars, list(CAST(20 + turn * 7 % 31 AS INTEGER)) AS hs FROM conversations GROUP BY 1)""")
def sample_report(spark, sf):
    c = table(spark, sf, "conversations")
    scanned = c.select(
        F.floor(F.col("conv_id") / 3).cast("long").alias("input"), (F.col("conv_id") % 3).cast("int").alias("page"), (F.col("conv_id") * 13 % 900 + 700).alias("ms"), "text", (F.col("turn") * 7 % 31 + 20).cast("int").alias("height")
    )
    return A.sample_report(scanned)


@query("page_progress", "SELECT user_id AS doc, count(*) FILTER (event_type <> 'view') AS done, count(*) AS total, count(*) FILTER (event_type <> 'view') / count(*) AS fraction FROM events GROUP BY user_id")
def page_progress(spark, sf):
    status = F.when(F.col("event_type") == "view", "notAttempted").otherwise("completed")
    return A.page_progress(table(spark, sf, "events").select(F.col("user_id").alias("doc"), status.alias("status")))


@query("pages_left_readings", LINES_SQL + ", d AS (SELECT doc, max(page) + 2 AS total FROM lines GROUP BY doc), r AS (SELECT doc, page + 1 AS page, max(text) AS text FROM lines GROUP BY ALL) SELECT d.doc, p.page, r.text FROM d, unnest(range(1, total + 1)) p(page) LEFT JOIN r ON r.doc = d.doc AND r.page = p.page")
def pages_left_readings(spark, sf):
    ls = lines(spark, sf)
    readings = ls.groupBy("doc", (F.col("page") + 1).cast("int").alias("page")).agg(F.max("text").alias("text"))
    return A.pages_left_readings(ls.groupBy("doc").agg((F.max("page") + 2).alias("total")), readings)


@query("lines_to_pages", "SELECT l_orderkey AS page_id, l_linenumber AS line, l_partkey AS width, l_suppkey AS height, NOT (l_suppkey > 0 AND o_custkey > 0 AND (l_partkey >= 4 * l_suppkey OR 5 * l_suppkey <= 2 * o_custkey)) AS fused FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lines_to_pages(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height"))
    return A.lines_to_pages(items, table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("height")))


@query("reading_order", """
SELECT doc, page, coalesce(string_agg(t, chr(10) ORDER BY y, line) FILTER (t <> ''), '') AS text FROM
(SELECT conv_id // 3 AS doc, conv_id % 3 AS page, turn // 2 AS line, min(1000 - turn // 2 * 30 % 100) AS y, coalesce(string_agg(text, '' ORDER BY turn), '') AS t FROM conversations GROUP BY conv_id, turn // 2) GROUP BY doc, page""")
def reading_order(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.floor(F.col("turn") / 2).cast("long")
    tiles = c.select(F.floor(F.col("conv_id") / 3).cast("long").alias("doc"), (F.col("conv_id") % 3).alias("page"), line.alias("line"), (1000 - line * 30 % 100).alias("y"), (F.col("turn") % 2).alias("tile"), "text")
    return A.reading_order(tiles)
