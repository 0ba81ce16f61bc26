"""Registered queries of the batch run, the contribution pipeline and the translation tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import contrib as C
from inkfold.operators import corpus as K
from inkfold.operators import locale as L
from inkfold.plans.scalars import STEM
from inkfold.sources import files
from inkfold.sources.derived import HISTORY_SQL, LINES_SQL, PATHS_SQL, TRANSLATIONS_SQL, UPLOADS_SQL, history, lines, paths, table, translations, uploads

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql if sql.lstrip().startswith(("SELECT", "WITH")) else f"WITH {sql}"
        return f

    return add


@query("expand_pages", "SELECT p_partkey AS id, CAST(unnest(range(1, p_size + 1)) AS INTEGER) AS page FROM part WHERE p_partkey % 10 <> 0")
def expand_pages(spark, sf):
    p = table(spark, sf, "part")
    return K.expand_pages(p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("bytes"), F.col("p_size").alias("pages")))[0]


@query("expand_pages_refused", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN 'empty' WHEN o_totalprice > 250000 THEN 'too_large' WHEN o_custkey % 7 = 0 THEN 'no_pages' ELSE 'too_many_pages' END AS reason FROM orders WHERE o_custkey % 9 = 0 OR o_totalprice > 250000 OR o_custkey % 7 = 0 OR o_custkey > 3000")
def expand_pages_refused(spark, sf):
    o = table(spark, sf, "orders")
    size = F.when(F.col("o_custkey") % 9 == 0, 0).when(F.col("o_totalprice") > 250000, K.MAX_BYTES + 1).otherwise(1)
    pages = F.when(F.col("o_custkey") % 7 == 0, 0).otherwise(F.col("o_custkey"))
    return K.expand_pages(o.select(F.col("o_orderkey").alias("id"), size.alias("bytes"), pages.alias("pages")))[1]


def _records(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.struct(*[x.cast(t).alias(n) for n, t, x in (("text", "string", F.col("text")), ("x", "int", F.col("turn")), ("y", "int", F.col("turn") * 30), ("width", "int", F.col("turn") + 5), ("height", "int", F.lit(20)), ("tiles", "int", F.lit(1)), ("looks_fused", "boolean", F.when(F.col("turn") % 3 == 0, True)))])
    pages = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    failed = F.col("conv_id") % 5 == 0
    return pages.select(
        F.when(failed, "failure").otherwise("page").alias("kind"), F.concat(F.lit("in-"), F.col("conv_id").cast("string")).alias("input"), F.lit(1).alias("page"),
        F.when(~failed, "page").alias("mode"), F.when(~failed, F.transform("ls", lambda x: x["l"])).alias("lines"), F.col("conv_id").alias("ms"), F.when(failed, "broken").alias("error"), F.lit(None).cast("string").alias("reason"),
    )


MANIFEST_SQL = """
SELECT concat('in-', conv_id) AS input, 1 AS page, 'page' AS mode, conv_id AS ms, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS line, text,
  CAST(turn AS INTEGER) AS x, CAST(turn * 30 AS INTEGER) AS y, CAST(turn + 5 AS INTEGER) AS width, 20 AS height, 1 AS tiles, CASE WHEN turn % 3 = 0 THEN true END AS looks_fused FROM conversations WHERE conv_id % 5 <> 0"""


@query("scan_manifest_lines", MANIFEST_SQL)
def scan_manifest_lines(spark, sf):
    return K.scan_manifest_lines(_records(spark, sf))


@query("write_manifest", MANIFEST_SQL)
def write_manifest(spark, sf):
    path = files.fresh_dir(spark, "manifest")
    records = _records(spark, sf)
    K.write_manifest(records.filter("ms % 2 = 0"), path)
    K.write_manifest(records.filter("ms % 2 = 1"), path)
    return K.scan_manifest_lines(spark.read.schema(K.MANIFEST).json(path))


def _written_pages(spark, sf) -> str:
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    text = F.array_join(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t.isNotNull()), "\n")
    pages = lines(spark, sf).groupBy(F.concat(F.lit("book-"), F.col("doc").cast("string")).alias("stem"), "page").agg(text.alias("text"))
    path = files.fresh_dir(spark, "pages")
    K.write_page_text(pages, path)
    return path


@query("write_page_text", f"{LINES_SQL} SELECT concat('book-', doc) AS stem, coalesce(string_agg(text, chr(10) ORDER BY page) FILTER (text <> ''), '') AS text FROM (SELECT doc, page, coalesce(string_agg(text, chr(10) ORDER BY line), '') AS text FROM lines GROUP BY doc, page) GROUP BY doc")
def write_page_text(spark, sf):
    return K.scan_document_text(spark, _written_pages(spark, sf))


@query("scan_page_text", f"{LINES_SQL} SELECT concat('book-', doc) AS stem, CAST(page AS INTEGER) AS page, coalesce(string_agg(text, chr(10) ORDER BY line), '') AS text FROM lines GROUP BY doc, page")
def scan_page_text(spark, sf):
    return K.scan_page_text(spark, _written_pages(spark, sf))


COMPLETED_SQL = """
inputs AS (SELECT page_id, sha256(coalesce(url, '')) AS digest, concat('s', page_id % 50) AS stem FROM pages),
completed AS (SELECT concat('old-', page_id) AS input, digest, stem, CAST(CASE WHEN page_id % 7 = 0 THEN 2 ELSE 5 END AS INTEGER) AS pages, CASE WHEN page_id % 5 <> 0 THEN 5 END AS expected_pages FROM inputs WHERE page_id % 3 <> 0)"""


def _inputs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(F.coalesce("url", F.lit("")), 256).alias("digest"), F.concat(F.lit("s"), (F.col("page_id") % 50).cast("string")).alias("stem"))


def _completed(spark, sf):
    p = F.col("page_id")
    return _inputs(spark, sf).filter(p % 3 != 0).select(F.concat(F.lit("old-"), p.cast("string")).alias("input"), "digest", "stem", F.when(p % 7 == 0, 2).otherwise(5).alias("pages"), F.when(p % 5 != 0, 5).alias("expected_pages"))


@query("load_resume_state", COMPLETED_SQL + " SELECT * FROM completed")
def load_resume_state(spark, sf):
    path = files.fresh_dir(spark, "state")
    _completed(spark, sf).write.json(path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return K.load_resume_state(spark, path)


@query("is_complete", COMPLETED_SQL + " SELECT digest, stem, coalesce(expected_pages > 0 AND pages >= expected_pages, false) AS complete FROM completed")
def is_complete(spark, sf):
    return _completed(spark, sf).select("digest", "stem", K.is_complete(F.col("expected_pages"), F.col("pages")).alias("complete"))


@query("resume_anti_join", COMPLETED_SQL + " SELECT * FROM inputs i WHERE NOT EXISTS (SELECT 1 FROM completed c WHERE c.digest = i.digest AND c.stem = i.stem AND expected_pages > 0 AND pages >= expected_pages)")
def resume_anti_join(spark, sf):
    return K.resume_anti_join(_inputs(spark, sf), _completed(spark, sf)).select("page_id", "digest", "stem")


@query("progress_upsert", COMPLETED_SQL + """, progress AS (SELECT concat('new-', page_id) AS input, digest, stem, CAST(page_id % 8 AS INTEGER) AS pages, CAST(6 AS INTEGER) AS expected_pages FROM inputs WHERE page_id % 2 = 0)
SELECT coalesce(p.digest, c.digest) AS digest, coalesce(p.stem, c.stem) AS stem, coalesce(p.input, c.input) AS input, greatest(coalesce(c.pages, 0), coalesce(p.pages, 0)) AS pages, CASE WHEN p.digest IS NOT NULL THEN p.expected_pages ELSE c.expected_pages END AS expected_pages
FROM completed c FULL JOIN progress p ON c.digest = p.digest AND c.stem = p.stem""")
def progress_upsert(spark, sf):
    p = F.col("page_id")
    progress = _inputs(spark, sf).filter(p % 2 == 0).select(F.concat(F.lit("new-"), p.cast("string")).alias("input"), "digest", "stem", (p % 8).cast("int").alias("pages"), F.lit(6).alias("expected_pages"))
    return K.progress_upsert(_completed(spark, sf), progress)


@query("discover_inputs", PATHS_SQL + r"""
SELECT kind, count(*) AS n FROM (SELECT CASE regexp_extract(path, '\.([A-Za-z]*)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'skipped' WHEN 'PNG' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'tiff' THEN 'image' ELSE 'skipped' END AS kind
FROM (SELECT concat('f', arg_no, ['.pdf', '.PNG', '.jpg', '.txt', '.tiff', ''][arg_no % 6 + 1]) AS path FROM paths)) GROUP BY kind""")
def discover_inputs(spark, sf):
    root = files.fresh_dir(spark, "found")
    kind = F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".jpg", ".txt", ".tiff", ""])), (F.col("arg_no") % 6).cast("int") + 1)
    folder = F.when(F.col("arg_no") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), (F.col("arg_no") % 3).cast("string"), F.lit("/")))
    made = paths(spark, sf).select(F.concat(folder, F.lit("f"), F.col("arg_no").cast("string"), kind).alias("name"), F.lit("x").alias("content"))
    hidden = made.select(F.concat(F.lit(".git/"), "name").alias("name"), "content")
    files.write_files(made.unionByName(hidden), root)
    inputs, skipped = K.discover_inputs(spark, [root], recursive=True)
    return inputs.select("kind").unionByName(skipped.select(F.lit("skipped").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("distinct_inputs", PATHS_SQL + " SELECT arg_no, path, canon FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY arg_no) AS r FROM (SELECT arg_no, path, lower(regexp_replace(path, '[0-9]+', '', 'g')) AS canon FROM paths)) WHERE r = 1")
def distinct_inputs(spark, sf):
    return K.distinct_inputs(paths(spark, sf).withColumn("canon", F.lower(F.regexp_replace("path", "[0-9]+", ""))))


@query("assign_stems", PATHS_SQL + f", b AS (SELECT arg_no, path, CASE WHEN {STEM} = '' THEN 'input' ELSE {STEM} END AS base FROM paths) SELECT arg_no, path, CASE WHEN count(*) OVER (PARTITION BY lower(base)) > 1 THEN concat(base, '-', left(sha256(path), 8)) ELSE base END AS stem FROM b")
def assign_stems(spark, sf):
    return K.assign_stems(paths(spark, sf))


NAMES = """n AS (SELECT event_id AS arg_no, concat('u', user_id % 600) AS root, CASE event_id % 9 WHEN 0 THEN '-2' WHEN 1 THEN '-3' WHEN 2 THEN '-2-2' WHEN 3 THEN '-12345678901234567890' WHEN 4 THEN '-02' WHEN 5 THEN '-4' ELSE '' END AS tail FROM events)"""


@query("force_unique", f"""WITH RECURSIVE {NAMES},
r AS (SELECT arg_no, root, concat(root, tail) AS name, row_number() OVER (PARTITION BY root ORDER BY arg_no) AS i FROM n),
named(root, i, arg_no, name, "unique", seen) AS (
  SELECT root, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[] FROM r GROUP BY root
  UNION ALL
  SELECT root, i, arg_no, name, u, list_append(seen, u) FROM (
    SELECT r.root, r.i, r.arg_no, r.name, d.seen, CASE WHEN list_contains(d.seen, r.name)
      THEN concat(r.name, '-', list_min(list_filter(range(2, len(d.seen) + 3), lambda k: NOT list_contains(d.seen, concat(r.name, '-', k))))) ELSE r.name END AS u
    FROM named d JOIN r ON r.root = d.root AND r.i = d.i + 1))
SELECT arg_no, name, "unique" FROM named WHERE i > 0""")
def force_unique(spark, sf):
    tails = {0: "-2", 1: "-3", 2: "-2-2", 3: "-12345678901234567890", 4: "-02", 5: "-4"}
    tail = F.lit("")
    for k, v in tails.items():
        tail = F.when(F.col("event_id") % 9 == k, v).otherwise(tail)
    return K.force_unique(table(spark, sf, "events").select(F.col("event_id").alias("arg_no"), F.concat(F.lit("u"), (F.col("user_id") % 600).cast("string"), tail).alias("name")))


@query("verify_digests", "SELECT page_id AS name FROM pages WHERE page_id % 6 <> 0")
def verify_digests(spark, sf):
    files = table(spark, sf, "pages").select(F.col("page_id").alias("name"), F.col("html").cast("binary").alias("content"))
    pinned = files.select("name", F.when(F.col("name") % 6 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return K.verify_digests(files, pinned)[0].select("name")


@query("shown_pages", "SELECT user_id, concat(array_to_string(list_sort(ps)[1:10], ', '), CASE WHEN len(ps) > 10 THEN concat(', and ', len(ps) - 10, ' more') ELSE '' END) AS shown FROM (SELECT user_id, list(event_id) AS ps FROM events GROUP BY user_id)")
def shown_pages(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("ps")).select("user_id", K.shown_pages(F.col("ps")).alias("shown"))


@query("skip_report", PATHS_SQL + ", s AS (SELECT path FROM paths WHERE path LIKE '%.txt') SELECT count(*) AS total, (SELECT list(path ORDER BY path) FROM (SELECT path FROM s ORDER BY path LIMIT 20)) AS shown, greatest(count(*) - 20, 0) AS more FROM s")
def skip_report(spark, sf):
    return K.skip_report(paths(spark, sf).filter(F.col("path").endswith(".txt")).select("path"))


@query("choose_mode", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'sparse' WHEN l_returnflag <> 'R' AND l_partkey > 0 AND l_suppkey > 0 AND l_suppkey * 9 < 320 AND l_partkey >= 36 * l_suppkey THEN 'line' ELSE 'page' END AS mode FROM lineitem")
def choose_mode(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "pdf").when(F.col("l_returnflag") == "A", "camera").when(F.col("l_linenumber") % 2 == 0, "scan").otherwise("image")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", K.choose_mode(kind, F.col("l_partkey"), F.col("l_suppkey") * 9).alias("mode"))


@query("mode_reason", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'PDF page render, which is known to be a document page'
  WHEN w IS NULL THEN concat('could not read the dimensions of f', l_orderkey, '.png; defaulting to page') WHEN h = 0 THEN concat(w, 'x', h, ' has no area; defaulting to page')
  WHEN h < 320 AND w >= 4 * h THEN concat(w, 'x', h, ', aspect ', printf('%.1f', round_even(w / h, 1)), ': short enough and line-shaped, so it is already a single line')
  WHEN h < 320 THEN concat(w, 'x', h, ' is short but aspect ', printf('%.1f', round_even(w / h, 1)), ' is under 4.0, so it is a block of lines rather than one line')
  ELSE concat(w, 'x', h, ': a file on disk is treated as a page unless told otherwise, because a photo and a scan look the same from here') END AS reason
  FROM (SELECT *, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey * 3 END AS w, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_suppkey * 16 END AS h FROM lineitem)""")
def mode_reason(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "pdf").otherwise("image")
    path = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".png"))
    w, h = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") * 3), F.when(F.col("l_suppkey") % 9 == 0, F.lit(0)).otherwise(F.col("l_suppkey") * 16)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", K.mode_reason(kind, path, w, h).alias("reason"))


@query("density_ratio", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 0.03::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS web, CASE l_linenumber % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS cli FROM lineitem")
def density_ratio(spark, sf):
    mode = F.element_at(F.array(*map(F.lit, ("page", "sparse", "line"))), (F.col("l_linenumber") % 3).cast("int") + 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", K.density_ratio(mode).alias("web"), K.density_ratio(mode, "cli").alias("cli"))


@query("result_json", LINES_SQL + """,
p AS (SELECT doc, page, bool_or(state = 'failed') AS failed FROM lines GROUP BY doc, page),
d AS (SELECT doc, concat('in/book ', doc) AS input, CASE WHEN doc % 2 = 0 THEN 'page' ELSE 'sparse' END AS mode, concat('book_', doc) AS stem, count(*) FILTER (NOT failed) AS pages,
  CASE WHEN doc % 5 <> 0 THEN count(*) END AS expected, coalesce(list_sort(list(page + 1) FILTER (failed)), []) AS failed FROM p GROUP BY doc)
SELECT input, CAST(CASE WHEN doc % 3 <> 0 THEN to_json({'expected_pages': expected, 'failed_pages': failed, 'input': input, 'mode': mode, 'pages': pages, 'stem': stem})
  ELSE to_json({'input': input, 'mode': mode, 'pages': pages, 'stem': stem}) END AS VARCHAR) AS json FROM d""")
def result_json(spark, sf):
    read = lines(spark, sf).groupBy("doc", "page").agg(F.bool_or(F.col("state") == "failed").alias("failed"))
    n = F.col("page").cast("int") + 1
    docs = read.groupBy("doc").agg(F.count_if(~F.col("failed")).alias("pages"), F.count("*").alias("expected"), F.collect_list(F.when(F.col("failed"), n)).alias("failed_pages"))
    mode = F.when(F.col("doc") % 2 == 0, "page").otherwise("sparse")
    return K.result_record(docs.select(
        F.concat(F.lit("in/book "), F.col("doc").cast("string")).alias("input"), F.when(F.col("doc") % 3 != 0, "pdf").otherwise("image").alias("kind"), mode.alias("mode"),
        F.concat(F.lit("book_"), F.col("doc").cast("string")).alias("stem"), "pages", F.when(F.col("doc") % 5 != 0, F.col("expected")).alias("expected_pages"), "failed_pages",
    ))


# --- contributions


@query("intake_check", UPLOADS_SQL + " SELECT id, CASE WHEN size > 52428800 THEN 'file_large' WHEN type NOT IN ('image/jpeg', 'image/png', 'image/webp', 'application/pdf', 'text/plain') THEN 'file_type' END AS problem FROM uploads")
def intake_check(spark, sf):
    return uploads(spark, sf).select("id", C.intake_check(F.col("size"), F.col("type")).alias("problem"))


VALIDATE = UPLOADS_SQL + """,
v AS (SELECT id, CASE WHEN NOT origin_ok THEN 'origin' WHEN name = '' OR type = '' OR record_id = '' THEN 'missing' WHEN NOT regexp_matches(record_id, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'record_id'
  WHEN type NOT IN ('image/jpeg', 'image/png', 'image/webp', 'application/pdf', 'text/plain') THEN 'type' WHEN size < 1 THEN 'size' WHEN size > 20971520 THEN 'too_large' END AS reason FROM uploads),
r AS (SELECT id, CASE WHEN reason IS NULL THEN 200 WHEN reason = 'origin' THEN 403 WHEN reason = 'too_large' THEN 413 ELSE 400 END AS status, reason FROM v)"""


@query("validate_upload", VALIDATE + " SELECT * FROM r")
def validate_upload(spark, sf):
    return C.validate_upload(uploads(spark, sf)).select("id", "status", "reason")


@query("rejected_split", VALIDATE + " SELECT status = 200 AS accepted, count(*) AS n FROM r GROUP BY 1")
def rejected_split(spark, sf):
    judged = C.validate_upload(uploads(spark, sf))
    both = judged.filter("status = 200").select(F.lit(True).alias("accepted")).unionByName(judged.filter("status <> 200").select(F.lit(False).alias("accepted")))
    return both.groupBy("accepted").agg(F.count("*").alias("n"))


@query("validate_part", UPLOADS_SQL + " SELECT id, CASE WHEN size > 20971520 THEN 413 WHEN octet_length(content) = 0 THEN 400 WHEN hex(content[1:4]) = '00FF00FE' THEN 400 ELSE 200 END AS status FROM uploads")
def validate_part(spark, sf):
    return C.validate_part(uploads(spark, sf)).select("id", "status")


for _surface, _rule in (("web", "category IN ('feedback', 'contribution') AND consent"), ("android", "category IN ('feedback', 'contribution', 'contribute')")):
    query("sync_eligible" if _surface == "web" else f"sync_eligible_{_surface}", f"{HISTORY_SQL} SELECT id FROM history WHERE NOT synced AND attempts < 5 AND {_rule}")(
        lambda spark, sf, _s=_surface: C.sync_eligible(history(spark, sf), _s).select("id")
    )


@query("submission_allowed", HISTORY_SQL + " SELECT id, consent AND CASE WHEN category = 'feedback' THEN trim(text) <> '' ELSE trim(text) <> '' OR size > 0 END AS allowed FROM history")
def submission_allowed(spark, sf):
    return history(spark, sf).select("id", C.submission_allowed(F.col("category"), F.col("consent"), F.col("text"), F.col("size") > 0).alias("allowed"))


for _surface, _rule, _end in (
    ("web", "trim(text) <> '' AND name <> 'Mon Text Contribution'", "'-transcription.txt'"),
    ("android", "trim(text) <> '' AND name <> 'Text Contribution' AND text <> '(Image only)'", "'-transcription.txt'"),
    ("ios", "text <> '' AND text <> '(Image only)'", "CASE WHEN size > 0 THEN '-transcription.txt' ELSE '.txt' END"),
):
    query("expand_payloads" if _surface == "web" else f"expand_payloads_{_surface}", rf"""{HISTORY_SQL}
SELECT id, 'file' AS slot, concat(id, ':file') AS request_id, name FROM history WHERE size > 0
UNION ALL SELECT id, 'transcription', concat(id, ':transcription'), concat(regexp_replace(name, '(.)\.[^.]*$', '\1'), {_end}) FROM history WHERE {_rule}""")(
        lambda spark, sf, _s=_surface: C.expand_payloads(history(spark, sf), _s)
    )


FAILURE = "CASE WHEN id % 50 = 0 THEN 'permanent' WHEN st IN (408, 429) OR st >= 500 THEN 'transient' WHEN st BETWEEN 400 AND 499 THEN 'permanent' ELSE 'transient' END"
STATUS_SQL = HISTORY_SQL + f", s AS (SELECT id, user_id, [200, 400, 408, 429, 500, 404, NULL][id % 7 + 1] AS st FROM history), f AS (SELECT id, user_id AS run, {FAILURE} AS failure FROM s)"


def _failures(spark, sf):
    status = F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 400, 408, 429, 500, 404, None)]), (F.col("id") % 7).cast("int") + 1)
    return history(spark, sf).select("id", F.col("user_id").alias("run"), C.classify_failure(status, F.col("id") % 50 == 0).alias("failure"))


@query("classify_failure", STATUS_SQL + " SELECT * FROM f")
def classify_failure(spark, sf):
    return _failures(spark, sf)


@query("sync_decision", STATUS_SQL + " SELECT run AS work, id // 8 % 5 AS run, CASE WHEN NOT bool_or(failure = 'transient') THEN 'success' WHEN id // 8 % 5 IN (0, 1) THEN 'retry' ELSE 'failure' END AS decision FROM f GROUP BY run, id // 8 % 5")
def sync_decision(spark, sf):
    outcomes = _failures(spark, sf).select(F.col("run").alias("work"), (F.floor(F.col("id") / 8) % 5).alias("run"), "failure")
    return C.sync_decision(outcomes)


@query("token_bucket", """
WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, epoch(ts)::DOUBLE / 86400 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::DOUBLE / 86400, event_id) AS n FROM events),
f AS (SELECT key, seq, ts, n, 3.0::DOUBLE - 1 AS tokens, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT key, seq, ts, n, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM
  (SELECT r.key, r.seq, r.ts, r.n, least(3.0::DOUBLE, f.tokens + greatest(r.ts - f.ts, 0) * 2.0::DOUBLE) AS t FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))
SELECT key, seq, allowed FROM f""")
def token_bucket(spark, sf):
    requests = table(spark, sf, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 86400).alias("ts"), F.col("event_id").alias("seq"))
    return C.token_bucket(requests, rate=2.0, burst=3)


@query("oldest_evicted", "SELECT key, last_seen, CASE WHEN idle THEN 'idle' ELSE 'cap' END AS why FROM (SELECT *, row_number() OVER (PARTITION BY idle ORDER BY last_seen DESC, key) AS r FROM (SELECT user_id AS key, max(event_id) AS last_seen, (SELECT max(event_id) FROM events) - max(event_id) > 600 AS idle FROM events GROUP BY user_id)) WHERE idle OR r > 5")
def oldest_evicted(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("event_id").alias("now"))
    keys = e.groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("last_seen")).join(F.broadcast(now))  # one row
    return C.oldest_evicted(keys, F.col("now"), 600, 5)


@query("history_recent", HISTORY_SQL + " SELECT id, ts, category FROM history WHERE category = 'feedback' ORDER BY ts DESC, id LIMIT 50")
def history_recent(spark, sf):
    return history(spark, sf).filter("category = 'feedback'").orderBy(F.col("ts").desc(), "id").limit(50).select("id", "ts", "category")


@query("history_table", HISTORY_SQL + " SELECT id, CASE WHEN id % 3 = 0 THEN 'feedback' ELSE category END AS category, CASE WHEN id % 3 = 0 THEN 0 ELSE attempts END AS attempts FROM history WHERE id % 10 <> 9")
def history_table(spark, sf):
    base = history(spark, sf).select("id", "category", "attempts")
    edits = base.filter("id % 3 = 0")
    changes = edits.withColumn("seq", F.lit(1)).unionByName(edits.withColumns({"category": F.lit("feedback"), "attempts": F.lit(0), "seq": F.lit(2)}))
    return C.delete_records(C.upsert(base, changes), base.filter("id % 10 = 9"))


@query("reset_retries", HISTORY_SQL + " SELECT id, CASE WHEN id % 2 = 0 AND NOT synced THEN 0 ELSE attempts END AS attempts, CASE WHEN (id % 2 <> 0 OR synced) AND attempts > 2 THEN 'error' END AS last_error FROM history WHERE category <> 'contribute'")
def reset_retries(spark, sf):
    h = history(spark, sf).select("id", "category", "synced", "attempts", F.when(F.col("attempts") > 2, "error").alias("last_error"))
    return C.reset_retries(C.clear_history(h, "contribute"), h.filter("id % 2 = 0")).select("id", "attempts", "last_error")


@query("upgrade_history", HISTORY_SQL + " SELECT id, category, 0 AS attempts, false AS synced, true AS has_id FROM history")
def upgrade_history(spark, sf):
    old = history(spark, sf).select("id", "category")
    return C.upgrade_history(old).select("id", "category", "attempts", "synced", F.col("record_id").isNotNull().alias("has_id"))


@query("write_object_store", "SELECT folder, month, key, seq FROM (SELECT event_type AS folder, strftime(ts, '%Y-%m') AS month, concat('k', user_id) AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def write_object_store(spark, sf):
    path = files.fresh_dir(spark, "objects")
    e = table(spark, sf, "events")
    C.write_object_store(e.select(F.col("event_type").alias("folder"), "ts", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("content")), path)
    return spark.read.parquet(path).select("folder", F.col("month").cast("string").alias("month"), "key", "seq")


@query("union_prefixes", HISTORY_SQL + " SELECT id, category FROM history WHERE category IN ('contribution', 'contribute')")
def union_prefixes(spark, sf):
    h = history(spark, sf).select("id", "category")
    return h.filter("category = 'contribution'").unionByName(h.filter("category = 'contribute'"))


@query("idle_sessions", """
WITH s AS (SELECT user_id AS key, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 5 HOUR AND ts < lag(ts) OVER w + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts) AS session FROM s)
SELECT key, min(ts) AS first_ts, count(*) AS n FROM g GROUP BY key, session""")
def idle_sessions(spark, sf):
    from inkfold.streaming.streams import idle_sessions as sessions

    return sessions(table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts"), "5 hours")


# --- translations


@query("scan_sheet", TRANSLATIONS_SQL + " SELECT key, coalesce(en, '') AS en, coalesce(mnw, '') AS mnw, row_number() OVER (ORDER BY key, en, mnw) > 10 AS late FROM translations")
def scan_sheet(spark, sf):
    path = files.fresh_dir(spark, "sheet")
    translations(spark, sf).drop("row_no").orderBy("key", "en", "mnw").write.option("header", True).option("escape", '"').csv(path)
    sheet = L.scan_sheet(spark, path)
    rest = L.scan_sheet(spark, path, start=11)
    return sheet.select("key", "en", "mnw", (F.col("row_no") > 10).alias("late")).exceptAll(rest.select("key", "en", "mnw", F.lit(True).alias("late"))).unionByName(rest.select("key", "en", "mnw", F.lit(True).alias("late")))


for _platform in ("web", "ios"):
    query("platform_filter" if _platform == "web" else "platform_filter_ios", f"{TRANSLATIONS_SQL} SELECT key FROM translations WHERE key <> '' AND (platforms = '' OR lower(platforms) LIKE '%all%' OR lower(platforms) LIKE '%{_platform}%')")(
        lambda spark, sf, _p=_platform: L.platform_filter(translations(spark, sf), _p).select("key")
    )


LOCALE_SQL = TRANSLATIONS_SQL + """,
web AS (SELECT concat('key_', row_no % 70) AS key, row_no, en, my, mnw FROM translations WHERE key <> '' AND (platforms = '' OR lower(platforms) LIKE '%all%' OR lower(platforms) LIKE '%web%')),
cells AS (SELECT key, row_no, en, unnest(['en', 'my', 'mnw']) AS lang, unnest([en, my, mnw]) AS v FROM web),
entries AS (SELECT lang, key, min(row_no) AS place, arg_max(coalesce(nullif(v, ''), nullif(en, ''), ''), row_no) AS value FROM cells GROUP BY lang, key)"""


def _repeated_keys(spark, sf):
    web = L.platform_filter(translations(spark, sf), "web")
    return web.withColumn("key", F.concat(F.lit("key_"), (F.col("row_no") % 70).cast("string")))


@query("locale_entries", LOCALE_SQL + " SELECT lang, place, key, value FROM entries")
def locale_entries(spark, sf):
    return L.locale_entries(_repeated_keys(spark, sf))


@query("write_locale_json", LOCALE_SQL + """ SELECT lang, '{' AS line FROM entries GROUP BY lang UNION ALL SELECT lang, '}' FROM entries GROUP BY lang
UNION ALL SELECT lang, concat('  ', to_json(key), ': ', to_json(value), CASE WHEN place < max(place) OVER (PARTITION BY lang) THEN ',' ELSE '' END) FROM entries""")
def write_locale_json(spark, sf):
    path = files.fresh_dir(spark, "messages")
    L.write_locale_json(_repeated_keys(spark, sf), path)
    return spark.read.text(path).select("lang", F.col("value").alias("line"))


@query("scan_strings_xml", TRANSLATIONS_SQL + " SELECT 'f' AS file, key, max(en) AS value FROM translations WHERE key <> '' AND en <> '' GROUP BY key")
def scan_strings_xml(spark, sf):
    entries = translations(spark, sf).filter("key <> '' and en <> ''").select(F.concat(F.lit('<string name="'), "key", F.lit('">'), "en", F.lit("</string>")).alias("value"), F.lit("f").alias("file"))
    return L.scan_strings_xml(entries)


@query("scan_catalogue", TRANSLATIONS_SQL + " SELECT key, 'my' AS lang, my AS value FROM translations WHERE key <> ''")
def scan_catalogue(spark, sf):
    unit = lambda c: F.create_map(F.lit("my"), F.struct(F.struct(F.lit("translated").alias("state"), F.col(c).alias("value")).alias("stringUnit")))
    files = translations(spark, sf).filter("key <> ''").select(F.to_json(F.struct(F.create_map("key", F.struct(unit("my").alias("localizations"))).alias("strings"))).alias("value"))
    return L.scan_catalogue(files)


SHEET_SQL = TRANSLATIONS_SQL + ", old AS (SELECT key, concat('old ', key) AS value FROM translations WHERE key LIKE '%1' OR key LIKE '%2'), sheet AS (SELECT key, my AS value, en FROM translations WHERE key <> '' AND key NOT LIKE '%2')"


@query("locale_merge", SHEET_SQL + " SELECT coalesce(old.key, sheet.key) AS key, coalesce(nullif(sheet.value, ''), nullif(sheet.en, ''), old.value, '') AS value FROM old FULL JOIN sheet USING (key)")
def locale_merge(spark, sf):
    t = translations(spark, sf)
    old = t.filter("key like '%1' or key like '%2'").select("key", F.concat(F.lit("old "), "key").alias("value"))
    return L.locale_merge(old, t.filter("key <> '' and key not like '%2'").select("key", F.col("my").alias("value"), "en"))


@query("keys_not_in_catalogue", TRANSLATIONS_SQL + " SELECT concat('key_', l_partkey) AS key, l_orderkey AS file FROM lineitem WHERE concat('key_', l_partkey) NOT IN (SELECT key FROM translations WHERE my <> '')")
def keys_not_in_catalogue(spark, sf):
    used = table(spark, sf, "lineitem").select(F.concat(F.lit("key_"), F.col("l_partkey").cast("string")).alias("key"), F.col("l_orderkey").alias("file"))
    return L.keys_not_in_catalogue(used, translations(spark, sf).filter("my <> ''"))[0]


@query("pattern_key_join", """SELECT concat('part {n} of ', p_partkey % 20) AS literal, min_by(concat('part %lld of ', p_partkey), p_partkey) AS key FROM (SELECT DISTINCT p_partkey % 20 AS r FROM part) JOIN part ON p_partkey = r GROUP BY 1""")
def pattern_key_join(spark, sf):
    part = table(spark, sf, "part")
    literals = part.select(F.concat(F.lit("part {n} of "), (F.col("p_partkey") % 20).cast("string")).alias("literal")).distinct()
    keys = part.select(F.concat(F.lit("part %lld of "), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").alias("ordinal"))
    return L.pattern_key_join(literals, keys)


GAPS_SQL = TRANSLATIONS_SQL + ", gaps AS (SELECT key, 'my' AS lang FROM translations WHERE key <> '' AND (my = '' OR my = en) UNION ALL SELECT key, 'mnw' FROM translations WHERE key <> '' AND (mnw = '' OR mnw = en))"


@query("translation_gaps", GAPS_SQL + " SELECT lang, count(*) AS gaps FROM gaps GROUP BY lang")
def translation_gaps(spark, sf):
    return L.gap_counts(translations(spark, sf).filter("key <> ''"))


@query("todo_reconcile", GAPS_SQL + ", listed AS (SELECT key, 'my' AS lang FROM translations WHERE key LIKE '%3' OR key LIKE '%4') SELECT key, lang, CASE WHEN listed.l IS NULL THEN 'unlisted' WHEN g.g IS NULL THEN 'stale' ELSE 'known' END AS status FROM (SELECT *, 1 AS g FROM gaps) g FULL JOIN (SELECT *, 1 AS l FROM listed) listed USING (key, lang)")
def todo_reconcile(spark, sf):
    t = translations(spark, sf)
    gaps = L.translation_gaps(t.filter("key <> ''")).select("key", F.explode("langs").alias("lang"))
    return L.todo_reconcile(gaps, t.filter("key like '%3' or key like '%4'").select("key", F.lit("my").alias("lang")))


@query("language_dictionary", TRANSLATIONS_SQL + " SELECT key, coalesce(nullif(my, ''), nullif(en, ''), '') AS value FROM translations WHERE key <> ''")
def language_dictionary(spark, sf):
    return L.language_dictionary(translations(spark, sf).select(F.col("key").alias("unique_key"), F.col("my").alias("value_my"), F.col("en").alias("mm")), "my")


@query("key_difference", "SELECT DISTINCT concat('k', p_partkey) AS key, 'left' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25) UNION ALL SELECT DISTINCT concat('k', (l_suppkey + 7) * 1000003), 'right' FROM lineitem WHERE l_quantity <= 1")
def key_difference(spark, sf):
    items = table(spark, sf, "lineitem")
    k = lambda c: F.concat(F.lit("k"), c.cast("string")).alias("key")
    right = items.filter("l_quantity > 25").select(k(F.col("l_partkey"))).union(items.filter("l_quantity <= 1").select(k((F.col("l_suppkey") + 7) * 1000003)))
    return L.key_difference(table(spark, sf, "part").select(k(F.col("p_partkey"))), right)
