"""Inputs of the page operators made from the driver tables, as whole-table projections that SQL repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.operators.masks import ink_runs
from inkfold.operators.raster import Drawn, pages_frame

#: Width of the character rasters.
WIDTH = 8
#: Ink is darker than this on a character raster.
INK_BELOW = 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, y, x, luma): every character of every document is a pixel, rows filled up with blanks. Without text there is no page."""
    full = F.rpad("text", (F.ceil(F.length("text") / WIDTH) * WIDTH).cast("int"), F.lit(" "))
    letters = F.split(full, "")  # of an empty text, one empty letter
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select(F.col("doc_id").alias("page_id"), F.posexplode(letters).alias("p", "ch"))
    return docs.select(
        "page_id", F.floor(F.col("p") / WIDTH).cast("int").alias("y"), (F.col("p") % WIDTH).alias("x"), ((F.ascii("ch") * 37 + 11) % 256).cast("int").alias("luma")
    )


def drawn(spark: SparkSession, sf_dir: str) -> Drawn:
    """The same rasters, drawn in the task that works on them. Documents are dealt out to all cores first: work on pages is long for their bytes."""

    def draw(batch):
        import numpy as np

        for page_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
            yield page_id, ((np.pad(codes, (0, -len(codes) % WIDTH), constant_values=ord(" ")) * 37 + 11) % 256).reshape(-1, WIDTH)

    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    return Drawn(docs.repartition(2 * spark.sparkContext.defaultParallelism), draw)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, width, luma) of the same rasters, a row a page."""
    return pages_frame(drawn(spark, sf_dir))


def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): the rasters as colour images, red as it is, green and blue its multiples; even pages have an alpha channel with a transparent first column."""

    def rows(it):
        import struct
        import zlib

        import numpy as np
        import pyarrow as pa

        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        for batch in it:
            for page_id, red in draw(batch):
                width = red.shape[1]
                alpha = np.where(np.arange(width) == 0, 0, 255) + 0 * red
                a = np.stack([red, red * 3 % 256, red * 7 % 256, *([alpha] if page_id % 2 == 0 else [])], -1).astype(np.uint8)
                lines = np.pad(a.reshape(len(red), -1), ((0, 0), (1, 0))).tobytes()  # a row's filter, none, before its bytes
                head = struct.pack(">IIBBBBB", width, len(red), 8, 2 if a.shape[2] == 3 else 6, 0, 0, 0)
                data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
                yield pa.RecordBatch.from_arrays([pa.array([f"p{page_id}.png"]), pa.array([data], pa.binary())], ["name", "content"])

    docs, draw = drawn(spark, sf_dir)
    return docs.mapInArrow(rows, "name string, content binary")


def ink_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark pixels by runs, a row a page."""
    return ink_runs(drawn(spark, sf_dir), INK_BELOW)


RASTER_SQL = """
letters AS (SELECT doc_id AS page_id, string_split(rpad(text, CAST(ceil(length(text) / 8.0) * 8 AS INTEGER), ' '), '') AS cs FROM documents WHERE length(text) > 0),
pixels AS (SELECT page_id, unnest(cs) AS ch, unnest(range(len(cs))) AS p FROM letters),
raster AS (SELECT page_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST((unicode(ch) * 37 + 11) % 256 AS INTEGER) AS luma FROM pixels),
dims AS (SELECT doc_id AS page_id, 8 AS width, CAST(ceil(length(text) / 8.0) AS INTEGER) AS height FROM documents WHERE length(text) > 0)"""
INK_SQL = f"{RASTER_SQL},\nink AS (SELECT page_id, y, x FROM raster WHERE luma < 18)"


def path_of(page_id: Column, url: Column) -> Column:
    """A path from a page's url: no scheme, no query, an extension by id."""
    kind = F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".jpg", ".txt", ".tiff", ""])), (page_id % 6).cast("int") + 1)
    return F.concat(F.regexp_replace(url, r"^[a-z]+://", ""), kind)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arg_no, path)."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("arg_no"), path_of(F.col("page_id"), F.col("url")).alias("path"))


PATHS_SQL = r"""
paths AS (SELECT page_id AS arg_no, concat(regexp_replace(url, '^[a-z]+://', ''), ['.pdf', '.PNG', '.jpg', '.txt', '.tiff', ''][page_id % 6 + 1]) AS path FROM pages)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, line, state, text, error) from conversations."""
    t = table(spark, sf_dir, "conversations")
    failed = (F.col("conv_id") % 7 == 0) | ((F.col("conv_id") * 7 + F.col("turn") * 3) % 17 == 0)
    blank = (F.col("conv_id") % 5 == 0) | ((F.col("conv_id") + F.col("turn")) % 11 == 0)
    return t.select(
        F.floor(F.col("conv_id") / 3).cast("long").alias("doc"), (F.col("conv_id") % 3).alias("page"), F.col("turn").alias("line"),
        F.when(failed, "failed").otherwise("read").alias("state"),
        F.when(~failed, F.when(blank, " ").otherwise(F.col("text"))).alias("text"),
        F.when(failed, F.concat(F.lit("line "), F.col("turn").cast("string"), F.lit(" failed"))).alias("error"),
    )


LINES_SQL = """
lines AS (SELECT conv_id // 3 AS doc, conv_id % 3 AS page, turn AS line,
  CASE WHEN f THEN 'failed' ELSE 'read' END AS state, CASE WHEN NOT f THEN CASE WHEN b THEN ' ' ELSE text END END AS text,
  CASE WHEN f THEN concat('line ', turn, ' failed') END AS error
  FROM (SELECT *, (conv_id % 7 = 0 OR (conv_id * 7 + turn * 3) % 17 = 0) AS f, (conv_id % 5 = 0 OR (conv_id + turn) % 11 = 0) AS b FROM conversations))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, user_id, category, consent, attempts, synced, text, size, name) from events."""
    kinds = {"click": "scan", "purchase": "contribution", "signup": "contribute", "error": "feedback", "view": "scan"}
    category = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("scan"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), "ts", "user_id", category.alias("category"), (e % 3 != 0).alias("consent"), (e % 7).alias("attempts"), (e % 4 == 0).alias("synced"),
        F.when(e % 5 == 0, "").when(e % 5 == 1, "(Image only)").otherwise(F.concat(F.lit("text "), e.cast("string"))).alias("text"),
        F.when(e % 6 == 0, 0).otherwise(e * 997 % 60_000_000).alias("size"),
        F.when(e % 8 == 0, "Text Contribution").otherwise(F.concat(F.lit("scan-"), e.cast("string"), F.lit(".png"))).alias("name"),
    )


HISTORY_SQL = """
history AS (SELECT event_id AS id, ts, user_id,
  CASE event_type WHEN 'purchase' THEN 'contribution' WHEN 'signup' THEN 'contribute' WHEN 'error' THEN 'feedback' ELSE 'scan' END AS category,
  event_id % 3 <> 0 AS consent, event_id % 7 AS attempts, event_id % 4 = 0 AS synced,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN '(Image only)' ELSE concat('text ', event_id) END AS text,
  CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id * 997 % 60000000 END AS size,
  CASE WHEN event_id % 8 = 0 THEN 'Text Contribution' ELSE concat('scan-', event_id, '.png') END AS name FROM events)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, record_id, name, type, size, content, origin_ok) from documents; content begins with one of six signatures."""
    d = F.col("doc_id")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (d % len(values)).cast("int") + 1)
    magic = of(["FFD8FFE0", "89504E470D0A1A0A", "52494646AAAAAAAA57454250", "255044462D312E37", "", "00FF00FE"])
    kind = of(["image/jpeg", "image/png", "image/webp", "application/pdf", "text/plain", "video/mp4", "image/jpeg"])
    digest = F.md5(d.cast("string"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.when(d % 11 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.when(d % 13 == 0, "not-a-uuid").when(d % 29 == 0, "").otherwise(uuid).alias("record_id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("/.."), d.cast("string"), F.lit(".png")).alias("name"),
        kind.alias("type"), F.when(d % 17 == 0, F.lit(0)).otherwise(F.coalesce("n_chars", F.lit(0)) * 6007).cast("long").alias("size"),
        F.when(d % 11 == 0, F.lit(b"")).otherwise(F.concat(F.unhex(magic), body.cast("binary"))).alias("content"), (d % 19 != 0).alias("origin_ok"),
    )


UPLOADS_SQL = """
uploads AS (SELECT doc_id AS id,
  CASE WHEN doc_id % 13 = 0 THEN 'not-a-uuid' WHEN doc_id % 29 = 0 THEN '' ELSE concat(m[1:8], '-', m[9:12], '-', m[13:16], '-', m[17:20], '-', m[21:32]) END AS record_id,
  concat(coalesce(text, ''), '/..', doc_id, '.png') AS name,
  ['image/jpeg', 'image/png', 'image/webp', 'application/pdf', 'text/plain', 'video/mp4', 'image/jpeg'][doc_id % 7 + 1] AS type,
  CASE WHEN doc_id % 17 = 0 THEN 0 ELSE coalesce(n_chars, 0) * 6007 END AS size,
  CASE WHEN doc_id % 11 = 0 THEN ''::BLOB ELSE unhex(['FFD8FFE0', '89504E470D0A1A0A', '52494646AAAAAAAA57454250', '255044462D312E37', '', '00FF00FE'][doc_id % 6 + 1]) || encode(coalesce(text, '')) END AS content,
  doc_id % 19 <> 0 AS origin_ok
  FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents))"""


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_no, key, platforms, en, my, mnw) from part, with blanks and copies of English."""
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    return part.select(
        p.alias("row_no"), F.when(p % 50 == 0, "").otherwise(F.concat(F.lit("key_"), p.cast("string"))).alias("key"),
        F.element_at(F.array(*map(F.lit, ["", "all", "Web", "android, ios", "ios"])), (p % 5).cast("int") + 1).alias("platforms"),
        F.when(p % 40 == 3, "").otherwise(F.col("p_name")).alias("en"),
        F.when(p % 4 == 0, "").when(p % 4 == 1, F.col("p_name")).otherwise(F.col("p_brand")).alias("my"),
        F.when(p % 4 == 2, "").otherwise(F.concat("p_type", F.lit(' & "x" <'), p.cast("string"))).alias("mnw"),
    )


TRANSLATIONS_SQL = """
translations AS (SELECT p_partkey AS row_no, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat('key_', p_partkey) END AS key,
  ['', 'all', 'Web', 'android, ios', 'ios'][p_partkey % 5 + 1] AS platforms, CASE WHEN p_partkey % 40 = 3 THEN '' ELSE p_name END AS en,
  CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN p_name ELSE p_brand END AS my,
  CASE WHEN p_partkey % 4 = 2 THEN '' ELSE concat(p_type, ' & "x" <', p_partkey) END AS mnw FROM part)"""
