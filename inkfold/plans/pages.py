"""Registered queries of page imaging and line finding over the character rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import lines as L
from inkfold.operators import masks as M
from inkfold.operators import raster as R
from inkfold.sources import files
from inkfold.sources.derived import INK_BELOW, INK_SQL, RASTER_SQL, drawn, ink_masks, pages, png_files, raster, table
from inkfold.sources.images import FILES, scan_images

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def on_ink(body: str) -> str:
    return f"WITH {INK_SQL}{body}"


def on_raster(body: str) -> str:
    return f"WITH {RASTER_SQL}{body}"


SMEAR = """,
smeared AS (SELECT DISTINCT i.page_id, i.y + d AS y, i.x FROM ink i JOIN dims USING (page_id), unnest(range(-2, 3)) t(d) WHERE i.y + d >= 0 AND i.y + d < height)"""
PROFILE = SMEAR + """,
profile AS (SELECT s.page_id, s.y, coalesce(c.raw, 0) AS raw FROM (SELECT page_id, CAST(unnest(range(height)) AS INTEGER) AS y FROM dims) s
  LEFT JOIN (SELECT page_id, y, count(*) AS raw FROM smeared GROUP BY ALL) c USING (page_id, y)),
smoothed AS (SELECT *, CAST(sum(raw) OVER w * 60 // count(*) OVER w AS BIGINT) AS smooth60, sum(raw) OVER w / count(*) OVER w AS smooth
  FROM profile WINDOW w AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
THRESHOLD = PROFILE + """,
threshold AS (SELECT page_id, CAST(coalesce(sum(smooth60) FILTER (smooth60 > 0), 0) * 3 AS BIGINT) AS num,
  CAST(greatest(count(*) FILTER (smooth60 > 0) * 6000, 1) AS BIGINT) AS den FROM smoothed GROUP BY page_id)"""
RUNS = THRESHOLD + """,
above AS (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM
  (SELECT p.*, sum(CASE WHEN raw = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y) AS zeros FROM profile p) JOIN threshold USING (page_id) WHERE raw * den > num),
runs AS (SELECT page_id, CAST(row_number() OVER w AS INTEGER) AS run_no, r0, r1, CAST(coalesce(zeros - lag(zeros) OVER w, zeros) AS INTEGER) AS blank
  FROM (SELECT page_id, min(y) AS r0, max(y) + 1 AS r1, min(zeros) AS zeros FROM above GROUP BY page_id, island) WINDOW w AS (PARTITION BY page_id ORDER BY r0))"""
MERGED = RUNS.replace("\nsmeared AS", "\nsmeared AS", 1) + """,
typical AS (SELECT page_id, greatest(coalesce(list_sort(tall)[len(tall) // 2 + 1], list_sort(hs)[len(hs) // 2 + 1]), 1) AS typical
  FROM (SELECT page_id, list(r1 - r0) FILTER (r1 - r0 >= 10) AS tall, list(r1 - r0) AS hs FROM runs GROUP BY page_id)),
fold AS (
  SELECT page_id, run_no, r0 AS a0, r1 AS a1, 1 AS band FROM runs WHERE run_no = 1
  UNION ALL
  SELECT r.page_id, r.run_no, CASE WHEN j THEN a0 ELSE r0 END, r1, CASE WHEN j THEN band ELSE band + 1 END FROM (
    SELECT r.*, f.a0, f.band, (greatest(r.r0 - f.a1, 0) <= 10 AND (r.blank = 0 OR (2 * least(r.r1 - r.r0, f.a1 - f.a0) <= t.typical AND greatest(r.r1 - r.r0, f.a1 - f.a0) >= 10))
      AND r.r1 - f.a0 <= 2 * t.typical) AS j
    FROM fold f JOIN runs r ON r.page_id = f.page_id AND r.run_no = f.run_no + 1 JOIN typical t ON t.page_id = r.page_id) r),
merged AS (SELECT page_id, CAST(band AS INTEGER) AS run_no, min(a0) AS r0, max(a1) AS r1 FROM fold GROUP BY page_id, band)"""
BOXES = MERGED + """,
bands AS (SELECT * FROM merged WHERE r1 - r0 >= 10),
held AS (SELECT b.page_id, b.run_no AS line, r0, r1, min(x) AS l, max(x) AS r FROM bands b JOIN smeared s ON s.page_id = b.page_id AND s.y >= r0 AND s.y < r1 GROUP BY ALL),
corners AS (SELECT held.page_id, line, greatest(l - CAST(ceil((r1 - r0) / 4.0) AS INTEGER), 0) AS x, greatest(r0 - CAST(ceil((r1 - r0) / 5.0) AS INTEGER), 0) AS y,
  least(r + CAST(ceil((r1 - r0) / 4.0) AS INTEGER), width) AS x2, least(r1 + CAST(ceil((r1 - r0) / 5.0) AS INTEGER), height) AS y2 FROM held JOIN dims USING (page_id)),
boxes AS (SELECT page_id, line, x, y, x2 - x AS width, y2 - y AS height FROM corners)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _profiles(spark, sf, with_luma=False):
    return M.profiles(drawn(spark, sf), lambda a: M.widened(a < INK_BELOW, 0, 2), with_luma)


def _runs(spark, sf):
    return L.page_runs(_profiles(spark, sf))


def _boxes(spark, sf, with_luma=False):
    return L.page_boxes(_profiles(spark, sf, with_luma))


def _every_box(spark, sf, with_luma=False):
    return L.whole_page_fallback(_boxes(spark, sf, with_luma))


@query("character_raster", on_raster(" SELECT page_id, count(*) AS n, CAST(sum(luma * (y + 1) * (x + 1)) AS BIGINT) AS checksum FROM raster GROUP BY page_id"))
def character_raster(spark, sf):
    return raster(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("luma").cast("long") * (F.col("y") + 1) * (F.col("x") + 1)).alias("checksum"))


@query("image_raster_scan", on_raster("""
, p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 AND x = 0 THEN 255 ELSE CAST(floor(0.299::DOUBLE * luma + 0.587::DOUBLE * (luma * 3 % 256) + 0.114::DOUBLE * (luma * 7 % 256)) AS INTEGER) END AS v, y * 8 + x + 1 AS p FROM raster)
SELECT concat('p', page_id, '.png') AS name, CAST(8 AS INTEGER) AS width, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * p) % 1000003 AS BIGINT) AS checksum FROM p GROUP BY page_id"""))
def image_raster_scan(spark, sf):
    root = files.fresh_dir(spark, "images")
    folder = F.pmod(F.xxhash64("name"), F.lit(table(spark, sf, "documents").count() // FILES + 1)).cast("string")
    files.write_files(png_files(spark, sf).withColumn("name", F.concat(folder, F.lit("/"), "name")), root)
    images = scan_images(spark, root)[0].select(F.regexp_extract("origin", r"([^/]+)$", 1).alias("name"), "width", "luma")  # a name an image, not a pixel
    found = images.select("name", "width", F.posexplode("luma").alias("p", "v"))
    checksum = F.sum(F.col("v").cast("long") * (F.col("p") + 1)) % 1000003
    return found.groupBy("name", "width").agg(F.count("*").alias("n"), F.sum("v").alias("total"), checksum.alias("checksum"))


@query("luma", on_raster("""
SELECT page_id, CAST(sum(CAST(floor(v) AS INTEGER)) AS BIGINT) AS floored, CAST(sum(CAST(floor(v + 0.5::DOUBLE) AS INTEGER)) AS BIGINT) AS rounded, max(v) AS highest
FROM (SELECT page_id, 0.299::DOUBLE * luma + 0.587::DOUBLE * (luma * 3 % 256) + 0.114::DOUBLE * (luma * 7 % 256) AS v FROM raster) GROUP BY page_id"""))
def luma(spark, sf):
    rgb = (F.col("luma"), F.col("luma") * 3 % 256, F.col("luma") * 7 % 256)
    return raster(spark, sf).groupBy("page_id").agg(F.sum(R.luma(*rgb, "floor")).alias("floored"), F.sum(R.luma(*rgb, "round")).alias("rounded"), F.max(R.luma(*rgb)).alias("highest"))


BOX = """, b AS (SELECT page_id, y, x, luma, sum(s) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
  // sum(c) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS blur
  FROM (SELECT *, sum(luma) OVER w AS s, count(*) OVER w AS c FROM raster WINDOW w AS (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)))"""


@query("box_blur", on_raster(BOX + " SELECT page_id, CAST(sum(blur) AS BIGINT) AS total, CAST(sum(blur * (y * 8 + x + 1)) % 1000003 AS BIGINT) AS checksum FROM b GROUP BY page_id"))
def box_blur(spark, sf):
    return R.raster_signature(R.box_blur(drawn(spark, sf)), "blur")


@query("box_blur_android", on_raster("""
, c AS (SELECT *, max(y) OVER (PARTITION BY page_id) + 1 AS height FROM raster),
h AS (SELECT page_id, y, x, height, (sum(luma) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(2 - x, 0) * first(luma) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(x - 5, 0) * last(luma) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) // 5 AS v FROM c WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
v AS (SELECT page_id, y, x, (sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(2 - y, 0) * first(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(y + 3 - height, 0) * last(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) // 5 AS blur FROM h WINDOW w AS (PARTITION BY page_id, x ORDER BY y))
SELECT page_id, CAST(sum(blur) AS BIGINT) AS total, CAST(sum(blur * (y * 8 + x + 1)) % 1000003 AS BIGINT) AS checksum FROM v GROUP BY page_id"""))
def box_blur_android(spark, sf):
    return R.raster_signature(R.box_blur(drawn(spark, sf), "android"), "blur")


@query("adaptive_threshold", on_raster(BOX + """,
s AS (SELECT page_id, y, x, luma, sum(r) OVER w AS total, sum(c) OVER w AS places FROM
  (SELECT *, sum(blur) OVER v AS r, count(*) OVER v AS c FROM b WINDOW v AS (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
  WINDOW w AS (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
SELECT page_id, count(*) AS ink, CAST(sum(y * 8 + x + 1) % 1000003 AS BIGINT) AS checksum FROM s WHERE luma * places < total - 8 * places GROUP BY page_id"""))
def adaptive_threshold(spark, sf):
    return R.adaptive_threshold(drawn(spark, sf)).groupBy("page_id").agg(F.count("*").alias("ink"), (F.sum(F.col("y").cast("long") * 8 + F.col("x") + 1) % 1000003).alias("checksum"))


@query("page_polarity", on_raster("""
, p AS (SELECT page_id, luma, y, x, height, greatest(height // 10, 3) AS ph FROM raster JOIN dims USING (page_id)),
c AS (SELECT page_id, luma FROM p WHERE x < 3 AND y < ph UNION ALL SELECT page_id, luma FROM p WHERE x < 3 AND y >= height - ph
  UNION ALL SELECT page_id, luma FROM p WHERE x >= 5 AND y < ph UNION ALL SELECT page_id, luma FROM p WHERE x >= 5 AND y >= height - ph)
SELECT page_id, median(luma)::DOUBLE AS corner_luma, median(luma) < 128 AS dark FROM c GROUP BY page_id"""))
def page_polarity(spark, sf):
    return R.page_polarity(drawn(spark, sf))


@query("corner_patch", on_raster(" SELECT page_id, CAST(greatest(width // 10, 3) AS INTEGER) AS patch_width, CAST(greatest(height // 10, 3) AS INTEGER) AS patch_height FROM dims"))
def corner_patch(spark, sf):
    sizes = raster(spark, sf).groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return sizes.select("page_id", R.corner_patch(F.col("width")).alias("patch_width"), R.corner_patch(F.col("height")).alias("patch_height"))


@query("invert", on_raster(", d AS (SELECT page_id, avg(luma) < 128 AS dark FROM raster GROUP BY page_id) SELECT page_id, CAST(sum(CASE WHEN dark THEN 255 - luma ELSE luma END) AS BIGINT) AS total FROM raster JOIN d USING (page_id) GROUP BY page_id"))
def invert(spark, sf):
    return R.raster_signature(R.upright(drawn(spark, sf))).select("page_id", "total")


@query("raster_signature", on_raster(" SELECT page_id, CAST(sum(luma) AS BIGINT) AS total, CAST(sum(luma * (y * 8 + x + 1)) % 1000003 AS BIGINT) AS checksum FROM raster GROUP BY page_id"))
def raster_signature(spark, sf):
    return R.raster_signature(pages(spark, sf))


RULES = """, m AS (SELECT *, count(*) OVER (PARTITION BY page_id, y, gx) AS rx, count(*) OVER (PARTITION BY page_id, x, gy) AS ry FROM
  (SELECT i.*, width, height, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS gx, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS gy FROM ink i JOIN dims USING (page_id))),
j AS (SELECT page_id, y, x, rx >= greatest(width // 2, 3) OR ry >= greatest(height // 2, 3) AS rule FROM m),
g AS (SELECT page_id, count(*) AS ink, count(*) FILTER (rule) AS rule_ink, count(*) FILTER (rule) * 5 > count(*) * 4 AS abandoned FROM j GROUP BY page_id)"""


@query("suppress_rules", on_ink(RULES + " SELECT j.page_id, j.y, j.x FROM j JOIN g USING (page_id) WHERE NOT rule OR abandoned"))
def suppress_rules(spark, sf):
    return M.pixels_of(M.suppress_rules(ink_masks(spark, sf), least=3))  # the rasters are eight pixels wide


@query("rule_ink_guard", on_ink(RULES + " SELECT * FROM g"))
def rule_ink_guard(spark, sf):
    return M.rule_ink_guard(ink_masks(spark, sf), least=3)


@query("smear", on_ink("""
, a AS (SELECT DISTINCT page_id, y, x + d AS x, height FROM ink JOIN dims USING (page_id), unnest(range(-5, 6)) t(d) WHERE x + d >= 0 AND x + d < 8),
b AS (SELECT DISTINCT page_id, y + d AS y, x FROM a, unnest(range(-2, 3)) t(d) WHERE y + d >= 0 AND y + d < height)
SELECT page_id, count(*) AS n, CAST(sum(y * 8 + x + 1) % 1000003 AS BIGINT) AS checksum FROM b GROUP BY page_id"""))
def smear(spark, sf):
    return M.pixels_of(M.smear(ink_masks(spark, sf))).groupBy("page_id").agg(F.count("*").alias("n"), (F.sum(F.col("y").cast("long") * 8 + F.col("x") + 1) % 1000003).alias("checksum"))


@query("laplacian_variance", on_raster("""
, l AS (SELECT page_id, lag(luma) OVER r + lead(luma) OVER r + lag(luma) OVER c + lead(luma) OVER c - 4 * luma AS lap FROM raster
  WINDOW r AS (PARTITION BY page_id, y ORDER BY x), c AS (PARTITION BY page_id, x ORDER BY y)),
s AS (SELECT page_id, count(lap) AS n, coalesce(sum(lap), 0) AS s, coalesce(sum(lap * lap), 0) AS ss FROM l GROUP BY page_id)
SELECT page_id, CASE WHEN n > 0 THEN (n::DOUBLE * ss::DOUBLE - s::DOUBLE * s::DOUBLE) / (n::DOUBLE * n::DOUBLE) ELSE 0.0::DOUBLE END AS sharpness,
  CASE WHEN n > 0 THEN (n::DOUBLE * ss::DOUBLE - s::DOUBLE * s::DOUBLE) / (n::DOUBLE * n::DOUBLE) ELSE 0 END < 100 AS soft FROM s"""))
def laplacian_variance(spark, sf):
    return R.laplacian_variance(drawn(spark, sf))


@query("contrast_stretch", on_raster("""
, m AS (SELECT *, min(luma) OVER (PARTITION BY page_id) AS lo, max(luma) OVER (PARTITION BY page_id) AS hi FROM raster)
SELECT page_id, y, x, luma, (CASE WHEN hi - lo > 30 THEN (luma - lo) * 255 / (hi - lo) ELSE luma::DOUBLE END) / 127.5::DOUBLE - 1 AS value FROM m"""))
def contrast_stretch(spark, sf):
    return R.contrast_stretch(pages(spark, sf))


SMALL = """, g AS (SELECT page_id, y, x, luma, height, greatest(height // 4, 1) AS th FROM raster JOIN dims USING (page_id)),
e AS (SELECT page_id, luma, th, unnest(range(y * th // height, ((y + 1) * th - 1) // height + 1)) AS cy, x // 4 AS cx, y, height FROM g),
o AS (SELECT page_id, cy, cx, th, least((y + 1) * th, (cy + 1) * height) - greatest(y * th, cy * height) AS w, luma FROM e),
small AS (SELECT page_id, CAST(cy AS INTEGER) AS y, CAST(cx AS INTEGER) AS x, CAST((2 * sum(w * luma) + sum(w)) // (2 * sum(w)) AS INTEGER) AS luma, 2 AS width, CAST(th AS INTEGER) AS height FROM o GROUP BY page_id, cy, cx, th)"""
DISK = SMALL + """, k AS (SELECT *, greatest(height // 4 | 1, 7) // 2 AS r FROM small),
z AS (SELECT k.page_id, k.y + dy AS y, k.x, k.luma, height, round_even(sqrt(r * r - dy * dy), 0)::INTEGER AS half FROM (SELECT *, unnest(range(-r, r + 1)) AS dy FROM k) k WHERE k.y + dy >= 0 AND k.y + dy < height),
disk AS (SELECT page_id, y, x, max(luma) AS luma, 2 AS width, height FROM (SELECT page_id, y, luma, height, x + unnest(range(-half, half + 1)) AS x FROM z) WHERE x >= 0 AND x < 2 GROUP BY page_id, y, x, height)"""


def _sized(found):
    """Pixels of pages, with the sizes of these."""
    height = (F.size("luma") / F.col("width")).cast("int")
    cells = found.select("page_id", "width", height.alias("height"), F.posexplode("luma").alias("p", "luma"))
    return cells.select("page_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "luma", "width", "height")


@query("area_downsample", on_raster(SMALL + " SELECT * FROM small"))
def area_downsample(spark, sf):
    return _sized(R.area_downsample(drawn(spark, sf)))


@query("disk_dilate", on_raster(DISK + " SELECT * FROM disk"))
def disk_dilate(spark, sf):
    return _sized(R.disk_dilate(R.area_downsample(drawn(spark, sf))))


@query("level_background", on_raster(DISK + """,
axes AS (SELECT r.page_id, y, x, luma AS own, height, greatest(height // 4, 1) AS th, greatest((2 * y + 1) * greatest(height // 4, 1) - height, 0) AS py, greatest((2 * x + 1) * 2 - 8, 0) AS px FROM raster r JOIN dims USING (page_id)),
low AS (SELECT *, least(py // (2 * height), th - 1) AS ly, least(px // 16, 1) AS lx FROM axes),
four AS (SELECT page_id, y, x, own, unnest([ly, ly, least(ly + 1, th - 1), least(ly + 1, th - 1)]) AS by_, unnest([lx, least(lx + 1, 1), lx, least(lx + 1, 1)]) AS bx,
  unnest([(2 * height - py + ly * 2 * height) * (16 - px + lx * 16), (2 * height - py + ly * 2 * height) * (px - lx * 16), (py - ly * 2 * height) * (16 - px + lx * 16), (py - ly * 2 * height) * (px - lx * 16)]) AS w FROM low),
level AS (SELECT f.page_id, f.y, f.x, own, sum(w * d.luma) AS v, sum(w) AS w FROM four f JOIN disk d ON d.page_id = f.page_id AND d.y = by_ AND d.x = bx GROUP BY ALL)
SELECT page_id, count(*) AS n, CAST(sum(least(own * 255 * w // greatest(v, w), 255)) AS BIGINT) AS total FROM level GROUP BY page_id"""))
def level_background(spark, sf):
    found = R.level_background(drawn(spark, sf))
    return found.select("page_id", F.size("luma").cast("long").alias("n"), F.aggregate("luma", F.lit(0).cast("long"), lambda total, v: total + v).alias("total"))


@query("crop_columns", on_raster("""
, c AS (SELECT page_id, luma, x - 2 AS x, y - 3 AS y FROM raster WHERE x >= 2 AND x < 7 AND y >= 3 AND y < 20),
s AS (SELECT *, max(x) OVER (PARTITION BY page_id) + 1 AS w, max(y) OVER (PARTITION BY page_id) + 1 AS h FROM c)
SELECT page_id, luma, x AS y, h - 1 - y AS x FROM s"""))
def crop_columns(spark, sf):
    return R.orient(R.crop(raster(spark, sf), 2, 3, 5, 17), R.TURNS[90])


@query("kernel_size", "SELECT doc_id AS id, CAST(greatest((n_chars // 4) | 1, 7) AS INTEGER) AS kernel, CAST(greatest(n_chars // 10, 3) AS INTEGER) AS patch FROM documents")
def kernel_size(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), R.kernel_size(F.col("n_chars")).alias("kernel"), R.corner_patch(F.col("n_chars")).alias("patch"))


@query("row_profile", on_ink(PROFILE + " SELECT page_id, y, raw FROM profile"))
def row_profile(spark, sf):
    return _profiles(spark, sf).select("page_id", F.posexplode("raw").alias("y", "raw")).withColumn("raw", F.col("raw").cast("long"))


@query("smooth_profile", on_ink(PROFILE + " SELECT page_id, y, raw, smooth60, smooth FROM smoothed"))
def smooth_profile(spark, sf):
    rows = L.smooth_profile(_profiles(spark, sf)).select("page_id", F.posexplode(F.arrays_zip("raw", "smooth60", "smooth")).alias("y", "r"))
    return rows.select("page_id", "y", F.col("r.raw").cast("long").alias("raw"), "r.smooth60", "r.smooth")


@query("profile_threshold", on_ink(THRESHOLD + " SELECT * FROM threshold"))
def profile_threshold(spark, sf):
    return L.profile_threshold(_profiles(spark, sf)).select("page_id", "num", "den")


@query("detect_runs", on_ink(RUNS + " SELECT * FROM runs"))
def detect_runs(spark, sf):
    return L.listed(_runs(spark, sf), "runs")


@query("merge_runs", recursive(on_ink(MERGED + " SELECT * FROM merged")))
def merge_runs(spark, sf):
    return L.listed(L.page_bands(_profiles(spark, sf)), "bands")


@query("min_height_filter", on_ink(RUNS + " SELECT page_id, run_no, r0, r1, blank FROM runs WHERE r1 - r0 >= 10"))
def min_height_filter(spark, sf):
    return L.min_height_filter(L.listed(_runs(spark, sf), "runs"))


@query("upper_median", on_ink(RUNS + """
SELECT page_id, list_sort(hs)[len(hs) // 2 + 1] AS median, greatest(coalesce(list_sort(tall)[len(tall) // 2 + 1], list_sort(hs)[len(hs) // 2 + 1]), 1) AS typical
FROM (SELECT page_id, list(r1 - r0) FILTER (r1 - r0 >= 10) AS tall, list(r1 - r0) AS hs FROM runs GROUP BY page_id)"""))
def upper_median(spark, sf):
    heights = _runs(spark, sf).filter(F.size("runs") > 0).select("page_id", F.transform("runs", lambda r: r["r1"] - r["r0"]).alias("hs"))
    return heights.select("page_id", L.upper_median(F.col("hs")).alias("median"), L.typical_height(F.col("hs")).alias("typical"))


@query("band_extents", recursive(on_ink(BOXES + " SELECT * FROM boxes")))
def band_extents(spark, sf):
    return L.box_rows(_boxes(spark, sf))


REJECT = BOXES + """,
medians AS (SELECT page_id, list_sort(hs)[len(hs) // 2 + 1] AS median FROM (SELECT page_id, list(height) FILTER (width >= 2 * height) AS hs FROM boxes GROUP BY page_id)),
kept AS (SELECT b.* FROM boxes b JOIN medians m USING (page_id) WHERE NOT (5 * width < height OR width < 10 OR height < 10)
  AND NOT (median IS NOT NULL AND 2 * width < 5 * height AND 2 * height > 5 * median))"""


@query("reject_outlier_boxes", """
WITH boxes AS (SELECT l_orderkey AS page_id, l_linenumber AS line, CAST(l_quantity * 20 AS INTEGER) AS width, CAST(l_suppkey * 7 % 130 AS INTEGER) AS height FROM lineitem),
medians AS (SELECT page_id, list_sort(hs)[len(hs) // 2 + 1] AS median FROM (SELECT page_id, list(height) FILTER (width >= 2 * height) AS hs FROM boxes GROUP BY page_id))
SELECT b.* FROM boxes b JOIN medians m USING (page_id) WHERE NOT (5 * width < height OR width < 10 OR height < 10)
  AND NOT (median IS NOT NULL AND 2 * width < 5 * height AND 2 * height > 5 * median)""")
def reject_outlier_boxes(spark, sf):
    items = table(spark, sf, "lineitem")  # the rasters' boxes are all under ten pixels wide
    boxes = items.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * 20).cast("int").alias("width"), (F.col("l_suppkey") * 7 % 130).cast("int").alias("height"))
    return L.reject_outlier_boxes(boxes)


FALLBACK = BOXES + """,
every AS (SELECT page_id, line, x, y, width, height, false AS no_regions FROM boxes
  UNION ALL SELECT page_id, 1, 0, 0, width, height, true FROM dims WHERE page_id NOT IN (SELECT page_id FROM boxes)),
shaped AS (SELECT e.*, e.height > 0 AND d.height > 0 AND (e.width >= 4 * e.height OR 5 * e.height <= 2 * d.height) AS line_shaped FROM every e JOIN dims d USING (page_id))"""


@query("whole_page_fallback", recursive(on_ink(FALLBACK + " SELECT * FROM shaped")))
def whole_page_fallback(spark, sf):
    return L.box_rows(_every_box(spark, sf))


@query("looks_like_line", "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity > 0 AND l_suppkey > 0 AND (l_partkey >= 4 * l_quantity OR 5 * l_quantity <= 2 * l_suppkey) AS line_shaped FROM lineitem")
def looks_like_line(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), L.looks_like_line(F.col("l_partkey"), F.col("l_quantity"), F.col("l_suppkey")).alias("line_shaped"))


@query("band_column_ink", recursive(on_ink(FALLBACK + """
SELECT s.page_id, s.line, r.x - s.x AS "column", count(*) FILTER (luma < 250) AS ink FROM shaped s JOIN raster r ON r.page_id = s.page_id
  AND r.x >= s.x AND r.x < s.x + s.width AND r.y >= s.y AND r.y < s.y + s.height GROUP BY ALL""")))
def band_column_ink(spark, sf):
    return L.band_column_ink(_every_box(spark, sf, with_luma=True))


TILES = """
WITH RECURSIVE k AS (SELECT doc_id AS id, text, length(text) AS width, 4 + doc_id % 60 AS height, greatest(CAST(floor(1024 * (4 + doc_id % 60) / 160.0) AS INTEGER), 1) AS tw FROM documents WHERE length(text) > 0),
f AS (SELECT id, width, height, tw, 0 AS x0, 0 AS n, false AS fits, text FROM k WHERE NOT (width * 160 // height <= 1024)
  UNION ALL
  SELECT id, width, height, tw, CASE WHEN ideal >= width THEN width WHEN low >= ideal THEN ideal ELSE greatest(abs(best.c), x0 + 1) END, n + 1, fits, text FROM
  (SELECT *, (SELECT min({'ink': unicode(text[c + 1]) % 7, 'c': CASE WHEN unicode(text[c + 1]) % 7 = 0 THEN -c ELSE c END}) FROM unnest(range(low, ideal)) t(c)) AS best FROM
   (SELECT *, least(x0 + tw, width) AS ideal, greatest(x0 + 1, least(x0 + tw, width) - greatest((least(x0 + tw, width) - x0) * 12 // 100, 1)) AS low FROM f WHERE x0 < width)))
SELECT id, list(x0 ORDER BY n) AS cuts FROM f WHERE n > 0 GROUP BY id UNION ALL SELECT id, [width] FROM k WHERE width * 160 // height <= 1024"""


@query("tile_line", TILES)
def tile_line(spark, sf):
    docs = table(spark, sf, "documents").filter(F.length("text") > 0)
    ink_of = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) % 7)
    lines = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("width"), (F.col("doc_id") % 60 + 4).cast("int").alias("height"), ink_of.alias("ink"))
    return L.tile_line(lines).select("id", "cuts")


@query("tile_scaled_width", "SELECT l_orderkey AS id, l_linenumber AS line, CAST(least(floor(l_partkey * 160 / (l_suppkey + 1)), 1024) AS INTEGER) AS width FROM lineitem")
def tile_scaled_width(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), L.scaled_width(F.col("l_partkey"), F.col("l_suppkey") + 1).alias("width"))


@query("capture_assessment", recursive(on_ink(FALLBACK + """,
l AS (SELECT page_id, lag(luma) OVER r + lead(luma) OVER r + lag(luma) OVER c + lead(luma) OVER c - 4 * luma AS lap FROM raster
  WINDOW r AS (PARTITION BY page_id, y ORDER BY x), c AS (PARTITION BY page_id, x ORDER BY y)),
t AS (SELECT page_id, count(lap) AS n, coalesce(sum(lap), 0) AS s, coalesce(sum(lap * lap), 0) AS ss FROM l GROUP BY page_id),
sharp AS (SELECT page_id, CASE WHEN n > 0 THEN (n::DOUBLE * ss::DOUBLE - s::DOUBLE * s::DOUBLE) / (n::DOUBLE * n::DOUBLE) ELSE 0.0::DOUBLE END AS sharpness FROM t),
found AS (SELECT page_id, list_sort(list(height)) AS hs, count(*) FILTER (NOT line_shaped) AS fused FROM shaped WHERE NOT no_regions GROUP BY page_id),
judged AS (SELECT page_id, sharpness, coalesce(hs[len(hs) // 2 + 1], 0) AS median_height, coalesce(len(hs), 0) AS line_count, coalesce(fused, 0) AS fused FROM sharp LEFT JOIN found USING (page_id))
SELECT *, list_filter([CASE WHEN line_count = 0 THEN 'no_lines' WHEN median_height <= 30 THEN concat('small_text:', CAST(floor(median_height / 2.5 + 0.5) AS INTEGER)) END,
  CASE WHEN sharpness < 100 THEN 'soft' END, CASE WHEN fused > 0 THEN concat('fused:', fused, '/', line_count) END], lambda w: w IS NOT NULL) AS warnings FROM judged""")))
def capture_assessment(spark, sf):
    return L.capture_assessment(L.box_rows(_every_box(spark, sf)), R.laplacian_variance(drawn(spark, sf)))


def flagship(spark, sf):
    return L.box_rows(_boxes(spark, sf))
