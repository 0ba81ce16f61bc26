"""From an ink mask to text-line boxes and tiles. Ratios are kept as whole numbers, so that no rounding decides a row.

Tables: profiles(page_id, width, height, raw, left, right) as in `masks`, a row a page, to which the steps add arrays: runs and bands with exclusive ends, boxes. No step
shuffles or joins anything: a page's row goes through all of them in one task. `listed` and `box_rows` give a row a run or box. A fold runs inside one page's array of runs,
or one line's array of columns. detect_runs and merge_runs take tables of rows and runs instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least height of a line, and the largest gap inside one.
MIN_LINE, MAX_GAP = 10, 10
#: Tiling: height and width that the recogniser takes, and the share of a tile searched for a blank column.
TARGET_HEIGHT, TARGET_WIDTH, SEARCH = 160, 1024, (12, 100)
#: A column pixel is ink below this.
COLUMN_INK = 250


def down_page():
    return W.partitionBy("page_id").orderBy("y")


_RUNS, _BANDS = ("r0", "r1", "blank"), ("r0", "r1")


def _with(profiles: DataFrame, work: Callable, fields: list[tuple]) -> DataFrame:
    """Adds `fields` (name, Spark type, Arrow array of the page's values) to pages, made of each page's profile `raw`; other columns go through as they are."""
    import pyarrow as pa

    columns = profiles.columns
    place = columns.index("raw")

    def rows(it):
        for batch in filter(lambda batch: batch.num_rows, it):
            own = [work(raw.values.to_numpy().astype(np.int64)) for raw in batch.column(place)]
            added = [make([page[k] for page in own]) for k, (_, _, make) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, *(n for n, _, _ in fields)])

    known = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profiles.schema)
    return profiles.mapInArrow(rows, known + "".join(f", {n} {kind}" for n, kind, _ in fields))


def _numbers(pages: list):
    """A long for each page."""
    import pyarrow as pa

    return pa.array(pages, pa.int64())


def _lists(pages: list):
    """A list column of pages' arrays."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pages)]), pa.int32()), pa.array(np.concatenate(pages)))


def _structs(names: tuple[str, ...]) -> Callable:
    """A list column of structs of whole numbers, of pages' arrays with a column for each of the names."""

    def make(pages: list):
        import pyarrow as pa

        cells = pa.StructArray.from_arrays([pa.array(np.concatenate([page[k] for page in pages]).astype(np.int32)) for k in range(len(names))], list(names))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(page[0]) for page in pages)]), pa.int32()), cells)

    return make


def _array_of(names: tuple[str, ...]) -> str:
    return f"array<struct<{','.join(f'{n}:int' for n in names)}>>"


def _smoothed(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows around each row, fewer at the edges."""
    before, at, half = np.concatenate([[0], raw.cumsum()]), np.arange(len(raw)), size // 2
    low, high = np.maximum(at - half, 0), np.minimum(at + half, len(raw) - 1) + 1
    return before[high] - before[low], high - low


def smooth_profile(profiles: DataFrame, size: int = 3) -> DataFrame:
    """Adds smooth: mean over `size` rows, fewer at the edges; smooth60 is 60 times it, a whole number."""

    def work(raw):
        total, n = _smoothed(raw, size)
        return total * 60 // n, total / n

    return _with(profiles, work, [("smooth60", "array<long>", _lists), ("smooth", "array<double>", _lists)])


def _threshold(raw: np.ndarray, size: int = 3, ratio_percent: int = 3) -> tuple[int, int]:
    total, n = _smoothed(raw, size)
    smooth60 = total * 60 // n
    return int(smooth60.sum()) * ratio_percent, max(int((smooth60 > 0).sum()) * 6000, 1)


def profile_threshold(profiles: DataFrame, size: int = 3, ratio_percent: int = 3) -> DataFrame:
    """Adds the threshold as num / den: mean of the smooth rows that aren't 0, times the ratio; 0 / 1 if there are none."""
    return _with(profiles, lambda raw: _threshold(raw, size, ratio_percent), [("num", "long", _numbers), ("den", "long", _numbers)])


def _runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r0, r1 and blank of the maximal runs of rows above the page's threshold."""
    num, den = _threshold(raw)
    edges = np.diff(np.concatenate([[0], (raw * den > num).astype(np.int8), [0]]))
    r0, r1 = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    zeros = np.concatenate([[0], (raw == 0).cumsum()])
    return r0, r1, zeros[r0] - zeros[np.concatenate([[0], r1[:-1]])[: len(r0)]]


def page_runs(profiles: DataFrame) -> DataFrame:
    """Adds `runs` as detect_runs finds them with the page's threshold: (r0, r1, blank) from the top."""
    return _with(profiles, lambda raw: (_runs(raw),), [("runs", _array_of(_RUNS), _structs(_RUNS))])


def page_bands(profiles: DataFrame, max_gap: int = MAX_GAP, least: int = MIN_LINE) -> DataFrame:
    """Adds `bands`: the page's runs joined to lines as by merge_runs, (r0, r1) from the top."""

    def work(raw):
        r0, r1, blank = (a.tolist() for a in _runs(raw))
        heights = sorted(b - a for a, b in zip(r0, r1, strict=True))
        tall = [h for h in heights if h >= least] or heights
        lines = _joined(zip(r0, r1, blank, strict=True), max(tall[len(tall) // 2], 1) if tall else 1, max_gap, least)
        return (np.array(lines, np.int32).reshape(-1, 2).T,)

    return _with(profiles, work, [("bands", _array_of(_BANDS), _structs(_BANDS))])


def listed(pages: DataFrame, name: str) -> DataFrame:
    """(page_id, run_no, …): a row each of the pages' array of runs or bands."""
    rows = pages.select("page_id", F.posexplode(name).alias("_at", "_r"))
    return rows.select("page_id", (F.col("_at") + 1).alias("run_no"), "_r.*")


def detect_runs(profile: DataFrame, threshold: DataFrame) -> DataFrame:
    """(page_id, run_no, r0, r1, blank): maximal runs of raw rows above the threshold; blank: rows without ink between the run before and this."""
    zeros = F.sum((F.col("raw") == 0).cast("int")).over(down_page().rowsBetween(W.unboundedPreceding, 0))
    above = profile.withColumn("zeros", zeros).join(threshold, "page_id").filter(F.col("raw") * F.col("den") > F.col("num"))
    island = above.withColumn("island", F.col("y") - F.row_number().over(down_page()))
    runs = island.groupBy("page_id", "island").agg(F.min("y").alias("r0"), (F.max("y") + 1).alias("r1"), F.min("zeros").alias("zeros"))
    order = W.partitionBy("page_id").orderBy("r0")
    return runs.select(
        "page_id", F.row_number().over(order).alias("run_no"), "r0", "r1", F.coalesce(F.col("zeros") - F.lag("zeros").over(order), F.col("zeros")).cast("int").alias("blank")
    )


def upper_median(values: Column) -> Column:
    """The upper middle of an array; null if it is empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def typical_height(heights: Column, least: int = MIN_LINE) -> Column:
    """Upper median of the heights of at least `least`, of all if there are none; 1 at least."""
    tall = F.filter(heights, lambda h: h >= least)
    return F.greatest(F.coalesce(upper_median(F.when(F.size(tall) > 0, tall).otherwise(heights)), F.lit(1)), F.lit(1))


def _joined(runs, typical: int, max_gap: int, least: int) -> list[list[int]]:
    """[r0, r1] of lines, from a page's runs (r0, r1, blank) from the top."""
    lines: list[list[int]] = []
    for r0, r1, blank in runs:
        if lines:
            top, end = lines[-1]
            high, line = r1 - r0, end - top
            fragment = 2 * min(high, line) <= typical and max(high, line) >= least
            if max(r0 - end, 0) <= max_gap and (blank == 0 or fragment) and r1 - top <= 2 * typical:
                lines[-1][1] = r1
                continue
        lines.append([r0, r1])
    return lines


def merge_runs(runs: DataFrame, max_gap: int = MAX_GAP, least: int = MIN_LINE) -> DataFrame:
    """(page_id, run_no, r0, r1): runs joined to lines, from the top.

    A run joins the line so far if the gap is at most `max_gap`, all its rows hold ink or one of both is a
    fragment of a line, and both together are at most twice as high as a typical run.
    """
    pages = runs.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("r0").cast("int").alias("r0"), F.col("r1").cast("int").alias("r1"), F.col("blank").alias("blank")))).alias("runs"))
    pages = pages.withColumn("typical", typical_height(F.transform("runs", lambda r: r["r1"] - r["r0"]), least))

    def merged(it):
        import pyarrow as pa

        for batch in it:
            out: list[list] = [[], [], [], []]
            for page_id, own, typical in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = _joined(((r["r0"], r["r1"], r["blank"]) for r in own), typical, max_gap, least)
                for column, values in zip(out, ([page_id] * len(lines), range(1, len(lines) + 1), *zip(*lines, strict=True)), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.int32()) for c in out[1:])], ["page_id", "run_no", "r0", "r1"])

    return pages.select("page_id", "runs", "typical").mapInArrow(merged, "page_id long, run_no int, r0 int, r1 int")


def min_height_filter(bands: DataFrame, least: int = MIN_LINE) -> DataFrame:
    return bands.filter(F.col("r1") - F.col("r0") >= least)


def band_extents(pages: DataFrame, least: int = MIN_LINE) -> DataFrame:
    """Adds `boxes` (line, x, y, width, height) of the pages' `bands` of at least that height: around each band's ink, padded by a quarter of its height across and a fifth up and down."""
    wide, high = F.col("width"), F.col("height")

    def box(band: Column, at: Column) -> Column:
        core = band["r1"] - band["r0"]
        pad = lambda num, den: F.ceil(core * num / den).cast("int")
        inked = lambda ends: F.slice(ends, band["r0"] + 1, core)
        x, y = F.greatest(F.array_min(inked("left")) - pad(1, 4), F.lit(0)), F.greatest(band["r0"] - pad(1, 5), F.lit(0))
        x2, y2 = F.least(F.array_max(inked("right")) + pad(1, 4), wide), F.least(band["r1"] + pad(1, 5), high)
        return F.when(core >= least, F.struct((at + 1).alias("line"), x.alias("x"), y.alias("y"), (x2 - x).alias("width"), (y2 - y).alias("height")))

    return pages.withColumn("boxes", F.array_compact(F.transform("bands", box)))


def page_boxes(profiles: DataFrame) -> DataFrame:
    """Adds `boxes` of a page's text lines: threshold, runs, merging, height, extents."""
    return band_extents(page_bands(profiles))


def box_rows(pages: DataFrame) -> DataFrame:
    """(page_id, line, x, y, width, height, …): a row a box."""
    return pages.select("page_id", F.inline("boxes"))


def reject_outlier_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes without slivers, specks, and blocks far higher than the page's line-like boxes."""
    wide = F.filter("all", lambda b: b["width"] >= 2 * b["height"])
    medians = boxes.groupBy("page_id").agg(F.collect_list(F.struct("width", "height")).alias("all")).select("page_id", upper_median(F.transform(wide, lambda b: b["height"])).alias("median"))
    w, h = F.col("width"), F.col("height")
    speck = (5 * w < h) | (w < 10) | (h < 10)
    block = F.col("median").isNotNull() & (2 * w < 5 * h) & (2 * h > 5 * F.col("median"))
    return boxes.join(medians, "page_id").filter(~speck & ~block).drop("median")


def looks_like_line(width: Column, height: Column, page_height: Column) -> Column:
    """At least four times as wide as high, or at most two fifths of the page high."""
    return (height > 0) & (page_height > 0) & ((width >= 4 * height) | (5 * height <= 2 * page_height))


def whole_page_fallback(pages: DataFrame) -> DataFrame:
    """The pages' boxes with no_regions and line_shaped; a page without any gets one box over all of it."""
    shaped = lambda b: looks_like_line(b["width"], b["height"], F.col("height"))
    found = F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in ("line", "x", "y", "width", "height")], F.lit(False).alias("no_regions"), shaped(b).alias("line_shaped")))
    whole = {"width": F.col("width"), "height": F.col("height")}
    one = F.struct(F.lit(1).alias("line"), F.lit(0).alias("x"), F.lit(0).alias("y"), *[v.alias(c) for c, v in whole.items()], F.lit(True).alias("no_regions"), shaped(whole).alias("line_shaped"))
    return pages.withColumn("boxes", F.when(F.size("boxes") > 0, found).otherwise(F.array(one)))


def band_column_ink(pages: DataFrame) -> DataFrame:
    """(page_id, line, column, ink): pixels below COLUMN_INK in each column of each of the pages' boxes, columns from the box's left. pages: with their luma as bytes."""

    def rows(it):
        import pyarrow as pa

        for batch in it:
            for page_id, width, luma, boxes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                dark = np.frombuffer(luma.as_buffer(), np.uint8).reshape(-1, width) < COLUMN_INK
                inside = [(b["line"], dark[b["y"] : b["y"] + b["height"], b["x"] : b["x"] + b["width"]].sum(0)) for b in boxes if b["height"] > 0 and b["width"] > 0]
                if inside:
                    lines, inks = [np.full(len(ink), line, np.int32) for line, ink in inside], [ink for _, ink in inside]
                    ids, places = np.full(sum(map(len, inks)), page_id), [np.arange(len(ink), dtype=np.int32) for ink in inks]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate(a)) for a in (lines, places, inks))], ["page_id", "line", "column", "ink"])

    return pages.select("page_id", "width", "luma", "boxes").mapInArrow(rows, "page_id long, line int, column int, ink long")


def scaled_width(width: Column, height: Column) -> Column:
    return F.least(F.floor(width * TARGET_HEIGHT / height), F.lit(TARGET_WIDTH)).cast("int")


def tile_line(lines: DataFrame, target_height: int = TARGET_HEIGHT, target_width: int = TARGET_WIDTH) -> DataFrame:
    """Adds `cuts`: right edges of each line's tiles. lines: width, height and ink, the ink of each column.

    A line that is too wide at the target height is cut before each full tile: at the rightmost blank column of
    the last 12 % of it, else at the first one with the least ink.
    """
    w, h = F.col("width"), F.col("height")
    fits = (h <= 0) | (w <= 0) | (F.floor(w * target_height / F.greatest(h, F.lit(1))) <= target_width)
    tile = F.greatest(F.floor(F.lit(target_width) * h / target_height).cast("int"), F.lit(1))

    def step(acc: Column, _: Column) -> Column:
        x0 = acc["x0"]
        ideal = F.least(x0 + tile, w)
        reach = F.greatest(F.floor((ideal - x0) * SEARCH[0] / SEARCH[1]).cast("int"), F.lit(1))
        low = F.greatest(x0 + 1, ideal - reach)
        places = F.sequence(low, ideal - 1)
        ink = F.transform(places, lambda c: F.struct(F.get("ink", c).alias("ink"), F.when(F.get("ink", c) == 0, -c).otherwise(c).alias("c")))
        best = F.abs(F.array_min(ink)["c"])
        cut = F.when(ideal >= w, w).when(low >= ideal, ideal).otherwise(F.greatest(best, x0 + 1))
        return F.when(x0 >= w, acc).otherwise(F.struct(cut.alias("x0"), F.concat(acc["cuts"], F.array(cut)).alias("cuts")))

    zero = F.struct(F.lit(0).alias("x0"), F.array().cast("array<int>").alias("cuts"))
    turns = F.sequence(F.lit(1), F.greatest(w, F.lit(1)))
    return lines.withColumn("cuts", F.when(fits, F.array(w)).otherwise(F.aggregate(turns, zero, step, lambda acc: acc["cuts"])))


def capture_assessment(boxes: DataFrame, sharpness: DataFrame, small: int = 30, soft_below: float = 100.0) -> DataFrame:
    """page_id, sharpness, median_height, line_count, fused, and in order the warnings that apply. boxes: with line_shaped and no_regions."""
    found = boxes.filter("not no_regions").groupBy("page_id").agg(F.collect_list("height").alias("heights"), F.sum((~F.col("line_shaped")).cast("int")).alias("fused"))
    page = sharpness.select("page_id", "sharpness").join(found, "page_id", "left")
    median, n = F.coalesce(upper_median(F.col("heights")), F.lit(0)), F.coalesce(F.size("heights"), F.lit(0))
    page = page.select("page_id", "sharpness", median.alias("median_height"), F.when(F.col("heights").isNull(), 0).otherwise(n).alias("line_count"), F.coalesce("fused", F.lit(0)).alias("fused"))
    text = F.when(F.col("line_count") == 0, "no_lines").when(F.col("median_height") <= small, F.format_string("small_text:%d", F.floor(F.col("median_height") / 2.5 + 0.5)))
    every = F.array(text, F.when(F.col("sharpness") < soft_below, "soft"), F.when(F.col("fused") > 0, F.format_string("fused:%d/%d", "fused", "line_count")))
    return page.withColumn("warnings", F.filter(every, lambda w: w.isNotNull()))
