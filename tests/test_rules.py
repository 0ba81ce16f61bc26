"""Folds and filters that SQL expresses badly, against plain versions."""

import itertools
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from inkfold.functions import scalars as S
from inkfold.operators import corpus as K
from inkfold.operators import lines as L
from inkfold.operators import masks as M
from inkfold.operators import raster as R
from inkfold.plans import registry


def noise(n, density, seed=2463534242):
    """xorshift32: whether each of n pixels is ink."""
    out, x = [], seed
    for _ in range(n):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        out.append(x % 100 < density)
    return out


def merged(runs, raw, gap_most=10, least=10):
    heights = sorted(b - a for a, b in runs)
    tall = [h for h in heights if h >= least] or heights
    typical = max(1, tall[len(tall) // 2])
    out = [list(runs[0])]
    for a, b in runs[1:]:
        line = out[-1]
        gap = max(0, a - line[1])
        own, so_far = b - a, line[1] - line[0]
        fragment = 2 * min(own, so_far) <= typical and max(own, so_far) >= least
        if gap <= gap_most and (all(raw[y] > 0 for y in range(line[1], a)) or fragment) and b - line[0] <= 2 * typical:
            line[1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_merge_runs(spark):
    rng = random.Random(4)
    pages, want = [], {}
    for page in range(60):
        raw, runs, y = [0] * 720, [], rng.randrange(5)
        while y < 560:
            h = rng.choice([1, 3, 6, 12, 20, 24, 50])
            runs.append((y, y + h))
            y += h
            g = rng.choice([1, 2, 5, 9, 12, 30])
            inked = rng.random() < 0.4
            for i in range(y, y + g):
                raw[i] = int(inked)
            y += g
        for a, b in runs:
            raw[a:b] = [9] * (b - a)
        want[page] = merged(runs, raw)
        pages += [(page, y, v) for y, v in enumerate(raw)]
    profile = spark.createDataFrame(pages, "page_id int, y int, raw long")
    threshold = profile.select("page_id").distinct().select("page_id", F.lit(5).alias("num"), F.lit(1).alias("den"))
    got = L.merge_runs(L.detect_runs(profile, threshold)).collect()
    for page, bands in want.items():
        assert sorted((r.r0, r.r1) for r in got if r.page_id == page) == bands


def tiles(width, height, ink):
    scale = 160 / height
    if int(width * scale) <= 1024:
        return [width]
    tile, x0, cuts = max(1, int(1024 / scale)), 0, []
    while x0 < width:
        ideal = min(x0 + tile, width)
        if ideal >= width:
            cut = width
        else:
            low = max(x0 + 1, ideal - max(1, int((ideal - x0) * 0.12)))
            if low >= ideal:
                cut = ideal
            else:
                blank = [c for c in range(low, ideal) if ink[c] == 0]
                cut = blank[-1] if blank else min(range(low, ideal), key=lambda c: ink[c])
        x0 = max(cut, x0 + 1)
        cuts.append(x0)
    return cuts


def test_tile_line(spark):
    rng = random.Random(8)
    rows = []
    for i, (w, h) in enumerate(itertools.product([1, 40, 700, 1500], [1, 5, 16, 40, 160])):
        rows.append((i, w, h, [rng.randrange(0 if i % 2 else 1, 6) for _ in range(w)]))
    got = L.tile_line(spark.createDataFrame(rows, "id int, width int, height int, ink array<int>")).collect()
    assert {r.id: list(r.cuts) for r in got} == {i: tiles(w, h, ink) for i, w, h, ink in rows}


def test_suppress_rules(spark):
    pixels, want = [], {}
    for page, (w, h, density, rule_rows) in enumerate([(60, 40, 5, [10]), (60, 40, 30, [3, 30]), (40, 80, 0, [5]), (50, 50, 10, [])]):
        ink = [[v for v in noise(w * h, density)[y * w : y * w + w]] for y in range(h)]
        for y in rule_rows:
            ink[y] = [True] * w
        hit = set()
        for y in range(h):
            for on, g in itertools.groupby(range(w), key=lambda x: ink[y][x]):
                g = list(g)
                if on and len(g) >= max(15, w // 2):
                    hit |= {(y, x) for x in g}
        for x in range(w):
            for on, g in itertools.groupby(range(h), key=lambda y: ink[y][x]):
                g = list(g)
                if on and len(g) >= max(15, h // 2):
                    hit |= {(y, x) for y in g}
        every = {(y, x) for y in range(h) for x in range(w) if ink[y][x]}
        want[page] = every if len(hit) * 5 > len(every) * 4 else every - hit
        pixels += [(page, y, x) for y, x in every]
    mask = spark.createDataFrame(pixels, "page_id int, y int, x int")
    dims = spark.createDataFrame([(0, 60, 40), (1, 60, 40), (2, 40, 80), (3, 50, 50)], "page_id int, width int, height int")
    masks = M.runs_of(mask, dims)
    assert sorted(map(tuple, M.pixels_of(masks).collect())) == sorted(pixels)
    got = M.pixels_of(M.suppress_rules(masks)).collect()
    for page, left in want.items():
        assert {(r.y, r.x) for r in got if r.page_id == page} == left


def test_smear_and_profile(spark):
    """Odd masks by runs: pixels widened by definition, and every row's ink and ends; a page without ink too."""
    rng = random.Random(1)
    sizes = {1: (9, 7), 2: (30, 20), 3: (1, 1), 4: (5, 4), 5: (17, 3)}
    ink = {p: {(rng.randrange(h), rng.randrange(w)) for _ in range(0 if p == 4 else w)} for p, (w, h) in sizes.items()}
    mask = spark.createDataFrame([(p, y, x) for p, cells in ink.items() for y, x in cells], "page_id int, y int, x int")
    dims = spark.createDataFrame([(p, w, h) for p, (w, h) in sizes.items()], "page_id int, width int, height int")
    for across, down in ((5, 2), (0, 2), (1, 0)):
        wide = {(p, y + d, x + e) for p, cells in ink.items() for y, x in cells for d in range(-down, down + 1) for e in range(-across, across + 1) if 0 <= y + d < sizes[p][1] and 0 <= x + e < sizes[p][0]}
        masks = M.smear(M.runs_of(mask, dims), across, down)
        got = [tuple(r) for r in M.pixels_of(masks).collect()]
        assert sorted(got) == sorted(wide)
        rows = {(r.page_id, r.y): (r.raw, r.left, r.right) for r in M.row_profile(masks).collect()}
        xs = {(p, y): sorted(x for q, z, x in wide if (q, z) == (p, y)) for p, (_, h) in sizes.items() for y in range(h)}
        assert rows == {k: (len(v), v[0] if v else None, v[-1] if v else None) for k, v in xs.items()}


def test_orientations_and_levelling(spark):
    page = spark.createDataFrame([(1, y, x, 10 * y + x) for y in range(3) for x in range(2)], "page_id int, y int, x int, luma int")
    grid = lambda df: {(r.y, r.x): r.luma for r in df.collect()}
    assert grid(R.orient(page, R.TURNS[90])) == {(0, 0): 20, (0, 1): 10, (0, 2): 0, (1, 0): 21, (1, 1): 11, (1, 2): 1}
    assert grid(R.orient(R.orient(page, R.TURNS[90]), R.TURNS[270])) == grid(page)
    flat = spark.createDataFrame([(1, y, x, 80) for y in range(20) for x in range(16)], "page_id int, y int, x int, luma int")
    assert set(grid(R.pixels_of(R.level_background(R.pages_of(flat)))).values()) == {255}


def test_dilation(spark):
    """Disks of any size on pages of any shape, by definition, and one of 251 rows on a large page."""
    rng = random.Random(6)
    sizes = {1: (1, 1), 2: (5, 3), 3: (17, 9), 4: (3, 20), 5: (12, 12)}
    shade = {p: [[rng.randrange(256) for _ in range(w)] for _ in range(h)] for p, (w, h) in sizes.items()}
    pages = spark.createDataFrame([(p, sizes[p][0], [v for row in rows for v in row]) for p, rows in shade.items()], "page_id long, width int, luma array<int>")
    for kernel in (1, 3, 7, 11, 31):
        r = kernel // 2
        disk = [(dy, dx) for dy in range(-r, r + 1) for half in [round((r * r - dy * dy) ** 0.5)] for dx in range(-half, half + 1)]
        got = {r_.page_id: list(r_.luma) for r_ in R.disk_dilate(pages, kernel).collect()}
        for p, (w, h) in sizes.items():
            want = [max(shade[p][y + dy][x + dx] for dy, dx in disk if 0 <= y + dy < h and 0 <= x + dx < w) for y in range(h) for x in range(w)]
            assert got[p] == want
    large = spark.range(1).select(F.col("id").alias("page_id"), F.lit(1000).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(1_399_999)), lambda i: (i % 251).cast("int")).alias("luma"))
    assert R.disk_dilate(large, 251).select(F.size("luma").alias("n"), F.array_max("luma").alias("most")).first() == (1_400_000, 250)


def test_scalars(spark):
    row = spark.range(1).select(
        S.sanitize_key(F.lit("..a b" + "é" * 100)).alias("key"), S.truncate_error(F.lit("x" * 4095 + "é")).alias("error"), S.output_stem(F.lit("/a/.hidden")).alias("hidden"),
        S.output_stem(F.lit("/a/Two words.tar.gz")).alias("stem"), S.work_digest(F.lit(b"abc"), F.lit("page"), F.lit(300)).alias("digest"),
    ).first()
    import hashlib

    assert row.key == "a_b"
    assert row.error == "x" * 4095 and row.hidden == "hidden" and row.stem == "Two_words.tar"
    assert row.digest == hashlib.sha256((3).to_bytes(8, "little") + b"abc" + b"page" + (300).to_bytes(4, "little") + b"v1").hexdigest()


def plain_unique(names):
    seen, out = set(), []
    for name in names:
        n, unique = 2, name
        while unique in seen:
            n, unique = n + 1, f"{name}-{n}"
        seen.add(unique)
        out.append(unique)
    return out


def unique_names(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "arg_no int, name string").repartition(3)
    got = {r.arg_no: r.unique for r in K.force_unique(rows).collect()}
    return [got[i] for i in range(len(names))]


def test_force_unique(spark):
    assert unique_names(spark, ["foo", "foo", "foo-2"]) == ["foo", "foo-2", "foo-2-2"]
    assert unique_names(spark, ["a", "a", "a-2", "a", "b", "b", "a-2", "b-3"]) == ["a", "a-2", "a-2-2", "a-3", "b", "b-2", "a-2-3", "b-3"]
    long = "scan-20240101123456789012"
    assert unique_names(spark, [long, "scan", "scan", long, "scan-02", "scan-2", "scan-1", "scan", "a\n", "a\n-2", "a\n"]) == plain_unique([long, "scan", "scan", long, "scan-02", "scan-2", "scan-1", "scan", "a\n", "a\n-2", "a\n"])
    empty = spark.createDataFrame([], "arg_no int, name string")
    assert K.force_unique(empty).collect() == [] and K.force_unique(spark.createDataFrame([(1, None)], "arg_no int, name string")).first().unique is None


@pytest.mark.parametrize("seed", range(2))
def test_force_unique_on_random_lists(spark, seed):
    rng = random.Random(seed)
    tails = ["", "", "", "-2", "-3", "-4", "-2-2", "-3-2", "-1", "-02", "-2-2-2", "-99999999999999999999"]
    names = [rng.choice("ab") + rng.choice(tails[: rng.choice([4, 6, 12])]) for _ in range(400)]
    assert unique_names(spark, names) == plain_unique(names)


def test_force_unique_of_one_hot_name(spark):
    """100,000 namesakes with 20,000 numbered names among them; ranks stay in range partitions."""
    names = spark.range(120_000).select(F.col("id").alias("arg_no"), F.when(F.col("id") % 6 == 5, F.concat(F.lit("hot-"), (F.col("id") * 7 % 120_000).cast("string"))).otherwise("hot").alias("name"))
    got = {r.arg_no: r.unique for r in K.force_unique(names).collect()}
    assert [got[i] for i in range(120_000)] == hot_names(names)


def hot_names(names):
    seen, free, out = set(), {}, []
    for r in sorted(names.collect()):
        n, unique = free.get(r.name, 2), r.name
        while unique in seen:
            n, unique = n + 1, f"{r.name}-{n}"
        free[r.name] = n if unique != r.name else 2
        seen.add(unique)
        out.append(unique)
    return out


def test_discovery_and_resume(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("_a.PDF", "b.txt", ".c.png", "deep/d.jpg"):
        (tmp_path / "in" / name).write_bytes(b"x")
    inputs, skipped = K.discover_inputs(spark, [str(tmp_path / "in")])
    assert [r.kind for r in inputs.collect()] == ["pdf"] and skipped.count() == 1
    inputs, _ = K.discover_inputs(spark, [str(tmp_path / "in")], recursive=True)
    assert sorted(r.kind for r in inputs.collect()) == ["image", "pdf"]
    assert K.load_resume_state(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "state").write_text(json.dumps({"input": "a", "digest": "d", "pages": 1}) + "\n{oops\n")
    assert [r.digest for r in K.load_resume_state(spark, str(tmp_path / "state")).collect()] == ["d"]


def test_pages_and_pixels(spark):
    """A row a page and a row a pixel are the same raster."""
    from inkfold.operators import raster as R

    pixels = spark.createDataFrame([(p, y, x, (p * 50 + y * 7 + x * 3) % 256) for p in range(3) for y in range(4 + p) for x in range(5 + 2 * p)], "page_id long, y int, x int, luma int")
    pages = R.pages_of(pixels.repartition(5))
    assert {r.page_id: r.width for r in pages.collect()} == {0: 5, 1: 7, 2: 9}
    assert sorted(map(tuple, R.pixels_of(pages).collect())) == sorted(map(tuple, pixels.collect()))
    assert R.adaptive_threshold(pages.limit(0)).collect() == [] and R.laplacian_variance(pages.limit(0)).collect() == []


def test_sql_functions_are_the_columns(spark):
    """The SQL functions give what the column rules give."""
    S.register_sql_functions(spark)
    rows = spark.createDataFrame([("a<b>&'\"\n.png", 7, True), (".hidden", 403, False), ("x.tar.gz\r\n", 0, False), ("plain", 40, True)], "s string, n int, b boolean")
    n, s, b = F.col("n"), F.col("s"), F.col("b")
    pairs = {
        "ink_header_safe(s)": S.header_safe(s), "ink_xml_escape(s)": S.xml_escape(s), "ink_transcription_name(s, b)": S.transcription_name(s, b), "ink_sync_badge(b, n)": S.sync_badge("ios", b, b, s, n),
        "ink_luma(n, n + 1, 9)": R.luma(n, n + 1, F.lit(9)), "ink_invert(n, b)": R.invert(n, b), "ink_kernel_size(n)": R.kernel_size(n), "ink_corner_patch(n)": R.corner_patch(n),
        "ink_scaled_width(n, 9)": L.scaled_width(n, F.lit(9)), "ink_path_tag(s)": S.path_tag(s), "ink_percent(n, 40)": S.percent(n, F.lit(40)), "ink_page_filename(n)": S.page_filename(n),
        "ink_sanitize_filename(s)": S.sanitize_filename(s), "ink_upload_route(s)": S.upload_route(s), "ink_format_megabytes(n * 99999)": S.format_megabytes(n * 99999),
    }
    got = rows.select(*[F.expr(sql).eqNullSafe(column).alias(sql) for sql, column in pairs.items()]).collect()
    assert all(all(r) for r in got), [r.asDict() for r in got]


def test_long_contents_and_cut_characters(spark):
    import hashlib
    import struct

    big = bytes(range(256)) * 12_000  # over two MiB: its first and last MiB count
    want = hashlib.sha256(struct.pack("<q", len(big)) + big[: 1 << 20] + big[-(1 << 20) :] + b"page" + struct.pack("<i", 300) + b"v1").hexdigest()
    rows = [(1, "x" * 4095 + "é"), (2, "x" * 4094 + "€uro"), (3, "y" * 4093 + "😀z"), (4, "z" * 4093 + "�"), (5, "z" * 4093 + "�" + "more"), (6, "short�")]
    cut = {r.id: r.e for r in spark.createDataFrame(rows, "id int, text string").select("id", S.truncate_error(F.col("text")).alias("e")).collect()}
    assert cut == {i: t.encode()[:4096].decode("utf-8", "ignore") for i, t in rows}
    assert spark.createDataFrame([(bytearray(big),)], "c binary").select(S.work_digest(F.col("c"), F.lit("page"), F.lit(300)).alias("d")).first().d == want


def executed(frame):
    """The plan as it runs."""
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["box_blur", "box_blur_android", "raster_signature", "invert", "contrast_stretch", "page_polarity", "area_downsample", "disk_dilate"])
def test_pages_stay_in_their_task(spark, name):
    """Pixels are neither sorted nor put into windows, and no chain of workers hands the pixels on: what is shuffled is the documents, and a row a page."""
    plan = executed(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan
    assert plan.count("MapInArrow") == (2 if name == "disk_dilate" else 1)


def test_page_statements(spark):
    rng = random.Random(8)
    pages = [(i, w, [rng.choice([0, 90, 127, 200, 255]) for _ in range(w * h)]) for i, (w, h) in enumerate([(1, 1), (2, 3), (8, 40), (45, 31), (7, 100)])]
    frame = spark.createDataFrame(pages, "page_id long, width int, luma array<int>")
    polarity = {r.page_id: (r.corner_luma, r.dark) for r in R.page_polarity(frame).collect()}
    signatures = {r.page_id: (r.total, r.checksum) for r in R.raster_signature(frame).collect()}
    upright = {r.page_id: r.luma for r in R.upright(frame).collect()}
    stretched = {(r.page_id, r.y, r.x): r.value for r in R.contrast_stretch(frame).collect()}
    for i, w, luma in pages:
        h = len(luma) // w
        ph, pw = max(h // 10, 3), max(w // 10, 3)
        corners = [luma[y * w + x] for right in (0, 1) for low in (0, 1) for y in range(h) for x in range(w) if (x >= w - pw if right else x < pw) and (y >= h - ph if low else y < ph)]
        middle = statistics.median(corners)
        assert polarity[i] == (middle, middle < 128)
        assert signatures[i] == (sum(luma), sum((p + 1) * v for p, v in enumerate(luma)) % 1_000_003)
        assert upright[i] == ([255 - v for v in luma] if sum(luma) < 128 * len(luma) else luma)
        low, high = min(luma), max(luma)
        want = [(v - low) * 255 / (high - low) if high - low > 30 else v for v in luma]
        assert all(abs(stretched[i, p // w, p % w] - (v / 127.5 - 1)) < 1e-12 for p, v in enumerate(want))


@pytest.mark.parametrize("name", ["rule_ink_guard", "row_profile", "smooth_profile", "profile_threshold", "detect_runs", "merge_runs", "min_height_filter", "upper_median", "band_extents", "whole_page_fallback", "band_column_ink"])
def test_lines_stay_in_their_task(spark, name):
    """One shuffle, that of the documents; no rows of pages in windows, sorts or joins; at most three workers a task."""
    plan = executed(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") <= (3 if name == "band_column_ink" else 2)


def test_lines_of_pages(spark):
    """Pages in one row each against tables of rows and runs, blank pages and pages of one row among them; boxes and their columns by definition."""
    rng = random.Random(9)
    raws = [[0], [7], [0] * 40, [9] * 35, *[[rng.choice([0, 0, 1, 9, 9, 12]) for _ in range(3) for _ in range(rng.randrange(1, 30))] for _ in range(40)]]
    raws += [[v for _ in range(20) for v in [rng.choice([0, 10])] * rng.randrange(1, 25)] for _ in range(30)]
    pages, ink = [], {}
    for i, raw in enumerate(raws):
        lefts = [rng.randrange(0, 14 - v) if v else None for v in raw]
        ink[i] = [[x for x in range(left, left + v)] if v else [] for left, v in zip(lefts, raw, strict=True)]
        luma = bytearray(255 if x not in row else 0 for row in ink[i] for x in range(14))
        pages.append((i, 14, len(raw), raw, lefts, [left + v - 1 if v else None for left, v in zip(lefts, raw, strict=True)], luma))
    frame = spark.createDataFrame(pages, "page_id long, width int, height int, raw array<int>, left array<int>, right array<int>, luma binary")
    rows = spark.createDataFrame([(i, y, v) for i, raw in enumerate(raws) for y, v in enumerate(raw)], "page_id long, y int, raw long")
    runs = L.detect_runs(rows, L.profile_threshold(frame).select("page_id", "num", "den"))
    order = lambda f: sorted(map(tuple, f.select("page_id", "run_no", "r0", "r1").collect()))
    assert sorted(map(tuple, L.listed(L.page_runs(frame), "runs").collect())) == sorted(map(tuple, runs.collect()))
    bands = order(L.listed(L.page_bands(frame), "bands"))
    assert bands == order(L.merge_runs(runs)) and len(bands) > 100
    want, columns = {}, {}
    for i, no, r0, r1 in bands:
        if r1 - r0 >= 10:
            held, core = [x for row in ink[i][r0:r1] for x in row], r1 - r0
            x, y, x2, y2 = max(min(held) - -(-core // 4), 0), max(r0 - -(-core // 5), 0), min(max(held) + -(-core // 4), 14), min(r1 + -(-core // 5), len(raws[i]))
            want[i, no] = (x, y, x2 - x, y2 - y, False, x2 - x >= 4 * (y2 - y) or 5 * (y2 - y) <= 2 * len(raws[i]))
    for i, raw in enumerate(raws):
        if not any(page == i for page, _ in want):
            want[i, 1] = (0, 0, 14, len(raw), True, 14 >= 4 * len(raw))
    boxes = L.whole_page_fallback(L.page_boxes(frame))
    assert {(r[0], r[1]): tuple(r)[2:] for r in L.box_rows(boxes).collect()} == want
    for (i, no), (x, y, width, height, *_) in want.items():
        for c in range(width):
            columns[i, no, c] = sum(x + c in row for row in ink[i][y : y + height])
    assert {tuple(r)[:3]: r.ink for r in L.band_column_ink(boxes).collect()} == columns


def test_image_names_are_read_once(spark):
    """An image's name is taken from its path before its pixels are parted, not for each of them."""
    plan = executed(registry.QUERIES["image_raster_scan"](spark, "/root/testdata/sf0.001"))
    assert plan.index("regexp_extract") > plan.index("Generate")


def test_images_are_read_some_at_a_time(spark, tmp_path, monkeypatch):
    """Spark is given a few files a read, all of them in the end: in folders of folders, with names that look like patterns, hidden ones and one that is no image among them."""
    from pyspark.sql import DataFrameReader

    from inkfold.sources import images
    from inkfold.sources.derived import png_files

    monkeypatch.setattr(images, "FILES", 10)
    given, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **b: given.append([path] if isinstance(path, str) else path) or load(self, path, *a, **b))
    made = png_files(spark, "/root/testdata/sf0.001").limit(60).collect()
    folders = ["", "a/", "a/b c/", "a/[x]/", "a/x=1/"]
    for i, (name, content) in enumerate(made):
        for place in (folders[i % 5] + name.replace("p", "p*?{%20", 1), f".hidden/{name}", f"_hidden/{name}"):
            (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / place).write_bytes(content)
    (tmp_path / "a/none.png").write_bytes(b"no image")
    pages, refused = images.scan_images(spark, str(tmp_path))
    assert pages.select("origin").distinct().count() == pages.count() == 60 and refused.count() == 1
    assert refused.first().origin.endswith("/a/none.png") and refused.first().reason
    assert len(given) > 3 and max(map(len, given)) <= 30 and sum(map(len, given)) == 61
    assert images.scan_images(spark, str(tmp_path / "a/none.png"))[1].count() == 1 and images.scan_images(spark, f"{tmp_path}/a/*/")[0].count() == 48
    (tmp_path / "empty").mkdir()
    assert images.scan_images(spark, str(tmp_path / "empty"))[0].count() == 0
