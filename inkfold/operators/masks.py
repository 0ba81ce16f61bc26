"""Ink masks by runs: a row for each page, (page_id, width, height, runs), with the runs of ink of its rows as (y, x0, x1), x1 exclusive, by row and place.

Masks come from page rasters, a row a page too, and are smeared, cleared of rules and summed up in the task that has the page: nothing is shuffled before the row
profile, and a page's mask is as long as its runs. NumPy works on one page at a time; a page has to fit a task, as everywhere here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.raster import LEAST_SPAN, SPAN_SHARE, Drawn, dark_pixels, drawn_of

_PAGE_PROFILE = ["page_id", "width", "height", "raw", "left", "right"]
_PROFILE = ["page_id", "y", "raw", "left", "right", "width", "height"]
RUNS = "page_id long, width int, height int, runs array<struct<y:int,x0:int,x1:int>>"


def runs_in(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of a mask's rows."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), x1 = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    return y, x0, x1


def dense(runs: tuple[np.ndarray, np.ndarray, np.ndarray], height: int, width: int) -> np.ndarray:
    """The mask of runs that don't overlap."""
    edges = np.zeros((height, width + 1), np.int32)
    y, x0, x1 = runs
    np.add.at(edges, (y, x0), 1)
    np.add.at(edges, (y, x1), -1)
    return edges.cumsum(1)[:, :width] > 0


def _batch(page_id, width: int, height: int, runs: tuple[np.ndarray, ...]):
    import pyarrow as pa

    cells = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)) for a in runs], ["y", "x0", "x1"])
    lists = pa.ListArray.from_arrays(pa.array([0, len(runs[0])], pa.int32()), cells)
    return pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), lists], ["page_id", "width", "height", "runs"])


def _from_pages(pages: DataFrame | Drawn, dark: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    source, draw = drawn_of(pages)

    def rows(it):
        for batch in it:
            for page_id, a in draw(batch):
                yield _batch(page_id, a.shape[1], len(a), runs_in(dark(a)))

    return source.mapInArrow(rows, RUNS)


def ink_runs(pages: DataFrame | Drawn, below: int) -> DataFrame:
    """The pixels darker than `below`. pages: page_id, width, luma."""
    return _from_pages(pages, lambda a: a < below)


def profiles(pages: DataFrame | Drawn, dark: Callable[[np.ndarray], np.ndarray], with_luma: bool = False) -> DataFrame:
    """(page_id, width, height, raw, left, right): a row a page, with row_profile of its mask as arrays by row. dark: a page's mask; with_luma adds its pixels as bytes."""
    source, draw = drawn_of(pages)

    def rows(it):
        import pyarrow as pa

        by_row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        for batch in it:
            for page_id, a in draw(batch):
                raw, left, right = profile_of(runs_in(dark(a)), len(a))
                columns = [pa.array([page_id], pa.int64()), *(pa.array([n], pa.int32()) for n in a.shape[::-1]), by_row(pa.array(raw.astype(np.int32)))]
                columns += [by_row(pa.array(end, mask=raw == 0)) for end in (left, right)]
                columns += [pa.array([a.astype(np.uint8).tobytes()], pa.binary())] * with_luma
                yield pa.RecordBatch.from_arrays(columns, [*_PAGE_PROFILE, *["luma"] * with_luma])

    return source.mapInArrow(rows, "page_id long, width int, height int, raw array<int>, left array<int>, right array<int>" + ", luma binary" * with_luma)


def adaptive_runs(pages: DataFrame | Drawn, surface: str = "web", radius: int = 12, constant: int = 8) -> DataFrame:
    """The mask of adaptive_threshold, by runs."""
    return _from_pages(pages, lambda a: dark_pixels(a, surface, radius, constant))


def runs_of(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """A mask of pixels (page_id, y, x), by runs. dims: page_id, width, height of all pages."""
    place = pixels.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("y", "x"))).alias("ink"))

    def rows(it):
        for batch in it:
            for page_id, width, height, ink in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                mask = np.zeros((height, width), bool)
                if ink.is_valid:
                    mask[ink.values.field(0).to_numpy(), ink.values.field(1).to_numpy()] = True
                yield _batch(page_id, width, height, runs_in(mask))

    return dims.select("page_id", "width", "height").join(place, "page_id", "left").mapInArrow(rows, RUNS)


def pixels_of(masks: DataFrame) -> DataFrame:
    """(page_id, y, x) of the ink."""
    return masks.select("page_id", F.explode("runs").alias("r")).select("page_id", "r.y", F.explode(F.sequence("r.x0", F.col("r.x1") - 1)).alias("x"))


def _arrays(run_list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(run_list.values.field(i).to_numpy() for i in range(3))


def _each(masks: DataFrame, work: Callable) -> DataFrame:
    """work: runs, height and width of a page in, runs out."""

    def rows(it):
        for batch in it:
            for page_id, width, height, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                yield _batch(page_id, width, height, work(_arrays(runs), height, width))

    return masks.select("page_id", "width", "height", "runs").mapInArrow(rows, RUNS)


def _widened(mask: np.ndarray, n: int) -> np.ndarray:
    """Each pixel widened by n along its row."""
    total = np.pad(mask.cumsum(1, dtype=np.int64), ((0, 0), (1, 0)))
    at = np.arange(mask.shape[1])
    return total[:, np.minimum(at + n + 1, mask.shape[1])] > total[:, np.maximum(at - n, 0)]


def widened(mask: np.ndarray, across: int, down: int) -> np.ndarray:
    """A mask smeared: each ink pixel widened by `across`, then by `down`, inside the page."""
    return _widened(_widened(mask, across).T, down).T


def smear(masks: DataFrame, across: int = 5, down: int = 2) -> DataFrame:
    """Each ink pixel widened by `across`, then by `down`, inside the page."""
    return _each(masks, lambda runs, height, width: runs_in(widened(dense(runs, height, width), across, down)))


def _rules(mask: np.ndarray, least: int, share: float) -> np.ndarray:
    """Unbroken runs of ink as long as a rule, of both axes, as a mask."""
    rules = np.zeros_like(mask)
    for a, out, side in ((mask, rules, mask.shape[1]), (mask.T, rules.T, mask.shape[0])):
        y, x0, x1 = runs_in(a)
        long = x1 - x0 >= max(int(side * share), least)
        out |= dense((y[long], x0[long], x1[long]), *a.shape)
    return rules


def _abandoned(ink: int, rule_ink: int) -> bool:
    """Whether rules hold so much of the ink that they are left alone."""
    return bool(rule_ink * 5 > ink * 4)


def suppress_rules(masks: DataFrame, least: int = LEAST_SPAN, share: float = SPAN_SHARE) -> DataFrame:
    """The masks without unbroken runs of ink as long as a rule; pages whose rules hold over 4/5 of the ink are left alone.

    Runs of both axes are found in the mask as it came.
    """

    def work(runs, height, width):
        mask = dense(runs, height, width)
        rules = _rules(mask, least, share)
        return runs if _abandoned(mask.sum(), rules.sum()) else runs_in(mask & ~rules)

    return _each(masks, work)


def rule_ink_guard(masks: DataFrame, least: int = LEAST_SPAN, share: float = SPAN_SHARE) -> DataFrame:
    """page_id, ink, rule_ink, abandoned of the pages with ink: what decides whether suppress_rules leaves a page alone."""

    def rows(it):
        import pyarrow as pa

        for batch in it:
            out = []
            for page_id, width, height, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                mask = dense(_arrays(runs), height, width)
                out.append((page_id, int(mask.sum()), int(_rules(mask, least, share).sum())))
            ids, ink, ruled = (pa.array([o[i] for o in out], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([ids, ink, ruled, pa.array([_abandoned(o[1], o[2]) for o in out], pa.bool_())], ["page_id", "ink", "rule_ink", "abandoned"])

    found = masks.select("page_id", "width", "height", "runs").filter(F.size("runs") > 0)
    return found.mapInArrow(rows, "page_id long, ink long, rule_ink long, abandoned boolean")


def profile_of(runs: tuple[np.ndarray, np.ndarray, np.ndarray], height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ink of every row, and its first and last place, from a page's runs."""
    y, x0, x1 = runs
    raw, left, right = np.bincount(y, x1 - x0, height).astype(np.int64), np.full(height, np.iinfo(np.int32).max, np.int32), np.full(height, -1, np.int32)
    np.minimum.at(left, y, x0.astype(np.int32))
    np.maximum.at(right, y, x1.astype(np.int32) - 1)
    return raw, left, right


def row_profile(masks: DataFrame) -> DataFrame:
    """(page_id, y, raw, left, right, width, height): ink of every row, and its first and last place (null in a row without any)."""

    def rows(it):
        import pyarrow as pa

        for batch in it:
            for page_id, width, height, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                raw, left, right = profile_of(_arrays(runs), height)
                own = {"page_id": np.full(height, page_id), "y": np.arange(height, dtype=np.int32), "raw": raw, "width": np.full(height, width, np.int32), "height": np.full(height, height, np.int32)}
                ends = {n: pa.array(a, pa.int32(), mask=raw == 0) for n, a in (("left", left), ("right", right))}
                columns = {n: pa.array(a) for n, a in own.items()} | ends
                yield pa.RecordBatch.from_arrays([columns[n] for n in _PROFILE], _PROFILE)

    kinds = {"page_id": "long", "raw": "long"}
    return masks.select("page_id", "width", "height", "runs").mapInArrow(rows, ", ".join(f"{n} {kinds.get(n, 'int')}" for n in _PROFILE))
