"""Lines to pages to documents, and what to say about them. Ordered text is gathered by page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.operators.corpus import shown_pages


def _ordered(value: Column, *order: str) -> Column:
    """The non-null values in order, as an array."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("value")))))
    return F.transform(rows, lambda r: r["value"])


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def assemble_page(lines: DataFrame) -> DataFrame:
    """(doc, page, status, text, line_count, failed_line_count): read lines with text, one below the other.

    Every line failed: status failed, no text. Some failed and the rest blank: still a page.
    """
    read = F.when((F.col("state") == "read") & ~_blank(F.col("text")), F.col("text"))
    page = lines.groupBy("doc", "page").agg(_ordered(read, "line").alias("texts"), F.count("*").alias("line_count"), F.count_if(F.col("state") == "failed").alias("failed_line_count"))
    failed = F.col("failed_line_count") == F.col("line_count")
    return page.select("doc", "page", F.when(failed, "failed").otherwise("read").alias("status"), F.when(~failed, F.array_join("texts", "\n")).alias("text"), "line_count", "failed_line_count")


def combine_pages(pages: DataFrame, variant: str = "web") -> DataFrame:
    """(doc, text, error): page texts under their headings. web, android and cli leave blank pages out, ios shows and trims."""
    n = (F.col("page") + 1).cast("string")
    heading = {"web": F.concat(F.lit("--- Page "), n, F.lit(" ---\n")), "ios": F.concat(F.lit("--- Page "), n, F.lit(" ---\n")), "android": F.concat(F.lit("Page "), n, F.lit("\n")), "cli": F.lit("")}[variant]
    own = F.when((F.col("status") == "read") & (F.lit(variant == "ios") | ~_blank(F.col("text"))), F.concat(heading, F.col("text")))
    docs = pages.groupBy("doc").agg(_ordered(own, "page").alias("texts"), F.count_if(F.col("status") == "read").alias("read"))
    text = F.array_join("texts", "\n\n")
    text = F.regexp_replace(text, r"^\s+|\s+$", "") if variant == "ios" else text
    return docs.select("doc", F.when(F.col("read") > 0, text).alias("text"), F.when(F.col("read") == 0, "No page could be read.").alias("error"))


def combine_totals(pages: DataFrame) -> DataFrame:
    """Sums and flags of a document's pages."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return pages.groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum("line_count").alias("lines"), F.sum("failed_line_count").alias("failed_lines"), F.sum(words).alias("words"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.bool_or(F.col("failed_line_count") > 0).alias("partial"),
    )


def document_warnings(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, warnings): missing pages, failed lines, then each note once with its pages, in the order first seen.

    notes: doc, page, position, note. Page numbers are shown from 1.
    """
    numbers = lambda rule: F.array_sort(F.collect_list(F.when(rule, F.col("page") + 1)))
    joined = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ", ")
    short = (F.col("status") == "read") & (F.col("failed_line_count") > 0)
    judged = pages.groupBy("doc").agg(numbers(F.col("status") == "failed").alias("missing"), numbers(short).alias("short"), F.sum(F.when(short, F.col("failed_line_count"))).alias("lost"), F.count("*").alias("n"))
    each = notes.groupBy("doc", "note").agg(F.array_sort(F.collect_set(F.col("page") + 1)).alias("on"), F.min(F.struct("page", "position")).alias("seen"))
    said = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seen", F.concat(F.lit("Page(s) "), joined(F.col("on")), F.lit(": "), F.col("note")).alias("note")))).alias("said"))
    head = F.array(
        F.when(F.size("missing") > 0, F.concat(F.lit("Page(s) "), joined(F.col("missing")), F.lit(" of "), F.col("n").cast("string"), F.lit(" could not be read. Their text is missing."))),
        F.when(F.size("short") > 0, F.concat(F.col("lost").cast("string"), F.lit(" line(s) on page(s) "), joined(F.col("short")), F.lit(" could not be read. The text is incomplete; check it against the source."))),
    )
    both = judged.join(said, "doc", "left")
    tail = F.coalesce(F.transform("said", lambda s: s["note"]), F.array().cast("array<string>"))
    return both.select("doc", F.concat(F.filter(head, lambda w: w.isNotNull()), tail).alias("warnings"))


def page_status(lines: DataFrame, surface: str = "android") -> DataFrame:
    """(doc, page, status) from a page's lines; reasons: array of review reasons for ios."""
    failed, n = F.count_if(F.col("state") == "failed"), F.count("*")
    blank = F.bool_and(_blank(F.col("text")))
    if surface == "android":
        status = F.when(failed == n, "INFERENCE_FAILED").when(failed > 0, "PARTIAL").when(blank, "EMPTY_UNVERIFIED").otherwise("COMPLETE")
    else:
        bare = F.bool_or(F.array_contains("reasons", "no_regions_detected"))
        status = F.when((failed == 0) & bare, "noRegionsDetected").when((failed == 0) & blank, "emptyUnverified").when(failed == 0, "completed").when(failed == n, "inferenceFailed").otherwise("partial")
    return lines.groupBy("doc", "page").agg(status.alias("status"))


#: Texts that a page's outcome carries.
LINES_UNREAD, RENDER_FAILED = "No detected line could be read completely.", "The page could not be rendered."


def page_outcomes(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, page, state, error, was_read) for every page, from its facts and its lines.

    pages: doc, page, attempted, cancelled, rendered; lines: doc, page, text, reasons. A line with the reason tile_failed is unread.
    """
    unread = F.array_contains("reasons", "tile_failed")
    found = lines.groupBy("doc", "page").agg(F.count("*").alias("n"), F.count_if(unread).alias("failed"), F.bool_or(F.array_contains("reasons", "no_regions_detected")).alias("bare"), F.bool_and(F.coalesce("text", F.lit("")) == "").alias("blank"))
    both = pages.join(found, ["doc", "page"], "left")
    n, failed = F.coalesce("n", F.lit(0)), F.coalesce("failed", F.lit(0))
    state = (
        F.when(~F.col("attempted"), F.when(F.col("cancelled"), "cancelled").otherwise("notAttempted")).when(~F.col("rendered"), "renderFailed")
        .when((failed == 0) & F.coalesce("bare", F.lit(False)), "noRegionsDetected").when((failed == 0) & F.coalesce("blank", F.lit(True)), "emptyUnverified").when(failed == 0, "completed")
        .when(failed == n, "inferenceFailed").otherwise("partial")
    )
    judged = both.select("doc", "page", state.alias("state"))
    error = F.when(F.col("state") == "inferenceFailed", LINES_UNREAD).when(F.col("state") == "renderFailed", RENDER_FAILED)
    return judged.select("doc", "page", "state", error.alias("error"), F.col("state").isin("completed", "partial", "emptyUnverified", "noRegionsDetected").alias("was_read"))


def review_warnings(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, warnings): typed warnings with counts, in display order. pages: doc, page, status, cancelled, soft; lines: doc, reasons, line_shaped."""
    unread = F.col("status").isin("renderFailed", "inferenceFailed")
    left = F.count_if(F.col("status").isin("notAttempted", "cancelled"))
    by_page = pages.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.when(unread, F.col("page") + 1))).alias("unread"), F.bool_or("cancelled").alias("cancelled"), left.alias("left"), F.count("*").alias("n"),
        F.bool_or(F.col("status") == "emptyUnverified").alias("empty"), F.bool_or("soft").alias("soft"),
    )
    has = lambda r: F.array_contains("reasons", r)
    by_line = lines.groupBy("doc").agg(F.bool_or(has("no_regions_detected")).alias("bare"), F.count_if(has("tile_failed")).alias("failed"), F.count_if(has("empty_tile_between_text")).alias("seams"), F.count_if(~F.col("line_shaped")).alias("blocks"))
    every = F.array(
        F.when(F.size("unread") > 0, F.concat(F.lit("pages_unread:"), F.array_join(F.transform("unread", lambda p: p.cast("string")), ", "))), F.when(F.col("cancelled"), "cancelled"),
        F.when((F.col("left") > 0) & ~F.col("cancelled"), F.format_string("unfinished:%d of %d", "left", "n")), F.when(F.col("empty"), "empty_unverified"), F.when(F.col("bare"), "no_regions_detected"),
        F.when(F.col("failed") > 0, F.format_string("lines_unread:%d", "failed")), F.when(F.col("seams") > 0, F.format_string("uncertain_seams:%d", "seams")), F.when(F.col("soft"), "soft"),
        F.when(F.col("blocks") > 0, F.format_string("blocks:%d", "blocks")),
    )
    return by_page.join(by_line, "doc", "left").select("doc", F.filter(every, lambda w: w.isNotNull()).alias("warnings"))


def assemble_tiles(tiles: DataFrame) -> DataFrame:
    """(line_id, state, text, reasons): tiles one after the other; a failed tile fails the line; a gap between texts is noted."""
    full = ~_blank(F.col("text")) & (F.col("state") == "read")
    line = tiles.groupBy("line_id").agg(
        _ordered(F.when(full, F.col("text")), "tile").alias("texts"), F.bool_or(F.col("state") == "failed").alias("failed"),
        F.min(F.when(full, F.col("tile"))).alias("first"), F.max(F.when(full, F.col("tile"))).alias("last"), F.collect_list(F.when(~full, F.col("tile"))).alias("bare"),
    )
    seam = F.exists("bare", lambda t: (t > F.col("first")) & (t < F.col("last")))
    reasons = F.filter(F.array(F.when(F.col("failed"), "tile_failed"), F.when(F.coalesce(seam, F.lit(False)), "empty_tile_between_text")), lambda r: r.isNotNull())
    return line.select("line_id", F.when(F.col("failed"), "failed").otherwise("read").alias("state"), F.when(~F.col("failed"), F.array_join("texts", "")).alias("text"), reasons.alias("reasons"))


def reading_order(tiles: DataFrame) -> DataFrame:
    """(doc, page, text): a page's lines from the top, each its tiles by index without a separator; lines without text give no row of it. tiles: doc, page, line, y, tile, text.

    A page's tiles are gathered in one task; sort keys go with them, so that any order of the input will do.
    """
    lines = tiles.groupBy("doc", "page", "line").agg(F.min("y").alias("y"), F.array_join(_ordered(F.col("text"), "tile"), "").alias("text"))
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("y", "line", "text"))))
    return lines.groupBy("doc", "page").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def uncertain_seam(tiles: DataFrame) -> DataFrame:
    """Empty tiles strictly between the first and the last tile with text of their line."""
    line = W.partitionBy("line_id")
    full = F.when(~_blank(F.col("text")), F.col("tile"))
    marked = tiles.withColumns({"first": F.min(full).over(line), "last": F.max(full).over(line)})
    return marked.filter(_blank(F.col("text")) & (F.col("tile") > F.col("first")) & (F.col("tile") < F.col("last"))).drop("first", "last")


def first_failure(lines: DataFrame) -> DataFrame:
    """(doc, page, error) of the lowest failing page and line."""
    bad = lines.filter("state = 'failed'").groupBy("doc").agg(F.min(F.struct("page", "line", "error")).alias("f"))
    return bad.select("doc", "f.page", "f.error")


def page_verdict(pages: DataFrame) -> DataFrame:
    """(doc, verdict, message): how an input ended, judged from its pages. pages: doc, page, status, text, error."""
    read, failed = F.count_if(F.col("status") == "read"), F.count_if(F.col("status") == "failed")
    tally = pages.groupBy("doc").agg(
        read.alias("read"), failed.alias("failed"), F.count_if((F.col("status") == "read") & ~_blank(F.col("text"))).alias("with_text"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("page") + 1))).alias("bad"), F.min_by("error", F.when(F.col("status") == "failed", F.col("page"))).alias("error"),
    )
    r, f = F.col("read"), F.col("failed")
    verdict = F.when((r == 0) & (f == 0), "not_started").when(r == 0, "unread").when((f == 0) & (F.col("with_text") == 0), "no_text").when(f == 0, "read").otherwise("partial")
    message = F.when(F.col("verdict") == "no_text", F.format_string("no text found on %d page(s); this is not an error", "read"))
    message = message.when(F.col("verdict") == "partial", F.concat(F.format_string("warning: %d of %d page(s) could not be read (page ", f, r + f), shown_pages(F.col("bad")), F.lit(")")))
    message = message.when(F.col("verdict") == "unread", F.concat(F.format_string("none of the %d page(s) could be read; the first error was: ", "failed"), F.coalesce("error", F.lit(""))))
    return tally.withColumn("verdict", verdict).select("doc", "verdict", message.alias("message"))


def run_end(verdicts: DataFrame) -> DataFrame:
    """One row: (success, message)."""
    total = verdicts.agg(F.count_if(F.col("verdict") == "unread").alias("failed"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count("*").alias("total"))
    message = F.when(F.col("failed") > 0, F.format_string("%d of %d input(s) failed; see manifest.jsonl", "failed", "total"))
    message = message.when(F.col("partial") > 0, F.format_string("warning: %d of %d input(s) were only partly read; see manifest.jsonl for the pages that failed", "partial", "total"))
    return total.select((F.col("failed") == 0).alias("success"), message.alias("message"))


def timeout_budget(pages: DataFrame, budget: int = 2) -> DataFrame:
    """Adds outcome: after `budget` timed-out pages of a document, the rest are not attempted. pages: doc, page, timed_out."""
    before = F.coalesce(F.sum(F.col("timed_out").cast("int")).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("outcome", F.when(before >= budget, "Not attempted").when(F.col("timed_out"), "timed_out").otherwise("read"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each key, if it was not cancelled. runs: key, seq, cancelled."""
    newest = W.partitionBy("key").orderBy(F.col("seq").desc())
    return runs.withColumn("rank", F.row_number().over(newest)).filter("rank = 1 and not cancelled").drop("rank")


def text_stats(docs: DataFrame) -> DataFrame:
    """(id, words, chars, lines)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("id", F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"), F.length(text).alias("chars"), F.size(F.split(text, "\n")).alias("lines"))


def garbage_lines(lines: DataFrame, digits: str = "၀-၉") -> DataFrame:
    """(id, lines, garbage): lines over three characters of which more than half are digits of the given range."""
    n = F.length("text")
    odd = (n > 3) & (2 * F.length(F.regexp_replace("text", f"[^{digits}]", "")) > n)
    return lines.groupBy("id").agg(F.count("*").alias("lines"), F.count_if(odd).alias("garbage"))


def sample_report(lines: DataFrame) -> DataFrame:
    """(input, pages, lines, garbage, chars, median_height, seconds_per_page) of scanned manifest lines."""
    odd = (F.length("text") > 3) & (2 * F.length(F.regexp_replace("text", "[^၀-၉]", "")) > F.length("text"))
    page = F.struct("page", "ms")
    total = lines.groupBy("input").agg(
        F.collect_set(page).alias("pages"), F.count("text").alias("lines"), F.count_if(odd).alias("garbage"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.array_sort(F.collect_list("height")).alias("heights"),
    )
    ms = F.aggregate("pages", F.lit(0).cast("long"), lambda acc, p: acc + p["ms"])
    return total.select("input", F.size("pages").alias("pages"), "lines", "garbage", "chars", F.get("heights", F.floor(F.size("heights") / 2).cast("int")).alias("median_height"), (ms / 1000 / F.size("pages")).alias("seconds_per_page"))


def page_progress(pages: DataFrame) -> DataFrame:
    """(doc, done, total, fraction): pages in any final state. pages: doc, status."""
    tally = pages.groupBy("doc").agg(F.count_if(F.col("status") != "notAttempted").alias("done"), F.count("*").alias("total"))
    return tally.withColumn("fraction", F.coalesce(F.try_divide(F.least("done", "total"), F.col("total")), F.lit(0.0)))


def pages_left_readings(documents: DataFrame, readings: DataFrame) -> DataFrame:
    """Every page 1..total of every document, with its reading or none. documents: doc, total; readings: doc, page, text."""
    spine = documents.select("doc", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("page"))
    return spine.join(readings, ["doc", "page"], "left")


def lines_to_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with fused: not line-shaped on their page. lines: page_id, line, width, height; pages: page_id, height."""
    from inkfold.operators.lines import looks_like_line

    sized = lines.join(pages.select("page_id", F.col("height").alias("page_height")), "page_id")
    return sized.withColumn("fused", ~looks_like_line(F.col("width"), F.col("height"), F.col("page_height"))).drop("page_height")
