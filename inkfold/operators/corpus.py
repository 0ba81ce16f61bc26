"""A batch run over a corpus: discovery, stems, resume, progress, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import scalars as S
from inkfold.operators.ranks import global_rank, rank_within
from inkfold.sources.files import list_folders, read_files, saved, write_files

MAX_BYTES, MAX_PAGES = 500 << 20, 3000


def natural_order(paths: DataFrame) -> DataFrame:
    """Adds place: the rank of each path in natural order, ties by arg_no."""
    return global_rank(paths, [S.natural_key(F.col("path")), F.col("arg_no")], "place")


def discover_inputs(spark: SparkSession, roots: list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(inputs(path, kind, length), skipped(path, reason)) below the named files and folders.

    Folders are listed inside tasks, one level of the tree a job; only the named roots are looked at by the driver. Names that begin with a dot are passed over;
    what is no image or PDF, and a folder that can't be listed, is skipped with its reason; a named file of another type is an error. A path comes once.
    """
    named = list_folders(spark.createDataFrame([(r.rstrip("/").rsplit("/", 1)[0] or "/",) for r in roots], "path string").distinct())
    asked = saved(named.filter(F.col("path").isin([r.rstrip("/") for r in roots])), "roots")
    missing = {r.rstrip("/") for r in roots} - {r.path for r in asked.collect()}  # as many as were named
    if missing:
        raise FileNotFoundError(", ".join(sorted(missing)))
    levels, level = [asked.filter("not folder")], asked.filter("folder")
    while not level.isEmpty():
        found = saved(list_folders(level), "listed")
        shown = found.filter(F.col("error").isNotNull() | ~S.basename(F.col("path")).startswith("."))
        levels.append(shown.filter(F.col("error").isNotNull() | ~F.col("folder")))
        level = shown.filter(F.col("folder") & F.col("error").isNull()) if recursive else level.limit(0)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    judged = every.distinct().withColumn("kind", F.when(F.col("error").isNull(), S.classify_input(F.col("path"))))
    wrong = judged.join(asked.select("path"), "path", "left_semi").filter("kind is null and error is null").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].path}: not an image or PDF")
    return judged.filter("kind is not null").select("path", "kind", "length"), judged.filter("kind is null").select("path", F.coalesce("error", F.lit("unknown type")).alias("reason"))


def expand_pages(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages(id, page), refused(id, reason)). documents: id, bytes, pages."""
    reason = F.when(F.col("bytes") == 0, "empty").when(F.col("bytes") > MAX_BYTES, "too_large").when(F.col("pages") < 1, "no_pages").when(F.col("pages") > MAX_PAGES, "too_many_pages")
    judged = documents.withColumn("reason", reason)
    good = judged.filter("reason is null").select("id", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    return good, judged.filter("reason is not null").select("id", "reason")


def distinct_inputs(paths: DataFrame) -> DataFrame:
    """The first spelling of each canonical path. paths: arg_no, path, canon."""
    first = W.partitionBy("canon").orderBy("arg_no")
    return paths.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")


def assign_stems(paths: DataFrame) -> DataFrame:
    """Adds stem: the clean base name, with a tag of the path where bases collide."""
    base = S.output_stem(F.col("path"))
    named = paths.withColumn("base", base)
    return named.withColumn("stem", F.when(F.count("*").over(W.partitionBy(F.lower("base"))) > 1, F.concat_ws("-", "base", S.path_tag(F.col("path")))).otherwise(F.col("base"))).drop("base")


#: A number that a repeated name may be given, at the end of a name: from 2, without leading zeros; longer ones are never reached.
_NUMBER = "(?:[2-9]|[1-9][0-9]{1,17})"


def _free_numbers(asked: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arg_no, name, unique) of the rows that ask for a number, and (name) of the numbered names that they got before their first row.

    asked: arg_no, name. taken: name, n, arg_no, own: the first row of the numbered name `own`, which is `name`-n.
    A number is taken if fewer rows asked before it than there are free numbers below it; that depends on lower numbers only, so the taken
    ones are told in one pass by number, which carries their count. Then the k-th row that asks has the k-th number that isn't taken.
    """
    number = lambda rank: F.concat(F.col("name"), F.lit("-"), rank.cast("string")).alias("unique")
    wanted = taken.join(asked.select("name").distinct(), "name", "left_semi")
    if wanted.isEmpty():
        return rank_within(asked, ["name"], [F.col("arg_no")], "k").select("arg_no", "name", number(F.col("k") + 1)), wanted.select("own").limit(0)
    both = asked.select("name", "arg_no", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("own")).unionByName(wanted)
    timed = rank_within(both, ["name"], [F.col("arg_no"), F.col("n").asc_nulls_first()], "at")
    firsts = rank_within(timed.filter("n is not null"), ["name"], [F.col("arg_no"), F.col("n")], "nth").withColumn("asked", F.col("at") - F.col("nth"))

    def scan(it):
        import pandas as pd

        name, count = None, 0
        for batch in it:
            out = []
            for own_name, n, asked_before in zip(batch["name"], batch["n"], batch["asked"], strict=True):
                name, count = own_name, count if own_name == name else 0
                held = count < n - 1 - asked_before
                out.append(n - count - 2 if held else -1)
                count += held
            yield pd.DataFrame({"name": batch["name"].astype(object), "own": batch["own"].astype(object), "below": out})

    judged = saved(firsts.select("name", "n", "asked", "own").repartition("name").sortWithinPartitions("name", "n").mapInPandas(scan, "name string, own string, below long"), "numbers")
    asking = rank_within(asked, ["name"], [F.col("arg_no")], "k").select("name", "arg_no", (2 * F.col("k")).alias("place"))
    held = judged.filter("below >= 0").select("name", F.lit(None).cast("long").alias("arg_no"), (2 * F.col("below") + 1).alias("place"))
    given = rank_within(asking.unionByName(held), ["name"], [F.col("place")], "rank").filter("arg_no is not null")
    return given.select("arg_no", "name", number(F.col("rank") + 1)), judged.filter("below < 0").select("own")


def force_unique(names: DataFrame) -> DataFrame:
    """arg_no, name, unique: by rising arg_no, a name that an earlier row has (its own, or given to it) gets -2, -3, … , the first that no earlier row has.

    names: arg_no (a long, unique), name. What takes a number of a name are rows of that name, and first rows of the numbered name itself. So
    names are worked on by how many numbers they end in, shortest first; a numbered name whose number was given away before its first row asks like a repeated one.
    One round a number at the end of names, as far as names with repeated rows have them. No list a name, and none on the driver: ranks are over range partitions, so a name's rows may fill
    many tasks; only the first rows of names, by number, go through one task a name, with one count in memory. Null names get null.
    """
    rows = saved(names.filter("name is not null").select(F.col("arg_no").cast("long").alias("arg_no"), "name"), "names")
    tail = F.regexp_extract("name", rf"((?:-{_NUMBER})*)\z", 1)
    depth = F.size(F.split(tail, "-")) - 1
    firsts = saved(rows.groupBy("name").agg(F.min("arg_no").alias("arg_no"), F.count("*").alias("n_rows")).withColumn("depth", depth), "firsts")
    parent, number = F.regexp_extract("name", rf"(?s)^(.*)-({_NUMBER})\z", 1), F.regexp_extract("name", rf"(?s)^(.*)-({_NUMBER})\z", 2).cast("long")
    todo = {r.depth for r in firsts.filter("n_rows > 1").select("depth").distinct().collect()}  # as many as names end in numbers
    given, lost = [], None
    while todo:
        now = min(todo)
        todo.remove(now)
        level = firsts.filter(F.col("depth") == now)
        again = rows.join(level.filter("n_rows > 1").select("name", F.col("arg_no").alias("_first")), "name").filter("arg_no <> _first").select("arg_no", "name")
        if lost is not None:
            again = again.unionByName(level.join(lost, level["name"] == lost["own"], "left_semi").select("arg_no", "name"))
        taken = firsts.filter(F.col("depth") == now + 1).select(parent.alias("name"), number.alias("n"), "arg_no", F.col("name").alias("own"))
        some, gone = _free_numbers(saved(again, "asked"), taken)
        given.append(saved(some, "given"))
        lost = saved(gone, "lost")
        if not lost.isEmpty():
            todo.add(now + 1)
    found = names.select(F.col("arg_no"), "name").withColumn("unique", F.col("name"))
    if not given:
        return found
    every = given[0]
    for more in given[1:]:
        every = every.unionByName(more)
    every = every.select(F.col("arg_no").alias("_arg"), F.col("unique").alias("_unique"))
    return found.join(every, F.col("arg_no") == F.col("_arg"), "left").select("arg_no", "name", F.coalesce("_unique", "unique").alias("unique"))


def is_complete(expected: Column, pages: Column) -> Column:
    return F.coalesce((expected > 0) & (pages >= expected), F.lit(False))


def resume_anti_join(inputs: DataFrame, completed: DataFrame) -> DataFrame:
    """Inputs without a complete record of the same digest and stem."""
    done = completed.filter(is_complete(F.col("expected_pages"), F.col("pages"))).select("digest", "stem")
    return inputs.join(done, ["digest", "stem"], "left_anti")


def progress_upsert(state: DataFrame, progress: DataFrame) -> DataFrame:
    """State merged with progress by (digest, stem): the larger page count, the newer expectation and input."""
    new = progress.select("digest", "stem", F.col("input").alias("_input"), F.col("pages").alias("_pages"), F.col("expected_pages").alias("_expected"), F.lit(True).alias("_new"))
    both = state.join(new, ["digest", "stem"], "full_outer")
    return both.select(
        "digest", "stem", F.coalesce("_input", "input").alias("input"), F.greatest(F.coalesce("pages", F.lit(0)), F.coalesce("_pages", F.lit(0))).alias("pages"),
        F.when(F.col("_new"), F.col("_expected")).otherwise(F.col("expected_pages")).alias("expected_pages"),
    )


def load_resume_state(spark: SparkSession, path: str) -> DataFrame:
    """Completed inputs of earlier runs; none if the file is missing, and lines that can't be read are left out."""
    schema = "input string, digest string, pages int, expected_pages int, stem string, _corrupt string"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).drop("_corrupt")
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null and digest is not null").drop("_corrupt")


MANIFEST = "kind string, input string, page int, mode string, lines array<struct<text:string,x:int,y:int,width:int,height:int,tiles:int,looks_fused:boolean>>, ms long, error string, reason string"


def write_manifest(records: DataFrame, path: str) -> None:
    """Appends records of kinds page, failure and skipped; fields without a value are left out."""
    records.write.mode("append").json(path)


def scan_manifest_lines(records: DataFrame) -> DataFrame:
    """A row for each line of the page records, and one for a page without lines."""
    pages = records.filter("kind = 'page'").select("input", "page", "mode", "ms", F.posexplode_outer("lines").alias("line", "l"))
    return pages.select("input", "page", "mode", "ms", "line", "l.*")


def write_page_text(pages: DataFrame, path: str) -> None:
    """<stem>/page-0001.txt for each page and <stem>.txt with all of its pages, each file whole or not at all. pages: stem, page, text.

    A document's pages, MAX_PAGES at most, are one row while its file is made.
    """
    text = F.coalesce("text", F.lit(""))
    own = pages.select(F.concat(F.col("stem").cast("string"), F.lit("/"), S.page_filename(F.col("page").cast("int"))).alias("name"), text.alias("content"))
    ordered = F.array_sort(F.collect_list(F.struct("page", text.alias("text"))))
    whole = pages.groupBy("stem").agg(F.array_join(F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t != ""), "\n").alias("content"))
    write_files(own.unionByName(whole.select(F.concat(F.col("stem").cast("string"), F.lit(".txt")).alias("name"), "content")), path)


def _texts(spark: SparkSession, path: str, pages: bool) -> DataFrame:
    """(path, text) of the pages' or the documents' files, listed and read inside tasks, empty ones too."""
    top = list_folders(spark.createDataFrame([(path,)], "path string"))
    found = list_folders(top.filter("folder").repartition("path")) if pages else top
    names = found.filter(~F.col("folder") & S.basename(F.col("path")).rlike(r"^page-[0-9]+\.txt$" if pages else r"^[^.].*\.txt$"))
    return read_files(names.repartition("path")).select("path", F.col("content").cast("string").alias("text"))


def scan_page_text(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page, text) of written pages."""
    place = lambda n: F.regexp_extract("path", r"([^/]+)/page-([0-9]+)\.txt$", n)
    return _texts(spark, path, True).select(place(1).alias("stem"), place(2).cast("int").alias("page"), "text")


def scan_document_text(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of written documents."""
    return _texts(spark, path, False).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), "text")


def verify_digests(files: DataFrame, pinned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused) by SHA-256. files: name, content; pinned: name, sha256."""
    both = files.join(pinned, "name").withColumn("actual", F.sha2("content", 256))
    return both.filter("actual = sha256"), both.filter("actual <> sha256").select("name", "sha256", "actual")


def shown_pages(pages: Column, most: int = 10) -> Column:
    """The first page numbers, and how many more."""
    shown = F.array_join(F.transform(F.slice(F.array_sort(pages), 1, most), lambda p: p.cast("string")), ", ")
    return F.concat(shown, F.when(F.size(pages) > most, F.format_string(", and %d more", F.size(pages) - most)).otherwise(""))


def skip_report(skipped: DataFrame, most: int = 20) -> DataFrame:
    """One row: total, the first paths, more."""
    first = skipped.orderBy("path").limit(most).agg(F.array_sort(F.collect_list("path")).alias("shown"))
    total = skipped.agg(F.count("*").alias("total"))
    return total.crossJoin(first).select("total", "shown", F.greatest(F.col("total") - most, F.lit(0)).alias("more"))  # one row each


#: Least width to height of a line, and the height from which an image is a page: twice what the recogniser takes.
LINE_ASPECT, LINE_CEILING = 4, 320


def choose_mode(kind: Column, width: Column, height: Column) -> Column:
    """sparse for a camera capture, whatever its shape; line for an image or a scan under LINE_CEILING rows that is at least LINE_ASPECT times as wide as high; else page. kind: pdf, image, scan or camera."""
    line = kind.isin("image", "scan") & (width > 0) & (height > 0) & (height < LINE_CEILING) & (width >= LINE_ASPECT * height)
    return F.when(kind == "camera", "sparse").when(F.coalesce(line, F.lit(False)), "line").otherwise("page")


def result_record(results: DataFrame) -> DataFrame:
    """(input, json): the line of each input's result. results: input, kind, mode, stem, pages (how many were written), expected_pages, failed_pages (array).

    A PDF says too how many pages it has (null: unknown) and which could not be read, so that a part is told from the whole; other inputs have neither.
    """
    own = [F.col(c) for c in ("input", "mode", "pages", "stem")]
    book = F.to_json(F.struct("expected_pages", F.coalesce(F.array_sort("failed_pages"), F.array().cast("array<int>")).alias("failed_pages"), *own), {"ignoreNullFields": "false"})
    return results.select("input", F.when(F.col("kind") == "pdf", book).otherwise(F.to_json(F.struct(*own))).alias("json"))


def mode_reason(kind: Column, path: Column, width: Column, height: Column) -> Column:
    """Why choose_mode chose: a sentence for the operator."""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    aspect = F.format_string("%.1f", F.bround(width / height, 1))
    return (
        F.when(kind == "pdf", "PDF page render, which is known to be a document page")
        .when(width.isNull() | height.isNull(), F.concat(F.lit("could not read the dimensions of "), path, F.lit("; defaulting to page")))
        .when((width == 0) | (height == 0), F.concat(size, F.lit(" has no area; defaulting to page")))
        .when((height < LINE_CEILING) & (width >= LINE_ASPECT * height), F.concat(size, F.lit(", aspect "), aspect, F.lit(": short enough and line-shaped, so it is already a single line")))
        .when(height < LINE_CEILING, F.concat(size, F.lit(" is short but aspect "), aspect, F.lit(f" is under {LINE_ASPECT:.1f}, so it is a block of lines rather than one line")))
        .otherwise(F.concat(size, F.lit(": a file on disk is treated as a page unless told otherwise, because a photo and a scan look the same from here")))
    )


def density_ratio(mode: Column, surface: str = "web") -> Column:
    """Share of the mean row that a text row has to reach: by mode, and lower in the batch tool."""
    return F.when(mode == "page", 0.05 if surface == "cli" else 0.03).when(mode == "sparse", 0.5)
