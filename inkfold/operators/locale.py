"""Translation tables: sheets to dictionaries, coverage of a catalogue, and its open gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import scalars as S
from inkfold.operators.ranks import global_rank
from inkfold.sources.files import saved

LANGUAGES = ("en", "my", "mnw")


def scan_sheet(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of a CSV export: the first is the header, missing cells are '', optional slice of row numbers from 1.

    A sheet in several files goes by their names, whatever their sizes: rows are numbered in the order of (file, place in file). A cell may hold line ends, so a file is
    read from its start by one task, row by row; what places a row is its number in that read.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    own = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns]
    placed = saved(rows.select(*own, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")), "sheet")
    return global_rank(placed, [F.col("_file"), F.col("_row")], "row_no").drop("_file", "_row").filter(F.col("row_no").between(start or 1, end or (1 << 62)))


def platform_filter(translations: DataFrame, platform: str) -> DataFrame:
    """Rows with a key, for all platforms or this one."""
    names = F.lower("platforms")
    return translations.filter((F.col("key") != "") & ((names == "") | names.contains("all") | names.contains(platform)))


def language_rows(translations: DataFrame) -> DataFrame:
    """(key, lang, value) of the language columns."""
    return translations.select("key", F.inline(F.array(*[F.struct(F.lit(c).alias("lang"), F.col(c).alias("value")) for c in LANGUAGES])))


def locale_entries(translations: DataFrame) -> DataFrame:
    """(lang, place, key, value): a dictionary's entries in order of their keys' first rows, each with the value of its last row.

    A cell without a value falls back to English, then to ''. Rows without a key are left out; a sheet without rows is an error. translations: with row_no.
    """
    if translations.isEmpty():
        raise ValueError("no rows in the sheet")
    cells = F.array(*[F.struct(F.lit(c).alias("lang"), S.translate_fallback(F.col(c), F.col("en")).alias("value")) for c in LANGUAGES])
    rows = translations.filter(F.col("key") != "").select("row_no", "key", F.inline(cells))
    return rows.groupBy("lang", "key").agg(F.min("row_no").alias("place"), F.max_by("value", "row_no").alias("value")).select("lang", "place", "key", "value")


def write_locale_json(translations: DataFrame, path: str) -> None:
    """lang=<language>/ with the lines of its JSON dictionary; part files in order of their names are one document.

    Lines are range-sorted by language and place, so that no task holds a dictionary.
    """
    entries = locale_entries(translations)
    last = entries.groupBy("lang").agg(F.max("place").alias("last"))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    rows = entries.join(F.broadcast(last), "lang").select("lang", F.col("place").cast("long").alias("place"), F.concat(F.lit("  "), text("key"), F.lit(": "), text("value"), F.when(F.col("place") < F.col("last"), ",").otherwise("")).alias("value"))
    ends = last.select("lang", F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit("{").alias("value")), F.struct((F.col("last") + 1).cast("long").alias("place"), F.lit("}").alias("value")))))
    rows.unionByName(ends).repartitionByRange("lang", "place").sortWithinPartitions("lang", "place").select("lang", "value").write.partitionBy("lang").text(path)


def scan_strings_xml(files: DataFrame) -> DataFrame:
    """(file, key, value) of <string name> entries; of repeated names the later wins. files: file, value."""
    pattern = r'(?s)<string name="([^"]+)"[^>]*>(.*?)</string>'
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("value"))
    rows = files.select("file", F.posexplode(pairs).alias("n", "pair")).select("file", "n", "pair.key", "pair.value")
    return rows.groupBy("file", "key").agg(F.max_by("value", "n").alias("value"))


def scan_catalogue(files: DataFrame) -> DataFrame:
    """(key, lang, value) of a nested JSON catalogue. files: value."""
    schema = "struct<strings:map<string,struct<localizations:map<string,struct<stringUnit:struct<state:string,value:string>>>>>>"
    keys = files.select(F.explode(F.from_json("value", schema)["strings"]).alias("key", "entry"))
    return keys.select("key", F.explode("entry.localizations").alias("lang", "unit")).select("key", "lang", F.col("unit.stringUnit.value").alias("value"))


def locale_merge(existing: DataFrame, sheet: DataFrame) -> DataFrame:
    """(key, value): the sheet over what is there; an empty cell falls back to English, then to the old value. sheet: key, value, en."""
    new = sheet.select("key", F.coalesce(F.nullif("value", F.lit("")), F.nullif("en", F.lit(""))).alias("_new"))
    return existing.join(new, "key", "full_outer").select("key", F.coalesce("_new", "value", F.lit("")).alias("value"))


def keys_not_in_catalogue(used: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(absent, present) of used keys with their files."""
    keys = catalogue.select("key").distinct()
    return used.join(keys, "key", "left_anti"), used.join(keys, "key", "left_semi")


#: What stands for a slot of a literal and for a specifier of a key; no text holds it.
_SLOT = "\u0001"
_SPECIFIER = r"%(?:[0-9]+\$)?(?:lld|@|d)"


def pattern_key_join(literals: DataFrame, keys: DataFrame) -> DataFrame:
    """(literal, key): the first catalogue key (by ordinal) that an interpolated literal's pattern matches.

    A pattern has fixed text, and a specifier for each slot. So both sides are written with one mark for each slot and specifier, and meet where these
    are equal, wherever the slots stand; specifiers in a literal's fixed text are marked too, and the pattern decides among the few that meet. Keys come in once, with their first ordinal.
    """
    marked = lambda text: F.regexp_replace(text, _SPECIFIER, _SLOT)
    asked = literals.select("literal").distinct().select("literal", S.specifier_regex(F.col("literal")).alias("pattern"), marked(F.regexp_replace("literal", r"\{[^}]*\}", _SLOT)).alias("form"))
    forms = keys.groupBy("key").agg(F.min("ordinal").alias("ordinal")).withColumn("form", marked(F.col("key")))
    met = asked.join(forms, "form").filter(F.rlike("key", F.col("pattern")))
    return met.groupBy("literal").agg(F.min_by("key", "ordinal").alias("key"))


def todo_reconcile(gaps: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, lang, status): open gaps that the list lacks (unlisted), and listed ones that are closed (stale)."""
    a, b = gaps.select("key", "lang", F.lit(True).alias("gap")), listed.select("key", "lang", F.lit(True).alias("listed"))
    both = a.join(b, ["key", "lang"], "full_outer")
    return both.select("key", "lang", F.when(F.col("listed").isNull(), "unlisted").when(F.col("gap").isNull(), "stale").otherwise("known").alias("status"))


def translation_gaps(translations: DataFrame) -> DataFrame:
    """(key, langs): languages whose value is empty or the English one."""
    rows = translations.select("key", F.array(*[F.when((F.col(c) == "") | (F.col(c) == F.col("en")), c) for c in LANGUAGES[1:]]).alias("all"))
    return rows.select("key", F.filter("all", lambda c: c.isNotNull()).alias("langs")).filter(F.size("langs") > 0)


def gap_counts(translations: DataFrame) -> DataFrame:
    return translation_gaps(translations).select(F.explode("langs").alias("lang")).groupBy("lang").agg(F.count("*").alias("gaps"))


def language_dictionary(sheet: DataFrame, lang: str) -> DataFrame:
    """(key, value) of a sheet with older column names: value_<lang> before <lang>, mm for my, key or unique_key."""
    have = set(sheet.columns)
    names = [c for c in (f"value_{lang}", lang, *(("value_mm", "mm") if lang == "my" else ())) if c in have]
    keys = [c for c in ("key", "unique_key") if c in have]
    pick = lambda cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    return sheet.select(pick(keys).alias("key"), pick(names).alias("value")).filter("key <> ''")


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, side): keys that only one of both has."""
    a, b = left.select("key"), right.select("key")
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
