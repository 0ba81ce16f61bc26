"""Line dedup by a log-template tree: lines that recur as a template across documents are dropped.

A line's tokens with digits are variable fields. The tree has a fixed depth: token count, then DEPTH leading
tokens; its leaves hold what may share a template. In a leaf, a token stays constant at its place if
MIN_DOCS documents have it there, and is a variable field otherwise; where fewer than half of the tokens stay
constant, the line is its own template. Templates in at least MIN_DOCS documents recur, and their lines are dropped.

A copied document repeats all its lines, and such copies are for near dedup, so what counts is documents unlike each other:
equal texts are one document, and so are near copies (op7's components, full word sets at 0.75). Near
copies are looked for where they matter, among documents with SUSPECT of their words in recurring lines; one
with less can't lose more than that share, whoever it resembles.

Scale: only hashes of lines are shuffled, 40 bytes a line. Texts of lines come from a second scan, for lines of
leaves with MIN_DOCS documents; a bitmap of fixed size (BITMAP_BITS) is all that tasks get of those leaves, it
lets through a few lines too many, never too few. Counts go through partial aggregation, so that a line that
a third of all rows hold is a row a task; of such a line's documents, joins get MIN_DOCS a task, which settle it.
Tables of leaves, recurring lines and dropped templates are joined by broadcast up to a checked size, else by shuffle.

Defined cases: null text has no lines and stays null; empty lines and lines of white space are kept; a line
that recurs in one document only is kept; very long texts and lines are read whole; rows that share an id count by their texts and lose the same lines, rows without an id count for
none and are kept whole; ties: none, counts alone decide; an empty table gives an empty result; columns beside doc_id and text
pass through unchanged in `drop_lines`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch, near_by, worker_cache
from inkfold.llm.minhash import near_duplicates

DEPTH, MIN_DOCS, LEAST_CONSTANT, SUSPECT = 2, 12, 0.5, 0.25
BITMAP_BITS = 1 << 22
VARIABLE = "<*>"
_VARIABLE, _DIGIT = VARIABLE.encode(), re.compile(b"[0-9]")
_ROWS = "doc_id long, leaf long, line long, same long, words int"


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def keys(line: str) -> tuple[int, int, list[bytes]] | None:
    """(leaf, hash of the line with its fields generalised, tokens, those with digits as VARIABLE); None for a blank line."""
    data = line.encode("utf-8", "replace")
    ts = data.split()  # of bytes: at ASCII white space alone
    if not ts:
        return None
    if _DIGIT.search(data):
        ts = [_VARIABLE if _DIGIT.search(t) else t for t in ts]
    return _hash(b"%d\x1f%b" % (len(ts), b"\x1f".join(ts[:DEPTH]))), _hash(b" ".join(ts)), ts


def _line_rows(docs: DataFrame) -> DataFrame:
    """A row for each distinct line of each document; `same` tells equal texts."""

    def rows(it):
        worker_cache("lines", dict)
        for batch in it:
            out = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = {k[:2]: len(k[2]) for k in map(keys, set(text.split("\n"))) if k}
                same = _hash(text.encode("utf-8", "replace"))
                for (leaf, line), words in found.items():
                    for column, value in zip(out, (doc_id, leaf, line, same, words), strict=True):
                        column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "line", "same", "words"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _ROWS)


def _line_texts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """leaf, line and tokens of the lines whose leaf the bitmap has."""

    def rows(it):
        for batch in it:
            out: dict[tuple[int, int], list[bytes]] = {}
            for text in batch.column(1).to_pylist():
                for k in map(keys, set((text or "").split("\n"))):
                    if k and bitmap[(k[0] % BITMAP_BITS) >> 3] >> (k[0] % BITMAP_BITS & 7) & 1:
                        out[k[:2]] = k[2]
            tokens = [[t.decode() for t in ts] for ts in out.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["leaf", "line", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(rows, "leaf long, line long, tokens array<string>")


def _bitmap(leaves: DataFrame) -> np.ndarray:
    """Set bits of the leaves' hashes, as bytes: BITMAP_BITS / 8 of them, however many leaves there are."""
    place = F.pmod("leaf", F.lit(BITMAP_BITS))
    words = leaves.groupBy((place / 32).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(leaf, {BITMAP_BITS}) % 32 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return bitmap.view(np.uint8)


def _templates(docs: DataFrame, wide_rows: DataFrame, wide: DataFrame, min_docs: int, scratch: Scratch) -> DataFrame:
    """(leaf, line, template) of the lines whose template is in min_docs documents of unequal texts."""
    held = wide_rows.select("leaf", "line", "same").distinct()
    counts = scratch.save(held.groupBy("leaf", "line").agg(F.count("*").alias("docs")), "counts")
    ranked = held.withColumn("rank", F.row_number().over(W.partitionBy("leaf", "line").orderBy("same")))
    few = scratch.save(ranked.filter(F.col("rank") <= min_docs).drop("rank"), "few")  # all texts of lines with fewer than min_docs
    texts = _line_texts(docs, _bitmap(wide)).groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    lines = scratch.save(counts.join(texts, ["leaf", "line"]), "lines")

    placed = lines.select("leaf", "line", "docs", F.posexplode("tokens").alias("place", "token"))
    spot = ["leaf", "place", "token"]
    bounds = placed.groupBy(spot).agg(F.max("docs").alias("least"), F.sum("docs").alias("most")).filter(F.col("most") >= min_docs)
    bounds = scratch.save(bounds, "bounds")  # of the texts with a token at its place; counted where the bounds leave it open
    unsure = placed.join(bounds.filter(F.col("least") < min_docs), spot).select("line", *spot).join(few, ["leaf", "line"])
    counted = unsure.groupBy(spot).agg(F.count_distinct("same").alias("support")).filter(F.col("support") >= min_docs)
    constant = bounds.filter(F.col("least") >= min_docs).select(spot).union(counted.select(spot))
    kept = placed.join(constant, spot).groupBy("leaf", "line").agg(F.collect_list(F.struct("place", "token")).alias("kept"))
    fixed = F.size(F.filter("kept", lambda k: k["token"] != VARIABLE))
    template = F.when(fixed >= F.lit(LEAST_CONSTANT) * F.size("tokens"), F.xxhash64(F.array_sort("kept"))).otherwise(F.col("line"))
    templates = scratch.save(lines.join(kept, ["leaf", "line"], "left").select("leaf", "line", F.coalesce(template, F.col("line")).alias("template")), "templates")
    over = few.join(templates, ["leaf", "line"]).groupBy("leaf", "template").agg(F.count_distinct("same").alias("docs"))
    return scratch.save(templates.join(over.filter(F.col("docs") >= min_docs).select("leaf", "template"), ["leaf", "template"]), "recurring")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, leaf, line) of the lines to drop: their template recurs across min_docs documents unlike each other."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.save(_line_rows(docs), "rows")
    wide = scratch.save(rows.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    wide_rows = scratch.save(rows.join(near_by(wide), "leaf", "left_semi"), "wide-rows")
    found = _templates(docs, wide_rows, wide, min_docs, scratch)
    hits = scratch.save(wide_rows.join(near_by(found), ["leaf", "line"]), "hits")
    scratch.drop("wide-rows", "counts", "few", "lines", "bounds", "templates")

    whole = rows.groupBy("doc_id").agg(F.sum("words").alias("whole"))
    share = hits.groupBy("doc_id").agg(F.sum("words").alias("held")).join(whole, "doc_id")
    suspects = scratch.save(share.filter(F.col("held") >= F.lit(SUSPECT) * F.col("whole")).select("doc_id"), "suspects")
    near = near_duplicates(docs.select(F.col("doc_id").cast("long"), "text").join(near_by(suspects), "doc_id", "left_semi"))
    classes = scratch.save(near.groupBy("doc_id").agg(F.min("component_id").alias("class")), "classes")
    alike = F.when(F.col("class").isNotNull(), F.xxhash64(F.lit("near"), "class")).otherwise(F.col("same"))
    counted = hits.join(near_by(classes), "doc_id", "left").select("leaf", "template", alike.alias("alike")).distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"))
    dropped = scratch.save(counted.filter(F.col("docs") >= min_docs).select("leaf", "template"), "dropped")
    return hits.join(near_by(dropped), ["leaf", "template"], "left_semi").select("doc_id", "leaf", "line")


def _marked(docs: DataFrame, min_docs: int) -> DataFrame:
    """The documents as struct `own`, with text and the hashes of the lines to drop (null: none)."""
    by_doc = recurring(docs, min_docs).groupBy("doc_id").agg(F.collect_set("line").alias("drop"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return named.join(by_doc.select(F.col("doc_id").alias("_key"), "drop"), F.col("own.doc_id") == F.col("_key"), "left").select("own", "drop")


def strip(text: str | None, drop: list[int] | None) -> tuple[str | None, int, int]:
    """(text without the lines to drop, lines before, lines dropped)."""
    if text is None:
        return None, 0, 0
    lines, gone = text.split("\n"), set() if drop is None else set(map(int, drop))
    left = [x for x in lines if not (k := keys(x)) or k[1] not in gone] if gone else lines
    return "\n".join(left), len(lines), len(lines) - len(left)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with recurring lines dropped from `text`; other columns as they were."""

    @F.pandas_udf("string")
    def stripped(text, drop):
        import pandas as pd

        return pd.Series([strip(t, d)[0] for t, d in zip(text, drop, strict=True)], dtype=object)

    marked = _marked(docs, min_docs)
    text = F.when(F.col("drop").isNull(), F.col("own.text")).otherwise(stripped("own.text", "drop"))
    return marked.withColumn("_text", text).select(*[F.col("_text").alias("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of the text that is left (null: empty)."""

    def rows(it):
        for batch in it:
            out = []
            for doc_id, text, drop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, n, gone = strip(text, drop)
                out.append({"doc_id": doc_id, "n_lines": n, "n_dropped": gone, "kept_sha256": hashlib.sha256((left or "").encode("utf-8", "replace")).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]))

    marked = _marked(docs.select("doc_id", "text"), min_docs)
    return marked.select("own.doc_id", "own.text", "drop").mapInArrow(rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
