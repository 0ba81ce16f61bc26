"""Packing by power-of-two decomposition: no training sequence crosses a document.

A document's token ids are cut into pieces of MAX_LENGTH and, for the rest, the powers of two of its binary form,
longest first. Every piece is a sequence of its own at offset 0, so that attention never crosses documents
and, all lengths being powers of two, nothing is padded; sequences of one length are numbered together, so that
a batch reads one bucket of equal lengths.

Tokens: the word-level BPE drops white space and never joins what ASCII white space parts, so a text's
ids are those of its words and units, and a worker encodes each once while its bounded cache holds it.

Scale: tokenizing is a map over documents; its pieces (without ids, unless asked for) are written once,
then range-partitioned by (length, document, start), which spreads a popular length over many tasks, and written in that order. A sequence's number is its
rank there: its place in its range plus the sizes of the ranges before, a row a range; so reruns give the same numbers wherever ranges are cut.

Defined cases: null and empty texts have only the end token, one piece of length 1; repeated rows are documents
of their own; very long texts are whole, as many pieces as they need; ties (repeated rows) are numbered one after the other; null ids are kept; an empty table gives no pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch, worker_cache

MAX_LENGTH, END_ID = 4096, 2
#: Units or words that a worker's caches hold at most, and the longest (in letters) that they take.
CACHE_UNITS, CACHE_LETTERS = 200_000, 64
#: Texts of these letters alone fall into the tokenizer's own units by _UNIT once they are in lower case.
_PLAIN = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
_UNIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class WordEncoder:
    """Little-endian ids of whole texts, unit by unit through bounded caches.

    New units of letters are encoded together, as one text: every unit's last token ends in the
    end-of-word mark, so that the ids can be parted again. Texts with other letters go word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.tokenizer, self.words, self.units = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        return [_as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, units: list[str]) -> list[bytes]:
        letters = [u for u in units if u[0].isalpha()]
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(letters):
            return self._each(units)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        found = dict(zip(letters, (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        marks = [u for u in units if not u[0].isalpha()]
        found.update(zip(marks, self._each(marks) if marks else [], strict=True))
        return [found[u] for u in units]

    def _join(self, parts: list[str], known: dict[str, bytes], encode) -> bytes:
        if len(known) > CACHE_UNITS:
            known.clear()
        new = list(set(parts).difference(known))
        if not new:
            return b"".join(map(known.__getitem__, parts))
        own = dict(zip(new, encode(new), strict=True))
        known.update((u, b) for u, b in own.items() if len(u) <= CACHE_LETTERS)
        return b"".join([own[u] if u in own else known[u] for u in parts])

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._join(_UNIT.findall(text.lower()), self.units, self._together)
        words = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]
        return self._join(words, self.words, self._each)


def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that tasks share what it knows."""
    return worker_cache(f"packing {path}", lambda: WordEncoder(path))


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Pieces of `longest`, then the powers of two of the rest, in falling order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False, longest: int = MAX_LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids: one row a piece."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def batches(it):
        encoder, end = _encoder(tokenizer), _as_bytes([END_ID])
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                out = [[] for _ in schema]
                for doc_id, text in zip(ids[at : at + 512], texts[at : at + 512].to_pylist(), strict=True):
                    tokens = encoder.encode(text or "") + end
                    start = 0
                    for n in binary_lengths(len(tokens) // 4, longest):
                        piece = tokens[4 * start : 4 * (start + n)]
                        row = [doc_id, start, n, zlib.crc32(piece), len(tokens) // 4] + [np.frombuffer(piece, "<i4")] * with_ids
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    spark_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(batches, spark_schema)


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False, longest: int = MAX_LENGTH) -> DataFrame:
    """`pieces` with sequence_id and offset, in order of (length, doc_id, start)."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer, with_ids, longest), "pieces")
    order = ["length", "doc_id", "start", "doc_tokens", "ids_crc32"]
    ranged = scratch.save(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    scratch.drop("pieces")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # as Spark numbers rows: partition, then place
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    numbered = ranged.join(F.broadcast(starts), part == F.col("_part"))  # one row a range
    return numbered.select(*cut.columns, (F.col("_start") + row).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
