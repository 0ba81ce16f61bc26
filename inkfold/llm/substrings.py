"""Substring dedup by recompression: every word of a repeated window of WINDOW words goes, but for its first occurrence.

Each document's words are renamed in ROUNDS rounds, first runs of one symbol, then pairs whose first symbol
has the coin "left" and whose second has "right". Names and coins are hashes of what they stand for, so they
are global without a dictionary, and a symbol is named alike wherever its words and the few around them
that its making has looked at (its reach) are the same. So equal windows hold the same symbols inside; each
window is posted under the least-hashed symbol whose reach it holds (of the highest level that has one;
single words always have one), named together with its reach, and equal windows are posted alike.

Windows under one occurrence of a symbol are neighbours and make a region, one row. A symbol that one region only
is posted under has no repeats; equal regions are repeats of the first; only where different regions
meet under a symbol are single windows compared, by 128-bit hashes of their words. A window is a
repeat if an equal one starts earlier: smaller doc_id, or earlier in the document.

Scale: a row for about eight words is shuffled, never the windows. Each task first settles what repeats inside its
own batch and leaves one row a symbol, so that a passage that a third of all documents hold is a row a
batch. Sorted rows stream through tasks. Texts are shuffled twice: those with windows to compare, and all for the result.

Defined cases: null and empty texts have no words; documents of fewer than WINDOW words lose nothing; very long texts are read whole, in chunks of whole documents; rows that share an
id are one document read again: the same place is not earlier than itself, and what goes from one goes from
each of them; rows without an id lose nothing and are not compared; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch, worker_cache

WINDOW, ROUNDS, SALTS = 20, 2, 16
CHUNK_WORDS, TABLE_WORDS = 200_000, 100_000
#: What a row says: only region of its symbol in its batch, a repeat, one of several regions of its symbol, to be compared.
ONLY, REPEAT, SEVERAL, COMPARE = range(4)
_ROW = pa.schema([("symbol", pa.int64()), ("region", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("kind", pa.int8())])
_SPARK_ROW = "symbol long, region long, doc_id long, pos int, n int, kind byte"
_SPAN = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("kind", pa.int8())])
_SPARK_SPAN = "doc_id long, pos int, n int, kind byte"
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _table() -> dict[bytes, int]:
    """Codes of words, one table a worker; emptied when it has TABLE_WORDS."""
    return worker_cache("substrings", dict)


def codes(words: list[bytes]) -> np.ndarray:
    table = _table()
    if len(table) > TABLE_WORDS:
        table.clear()
    for w in set(words).difference(table):
        table[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


@lru_cache(4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, base, U)), np.cumprod(np.full(n, pow(base, -1, 1 << 64), U))


class Spans:
    """Hashes of any span of a code array from running sums."""

    def __init__(self, c: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = 1 << max(18, len(c).bit_length())
        up, self.down = _powers(n, base)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(c + U(base & 0xFFFF)) * up[: len(c)])])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(U))


def recompress(c: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """(symbol, low, high) of each level, words first; low and high bound a symbol's reach."""
    at = np.arange(len(c))
    sym, low, high = c, at, at + 1
    levels = [(sym, low, high)]
    for r in range(rounds):
        heads = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        tails = np.concatenate([heads[1:], [len(sym)]]) - 1
        length = (tails - heads + 1).astype(U)
        sym = np.where(length > 1, mix(sym[heads] + length * U(0xA24BAED4963EE407 + 2 * r)), sym[heads])
        # a run ends where the symbol beside it differs: of the run beside it, only that one is looked at
        low = np.minimum(low[heads], np.concatenate([[-1], low])[heads])
        high = np.maximum(high[tails], np.concatenate([high, [len(c) + 1]])[tails + 1])
        right = (mix(sym ^ U(0x9FB21C651E98DF25 + 2 * r)) >> U(63)).astype(bool)
        joins = np.concatenate([~right[:-1] & right[1:], [False]])
        second = np.concatenate([[False], joins[:-1]])
        after = lambda x, last: np.concatenate([x[1:], [last]])
        before = lambda x, first: np.concatenate([[first], x[:-1]])
        high = np.where(~right, np.maximum(high, after(high, len(c) + 1)), high)  # joined or not, a left symbol looks at the next
        low = np.where(right & ~second, np.minimum(low, before(low, -1)), low)
        sym = np.where(joins, mix(sym * U(0xC2B2AE3D27D4EB4F) + after(sym, U(0))), sym)
        low = np.where(joins, np.minimum(low, after(low, len(c) + 1)), low)
        keep = ~second
        sym, low, high = sym[keep], low[keep], high[keep]
        levels.append((sym, low, high))
    return levels


def regions(c: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, region, first window, windows) of each region. c: codes; ok: which places start a window."""
    span = Spans(c)
    best = np.full(len(c), -1)
    names = np.zeros(0, U)
    anchor = np.zeros(0, np.int64)
    for sym, low, high in reversed(recompress(c)):
        first, last = np.maximum(high - WINDOW, 0), np.minimum(low, len(c) - 1)
        open_ = np.concatenate([[0], np.cumsum(ok & (best < 0))])
        use = np.flatnonzero((first <= last) & (low >= 0) & (high <= len(c)))
        use = use[open_[last[use] + 1] > open_[first[use]]]
        if not len(use):
            continue
        name = mix(span(low[use], high[use]) + sym[use])
        order = np.lexsort((use, name))[::-1]
        use, name = use[order], name[order]
        size = last[use] - first[use] + 1
        ids = np.repeat(np.arange(len(use)), size)
        places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[use][ids]
        free = ok[places] & (best[places] < 0)
        best[places[free]] = ids[free] + len(names)  # the last stays: the least name, of equal ones the leftmost
        names, anchor = np.concatenate([names, name]), np.concatenate([anchor, low[use]])
    places = np.flatnonzero(ok)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), places, places
    chosen = best[places]
    heads = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (places[1:] != places[:-1] + 1)]))
    n = np.diff(np.concatenate([heads, [len(places)]]))
    start, chosen = places[heads], chosen[heads]
    region = mix(span(start, start + n + WINDOW - 1) + mix((anchor[chosen] - start).astype(U)))
    return names[chosen].view(np.int64), region.view(np.int64), start, n


def settle(symbol, region, doc_id, pos, n):
    """Rows of one batch, sorted: what repeats inside the batch is settled, and each symbol keeps one row for others."""
    order = np.lexsort((pos, doc_id, region, symbol))
    symbol, region, doc_id, pos, n = (x[order] for x in (symbol, region, doc_id, pos, n))
    new_symbol = np.concatenate([[True], symbol[1:] != symbol[:-1]])
    new = new_symbol | np.concatenate([[True], region[1:] != region[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = ~new & ((doc_id != doc_id[head]) | (pos != pos[head]))
    several = np.add.reduceat(new, np.flatnonzero(new_symbol))[np.cumsum(new_symbol) - 1] > 1
    kind = np.where(later, REPEAT, np.where(~several, ONLY, np.where(new_symbol, SEVERAL, COMPARE))).astype(np.int8)
    keep = new | later
    return symbol[keep], region[keep], doc_id[keep], pos[keep], n[keep], kind[keep]


def _chunks(batch: pa.RecordBatch):
    """Documents' codes joined by codes that occur nowhere else: (codes, ok, doc_id of each place, first place of each place's document)."""
    rng = np.random.default_rng()
    held, size = [], 0

    def joined():
        parts, ok, ids, starts, at = [rng.integers(0, 1 << 63, 1, dtype=U)], [np.zeros(1, bool)], [0], [0], 1
        lengths = [1]
        for doc_id, c in held:
            parts += [c, rng.integers(0, 1 << 63, 1, dtype=U)]
            ok += [np.arange(len(c)) <= len(c) - WINDOW, np.zeros(1, bool)]
            ids.append(doc_id)
            starts.append(at)
            lengths.append(len(c) + 1)
            at += len(c) + 1
        return np.concatenate(parts), np.concatenate(ok), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(starts), lengths)

    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        words = split(text.as_py()) if doc_id is not None else ()
        if len(words) >= WINDOW:
            held.append((doc_id, codes(words)))
            size += len(words)
        if size >= CHUNK_WORDS:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _region_rows(docs: DataFrame) -> DataFrame:
    def rows(it):
        for batch in it:
            found = []
            for c, ok, ids, starts in _chunks(batch):
                symbol, region, start, n = regions(c, ok)
                found.append((symbol, region, ids[start], start - starts[start], n))
            if found:
                columns = settle(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type, safe=False) for x, f in zip(columns, _ROW, strict=True)], schema=_ROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _SPARK_ROW)


def _judged(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, n, REPEAT or COMPARE) from sorted rows: repeats, and regions whose windows have to be compared."""

    def out(columns):
        symbol, region, doc_id, pos, n, kind = columns
        done = (kind == REPEAT) | (kind == COMPARE)
        new_symbol = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        new = new_symbol | np.concatenate([[True], region[1:] != region[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = ~new & ((doc_id != doc_id[head]) | (pos != pos[head]))
        group = np.cumsum(new_symbol) - 1
        heads = np.flatnonzero(new_symbol)
        several = (np.add.reduceat(new, heads) > 1) | (np.maximum.reduceat(kind, heads) >= SEVERAL)
        compare = new & several[group]
        kind = np.where(done, kind, np.where(later, REPEAT, np.where(compare, COMPARE, ONLY)))
        use = kind != ONLY
        return pa.RecordBatch.from_arrays([pa.array(x[use], f.type, safe=False) for x, f in zip((doc_id, pos, n, kind), _SPAN, strict=True)], schema=_SPAN)

    def stream(it):
        held = None
        for batch in it:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            cut = np.searchsorted(columns[0], columns[0][-1])  # the last symbol may go on
            held = [x[cut:] for x in columns]
            if cut:
                yield out([x[:cut] for x in columns])
        if held:
            yield out(held)

    # settled rows need no company: they are dealt by place
    key = F.when(F.col("kind").isin(REPEAT, COMPARE), F.xxhash64("doc_id", "pos")).otherwise(F.col("symbol"))
    return rows.withColumn("symbol", key).repartition("symbol").sortWithinPartitions("symbol", "region", "doc_id", "pos").mapInArrow(stream, _SPARK_SPAN)


def _compared(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, pos, n=1) of the windows of the spans to compare that an equal window precedes.

    Of equal windows the first is found by partial aggregation, and they meet it under salted keys, so that a passage in a third
    of all documents, each time in other surroundings, is no large group. Inside the first document, places are compared once more.
    """
    wanted = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "pos", "n")
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def rows(it):
        for batch in it:
            found = []
            for doc_id, text, pos, n in zip(*batch.columns, strict=True):
                c = codes(split(text.as_py()))
                at = np.unique(np.concatenate([np.arange(p, p + k) for p, k in zip(pos.as_py(), n.as_py(), strict=True)]))
                at = at[at + WINDOW <= len(c)]
                w1, w2 = (Spans(c, base)(at, at + WINDOW) for base in (0x9E3779B97F4A7C15, 0xC13FA9A902A6328F))
                found.append((w1.view(np.int64), w2.view(np.int64), np.full(len(at), doc_id.as_py()), at))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type, safe=False) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    windows = scratch.save(texts.mapInArrow(rows, "w1 long, w2 long, doc_id long, pos int"), "to-compare")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    met = scratch.save(salted.join(first.select("w1", "w2", "first_id", salts), ["w1", "w2", "salt"]), "met")
    inside = met.filter("doc_id = first_id").groupBy("w1", "w2").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    again = met.filter("doc_id = first_id").join(inside.filter("last_pos > first_pos"), ["w1", "w2"]).filter("pos > first_pos")
    return met.filter("doc_id > first_id").select("doc_id", "pos", F.lit(1).alias("n")).union(again.select("doc_id", "pos", F.lit(1)))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (pos, n), n windows from pos that equal windows precede. Documents without any are left out."""
    scratch = Scratch(docs.sparkSession, "substrings")
    judged = scratch.save(_judged(_region_rows(docs)), "judged")
    windows = scratch.save(_compared(docs, judged.filter(F.col("kind") == COMPARE), scratch), "windows")
    found = judged.filter(F.col("kind") == REPEAT).select("doc_id", "pos", "n").unionByName(windows)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def covered(n_words: int, spans: list[dict] | None) -> np.ndarray:
    """Which words the repeated windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    if spans:
        pos, n = (np.array([s[k] for s in spans], np.int64) for k in ("pos", "n"))
        np.add.at(edges, np.minimum(pos, n_words), 1)
        np.add.at(edges, np.minimum(pos + n + WINDOW - 1, n_words), -1)
    return np.cumsum(edges)[:n_words] > 0


def kept_words(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words left, joined by spaces."""
    found = repeats(docs).select(F.col("doc_id").alias("_id"), "spans")
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text)

    def rows(it):
        for batch in it:
            out = [[] for _ in schema]
            for doc_id, text, spans in zip(*batch.columns, strict=True):
                words = split(text.as_py())
                gone = 0
                if spans.is_valid:
                    mask = covered(len(words), spans.as_py())
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                kept = b" ".join(words)
                row = [doc_id.as_py(), len(words) + gone, gone, hashlib.sha256(kept).hexdigest()] + [kept.decode()] * with_text
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return joined.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
