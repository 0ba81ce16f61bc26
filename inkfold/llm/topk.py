"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie in blocks, dimensions first (vertical layout). For a query, scores are accumulated one group of
dimensions after the other; what is left can add at most the product of the remaining norms (Cauchy-Schwarz),
so candidates whose upper bound is below the k-th best lower bound are dropped and the block is compacted.
Scores are sums of integers and exact; bounds are widened by more than their rounding.

Scale: a stated query set against all rows, in blocks. Both sides are packed into blocks of bounded size, blocks
meet in the cells of a grid (an equi-join on the cell), and each pair of blocks gives k rows a query at most,
which are merged by a ranked window. No side is broadcast or collected; only counts reach the driver.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors meet only those
of their own length; rows repeated with the same id and vector count once; a null id takes no part; an empty
table gives an empty result; very long vectors are blocks of their width; other columns, whatever their names, are not read. A vector whose squared
components sum to 2^62 or more raises an error; below that, no score leaves 64 bits (Cauchy-Schwarz).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch

BLOCK_ROWS, QUERY_ROWS, DIMENSIONS = 4096, 1024, 8
BLOCK_SCHEMA = "block long, width int, ids binary, vectors binary"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; unusable vectors are left out."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    square = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + F.floor(x).cast("double") * F.floor(x).cast("double"))
    too_large = F.raise_error(F.concat(F.lit("components too large for exact scores: vec_id "), F.col("vec_id").cast("string"))).cast("array<bigint>")
    whole = F.when(square < F.lit(2.0**62), F.transform(scaled, lambda x: F.floor(x))).otherwise(too_large)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(F.col("vec_id").cast("long"), whole.alias("v"))


def blocks(vectors: DataFrame, rows: int, name: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """Blocks of at most `rows` vectors of one width, stored with dimensions first; and how many."""

    def build(it):
        parts: dict[int, tuple[list, list]] = {}

        def out(width, ids, vs):  # a row repeated in a block would take another's place among its k best
            once = np.unique(np.column_stack([np.concatenate(ids), np.concatenate(vs)]), axis=0)
            return pa.RecordBatch.from_pylist(
                [{"block": 0, "width": width, "ids": once[:, 0].tobytes(), "vectors": np.ascontiguousarray(once[:, 1:].T).tobytes()}],
                pa.schema([("block", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]),
            )

        for batch in it:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            widths = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                vs = flat[starts[at][:, None] + np.arange(width)] if width else np.zeros((len(at), 0), np.int64)
                for lo in range(0, len(at), rows):
                    held = parts.setdefault(width, ([], []))
                    held[0].append(ids[at[lo : lo + rows]])
                    held[1].append(vs[lo : lo + rows])
                    if sum(map(len, held[0])) > rows:
                        *full, last = zip(*held, strict=True)
                        yield out(width, [x[0] for x in full], [x[1] for x in full])
                        parts[width] = ([last[0]], [last[1]])
        for width, held in parts.items():
            yield out(width, *held)

    n = max(1, math.ceil(vectors.count() / rows))
    built = scratch.save(vectors.repartition(n).mapInArrow(build, BLOCK_SCHEMA), name)
    return built, built.count()


def best_in_block(ids: np.ndarray, c: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c: [width, n], q: [m, width]. Up to k (query id, id, score) a query, ties to smaller ids, own ids left out."""
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(1), kind="stable")
    exact = len(order) * float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**52
    c, q = (x.astype(np.float64 if exact else np.int64) for x in (c[order], q[:, order]))
    cuts = list(range(0, len(order), DIMENSIONS))
    left = [np.sqrt((c[cut + DIMENSIONS :].astype(np.float64) ** 2).sum(0)) for cut in cuts]
    got: list[tuple] = []
    for query_id, row in zip(query_ids.tolist(), q, strict=True):
        alive = np.flatnonzero(ids != query_id)
        score = np.zeros(len(alive), c.dtype)
        whole = len(alive) == len(ids)
        for cut, rest in zip(cuts, left, strict=True):
            part = c[cut : cut + DIMENSIONS]
            score = score + row[cut : cut + DIMENSIONS] @ (part if whole else part[:, alive])
            if len(alive) <= k or cut == cuts[-1]:
                continue
            slack = rest[alive] * (math.sqrt(float((row[cut + DIMENSIONS :].astype(np.float64) ** 2).sum())) * (1 + 1e-9)) + 1e-3
            keep = score + slack >= np.partition(score - slack, len(alive) - k)[len(alive) - k]
            if keep.sum() < 0.8 * len(alive):
                alive, score, whole = alive[keep], score[keep], False
        best = np.lexsort((ids[alive], -score))[:k]
        got.append((np.full(len(best), query_id), ids[alive[best]], score[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` selects, its k best other rows. vectors: vec_id, v."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    rows, n_rows = blocks(vectors, BLOCK_ROWS, "rows", scratch)
    asked, n_asked = blocks(vectors.filter(queries), QUERY_ROWS, "queries", scratch)
    side = max(1, min(64, math.isqrt(n_rows * n_asked // (4 * spark.sparkContext.defaultParallelism))))
    tall, wide = max(1, math.ceil(n_rows / side)), max(1, math.ceil(n_asked / side))
    number = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    left = rows.withColumn("tall", number(tall)).withColumn("wide", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    right = asked.withColumn("wide", number(wide)).withColumn("tall", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))))
    met = left.join(
        right.select("tall", "wide", F.col("width").alias("query_width"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), ["tall", "wide"]
    ).filter("width = query_width")

    def search(it):
        for batch in it:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                shape = (row["width"], -1) if row["width"] else (0, len(row["ids"]) // 8)
                c = np.frombuffer(row["vectors"], np.int64).reshape(shape)
                q = np.frombuffer(row["query_vectors"], np.int64).reshape(shape if row["width"] else (0, len(row["query_ids"]) // 8)).T
                found = best_in_block(np.frombuffer(row["ids"], np.int64), c, np.frombuffer(row["query_ids"], np.int64), q, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    found = met.select("width", "ids", "vectors", "query_ids", "query_vectors").mapInArrow(search, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
