"""Numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.sources.files import saved


def number_rows(rows: DataFrame, name: str) -> DataFrame:
    """Adds `name`: 1, 2, … over the partitions as they come, each in its own order.

    A row's number is its place in its partition plus the sizes of the partitions before; these, one row a partition, are joined by broadcast.
    The rows are written first, so that both see the same partitions.
    """
    kept = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # as Spark numbers rows
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), part == F.col("_part")).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_start") + place + 1).alias(name))


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the rank from 1 in a global order. Rows are range-partitioned by it and sorted inside their range."""
    return number_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), name)


def rank_within(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the rank from 1 among the rows of the same keys (not null). A key's rows may fill many tasks: a rank over all, less that of the key's first row."""
    ranked = global_rank(rows, [*[F.col(k) for k in keys], *order], "_all")  # reads the rows that it has written, whenever it is read
    firsts = ranked.groupBy(*keys).agg(F.min("_all").alias("_first"))
    return ranked.join(firsts, keys).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_all") - F.col("_first") + 1).alias(name))
