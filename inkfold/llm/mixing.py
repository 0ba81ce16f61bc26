"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in shuffled order, repeated up to `max_copies` times. A copy's
virtual finish time is the source's cumulative words up to and with it, divided by the source's target. The
copies of all sources are range-sorted by that time, and the mix is the front of this order: what lies before the
point where the running total of words reaches the total budget. The copy at that point is cut at a word.
A source has had its whole target at virtual time 1; the one copy of each source that is in service then is cut into packets of
PACKET words, which queue one by one, so that a long document neither holds its source up nor overshoots.

Scale: one pass reads the texts and leaves (id, source, size). Running sums are two-level, twice. In a source, documents fall
into 4,096 buckets by the leading digits of their shuffle key, and only bucket totals are summed
over the whole source. In the sorted queue, only totals of range partitions are summed over all; the running total by row is
needed in one range partition alone, the one that the budget ends in. No task holds a large source. Unpartitioned windows are over one row
for each source or range partition.

Defined cases: null text and text of white space have size 0 and taken 0; null source is a source of its
own, sorted last; repeated rows are documents of their own; very long texts are packets where it matters, else one copy like others; ties of
finish times go by source, shuffle key, size, then copy; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch, word_count

#: Hexadecimal digits of the shuffle key that name a document's bucket.
BUCKET_DIGITS = 3
#: Words of a packet of the copy that is in service at virtual time 1.
PACKET = 16
#: The global order of the queue; `place` tells rows of one document id apart.
ORDER = ("v_finish", "queue", "shuffle_key", "place", "copy", "packet")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """(source, source_size) -> with target.

    Weights go round the sources in code-point order, null last. A target stops at `max_copies` times its
    source's size and the excess is shared again by weight. With sources sorted by cap a unit of weight,
    the level that the first k leave to the rest is a prefix expression, and the final level its maximum.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    cap = F.lit(float(max_copies)) * F.col("source_size")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("weight", pick)
        .withColumn("cap", cap)
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def fair_queue(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix-1",
    size: Column | None = None,
) -> DataFrame:
    """The whole queue in the order of service, a row a copy or packet.

    doc_id, source, size, source_size, target, bucket and ORDER's columns, words (of the copy or packet) and taken, 0 after the budget is spent.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        (word_count(F.col("text")) if size is None else size).alias("size"),
        key.alias("shuffle_key"),
        F.substring(key, 1, BUCKET_DIGITS).alias("bucket"),
    ).withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = scratch.save(sized, "sized")

    buckets = sized.groupBy("queue", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("queue").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    targets = scratch.save(source_targets(totals.select("source", "source_size"), weights, share, max_copies), "targets")
    named = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"), "source_size", "target")
    earlier = W.partitionBy("queue").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("queue", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start")).join(named, "queue")
    inside = W.partitionBy("queue", "bucket").orderBy("shuffle_key", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumns({"inside": before, "place": F.row_number().over(inside)}).join(offsets, ["queue", "bucket"])

    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
    copies = copies.withColumn("start", F.col("bucket_start") + F.col("inside") + F.col("copy") * F.col("source_size"))
    in_service = (F.col("start") < F.col("target")) & (F.col("start") + F.col("size") > F.col("target"))
    length = F.when(in_service, F.lit(PACKET)).otherwise(F.greatest("size", F.lit(1)))
    packets = copies.withColumn("length", length).withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / F.col("length")) - 1, F.lit(0).cast("long")))))
    words = F.least("length", F.col("size") - F.col("packet") * F.col("length"))
    finish = F.coalesce(F.try_divide((F.col("start") + F.col("packet") * F.col("length") + words).cast("double"), F.col("target")), F.lit(0.0))
    rows = packets.withColumns({"words": words, "v_finish": finish}).select("doc_id", "source", "size", "source_size", "target", "bucket", "words", *ORDER)
    queue = scratch.save(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()), "queue")

    budget = targets.agg(F.round(F.sum("target")).cast("long")).first()[0]
    running = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = queue.groupBy("part").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(running))
    last = parts.filter(F.col("upto") >= F.lit(budget or 0)).orderBy("part").select("part", (F.col("upto") - F.col("words")).alias("before")).limit(1).first()
    if last is None:  # the budget is not spent, or there are no rows
        return queue.withColumn("taken", F.col("words")).drop("part")
    by_row = W.partitionBy("part").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(budget - last["before"])
    in_last = queue.filter(F.col("part") == last["part"]).withColumn("left", left - F.coalesce(F.sum("words").over(by_row), F.lit(0)))
    cut = in_last.filter("left > 0").orderBy(*[F.col(c).desc() for c in ORDER]).select(F.struct(*ORDER).alias("at"), "left").limit(1).first()
    if cut is None:  # a budget of 0
        return queue.withColumn("taken", F.lit(0).cast("long")).drop("part")
    at, place = F.struct(*[F.lit(v).cast(queue.schema[c].dataType).alias(c) for c, v in zip(ORDER, cut["at"], strict=True)]), F.struct(*ORDER)
    taken = F.when(place < at, F.col("words")).when(place == at, F.least("words", F.lit(cut["left"]))).otherwise(F.lit(0))
    return queue.withColumn("taken", taken.cast("long")).drop("part")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself in the order of service: doc_id, copy (from 1), source, size, taken, v_finish; a row a copy or packet."""
    served = fair_queue(docs, **options).filter("taken > 0")
    return served.orderBy(*ORDER).select("doc_id", (F.col("copy") + 1).alias("copy"), "source", "size", "taken", "v_finish")


#: What names one row of the documents in the queue.
_ROW = ("queue", "bucket", "place", "doc_id", "size")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """For each document what the mix takes: doc_id, size, source_size, target, taken."""
    by_row = fair_queue(docs, **options).groupBy(*_ROW).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    return by_row.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, a row a copy, whole, with their own columns.

    A copy that is cut is taken if at least half of its words were. Of rows that share an
    id, each comes as often as the most favoured one.
    """
    by_copy = fair_queue(docs, **options).groupBy(*_ROW, "copy").agg(F.sum("taken").alias("taken")).filter((F.col("size") > 0) & (2 * F.col("taken") >= F.col("size")))
    times = by_copy.groupBy(*_ROW).count().groupBy("doc_id").agg(F.max("count").cast("int").alias("_times"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    taken = own.join(times, F.col("own.doc_id").eqNullSafe(F.col("doc_id")))
    repeated = taken.select("own", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return repeated.select(*[F.col(f"own.`{c}`") for c in docs.columns])
