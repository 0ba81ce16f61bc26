"""Structured Streaming forms of the keyed and timed jobs. Each has a batch twin, named in its docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold.operators import contrib as C
from inkfold.streaming.ordered import Buckets, Delivery, Pages, Throttle


def stream_ingest(uploads: DataFrame, good: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Uploads to a month-partitioned store, the others with status and reason to a side table. Twin: validate_upload. uploads: with ts.

    Both have a folder for each epoch, so that an epoch that is repeated replaces its rows. Ranges of months and ids go to a task each: an epoch has about a file a month, however
    many tasks there are, and a month with many rows is parted among tasks.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        judged = C.validate_upload(batch).withColumn("month", F.date_format("ts", "yyyy-MM")).persist()
        judged.filter("status = 200").repartitionByRange("month", "id").write.mode("overwrite").partitionBy("month").parquet(f"{good}/epoch={epoch}")
        judged.filter("status <> 200").write.mode("overwrite").parquet(f"{rejected}/epoch={epoch}")
        judged.unpersist()

    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(rows: DataFrame, ms: Column, delay: str) -> DataFrame:
    """rows with their event time in ms, and a watermark on it."""
    return rows.withColumn("ms", ms.cast("long")).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", delay)


def stream_sync_queue(outcomes: DataFrame, records: DataFrame, surface: str = "android", delay: str = "1 minute", shards: int = 64) -> DataFrame:
    """Changes (id, ms, attempts, synced, last_error, due) of records by delivery outcomes. Twin: charge_outcomes.

    outcomes: id, ts, seq, ok, error. records (a batch): id, attempts, synced, last_error, where deliveries begin. One attempt an outcome, up to MAX_ATTEMPTS and to
    the first success, which clears the error. After a failure the record comes out again, due, when its retry delay is over. Records fall into shards, a task's call each, whose
    state has a row a record: choose `shards` so that one's waiting rows fit a task. Needs the RocksDB state store;
    a batch gives out the records that it changes and no others.
    """
    retry = (lambda n: 1500 * n) if surface == "web" else (lambda n: 30_000 << (n - 1))
    shard = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(shards)).alias("shard")
    own = (F.col("id").isNotNull().alias("named"), F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")).alias("id"))  # Pandas makes fractions of columns with nulls
    seq = (F.col("seq").isNotNull().alias("known"), F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"))
    timed = _timed(outcomes, F.round(F.unix_micros("ts") / 1000), delay).select(shard, *own, "ms", "at", *seq, "ok", "error")
    before = records.select(shard, *own, "attempts", "synced", "last_error")
    schema = "id long, ms long, attempts long, synced boolean, last_error string, due boolean"
    return timed.groupBy("shard").transformWithStateInPandas(Delivery(retry), schema, "Update", "EventTime", initialState=before.groupBy("shard"))


def charge_outcomes(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """id, attempts, synced, last_error of all records after the outcomes, in the order of ts, then seq: the batch form of stream_sync_queue."""
    before = records.select("id", F.col("attempts").alias("_attempts"), F.col("synced").alias("_synced"))
    order = W.partitionBy("id").orderBy("ts", "seq")
    earlier = F.coalesce(F.max("ok").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    met = outcomes.join(before, "id", "left").withColumns({"_n": F.row_number().over(order), "_done": earlier | F.coalesce("_synced", F.lit(False))})
    counted = met.filter(~F.col("_done") & (F.coalesce("_attempts", F.lit(0)) + F.col("_n") <= C.MAX_ATTEMPTS))
    new = counted.groupBy("id").agg(F.count("*").alias("_tries"), F.bool_or("ok").alias("_ok"), F.max_by(F.struct("error"), "_n").alias("_last"))
    both = records.join(new, "id", "full_outer")
    return both.select(
        "id", (F.coalesce("attempts", F.lit(0)) + F.coalesce("_tries", F.lit(0))).alias("attempts"), (F.coalesce("synced", F.lit(False)) | F.coalesce("_ok", F.lit(False))).alias("synced"),
        F.when(F.col("_ok"), None).when(F.col("_tries") > 0, F.col("_last.error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def current_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    """The records with the newest of the changes that stream_sync_queue gave out."""
    newest = changes.groupBy("id").agg(F.max_by(F.struct("attempts", "synced", "last_error"), F.struct("attempts", "synced")).alias("_new"))
    both = records.join(newest, "id", "full_outer")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("id", pick("attempts"), pick("synced"), pick("last_error"))


def stream_rate_limit(requests: DataFrame, rate: float = 5.0, burst: int = 10, ttl: float = 600.0, cap: int = 50_000, shards: int = 64, delay: str = "10 seconds") -> DataFrame:
    """(key, seq, allowed). Twin: token_bucket, while no shard has more than `cap` keys. requests: key, ts in seconds, seq.

    Requests are judged in the order of ts, then seq, once the watermark has passed them. Keys fall into shards; each is like one instance of the service: it forgets a key after `ttl` idle seconds
    and the least recently seen one beyond `cap`. Its state is bounded by the cap, whatever keys come. Needs the RocksDB state store.
    """
    timed = _timed(requests, F.round(F.col("ts") * 1000), delay).select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "ts", "seq", "ms", "at")
    return timed.groupBy("shard").transformWithStateInPandas(Buckets(rate, burst, ttl, cap), "key long, seq long, allowed boolean", "Append", "EventTime")


def stream_latest(runs: DataFrame) -> DataFrame:
    """(key, seq, cancelled) of each key's newest run. Twin: latest_run."""
    newest = runs.groupBy("key").agg(F.max_by(F.struct("seq", "cancelled"), "seq").alias("r"))
    return newest.select("key", "r.seq", "r.cancelled")


def stream_throttle(progress: DataFrame, gap: float = 0.2, idle: float = 60.0, delay: str = "10 seconds") -> DataFrame:
    """(key, ts, percent) rows to show. Twin: throttle. Needs the RocksDB state store. progress: key, ts in seconds, percent (-1: of unknown total)."""
    timed = _timed(progress, F.round(F.col("ts") * 1000), delay).select("key", "ts", "percent", "ms", "at")
    return timed.groupBy("key").transformWithStateInPandas(Throttle(round(gap * 1000), round(idle * 1000)), "key long, ts double, percent int", "Append", "EventTime")


def throttle(progress: DataFrame, gap: float = 0.2, idle: float = 60.0) -> DataFrame:
    """The batch form of stream_throttle: a fold over each key's progress in order, and its last row before each pause and at its end."""
    row = "struct<ms:bigint,ts:double,percent:int>"
    kind = f"struct<ms:bigint,percent:int,out:array<{row}>>"
    own = F.struct(F.round(F.col("ts") * 1000).cast("long").alias("ms"), F.col("ts").cast("double").alias("ts"), F.col("percent").cast("int").alias("percent"))
    keys = progress.groupBy("key").agg(F.array_sort(F.collect_list(own)).alias("all"))
    ends = F.zip_with("all", F.slice("all", 2, F.size("all")), lambda r, n: F.struct(r.alias("r"), F.coalesce(n["ms"] - r["ms"] > round(idle * 1000), F.lit(True)).alias("end")))

    def step(acc, e):
        r = e["r"]
        passes = acc["ms"].isNull() | ((r["ms"] - acc["ms"] >= round(gap * 1000)) & ((r["percent"] < 0) | (r["percent"] != acc["percent"]))) | e["end"]
        return F.when(passes, F.struct(r["ms"].alias("ms"), r["percent"].alias("percent"), F.concat(acc["out"], F.array(r)).alias("out")).cast(kind)).otherwise(acc)

    zero = F.struct(F.lit(None).cast("long").alias("ms"), F.lit(None).cast("int").alias("percent"), F.array().cast(f"array<{row}>").alias("out")).cast(kind)
    return keys.select("key", F.inline(F.aggregate(ends, zero, step, lambda acc: acc["out"]))).select("key", "ts", "percent")


def stream_combine_pages(pages: DataFrame) -> DataFrame:
    """(doc, text) of the documents whose text changed, as pages arrive or are read again. Twin: combine_pages of newest_pages. Needs the RocksDB state store.

    pages: doc, page, status, text, seq (the number of its reading: the newest counts). State has a row a page, so a page that comes again replaces what it held.
    """
    shown = F.when((F.col("status") == "read") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    rows = pages.select("doc", F.col("page").cast("int").alias("page"), F.col("seq").cast("long").alias("seq"), shown.alias("shown"))
    return rows.groupBy("doc").transformWithStateInPandas(Pages(), "doc long, text string", "Update", "None")


def newest_pages(pages: DataFrame) -> DataFrame:
    """Of each page its newest reading. pages: doc, page, status, text, seq."""
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    return pages.groupBy("doc", "page").agg(F.max_by(own, F.struct("seq", "text")).alias("own")).select("own.*")


def idle_sessions(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """(key, first_ts, n): sessions that end after an idle gap. Batch and stream alike; a stream needs a watermark on ts."""
    sessions = events.groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return sessions.select("key", F.col("session_window.start").alias("first_ts"), "n")


def periodic_sweep(frame: DataFrame, sweep, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs `sweep(batch, epoch)` on what arrived: every so often, or (None) once over all there is."""
    writer = frame.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
