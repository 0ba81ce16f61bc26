"""Registered queries of the streaming forms: each feeds a driver table as a stream of several batches, in no order, and gives what the stream gave out.

Feeds, checkpoints and results are folders of the shared place; results have a folder for each epoch, so an epoch that is repeated replaces its rows. State is RocksDB's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold.plans import documents, jobs
from inkfold.sources import files
from inkfold.sources.derived import table, uploads
from inkfold.streaming import streams as T

QUERIES, ORACLE = {}, {}
BATCHES = 3
#: Batches come in no order, so nothing is late: the delay is longer than the data, and one row of END_S, years after all others, ends the waiting.
DELAY, END_S, END_KEY = "3650 days", 4_102_444_800, -1
#: Records of a shard of the sync queue, about.
SHARD = 5_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def _fed(spark: SparkSession, frame: DataFrame, label: str, last: DataFrame | None = None) -> DataFrame:
    """The frame's rows as a stream of BATCHES batches, then `last`. The stream has a session of its own, so that its settings stay with it."""
    path = files.fresh_dir(spark, f"{label}-feed")
    n = max(BATCHES, spark.sparkContext.defaultParallelism)
    frame.repartition(n).write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return session.readStream.schema(frame.schema).option("maxFilesPerTrigger", -(-n // BATCHES)).parquet(path)


def _ended(query: StreamingQuery) -> None:
    """Waits for a query over all there is; its failure is raised here."""
    query.awaitTermination()


def _drained(spark: SparkSession, frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What the stream gave out, with the epoch of each row."""
    out = files.fresh_dir(spark, label)
    writer = frame.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
    _ended(writer.outputMode(mode).option("checkpointLocation", files.fresh_dir(spark, f"{label}-state")).trigger(availableNow=True).start())
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in frame.schema)}, epoch long").parquet(out)


def _row(spark: SparkSession, frame: DataFrame, **values) -> DataFrame:
    """One row of the frame's schema; columns that are not given are null."""
    return spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in frame.schema])


def _seconds():
    """Event time where a day counts as a second."""
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 86400


@query("stream_ingest", jobs.ORACLE["rejected_split"].split(" SELECT status = 200")[0] + " SELECT id, status, reason, strftime(make_timestamp((1700000000 + id * 36000) * 1000000), '%Y-%m') AS month, status = 200 AS stored FROM r")
def stream_ingest(spark, sf):
    rows = uploads(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 36_000))
    good, bad, state = (files.fresh_dir(spark, f"ingest-{x}") for x in ("good", "rejected", "state"))
    _ended(T.stream_ingest(_fed(spark, rows, "ingest"), good, bad, state))
    read = lambda path, stored: spark.read.schema("id long, status int, reason string, month string, epoch long").parquet(path).select("id", "status", "reason", "month", F.lit(stored).alias("stored"))
    return read(good, True).unionByName(read(bad, False))


@query("stream_sync_queue", """
WITH records AS (SELECT user_id AS id, count(*) % 4 AS attempts, user_id % 5 = 0 AS synced, CASE WHEN user_id % 2 = 0 THEN 'old' END AS last_error FROM events GROUP BY user_id),
o AS (SELECT user_id AS id, event_id AS seq, CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, event_id % 7 = 1 AS ok, CASE WHEN event_id % 3 <> 0 THEN concat('e', event_id) END AS error FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ms, seq) AS n, coalesce(bool_or(ok) OVER (PARTITION BY id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM o),
c AS (SELECT id, count(*) AS tries, bool_or(ok) AS ok, list(error ORDER BY n)[-1] AS error FROM n JOIN records USING (id) WHERE NOT done AND NOT synced AND attempts + n <= 5 GROUP BY id)
SELECT id, attempts + coalesce(tries, 0) AS attempts, synced OR coalesce(ok, false) AS synced, CASE WHEN ok THEN NULL WHEN tries > 0 THEN error ELSE last_error END AS last_error FROM records LEFT JOIN c USING (id)""")
def stream_sync_queue(spark, sf):
    def records(session):
        e = table(session, sf, "events").groupBy(F.col("user_id").alias("id")).agg((F.count("*") % 4).alias("attempts"))
        return e.select("id", "attempts", (F.col("id") % 5 == 0).alias("synced"), F.when(F.col("id") % 2 == 0, "old").alias("last_error"))

    e = F.col("event_id")
    outcomes = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), e.alias("seq"), (e % 7 == 1).alias("ok"), F.when(e % 3 != 0, F.concat(F.lit("e"), e.cast("string"))).alias("error"))
    last = spark.range(1).select(F.lit(END_KEY).cast("long").alias("id"), F.timestamp_seconds(F.lit(END_S)).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    fed = _fed(spark, outcomes, "sync", last)
    shards = max(64, records(spark).count() // SHARD)
    changes = _drained(spark, T.stream_sync_queue(fed, records(fed.sparkSession), delay=DELAY, shards=shards), "sync", "update")
    return T.current_records(records(spark), changes.filter(F.col("id") != END_KEY))


@query("stream_rate_limit", jobs.ORACLE["token_bucket"])
def stream_rate_limit(spark, sf):
    requests = table(spark, sf, "events").select(F.col("user_id").alias("key"), _seconds().alias("ts"), F.col("event_id").alias("seq"))
    fed = _fed(spark, requests, "rate", _row(spark, requests, key=END_KEY, ts=float(END_S), seq=0))
    judged = _drained(spark, T.stream_rate_limit(fed, rate=2.0, burst=3, delay=DELAY), "rate")
    return judged.filter(F.col("key") != END_KEY).select("key", "seq", "allowed")


@query("stream_latest", "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type = 'view', event_id) AS cancelled FROM events GROUP BY user_id")
def stream_latest(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("cancelled"))
    changes = _drained(spark, T.stream_latest(_fed(spark, runs, "latest")), "latest", "update")
    return changes.groupBy("key").agg(F.max_by(F.struct("seq", "cancelled"), "epoch").alias("r")).select("key", "r.seq", "r.cancelled")


@query("stream_throttle", """
WITH RECURSIVE p AS (SELECT user_id AS key, epoch(ts)::DOUBLE / 86400 AS ts, CAST(CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 4 * 25 END AS INTEGER) AS percent FROM events),
m AS (SELECT *, CAST(round(ts * 1000) AS BIGINT) AS ms FROM p),
r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(ms) OVER w - ms > 1200, true) AS last FROM m WINDOW w AS (PARTITION BY key ORDER BY ms, ts, percent)),
f AS (SELECT key, ts, percent, n, true AS shown, ms AS shown_ms, percent AS shown_percent FROM r WHERE n = 1
  UNION ALL SELECT key, ts, percent, n, p, CASE WHEN p THEN ms ELSE shown_ms END, CASE WHEN p THEN percent ELSE shown_percent END FROM
  (SELECT r.*, f.shown_ms, f.shown_percent, r.last OR (r.ms - f.shown_ms >= 600 AND (r.percent < 0 OR r.percent <> f.shown_percent)) AS p FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))
SELECT key, ts, percent FROM f WHERE shown""")
def stream_throttle(spark, sf):
    e = F.col("event_id")
    progress = table(spark, sf, "events").select(F.col("user_id").alias("key"), _seconds().alias("ts"), F.when(e % 5 == 0, -1).otherwise(e % 4 * 25).cast("int").alias("percent"))
    fed = _fed(spark, progress, "throttle", _row(spark, progress, key=END_KEY, ts=float(END_S), percent=0))
    shown = _drained(spark, T.stream_throttle(fed, gap=0.6, idle=1.2, delay=DELAY), "throttle")
    return shown.filter(F.col("key") != END_KEY).select("key", "ts", "percent")


@query("stream_combine_pages", "WITH " + documents.PAGES + """,
newest AS (SELECT doc, page, status, CASE WHEN page % 2 = 0 THEN 'again ' || text ELSE text END AS text FROM pages)
SELECT doc, coalesce(string_agg(concat('--- Page ', page + 1, ' ---', chr(10), text), chr(10) || chr(10) ORDER BY page) FILTER (status = 'read' AND trim(coalesce(text, '')) <> ''), '') AS text FROM newest GROUP BY doc""")
def stream_combine_pages(spark, sf):
    pages = documents._pages(spark, sf).select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "status", "text", F.lit(1).cast("long").alias("seq"))
    again = pages.filter("page % 2 = 0").withColumns({"text": F.concat(F.lit("again "), "text"), "seq": F.lit(2).cast("long")})
    texts = _drained(spark, T.stream_combine_pages(_fed(spark, pages.union(again), "pages")), "pages", "update")
    return texts.groupBy("doc").agg(F.max_by("text", "epoch").alias("text"))


@query("newest_pages", "WITH " + documents.PAGES + " SELECT doc, page, status, CASE WHEN page % 2 = 0 THEN 'again ' || text ELSE text END AS text FROM pages")
def newest_pages(spark, sf):
    pages = documents._pages(spark, sf).select("doc", "page", "status", "text", F.lit(1).alias("seq"))
    again = pages.filter("page % 2 = 0").withColumns({"text": F.concat(F.lit("again "), "text"), "seq": F.lit(2)})
    return T.newest_pages(pages.union(again)).drop("seq")


@query("periodic_sweep", "SELECT user_id AS key, count(*) AS n, max(event_id) AS last_seen FROM events GROUP BY user_id")
def periodic_sweep(spark, sf):
    out = files.fresh_dir(spark, "sweep")

    def sweep(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last_seen")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    seen = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    _ended(T.periodic_sweep(_fed(spark, seen, "sweep"), sweep, files.fresh_dir(spark, "sweep-state")))
    swept = spark.read.schema("key long, n long, last_seen long, epoch long").parquet(out)
    return swept.groupBy("key").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))
