"""Streaming forms against their batch twins."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkfold.operators import assemble as A
from inkfold.operators import contrib as C
from inkfold.sources.derived import lines, uploads
from inkfold.streaming import streams as T

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def feed(spark, tmp_path):
    """A frame as a stream of a few files."""

    def stream(frame, parts=3):
        path = str(tmp_path / "feed")
        frame.repartition(parts).write.parquet(path)
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return stream


@pytest.fixture
def rocks(spark):
    keys = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def drain(frame, name, tmp_path, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def requests(spark, n=300):
    rng = random.Random(2)
    return spark.createDataFrame([(rng.randrange(8), 1 + float(i // 3) / 4, i) for i in range(n)], "key long, ts double, seq long")


class Source:
    """A folder that batches are put into, and what a query over it gave out; each run goes on from the checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.n, self.schema = spark, tmp_path, 0, schema
        (tmp_path / "source").mkdir()

    def put(self, frame):
        self.n += 1
        frame.coalesce(1).write.parquet(str(self.path / f"made-{self.n}"))
        part = next((self.path / f"made-{self.n}").glob("part-*.parquet"))
        os.utime(part, (self.n * 10, self.n * 10))
        part.rename(self.path / "source" / f"{self.n}.parquet")

    def run(self, make, mode="append"):
        out = []
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "source"))
        q = make(stream).writeStream.foreachBatch(lambda batch, _: out.append(batch.collect())).outputMode(mode).option("checkpointLocation", str(self.path / "checkpoint")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        return out


def shuffled_in_parts(frame, parts=3, seed=1):
    rows = frame.collect()
    random.Random(seed).shuffle(rows)
    return [frame.sparkSession.createDataFrame(rows[k::parts], frame.schema) for k in range(parts)]


@pytest.fixture
def timed_rocks(spark):
    keys = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def ran(spark, tmp_path, frame, far, make, mode="append"):
    """Rows that `make` gives for three shuffled batches of the frame, one of its rows again, and a last row far ahead; the query is stopped and started between them."""
    source = Source(spark, tmp_path, frame.schema)
    first, *rest = shuffled_in_parts(frame)
    source.put(first)
    out = source.run(make, mode)
    for batch in rest:
        source.put(batch)
    out += source.run(make, mode)
    source.put(far)
    return [r for batch in out + source.run(make, mode) for r in batch]


def test_rate_limit(spark, tmp_path, timed_rocks):
    """Three shuffled batches and a restart give what the batch form gives; a request that comes twice counts twice."""
    frame = requests(spark).union(requests(spark).limit(1))
    want = sorted((r.key, r.seq, r.allowed) for r in C.token_bucket(frame, 1.0, 3).collect())
    assert {w[2] for w in want} == {True, False}
    far = spark.createDataFrame([(99, 1e6, 10**6)], frame.schema)
    got = ran(spark, tmp_path, frame, far, lambda f: T.stream_rate_limit(f, 1.0, 3, shards=3, delay="1 hour"))
    assert sorted((r.key, r.seq, r.allowed) for r in got if r.key != 99) == want


def test_rate_limit_cap(spark, tmp_path, timed_rocks):
    """One shard that holds two keys: the least recently seen is forgotten, and so has a full bucket when it comes again."""
    keys = [1, 1, 2, 1, 3, 1, 2, 2, 3, 1]
    frame = spark.createDataFrame([(k, 1 + float(i) / 100, i) for i, k in enumerate(keys)], "key long, ts double, seq long")
    far = spark.createDataFrame([(99, 1e6, 10**6)], frame.schema)
    got = ran(spark, tmp_path, frame, far, lambda f: T.stream_rate_limit(f, 0.0, 1, cap=2, shards=1, delay="1 hour"))
    held, want = [], {}
    for i, k in enumerate(keys):
        want[i] = k not in held
        held = [x for x in held if x != k] + [k]
        held = held[-2:]
    assert {r.seq: r.allowed for r in got if r.key != 99} == want and len(set(want.values())) == 2


def test_throttle(spark, tmp_path, timed_rocks):
    """The last row of a key comes out, whatever its percent; unknown totals pass by time alone; a pause ends a run of rows."""
    rows = [(k, 1 + t / 10, min(37 + k, t * (k + 1))) for k in range(3) for t in range(60)] + [(7, 1 + t / 20, -1) for t in range(50)] + [(8, 1.0, 5), (8, 1.05, 6), (8, 500.0, 6), (8, 500.1, 6)]
    frame = spark.createDataFrame(rows, "key long, ts double, percent int")
    want = sorted(map(tuple, T.throttle(frame).collect()))
    assert (0, 6.9, 37) in want and (8, 1.05, 6) in want and (8, 500.1, 6) in want
    unknown = [ts for k, ts, _ in want if k == 7]
    assert unknown == [1 + t / 20 for t in range(0, 50, 4)] + [1 + 49 / 20]
    far = spark.createDataFrame([(99, 1e6, 1)], frame.schema)
    got = sorted(map(tuple, ran(spark, tmp_path, frame.union(frame.limit(1)), far, lambda f: T.stream_throttle(f, delay="1 hour"))))
    assert [g for g in got if g[0] != 99] == want and len(want) < len(rows)


def test_latest_and_pages(spark, tmp_path, feed):
    runs = requests(spark).select("key", "seq", (F.col("seq") % 5 == 0).alias("cancelled"))
    got = {r.key: (r.seq, r.cancelled) for r in drain(T.stream_latest(feed(runs)), "latest", tmp_path, "complete")}
    assert {k: s for k, (s, c) in got.items() if not c} == {r.key: r.seq for r in A.latest_run(runs).collect()}


def test_combine_pages(spark, tmp_path, timed_rocks):
    """A page that comes again, in its batch or a later one, replaces its text; the last text of a document is the batch form's."""
    pages = A.assemble_page(lines(spark, SF)).select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "status", "text").withColumn("seq", F.lit(1).cast("long"))
    again = pages.filter("page % 2 = 0").withColumns({"text": F.concat(F.lit("again "), "text"), "seq": F.lit(2).cast("long")})
    blank = pages.filter("page % 5 = 1").withColumns({"text": F.lit(" "), "seq": F.lit(3).cast("long")})
    frame = pages.union(again).union(blank).union(pages.limit(20))
    want = {r.doc: r.text or "" for r in A.combine_pages(T.newest_pages(frame)).collect()}
    source = Source(spark, tmp_path, frame.schema)
    texts, seen = {}, 0
    for batch in shuffled_in_parts(frame):
        source.put(batch)
        for r in [r for rows in source.run(T.stream_combine_pages, "update") for r in rows]:
            assert texts.get(r.doc) != r.text
            texts[r.doc], seen = r.text, seen + 1
    assert texts == want and seen > len(want)
    source.put(frame)  # all of it once more: nothing changes, so nothing comes out
    assert not [r for rows in source.run(T.stream_combine_pages, "update") for r in rows]


def test_ingest(spark, tmp_path, feed):
    frame = uploads(spark, SF).withColumn("ts", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    q = T.stream_ingest(feed(frame), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    judged = C.validate_upload(frame).groupBy((F.col("status") == 200).alias("ok")).count().collect()
    assert {r.ok: r["count"] for r in judged} == {True: spark.read.parquet(str(tmp_path / "good")).count(), False: spark.read.parquet(str(tmp_path / "bad")).count()}


def test_sync_queue(spark, tmp_path, timed_rocks):
    """Several batches and a restart: attempts stop at five, success ends them, a batch gives out what it changes only, and failures come out as due after their delay."""
    records = spark.createDataFrame([(i, i % 3, i == 4, "old" if i % 3 else None) for i in range(40)], "id long, attempts long, synced boolean, last_error string")
    rng = random.Random(3)
    rows = [(rng.randrange(12), 1000 * n + 1, n, rng.random() < 0.2, None if rng.random() < 0.3 else f"e{n}") for n in range(90)]
    outcomes = spark.createDataFrame(rows, "id long, s long, seq long, ok boolean, error string").select("id", F.timestamp_seconds("s").alias("ts"), "seq", "ok", "error")
    want = {r.id: tuple(r)[1:] for r in T.charge_outcomes(records, outcomes).collect()}
    assert max(w[0] for w in want.values()) == C.MAX_ATTEMPTS and any(w[1] for i, w in want.items() if i != 4)
    far = spark.createDataFrame([(99, 10**7, 10**6, True, None)], "id long, s long, seq long, ok boolean, error string").select("id", F.timestamp_seconds("s").alias("ts"), "seq", "ok", "error")
    got = ran(spark, tmp_path, outcomes, far, lambda f: T.stream_sync_queue(f, records, delay="2 days"), "update")
    changes = [r for r in got if r.id != 99]
    assert {r.id for r in changes} <= {r[0] for r in rows}
    schema = "id long, ms long, attempts long, synced boolean, last_error string, due boolean"
    assert {r.id: tuple(r)[1:] for r in T.current_records(records, spark.createDataFrame(changes, schema)).collect()} == want
    due = {r.id: r.ms for r in changes if r.due}
    last = {i: max(r[1] for r in rows if r[0] == i) for i in due}
    for i, (attempts, synced, _) in want.items():
        assert (i in due) == (i in {r[0] for r in rows} and not synced and attempts < C.MAX_ATTEMPTS)
        assert i not in due or due[i] == last[i] * 1000 + (30_000 << (attempts - 1))


def test_sync_queue_waits_with_what_can_count():
    """A shard's state is called for a batch, not for each of its outcomes, and no more rows wait than can be charged; retries come out whatever the batches."""
    import pandas as pd

    from inkfold.streaming.ordered import Delivery

    calls = []

    class Held(dict):
        rows = ()
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        put = lambda self, rows: setattr(self, "rows", rows)
        appendList = lambda self, rows: calls.append(len(rows)) or self.put([*self.rows, *rows])
        clear = lambda self: self.put(())
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        getListState = getMapState = lambda self, name, *_: Held()
        registerTimer = lambda self, ms: timers.add(ms)

    timers, rng = set(), random.Random(4)
    queue = Delivery(lambda n: 50 * n)
    queue.init(Handle())
    rows = [(1000 + n, True, n, rng.random() < 0.05, f"e{n}", i < 29, i if i < 29 else 0) for n in range(3000) for i in [rng.randrange(30)]]
    rng.shuffle(rows)
    for at in range(0, 3000, 1000):
        assert list(queue.handleInputRows((0,), iter([pd.DataFrame(rows[at : at + 1000], columns=Delivery.WAITING)]), None)) == []
    assert len(calls) == 3 and max(calls) <= 30 * C.MAX_ATTEMPTS
    got = []
    for upto in (999, 1040, 1100, 2000, 10_000, 10_000):
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, upto=upto: upto})()
        got += [r for f in queue.handleExpiredTimer((0,), clock, None) for r in f.itertuples(index=False)]
    for i in [*range(29), None]:
        own = sorted(r for r in rows if (r[6] if r[5] else None) == i)[: C.MAX_ATTEMPTS]
        tries = next((n for n, r in enumerate(own, 1) if r[3]), len(own))
        last = [r for r in got if r.id == i and not r.due][-1]
        assert (last.ms, last.attempts, last.synced, last.last_error) == (own[tries - 1][0], tries, own[tries - 1][3], None if own[tries - 1][3] else own[tries - 1][4])
    assert timers and queue.waiting.rows == ()


def test_sweep_and_sessions(spark, tmp_path, feed):
    seen = []
    q = T.periodic_sweep(feed(requests(spark, 30)), lambda batch, epoch: seen.append(batch.count()), str(tmp_path / "c"))
    assert q.awaitTermination(120) and sum(seen) == 30
    events = spark.createDataFrame([(1, 0), (1, 200), (1, 700), (2, 0)], "key int, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n for r in T.idle_sessions(events).collect()) == [1, 1, 2]


def test_ingest_writes_few_files(spark, tmp_path, feed):
    """Many months: a file a month and task that shares it, not one for each month of each task."""
    frame = uploads(spark, SF).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1_200_000))
    q = T.stream_ingest(feed(frame.repartition(4)), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    shared = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for epoch in (tmp_path / "good").glob("epoch=*"):
        months = list(epoch.glob("month=*"))
        assert len(list(epoch.glob("month=*/*.parquet"))) < len(months) + shared
    stored = C.validate_upload(frame).filter("status = 200")
    kept = spark.read.parquet(str(tmp_path / "good"))
    assert kept.select("id", kept["month"].cast("string")).exceptAll(stored.select("id", F.date_format("ts", "yyyy-MM"))).count() == 0 and kept.count() == stored.count()
