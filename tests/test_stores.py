"""Stores, sheets and keyed folds that grow: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from inkfold.operators import contrib as C
from inkfold.operators import locale as L


def stored(spark, path):
    rows = spark.read.parquet(path).select("folder", F.col("month").cast("string").alias("month"), "key", "seq", "content").collect()
    return sorted(map(tuple, rows))


def test_object_store_replaces_by_key(spark, tmp_path):
    """Random writes: one object a key, the last written, in its month alone; other months' files stay as they are."""
    rng, path, want = random.Random(5), str(tmp_path / "objects"), {}
    schema = "folder string, ts timestamp, key string, seq long, content binary"
    for write in range(4):
        rows = []
        for n in range(12):
            month = rng.randrange(1, 4 if write else 3)
            rows.append((rng.choice(["a", "b"]), month, f"k{rng.randrange(15)}", write * 100 + n, f"{write}-{n}".encode()))
        for folder, month, key, seq, content in sorted(rows, key=lambda r: r[3]):
            want[key] = (folder, f"2024-0{month}", key, seq, bytearray(content))
        frame = spark.createDataFrame([(f, key, seq, c, m) for f, m, key, seq, c in rows], "folder string, key string, seq long, content binary, m int")
        made = frame.select("folder", F.make_timestamp(F.lit(2024), "m", F.lit(9), F.lit(1), F.lit(0), F.lit(0)).alias("ts"), "key", "seq", "content")
        assert made.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        C.write_object_store(made, path)
        assert stored(spark, path) == sorted(want.values())
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "objects").glob("folder=*/month=2024-01/*.parquet")}
    C.write_object_store(spark.createDataFrame([("z", "new", 999, b"x")], "folder string, key string, seq long, content binary").withColumn("ts", F.lit("2025-12-01").cast("timestamp")).select("folder", "ts", "key", "seq", "content"), path)
    assert before and {p: p.stat().st_mtime_ns for p in (tmp_path / "objects").glob("folder=*/month=2024-01/*.parquet")} == before
    assert len(stored(spark, path)) == len(want) + 1


def test_moved_key_empties_its_month(spark, tmp_path):
    path = str(tmp_path / "objects")
    one = spark.createDataFrame([("a", "k", 1, b"1")], "folder string, key string, seq long, content binary")
    for month in ("2024-01-05", "2024-02-05"):
        C.write_object_store(one.withColumn("ts", F.lit(month).cast("timestamp")), path)
        assert [r[1] for r in stored(spark, path)] == [month[:7]]
    assert not (tmp_path / "objects" / "folder=a" / "month=2024-01").exists()


def test_sheet_of_files_keeps_their_order(spark, tmp_path):
    """Ten files of falling size, a cell with line ends among them."""
    want = []
    for n in range(10):
        rows = [(f"f{n}r{i}", f"line\nend {i}" if i % 4 == 1 else "x" * 50, "") for i in range(40 - 4 * n)]
        want += [r[0] for r in rows]
        (tmp_path / f"part-{n:02}.csv").write_text("key,en,mnw\n" + "".join(f'{k},"{e}",{m}\n' for k, e, m in rows))
    got = L.scan_sheet(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r.key for r in got] == want and [r.row_no for r in got] == list(range(1, len(want) + 1)) and got[1].en == "line\nend 1"
    assert [r.key for r in L.scan_sheet(spark, str(tmp_path), start=38, end=43).orderBy("row_no").collect()] == want[37:43]


def plain_bucket(rows, rate, burst):
    held, out = {}, {}
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        tokens, last = held.get(key, (float(burst), ts))
        tokens = min(float(burst), tokens + max(ts - last, 0.0) * rate)
        out[key, seq] = tokens >= 1
        held[key] = (tokens - (tokens >= 1), ts)
    return out


def test_token_bucket(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2**60 + 1]), rng.randrange(400) / 8, i) for i in range(900)]
    got = C.token_bucket(spark.createDataFrame(rows, "key long, ts double, seq long").repartition(5), 1.5, 4).collect()
    assert {(r.key, r.seq): r.allowed for r in got} == plain_bucket(rows, 1.5, 4) and len(got) == 900
    assert C.token_bucket(spark.createDataFrame([], "key string, ts double, seq long")).collect() == []


def test_token_bucket_of_one_key(spark):
    """A million requests of one key, in batches."""
    frame = spark.range(1_000_000).select(F.lit("hot").alias("key"), (F.col("id") / 7).alias("ts"), F.col("id").alias("seq"))
    found = C.token_bucket(frame, 5.0, 10).agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed")).first()
    assert found.n == 1_000_000 and abs(found.allowed - 1_000_000 * 5 / 7) < 20


def test_pattern_keys(spark):
    """Slots anywhere, fixed text with specifiers and signs in it; the first key by ordinal."""
    literals = ["{n} of {m}", "{a}", "{n}%d", "100%{n}", "a.b {x}", "{x} a.b", "none {x}", "%1${n}", "plain", "(x) {n}? [{m}]"]
    keys = ["%lld of %1$d", "%d of %@", "%@", "%2$lld", "%d%d", "%@%d", "100%%d", "axb %d", "a.b %d", "%d a.b", "%1$%d", "plain", "(x) %d? [%@]", "of", "%d of", "%d of x"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(keys[0], 99)], "key string, ordinal int")
    frame = spark.createDataFrame([(x,) for x in [*literals, "{a}"]], "literal string")
    patterns = {r.literal: r.p for r in frame.select("literal", L.S.specifier_regex(F.col("literal")).alias("p")).distinct().collect()}
    import re

    want = {x: next(k for k in keys if re.search(p, k)) for x, p in patterns.items() if any(re.search(p, k) for k in keys)}
    got = {r.literal: r.key for r in L.pattern_key_join(frame, rows).collect()}
    assert got == want and got["{n} of {m}"] == keys[0] and "none {x}" not in got and len(got) >= 8


def test_slot_first_literals_meet_no_other_keys(spark):
    """10,000 literals that begin with their slot, 100,000 keys: the join makes a row a match."""
    literals = spark.range(10_000).select(F.concat(F.lit("{n} files in box "), F.col("id").cast("string")).alias("literal"))
    keys = spark.range(100_000).select(F.concat(F.lit("%lld files in box "), F.col("id").cast("string")).alias("key"), F.col("id").alias("ordinal"))
    found = L.pattern_key_join(literals, keys)
    assert found.count() == 10_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_upgraded_ids_are_the_same_again(spark):
    old = spark.range(50).select("id", F.lit("feedback").alias("category"))
    first, again = ({r.id: r.record_id for r in C.upgrade_history(old.repartition(n)).collect()} for n in (1, 7))
    assert first == again and len(set(first.values())) == 50
    assert all(r.ok for r in C.upgrade_history(old).select(F.col("record_id").rlike(C.S.UUID).alias("ok")).collect())


@pytest.mark.parametrize("n", [0, 1])
def test_empty_stores(spark, tmp_path, n):
    none = spark.createDataFrame([], "folder string, ts timestamp, key string, seq long, content binary")
    for _ in range(n + 1):
        C.write_object_store(none, str(tmp_path / "objects"))
