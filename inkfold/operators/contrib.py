"""The contribution pipeline: eligibility, payloads, validation, storage keys, rate limits, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import scalars as S
from inkfold.operators.ranks import global_rank
from inkfold.sources.files import saved

MAX_ATTEMPTS, MAX_RETRIES = 5, 2
SYNC_CATEGORIES = {"web": ("feedback", "contribution"), "android": ("feedback", "contribution", "contribute"), "ios": ("feedback", "contribution", "contribute")}


def to_source_rect(x: Column, y: Column, w: Column, h: Column, scale: float, width: int, height: int) -> Column:
    """struct(sx, sy, sw, sh): a box drawn at a display scale, in source pixels, at least one, inside the source."""
    whole = lambda v: F.floor(v * scale + 0.5).cast("int")
    sx, sy = F.least(F.greatest(whole(x), F.lit(0)), F.lit(width - 1)), F.least(F.greatest(whole(y), F.lit(0)), F.lit(height - 1))
    return F.struct(sx.alias("sx"), sy.alias("sy"), F.least(F.greatest(whole(w), F.lit(1)), width - sx).alias("sw"), F.least(F.greatest(whole(h), F.lit(1)), height - sy).alias("sh"))


def intake_check(size: Column, kind: Column, max_mib: int = 50) -> Column:
    return F.when(size > max_mib * 1024 * 1024, "file_large").when(~kind.isin(*S.ALLOWED_TYPES), "file_type")


def validate_upload(uploads: DataFrame) -> DataFrame:
    """Adds status and reason of the first rule that a signing request breaks; 200 without one."""
    missing = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("type", F.lit("")) == "") | (F.coalesce("record_id", F.lit("")) == "")
    rules = [
        (~F.col("origin_ok"), 403, "origin"), (missing, 400, "missing"), (~F.col("record_id").rlike(S.UUID), 400, "record_id"),
        (~F.col("type").isin(*S.ALLOWED_TYPES), 400, "type"), (F.col("size") < 1, 400, "size"), (F.col("size") > S.MAX_UPLOAD_BYTES, 413, "too_large"),
    ]
    status, reason = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for broken, code, why in rules:
        status, reason = status.when(broken, code), reason.when(broken, why)
    return uploads.withColumns({"status": status.otherwise(200), "reason": reason})


def validate_part(uploads: DataFrame) -> DataFrame:
    """The service's rules on a received part: too large 413, no file 400, empty 400, content type 400."""
    n = F.octet_length("content")
    status = F.when(F.col("size") > S.MAX_UPLOAD_BYTES, 413).when(n.isNull() | (n == 0), 400).when(~S.sniff_mime(F.col("content")).isin(*S.ALLOWED_TYPES), 400)
    return uploads.withColumn("status", status.otherwise(200))


def sync_eligible(history: DataFrame, surface: str = "web") -> DataFrame:
    rule = ~F.col("synced") & (F.col("attempts") < MAX_ATTEMPTS) & F.col("category").isin(*SYNC_CATEGORIES[surface])
    return history.filter(rule & F.col("consent") if surface == "web" else rule)


def submission_allowed(kind: Column, consent: Column, text: Column, attachment: Column) -> Column:
    written = F.trim(F.coalesce(text, F.lit(""))) != ""
    return consent & F.when(kind == "feedback", written).otherwise(written | attachment)


def expand_payloads(history: DataFrame, surface: str = "web") -> DataFrame:
    """(id, slot, request_id, name): a row for each part that a record sends."""
    text, name = F.col("text"), F.col("name")
    blank = F.trim(text) == ""
    file = F.col("size") > 0
    written = {
        "web": ~blank & (name != "Mon Text Contribution"),
        "android": ~blank & (name != "Text Contribution") & (text != "(Image only)"),
        "ios": (text != "") & (text != "(Image only)"),
    }[surface]
    record = F.col("id").cast("string")
    slots = F.array(
        F.when(file, F.struct(F.lit("file").alias("slot"), name.alias("name"))),
        F.when(written, F.struct(F.lit("transcription").alias("slot"), S.transcription_name(name, ~file if surface == "ios" else False).alias("name"))),
    )
    parts = history.select("id", record.alias("record"), F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("part"))
    return parts.select("id", "part.slot", S.request_id(F.col("record"), F.col("part.slot")).alias("request_id"), "part.name")


def classify_failure(status: Column, too_large: Column) -> Column:
    return F.when(too_large, "permanent").when(status.isin(408, 429) | (status >= 500), "transient").when(status.between(400, 499), "permanent").otherwise("transient")


def sync_decision(outcomes: DataFrame) -> DataFrame:
    """work, run, decision: success without transient failures, retry in the first MAX_RETRIES runs, else failure.

    outcomes: work, run (the number of its attempt, from 0), failure.
    """
    transient = F.coalesce(F.bool_or(F.col("failure") == "transient"), F.lit(False))
    decision = F.when(~F.col("t"), "success").when(F.col("run") < MAX_RETRIES, "retry").otherwise("failure")
    return outcomes.groupBy("work", "run").agg(transient.alias("t")).select("work", "run", decision.alias("decision"))


def token_bucket(requests: DataFrame, rate: float = 5.0, burst: int = 10) -> DataFrame:
    """(key, seq, allowed): a bucket for each key starts full, refills by `rate` a second and gives a token a request.

    requests: key, ts in seconds, seq. A secondary sort: requests are dealt by key and sorted by (key, ts, seq), and a task streams them with one key's bucket in hand, carried from
    batch to batch. So a key may have any number of requests; they go through one task, as each depends on the one before.
    """
    own = requests.select("key", F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"))
    kind = own.schema["key"].dataType.simpleString()

    def stream(it):
        import pyarrow as pa

        key, tokens, last, full = None, 0.0, None, float(burst)
        for batch in it:
            allowed = []
            for own_key, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None or own_key != key:
                    key, tokens, last = own_key, full, ts
                tokens = min(full, tokens + max(ts - last, 0.0) * rate)
                allowed.append(tokens >= 1)
                tokens, last = tokens - allowed[-1], ts
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_())], ["key", "seq", "allowed"])

    return own.repartition("key").sortWithinPartitions("key", "ts", "seq").mapInArrow(stream, f"key {kind}, seq long, allowed boolean")


def oldest_evicted(keys: DataFrame, now: Column, ttl_seconds: int = 600, cap: int = 50_000) -> DataFrame:
    """Keys to drop: idle longer than the TTL, then the oldest beyond the cap, by their rank among the live ones."""
    judged = keys.select("key", "last_seen", (now - F.col("last_seen") > ttl_seconds).alias("idle"))
    ranked = global_rank(judged.filter("not idle"), [F.col("last_seen").desc(), F.col("key")], "rank")
    over = ranked.filter(F.col("rank") > cap).select("key", "last_seen", F.lit("cap").alias("why"))
    return judged.filter("idle").select("key", "last_seen", F.lit("idle").alias("why")).unionByName(over)


def write_object_store(objects: DataFrame, path: str) -> None:
    """Month-partitioned objects, one a key: a later write of a key takes its place, in whatever folder and month it was. objects: folder, ts, key, seq, content.

    Of rows of one write with one key the last (seq) counts. A month that a write puts objects into, or takes replaced ones out of, is written anew from
    what it holds and what is new; other months are not touched. The months are written to the shared folder first, so that none is read while it is replaced. A write that breaks off can be repeated.
    """
    spark = objects.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in objects.columns])
    new = objects.groupBy("key").agg(F.max_by(own, F.struct("seq", "ts")).alias("own")).select("own.*").withColumn("month", F.date_format("ts", "yyyy-MM"))
    new = saved(new, "objects")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        new.write.partitionBy("folder", "month").parquet(path)
        return
    schema = new.select(*[c for c in new.columns if c not in ("folder", "month")], "folder", "month").schema
    held = spark.read.schema(schema).parquet(path)
    replaced = held.join(new.select("key"), "key", "left_semi").select("folder", "month")
    touched = saved(replaced.union(new.select("folder", "month")).distinct(), "months")  # a row a month
    kept = held.join(F.broadcast(touched), ["folder", "month"], "left_semi").join(new.select("key"), "key", "left_anti")
    after = saved(kept.unionByName(new), "stored")
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "month").parquet(path)
    emptied = touched.join(after.select("folder", "month").distinct(), ["folder", "month"], "left_anti")
    for row in emptied.collect():  # months that lost their last object to another one
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, f"folder={row.folder}/month={row.month}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with rows inserted or replaced by key; of several changes the last (seq) counts."""
    both = table.withColumn("_seq", F.lit(-1).cast("long")).unionByName(changes.withColumnRenamed("seq", "_seq"))
    last = W.partitionBy(key).orderBy(F.col("_seq").desc())
    return both.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", "_seq")


def delete_records(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the records of `ids`; ids that it lacks change nothing."""
    return table.join(ids.select(key), key, "left_anti")


def clear_history(table: DataFrame, category: str) -> DataFrame:
    """The table without the records of a category."""
    return table.filter(F.coalesce(F.col("category") != category, F.lit(True)))


def reset_retries(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table with the records of `ids` as if they had never been tried: no attempts, no error; what is synced stays so."""
    marked = table.join(ids.select(key).distinct().withColumn("_reset", F.lit(True)), key, "left")
    again = F.coalesce(F.col("_reset"), F.lit(False)) & ~F.col("synced")
    return marked.withColumns({"attempts": F.when(again, F.lit(0).cast("long")).otherwise(F.col("attempts")), "last_error": F.when(~again, F.col("last_error"))}).drop("_reset")


def upgrade_history(old: DataFrame) -> DataFrame:
    """Rows of earlier versions with the columns of the fourth: defaults for what is missing, an id for each, made from the row's own id so that a repeated task gives it again."""
    digest = F.sha2(F.concat(F.lit("record:"), F.col("id").cast("string")), 256)
    made = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4))], F.concat(F.lit("4"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    have = set(old.columns)
    missing = {"synced": F.lit(False), "attempts": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "record_id": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")}
    full = old.withColumns({c: v for c, v in missing.items() if c not in have})
    return full.withColumns({"record_id": F.coalesce("record_id", made), "synced": F.coalesce("synced", F.lit(False)), "attempts": F.coalesce("attempts", F.lit(0).cast("long"))})
