"""What the training-data operators share: table access, word patterns and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_HELD: dict[str, object] = {}


def worker_cache(owner: str, make: Callable[[], object]):
    """What a Python worker keeps for one operator from task to task; what it kept for another one is let go first."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of this machine's if Spark runs on it alone (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkfold-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables that cut a job's lineage, written as Parquet to the shared folder.

    A lost executor re-reads them instead of recomputing what led there. `drop` removes one as soon as
    nothing reads it any more; what the returned DataFrame still reads stays for the owner of the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partitions: int | None = None, codec: str = "snappy") -> DataFrame:
        df = df.coalesce(partitions) if partitions else df
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


#: Tables of up to so many rows of a few numbers (counted, 10 MB at most) are joined by broadcast.
BROADCAST_ROWS = 100_000


def near_by(table: DataFrame) -> DataFrame:
    """A saved table of short rows, to be broadcast if its count is within BROADCAST_ROWS, else joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, one for each of the keys with the smallest hashes: the same in every run, however the input is split.

    Of rows that share a key, one is chosen by the hash of its values; rows without a key are left out.
    """
    mark = F.xxhash64(key)
    keyed = df.filter(F.col(key).isNotNull())
    last = keyed.select(mark.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return df.limit(0)
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return keyed.filter(mark <= F.lit(last)).groupBy(mark.alias("_mark")).agg(F.min_by(own, F.xxhash64(own)).alias("own")).select("own.*")
