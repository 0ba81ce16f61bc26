"""The shared folder, tables in it, and single files under names of their own, written and listed inside tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; one of this machine's only where Spark runs on it alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkfold-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A folder in the shared place that nothing has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read back: its rows stay as they are when tasks are repeated."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def write_files(files: DataFrame, root: str) -> int:
    """Writes each (name, content) as a file under root, whole or not at all: beside its place first, then moved. Returns how many."""

    def rows(it):
        import pyarrow as pa

        store, base = _store(root)
        made = set()
        for batch in it:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1), strict=True):
                folder = f"{base}/{name}".rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                store.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    done = files.select(F.col("name"), F.col("content").cast("binary")).mapInArrow(rows, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def list_folders(folders: DataFrame) -> DataFrame:
    """(path, folder, length, error): what is in each folder (path), or why it can't be listed; a row an entry."""

    def rows(it):
        import pandas as pd
        from pyarrow import fs

        for batch in it:
            for path in batch["path"]:
                found, scheme = [], ""
                try:
                    store, base = _store(path)
                    scheme = path[: len(path) - len(base)] if path.endswith(base) else ""
                    for x in store.get_file_info(fs.FileSelector(base)):
                        found.append((scheme + x.path, x.type == fs.FileType.Directory, x.size, None))
                except (OSError, ValueError) as failed:
                    found.append((path, True, None, str(failed)))
                yield pd.DataFrame(found, columns=["path", "folder", "length", "error"]).astype({"length": "Int64"})

    return folders.select("path").mapInPandas(rows, "path string, folder boolean, length long, error string")


def read_files(paths: DataFrame) -> DataFrame:
    """(path, content) of files, empty ones too."""

    def rows(it):
        import pyarrow as pa

        for batch in it:
            for path in batch.column(0).to_pylist():
                store, base = _store(path)
                with store.open_input_stream(base, compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(rows, "path string, content binary")
