"""The corpus pipeline: quality, line dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Stages can be run and written one by one, or all by `run`, which writes each to the shared folder, so
that a lost executor costs a stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch, table
from inkfold.llm.lines import drop_lines
from inkfold.llm.minhash import keep_one
from inkfold.llm.mixing import mixed_documents
from inkfold.llm.packing import pack
from inkfold.llm.quality import keep_good
from inkfold.llm.queries import TOKENIZER

#: Stages fit models, group and iterate: SQL can't express them. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go from the texts; n_chars follows."""
    return drop_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get words by their weights (3, 1, 2, repeating; 150 % of all words, no source more than twice); a row a copy."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence of its own."""
    from public_tokenizers import path

    return pack(docs, path(TOKENIZER))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
