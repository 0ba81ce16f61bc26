"""Class scores to text: the model contract, greedy decoding, the character table, and the recogniser's seam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def charset_dim(charset: DataFrame) -> DataFrame:
    """(idx from 1, ch) of a character string, without line ends behind it. charset: text."""
    letters = F.regexp_extract_all(F.regexp_replace("text", "[\r\n]+$", ""), F.lit("(?s)."), F.lit(0))
    return charset.select(F.posexplode(letters).alias("i", "ch")).select((F.col("i") + 1).alias("idx"), "ch")


def model_contract(logits: DataFrame, characters: int, steps: int | None = None) -> DataFrame:
    """Adds error, by step: a class count that isn't one blank and the characters, more or fewer steps than the model declares, a score that is not finite; null if all is well.

    logits: seq, t, scores. steps: how many steps a sequence has by the model's shape; null if that is not declared.
    """
    finite = F.forall("scores", lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    error = F.when(F.coalesce(F.size("scores"), F.lit(-1)) != characters + 1, "classes")
    if steps is not None:
        own = logits.groupBy("seq").agg(F.count("*").alias("_n"), F.min("t").alias("_low"), F.max("t").alias("_high"))
        logits = logits.join(own, "seq")
        error = error.when((F.col("_n") != steps) | (F.col("_low") != 0) | (F.col("_high") != steps - 1), "steps")
    return logits.withColumn("error", error.when(~finite, "not finite")).drop("_n", "_low", "_high")


def require_contract(logits: DataFrame, characters: int, steps: int | None = None) -> DataFrame:
    """The logits as they are; a task that reads a step which breaks the contract fails with what it found."""
    judged = model_contract(logits, characters, steps)
    said = F.concat(F.lit("model output refused at sequence "), F.col("seq").cast("string"), F.lit(", step "), F.col("t").cast("string"), F.lit(": "), F.col("error"))
    return judged.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(said).cast("boolean"))).drop("error")


def ctc_collapse(logits: DataFrame) -> DataFrame:
    """(seq, t, idx): the best class of each step, without blanks (class 0) and repeats of the step before.

    Ties go to the lowest class. The step before counts whether blank or not, so a blank parts doubles.
    """
    best = logits.withColumn("idx", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    before = F.lag("idx", 1, -1).over(W.partitionBy("seq").orderBy("t"))
    return best.withColumn("before", before).filter((F.col("idx") != 0) & (F.col("idx") != F.col("before"))).select("seq", "t", "idx")


def charset_lookup(steps: DataFrame, charset: DataFrame) -> DataFrame:
    """(seq, text, unknown): characters in order; unknown counts classes that the table lacks. The table is a few hundred rows."""
    named = steps.join(F.broadcast(charset), "idx", "left")
    rows = F.array_sort(F.collect_list(F.struct("t", "ch")))
    return named.groupBy("seq").agg(F.array_join(F.transform(rows, lambda r: r["ch"]), "").alias("text"), F.count_if(F.col("ch").isNull()).alias("unknown"))


def recognize_tiles(tiles: DataFrame, open_session: Callable[[], Callable], schema: str = "tile_id long, t int, scores array<double>, error string") -> DataFrame:
    """Class scores of tiles. open_session is called once a task and gives the recogniser: a batch of tiles in, a frame of `schema` out.

    A batch that the recogniser fails on is tried tile by tile, so that a failure marks its own tile; nothing of a batch is given on before all of it is read.
    """

    def batches(it):
        import pandas as pd

        recognise = open_session()
        for batch in it:
            try:
                out = [recognise(batch)]
            except Exception:
                out = []
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        out.append(recognise(one))
                    except Exception as failed:
                        out.append(pd.DataFrame({"tile_id": one["tile_id"], "t": [None], "scores": [None], "error": [str(failed)]}))
            yield from out

    return tiles.mapInPandas(batches, schema)
