"""Quality classifier by co-training: a text view and a metadata view teach each other.

Both views are logistic models. In each round, each view labels the documents of an unlabelled pool that it is sure of, and
these join the other view's training rows. What neither has trained on calibrates: a logistic
combination of the two views' log odds is fitted to the held-out labelled rows, and the cut is the score
above which KEEP_GOOD of their good documents lie.

Fitting reads at most LABELLED labelled and POOL unlabelled documents, chosen by hash, one row a document id; only their features (numbers)
reach the driver. Scoring is one column expression over all documents: a single scan, no shuffle, no Python.

Defined cases: null text counts as empty; null lang or source is a value of its own; very long texts are read whole; label rows without quality are
left out and repeated ones averaged, ties (as many good as bad) are good; without labels of both classes everything is kept with score null;
repeated rows are scored each and train once; null ids are scored and never train; an empty table gives an empty result; documents' own columns, whatever their
names, are neither read (but for those of `documents`) nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import hash_sample

LABELLED, POOL, ROUNDS, SURE, KEEP_GOOD = 20_000, 20_000, 3, 0.97, 0.995
LANG_BINS, SOURCE_BINS = 8, 32


def text_view(of: str = "") -> dict[str, Column]:
    """Numbers from the text alone. of: where the documents' columns are, as a prefix."""
    text = F.coalesce(f"{of}text", F.lit(""))
    n = F.length(text)
    lines = F.split(text, "\n")
    share = lambda letters: (n - F.length(F.translate(text, letters, ""))) / F.greatest(n, F.lit(1))
    spaces = n - F.length(F.translate(text, " \n\t", ""))
    return {
        "symbols": share("*#$%&@~^<>{}[]\\="),
        "bars": share("|_"),
        "shouts": share("!?"),
        "digits": share("0123456789"),
        "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "stops": share(".,;:"),
        "word_length": F.least((n - spaces) / (spaces + 1), F.lit(30.0)),
        "line_length": F.log1p(n / F.size(lines)),
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


def metadata_view(of: str = "") -> dict[str, Column]:
    """Numbers from what is known without reading the text."""
    n = F.coalesce(F.col(f"{of}n_chars").cast("double"), F.lit(0.0))
    bin_of = lambda c, bins: F.pmod(F.xxhash64(F.coalesce(F.col(of + c).cast("string"), F.lit(""))), F.lit(bins))
    bit = lambda c: c.cast("double")
    view = {"log_chars": F.log1p(F.greatest(n, F.lit(0.0))), "short": bit(n < 200), "long": bit(n > 20_000)}
    view |= {f"lang_{i}": bit(bin_of("lang", LANG_BINS) == i) for i in range(LANG_BINS)}
    return view | {f"source_{i}": bit(bin_of("source", SOURCE_BINS) == i) for i in range(SOURCE_BINS)}


@dataclass
class Linear:
    """Log odds: bias + sum of weight * feature."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def column(self, values: dict[str, Column]) -> Column:
        return sum((F.lit(w) * values[k] for k, w in self.weights.items()), F.lit(self.bias))

    def values(self, names: list[str], x: np.ndarray) -> np.ndarray:
        return self.bias + x @ np.array([self.weights[n] for n in names])


@dataclass
class Model:
    text: Linear
    metadata: Linear
    joint: tuple[float, float, float]
    cut: float


def logistic(names: list[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> Linear:
    """Newton's method on standardised features; classes weigh the same."""
    mean, spread = np.average(x, axis=0, weights=w), np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    spread[spread < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = w * np.where(y == 1, 0.5 / max(w[y == 1].sum(), 1e-9), 0.5 / max(w[y == 0].sum(), 1e-9)) * w.sum()
    beta, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[1:] / spread
    return Linear(float(beta[0] - weights @ mean), {n: float(v) for n, v in zip(names, weights, strict=True)})


def co_train(views: dict[str, list[str]], x: np.ndarray, y: np.ndarray, columns: list[str]) -> dict[str, Linear]:
    """y: 1, 0 or -1 for unlabelled rows. A pseudo-label counts half."""
    at = {v: [columns.index(c) for c in names] for v, names in views.items()}
    known = y >= 0
    given = {v: np.where(known, y, -1) for v in views}
    models: dict[str, Linear] = {}
    for turn in range(ROUNDS):
        for v, names in views.items():
            rows = given[v] >= 0
            models[v] = logistic(names, x[rows][:, at[v]], given[v][rows], np.where(known[rows], 1.0, 0.5))
        if turn == ROUNDS - 1:
            break
        sure = {v: 1 / (1 + np.exp(-np.clip(models[v].values(views[v], x[:, at[v]]), -30, 30))) for v in views}
        first, second = views
        for own, other in ((first, second), (second, first)):
            label = np.where(sure[other] >= SURE, 1, np.where(sure[other] <= 1 - SURE, 0, -1))
            given[own] = np.where(known, y, label)
    return models


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """None if the labelled rows lack a class."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    some = hash_sample(marks, "_id", labelled)  # at most `labelled` rows, so that they may be broadcast
    own = docs.filter(F.col("doc_id").isNotNull()).select(F.struct("doc_id", "text", "lang", "source", "n_chars").alias("own"))
    mark = F.xxhash64("own.doc_id")
    last = own.select(mark.alias("h")).distinct().orderBy("h").limit(pool).agg(F.max("h")).first()[0]
    if last is None:
        return None
    text, metadata = text_view("own."), metadata_view("own.")
    columns = [*text, *metadata]
    values = F.struct(*[c.cast("double").alias(n) for n, c in (text | metadata).items()])
    rows = (
        own.join(F.broadcast(some), F.col("own.doc_id") == F.col("_id"), "left")
        .filter(F.col("_y").isNotNull() | (mark <= F.lit(last)))
        .select(F.coalesce("_y", F.lit(-1)).alias("y"), F.pmod(F.xxhash64("own.doc_id", F.lit(7)), F.lit(4)).alias("part"), mark.alias("h"), values.alias("v"))
        .groupBy("h", "part", "y")
        .agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        .select("h", "part", "y", "v.*")
        .toPandas()
        .sort_values(["h", "y"], kind="stable")
    )
    x, y, held = rows[columns].to_numpy(np.float64), rows["y"].to_numpy(), ((rows["part"] == 0) & (rows["y"] >= 0)).to_numpy()
    if min((y[~held] == c).sum() for c in (0, 1)) < 2 or min((y[held] == c).sum() for c in (0, 1)) < 1:
        return None
    views = {"text": list(text), "metadata": list(metadata)}
    models = co_train(views, x[~held], y[~held], columns)
    odds = np.column_stack([models[v].values(names, x[held][:, [columns.index(c) for c in names]]) for v, names in views.items()]).clip(-30, 30)
    joint = logistic(list(views), odds, y[held], np.ones(held.sum()))
    score = joint.values(list(views), odds)
    cut = np.quantile(score[y[held] == 1], 1 - KEEP_GOOD)
    edges = np.unique(score)
    middles = (edges[1:] + edges[:-1]) / 2
    right = ((score[None, :] >= middles[:, None]) == y[held][None, :]).mean(1) if len(edges) < 4000 else np.array([((score >= t) == y[held]).mean() for t in middles])
    best = middles[right.argmax()] if len(middles) else cut
    return Model(models["text"], models["metadata"], (joint.bias, *joint.weights.values()), float(min(cut, best)))


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents as struct `own`, with p_text, p_metadata, score and keep."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    if model is None:
        return own.select("own", *[F.lit(None).cast("double").alias(c) for c in ("p_text", "p_metadata", "score")], F.lit(True).alias("keep"))
    sigmoid = lambda odds: F.round(1 / (1 + F.exp(-odds)), 6)
    clip = lambda c: F.greatest(F.least(c, F.lit(30.0)), F.lit(-30.0))
    text, metadata = clip(model.text.column(text_view("own."))), clip(model.metadata.column(metadata_view("own.")))
    bias, a, b = model.joint
    views = own.select("own", F.struct(text.alias("t"), metadata.alias("m")).alias("views"))
    odds = F.lit(bias) + F.lit(a) * F.col("views.t") + F.lit(b) * F.col("views.m")
    return views.select("own", sigmoid(F.col("views.t")).alias("p_text"), sigmoid(F.col("views.m")).alias("p_metadata"), sigmoid(odds).alias("score"), (odds >= F.lit(model.cut)).alias("keep"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, p_text, p_metadata, score (calibrated probability of good) and keep, a row for each of the documents."""
    return _scored(docs, model).select("own.doc_id", "p_text", "p_metadata", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return _scored(docs, fit(docs, labels)).filter("keep").select(*[F.col(f"own.`{c}`") for c in docs.columns])
