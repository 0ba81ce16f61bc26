"""Held-out accuracy of the co-trained classifier, its scores and training against plain versions, and its defined cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from inkfold.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    scored = quality.score(docs, quality.fit(docs, seen)).join(unseen, "doc_id")
    got = {(r.quality, r.keep): r.n for r in scored.groupBy("quality", "keep").agg(F.count("*").alias("n")).collect()}
    good, bad = got.get((1, True), 0), got.get((0, False), 0)
    assert good / (good + got.get((1, False), 0)) > 0.98
    assert bad / (bad + got.get((0, True), 0)) > 0.9


def plain_text(t):
    """The text view by counting letters."""
    t = t or ""
    n, lines = len(t), t.split("\n")
    of = lambda letters: sum(c in letters for c in t) / max(n, 1)
    blank = sum(c in " \n\t" for c in t)
    return {
        "symbols": of("*#$%&@~^<>{}[]\\="), "bars": of("|_"), "shouts": of("!?"), "digits": of("0123456789"), "capitals": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "stops": of(".,;:"),
        "word_length": min((n - blank) / (blank + 1), 30.0), "line_length": math.log1p(n / len(lines)), "repeated_lines": 1 - len(set(lines)) / len(lines),
    }


def plain_metadata(row, bins):
    n = float(row.n_chars or 0)
    lang, source = bins[row.lang or ""][0], bins[row.source or ""][1]
    out = {"log_chars": math.log1p(max(n, 0.0)), "short": n < 200, "long": n > 20_000}
    return out | {f"lang_{i}": lang == i for i in range(8)} | {f"source_{i}": source == i for i in range(32)}


def plain_logistic(x, y, w):
    """Ridge logistic regression on standardised columns, classes of equal weight, by damped gradient steps of Newton's kind."""
    mean = (w[:, None] * x).sum(0) / w.sum()
    spread = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    spread = np.where(spread < 1e-9, 1.0, spread)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    share = {c: w[y == c].sum() for c in (0, 1)}
    v = np.array([wi * 0.5 / share[c] * w.sum() for wi, c in zip(w, y, strict=True)])
    v = v / (v.sum() / (sum(wi * 0.5 / share[c] for wi, c in zip(w, y, strict=True)) * w.sum()))
    b, pull = np.zeros(z.shape[1]), np.array([1e-6] + [1.0] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (v * (y - p)) - pull * b
        if np.abs(gradient).max() < 1e-9:
            break
        b = b + np.linalg.lstsq(z.T @ (z * (v * p * (1 - p))[:, None]) + np.diag(pull), gradient, rcond=None)[0]
    return b[0] - (b[1:] / spread) @ mean, b[1:] / spread


def plain_rounds(x, y, at, rounds=3, sure=0.97):
    """Views take turns: each trains on the labels and on what the other is sure of."""
    labels = {v: list(y) for v in at}
    for turn in range(rounds):
        odds = {}
        for v, columns in at.items():
            rows = [i for i, c in enumerate(labels[v]) if c >= 0]
            models = plain_logistic(x[rows][:, columns], np.array([labels[v][i] for i in rows]), np.array([1.0 if y[i] >= 0 else 0.5 for i in rows]))
            odds[v] = models[0] + x[:, columns] @ models[1]
        if turn == rounds - 1:
            return odds
        p = {v: 1 / (1 + np.exp(-np.clip(o, -30, 30))) for v, o in odds.items()}
        text, metadata = at
        for own, other in ((text, metadata), (metadata, text)):
            labels[own] = [y[i] if y[i] >= 0 else 1 if q >= sure else 0 if q <= 1 - sure else -1 for i, q in enumerate(p[other])]


def test_scores_by_definition(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.collect()
    names = sorted({r.lang or "" for r in rows} | {r.source or "" for r in rows})
    hashed = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.pmod(F.xxhash64("n"), F.lit(8)).alias("l"), F.pmod(F.xxhash64("n"), F.lit(32)).alias("s")).collect()
    bins = {r.n: (r.l, r.s) for r in hashed}
    sigmoid = lambda o: 1 / (1 + math.exp(-o))
    clip = lambda o: max(min(o, 30.0), -30.0)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    for r in rows:
        t = clip(model.text.bias + sum(model.text.weights[k] * v for k, v in plain_text(r.text).items()))
        m = clip(model.metadata.bias + sum(model.metadata.weights[k] * v for k, v in plain_metadata(r, bins).items()))
        odds = model.joint[0] + model.joint[1] * t + model.joint[2] * m
        g = got[r.doc_id]
        assert abs(g.p_text - sigmoid(t)) < 2e-6 and abs(g.p_metadata - sigmoid(m)) < 2e-6 and abs(g.score - sigmoid(odds)) < 2e-6
        assert abs(odds - model.cut) < 1e-9 or g.keep == (odds >= model.cut) == (r.doc_id in kept)


def test_co_training_by_definition():
    rng = np.random.default_rng(4)
    n = 600
    truth = rng.integers(0, 2, n)
    x = np.column_stack([truth * 2.5 + rng.normal(size=n), rng.normal(size=n), truth * 3 + rng.normal(size=n), rng.normal(size=n) * 5 + 7])
    y = np.where(np.arange(n) < 60, truth, -1)
    columns, views = ["a", "b", "c", "d"], {"text": ["a", "b"], "metadata": ["c", "d"]}
    models = quality.co_train(views, x, y, columns)
    want = plain_rounds(x, y, {"text": [0, 1], "metadata": [2, 3]})
    for v, names in views.items():
        at = [columns.index(c) for c in names]
        assert np.allclose(models[v].values(names, x[:, at]), want[v], atol=1e-5)
    both = np.sign(want["text"]) == np.where(truth == 1, 1, -1)
    assert both.mean() > 0.85


def test_cases(spark):
    rows = [(i, ("Plain words, one after another. " if i % 2 else "ab### cd$$$ | !! ") * (1 + i % 7), "en", None if i % 3 else "s", 10 * i, "mine", "a", 1.5, i, -1) for i in range(80)]
    odd = [(90, None, None, None, None, None, None, None, None, None)] * 2 + [(None, "x", "en", "s", 1, "mine", "b", 2.5, 1, 1)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string, n_chars long, keep string, p_text string, score double, y int, own int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 0), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 83 and all(r.keep == bool(r.doc_id % 2) for r in got if r.doc_id is not None and 60 <= r.doc_id < 80)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {r.keep for r in kept.filter("doc_id < 80").collect()} == {"mine"} and {r.doc_id for r in kept.filter("doc_id < 80").collect()} >= set(range(61, 80, 2))
    for one in (labels.limit(0), labels.filter("quality = 1"), labels.filter("quality = 0")):
        found = quality.score(docs, quality.fit(docs, one)).collect()
        assert all(r.keep and r.score is None for r in found) and len(found) == 83
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []
    long = spark.createDataFrame([(1, "word " * 200_000, "en", "s", 1_000_000)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(quality.score(long, model).collect()) == 1


def test_sample_bound(spark):
    """Rows that share an id are one in the sample."""
    docs = spark.createDataFrame([(i % 5, f"t{i}", "en", "s", 3) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.hash_sample(docs, "doc_id", 3).count() == 3 and quality.hash_sample(docs, "doc_id", 50).count() == 5
    again = quality.hash_sample(docs.repartition(7), "doc_id", 3)
    assert sorted(r.text for r in again.collect()) == sorted(r.text for r in quality.hash_sample(docs, "doc_id", 3).collect())
