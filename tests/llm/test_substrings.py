"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np

from inkfold.llm import substrings


def brute(rows):
    """(n_words, n_removed, digest) by doc_id; rows: (doc_id, text), ids distinct."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first, gone = {}, {}
    for d in sorted(words):
        gone[d] = set()
        for i in range(len(words[d]) - 19):
            w = tuple(words[d][i : i + 20])
            if first.setdefault(w, (d, i)) != (d, i):
                gone[d] |= set(range(i, i + 20))
    digest = lambda d: hashlib.sha256(" ".join(w for i, w in enumerate(words[d]) if i not in gone[d]).encode()).hexdigest()
    return {d: (len(words[d]), len(gone[d]), digest(d)) for d in words}


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, pos int").repartition(parts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.kept_words(docs).collect()}
    assert got == brute(rows)


def test_planted(spark):
    rng = random.Random(3)
    words = lambda n, k=3000: [f"w{rng.randrange(k)}" for _ in range(n)]
    passage, run = words(70), ["na"] * 60
    rows = [(0, None), (1, ""), (2, " ".join(words(19))), (3, "ab " * 500), (4, " ".join(run)), (5, "ab cd " * 300)]
    rows += [(10 + i, " ".join(words(rng.randrange(5, 200)) + passage[: rng.randrange(15, 70)] + words(30))) for i in range(60)]
    rows += [(100 + i, " ".join(passage[i % 9 :] + words(i, 2))) for i in range(60)]
    base = words(150)
    for i in range(40):
        own = list(base)
        own[rng.randrange(150)] = "edited"
        rows.append((200 + i, "\n".join(own)))
    rows += [(300 + i, " ".join(words(400, 2))) for i in range(3)]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, 11)


def test_small_chunks_and_whole_table(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_same_id_null_id_empty(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.kept_words(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]
    assert substrings.kept_words(docs.limit(0)).collect() == []


def test_levels_are_local():
    rng = np.random.default_rng(1)
    c = substrings.mix(rng.integers(0, 40, 4000).astype(np.uint64))
    inner = c[1000:1400]
    for whole, part in zip(substrings.recompress(c), substrings.recompress(inner), strict=True):
        held = lambda level, a, b, off: {(int(s), int(lo) + off, int(hi) + off) for s, lo, hi in zip(*level) if lo >= a and hi <= b}
        assert held(whole, 1000, 1400, 0) == held(part, 0, 400, 1000)


def test_one_passage_in_thousands_of_surroundings(spark):
    """Every window of the passage meets its first under salted keys: no task has all of them."""
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(45)
    rows = [(i, " ".join(words(12) + passage + words(12))) for i in range(2000)]
    tables = {}
    saved = substrings.Scratch.save

    def save(self, df, name, partitions=None, codec="snappy"):
        tables[name] = saved(self, df, name, partitions, codec)
        return tables[name]

    substrings.Scratch.save = save
    try:
        check(spark, rows, 8)
    finally:
        substrings.Scratch.save = saved
    largest = [r[0] for r in tables["met"].groupBy("w1", "w2", "salt").count().select("count").collect()]
    assert not largest or max(largest) < 2000 / 8
