"""Packing against a plain encode of whole texts; top-k against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import packing, topk

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
TEXTS = [None, "Über-Größe straße, ÇA!! I'm he'll don't|*** x's ÿ×÷ª µ ß", "", " \t\n", "The theory's don't 12 345", "naïve café é ́x", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "wörd " * 9000, "İstanbul ΣΑΣ\x1cword\x85next"]


def test_pieces_are_whole_encodes(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    tokenizer = packing._encoder(PATH).tokenizer
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == [sum(r.length for r in own[:n]) for n in range(len(own))]
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())


def test_words_of_the_small_table():
    import pyarrow.parquet as pq

    encoder = packing._encoder(PATH)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert encoder.encode(text) == np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_binary_lengths():
    for n in [1, 2, 3, 4095, 4096, 4097, 12345]:
        got = packing.binary_lengths(n)
        assert sum(got) == n and got == sorted(got, reverse=True)


@pytest.mark.parametrize("width", [0, 1, 7, 64])
def test_best_in_block_is_exact(width):
    rng = np.random.default_rng(width)
    c, q = rng.integers(-40, 40, (width, 300)), rng.integers(-40, 40, (20, width))
    ids = np.arange(300)
    query_id, vec_id, score = topk.best_in_block(ids, c, ids[:20], q, 5)
    for i in range(20):
        full = sorted((-int(q[i] @ c[:, j]), j) for j in range(300) if j != i)[:5]
        assert [(-s, v) for s, v in zip(score[query_id == i].tolist(), vec_id[query_id == i].tolist())] == full


def test_top_k_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (50, [-1.0, 2.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    got = topk.top_k(topk.quantized(vectors), F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 2, 32768), (50, 1, 2, 32768), (50, 2, 0, -65536)]
    assert topk.top_k(topk.quantized(vectors.limit(0)), F.col("vec_id") % 50 == 0).collect() == []


def test_sequence_numbers_are_ranks(spark):
    docs = spark.createDataFrame([(i % 90, "word " * (i % 50)) for i in range(300)], "doc_id long, text string")
    runs = [packing.pack(d, PATH).collect() for d in (docs, docs.repartition(7))]
    for rows in runs:
        rows.sort(key=lambda r: r.sequence_id)
        assert [r.sequence_id for r in rows] == list(range(len(rows)))
        assert [(r.length, r.doc_id, r.start) for r in rows] == sorted((r.length, r.doc_id, r.start) for r in rows)
    assert runs[0] == runs[1]


def test_large_components(spark):
    fits = spark.createDataFrame([(0, [2.0**22, 1.0]), (1, [2.0**22, -1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(topk.quantized(fits), F.col("vec_id") == 0, k=1).first().score == 2**60 - 2**16
    wide = spark.createDataFrame([(0, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components too large"):
        topk.quantized(wide).collect()
