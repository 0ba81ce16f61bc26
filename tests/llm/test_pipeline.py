"""Each stage of the pipeline against a brute-force version over what the stage before kept; archives too."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import lines, packing, quality, warc
from test_line_classes import plain as plain_lines
from test_minhash import brute as brute_near
from test_mixing import plain_mix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    public = pytest.importorskip("public_tokenizers")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    start = rows(docs)
    good_df = stages["quality"](spark, docs, SF).cache()
    good = rows(good_df)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in quality.score(docs, model).collect() if r.keep} == set(good) and len(good) < len(start)
    lined_df = stages["line_dedup"](spark, good_df, SF).cache()
    lined = rows(lined_df)
    assert {d: r.text for d, r in lined.items()} == plain_lines({d: r.text for d, r in good.items()}, lines.MIN_DOCS)
    near_df = stages["near_dedup"](spark, lined_df, SF).cache()
    near = rows(near_df)
    assert set(near) == {d for d, (_, c) in brute_near({d: r.text for d, r in lined.items()}).items() if d == c}
    mixed_df = stages["mixing"](spark, near_df, SF).cache()
    queued = [(r.doc_id, r.source, r.text) for r in near.values()]
    want = {d: sum(n > 0 and 2 * n >= len((t or "").split()) for n in x["copies"]) for (d, _, t), x in zip(queued, plain_mix(queued), strict=True)}
    got = defaultdict(int)
    for r in mixed_df.collect():
        got[r.doc_id] += 1
        assert r == near[r.doc_id]
    assert got == {d: n for d, n in want.items() if n}
    for df in (good_df, lined_df, near_df, mixed_df):
        assert df.dtypes == docs.dtypes
    encoder = packing._encoder(public.path(corpus_pipeline.TOKENIZER))
    packed = defaultdict(int)
    for r in stages["packing"](spark, mixed_df, SF).collect():
        packed[r.doc_id] += r.length
    assert packed == {d: n * (len(encoder.encode(near[d].text or "")) // 4 + 1) for d, n in got.items()}


def test_warc(spark):
    big = "<p>" + "é" * 60
    rows = [(5, "http://a/1", big), (3, None, big), (9, "http://b/2", big), (3, None, big), (1, "http://b/3", "x" * 99), (2, "u", "x" * 99), (None, "u", big), (7, "u", None), (8, "u", "WARC/1.1\r\n\r\n" + "y" * 200)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    from inkfold.llm.common import Scratch

    path = Scratch(spark, "t").path("a")
    warc.write_warc(warc.page_records(pages), path)
    got = warc.read_warc(spark, path, verify=True).select(warc.page_of("record_id").alias("id"), "*").collect()
    assert sorted((r.id if r.id is not None else -1, r.record_type) for r in got) == [(-1, "response"), (1, "response"), (2, "response"), (3, "response"), (3, "response"), (5, "revisit"), (7, "response"), (8, "response"), (9, "revisit")]
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.id).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha256(html).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == html
    some = warc.read_warc(spark, path).filter("record_type = 'revisit' and target_uri like 'http://b%'")
    assert [r.refers_to for r in some.collect()] == ["<urn:page:3>"]
    empty = Scratch(spark, "t").path("b")
    warc.write_warc(warc.page_records(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_warc_goes_over_unwanted_members(tmp_path):
    """Only heads of unwanted records are read and inflated; other writers' archives are read through."""
    import gzip
    import io
    import random

    noise = random.Random(1).randbytes(3_000_000)
    rows = [{"record_type": t, "record_id": f"<urn:page:{i}>", "target_uri": u, "payload_digest": "d", "payload_bytes": len(noise), "payload": noise, "refers_to": "<urn:page:0>"} for i, (t, u) in enumerate([("response", "http://a/"), ("response", "http://b/"), ("revisit", "http://b/")])]
    ours = b"".join(warc._member(warc._record(r)) for r in rows)
    assert gzip.decompress(ours) == b"".join(map(warc._record, rows))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    def read(data, **wanted):
        reader = warc.WarcReader({"path": "x"})
        reader.equal = {k: {v} for k, v in wanted.items()}
        f = Counted(data)
        return [(r["record_id"], r["payload"]) for r in reader._members(f)], f.taken

    got, taken = read(ours, record_type="revisit")
    assert got == [("<urn:page:2>", None)] and taken < 20_000
    got, taken = read(ours, target_uri="http://a/")
    assert got == [("<urn:page:0>", noise)] and taken < len(noise) * 1.1 + 20_000
    theirs = b"".join(gzip.compress(warc._record(r)) for r in rows)
    assert read(theirs, target_uri="http://b/")[0] == [("<urn:page:1>", noise), ("<urn:page:2>", None)]


def test_stages_on_odd_tables(spark):
    """Columns with the names that stages use inside, null rows, and no rows at all."""
    pytest.importorskip("public_tokenizers")
    few = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = few.union(spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, 0)], few.schema))
    names = ("keep", "own", "y", "drop", "line", "leaf", "node", "component", "copy", "taken", "queue", "_key", "_times", "_views")
    odd = odd.withColumns({n: F.lit(n) for n in names})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = out.cache()
            assert all(r[n] == n for r in docs.collect() for n in names), name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (docs.count() > 0)
