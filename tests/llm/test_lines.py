"""Line dedup against a plain version with a low count, and on planted templates, copies and odd rows."""

import hashlib

from inkfold.llm import lines
from test_line_classes import plain


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain(texts, 4)
    got = {r.doc_id: r for r in lines.line_report(docs, min_docs=4).collect()}
    assert sum(want[d] != texts[d] for d in texts) > 5
    for d, t in want.items():
        assert got[d].kept_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[d].n_lines == len(texts[d].split("\n"))


def test_planted(spark):
    names = ["ann", "bob", "cho", "dee", "eli", "fay", "gus", "hal", "ida", "jon", "kim", "lee", "mia", "ned", "ola", "pia"]
    word = lambda i, j: hashlib.md5(f"{i}.{j}".encode()).hexdigest()[:8].translate(str.maketrans("0123456789", "ghijklmnop"))
    body = lambda i: " ".join(word(i, j) for j in range(30))
    rows = [(i, f"{body(i)}\nPosted by {names[i]} on page {i} of this site\n\n{body(i + 100)}") for i in range(16)]
    rows += [(100 + i, "One copied text of its own.\nWith the same second line here.") for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "lone\nlone\nlone"), (None, "no id at all here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, drop string, own int")
    got = {r.doc_id: r for r in lines.drop_lines(docs).collect()}
    assert len(got) == len(rows) and docs.columns == lines.drop_lines(docs).columns
    for i, t in rows:
        assert got[i].text == (f"{body(i)}\n\n{body(i + 100)}" if i is not None and i < 16 else t) and got[i].drop == "x"
    assert lines.drop_lines(docs.limit(0)).collect() == []
