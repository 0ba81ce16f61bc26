"""Line dedup counts independent documents: held against counts that use nothing of inkfold."""

import hashlib
from collections import defaultdict

from inkfold.llm import lines


def word(*of) -> str:
    return hashlib.md5(str(of).encode()).hexdigest()[:8].translate(str.maketrans("0123456789", "ghijklmnop"))


def prose(n: int, *of) -> str:
    return " ".join(word(*of, j) for j in range(n))


def texts(spark, rows: dict[int, str]) -> dict[int, str]:
    return {r.doc_id: r.text for r in lines.drop_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}


def test_long_passage_in_short_documents(spark):
    """40 unlike documents of 30 own words and one passage of 70: the least window hash lies in the passage for most of them."""
    passage = prose(70, "shared")
    rows = {i: f"{prose(15, i)}\n{passage}\n{prose(15, i, 'b')}" for i in range(40)}
    assert texts(spark, rows) == {i: t.replace(f"{passage}\n", "") for i, t in rows.items()}


def test_copies_neither_count_nor_shield(spark):
    """30 independent documents and 120 copies of another share a line: the line goes from all of them, the copies' own lines stay."""
    line = "Sent from the shared desk of all"
    rows = {i: f"{prose(60, i)}\n{line}" for i in range(30)}
    rows |= {100 + i: f"{prose(80, 'copy')} {word(i)}\n{prose(20, 'copy', 2)}\n{line}" for i in range(120)}
    assert texts(spark, rows) == {i: t.replace(f"\n{line}", "") for i, t in rows.items()}


def test_several_lines_of_a_template_in_a_document(spark):
    """A field that stands three times in each document: 180 lines of 60 documents."""
    rows = {i: f"{prose(40, i)}\n" + "\n".join(f"Comment by {word(i, j)} posted to thread" for j in range(3)) for i in range(60)}
    assert texts(spark, rows) == {i: t.split("\n")[0] for i, t in rows.items()}


def test_lines_of_one_document_are_one(spark):
    """14 lines of one document don't make its own word a constant: with it, 12 documents have the template, without it 11."""
    rows = {i: f"{prose(40, i)}\nGoods sold: {word(i)} item {i} by desk" for i in range(11)}
    assert texts(spark, rows) == rows
    rows[50] = f"{prose(40, 50)}\n" + "\n".join(f"Goods sold: bolts {word(50, j)} {j} by desk" for j in range(14))
    assert texts(spark, rows) == {i: t.split("\n")[0] for i, t in rows.items()}


def plain(rows: dict[int, str], least: int) -> dict[int, str]:
    """The rules over sets, all in memory, by texts: no hashes, no functions of inkfold."""
    blank = " \t\n\v\f\r"
    split = lambda s: "".join(" " if c in blank else c for c in s).split(" ")
    fields = lambda x: tuple("<*>" if any("0" <= c <= "9" for c in t) else t for t in split(x) if t)
    holds, leaves = {d: {fields(x) for x in (t or "").split("\n")} - {()} for d, t in rows.items()}, defaultdict(list)
    for d, found in holds.items():
        for x in found:
            leaves[len(x), x[:2]].append((d, x))
    leaves = {k: v for k, v in leaves.items() if len(v) >= least}
    template = {}
    for v in leaves.values():
        at = defaultdict(set)
        for d, x in v:
            for i, t in enumerate(x):
                at[i, t].add(rows[d])
        for _, x in v:
            kept = tuple((i, t) for i, t in enumerate(x) if len(at[i, t]) >= least)
            template[x] = (len(x), x[:2], kept) if 2 * sum(t != "<*>" for _, t in kept) >= len(x) else x

    def over(of):
        classes = defaultdict(set)
        for v in leaves.values():
            for d, x in v:
                classes[template[x]].add(of[d])
        return {x for x, t in template.items() if len(classes[t]) >= least}

    first = over(rows)
    suspects = [d for d, found in sorted(holds.items()) if found and 4 * sum(len(x) for x in found & first) >= sum(map(len, found))]
    suspects = [d for d in suspects if holds[d] & first]
    low = {c: chr(ord(c) + 32) for c in map(chr, range(65, 91))}
    words = {d: [w for w in split("".join(low.get(c, c) for c in rows[d])) if w] for d in suspects}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    of = {d: d for d in suspects}
    for i, a in enumerate(suspects):
        for b in suspects[:i]:
            both = len(sets[a] & sets[b])
            if of[a] != of[b] and 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                low_, high = sorted((of[a], of[b]))
                of = {d: low_ if c == high else c for d, c in of.items()}
    gone = over({d: of.get(d, t) for d, t in rows.items()})
    return {d: t if t is None else "\n".join(x for x in t.split("\n") if fields(x) not in gone) for d, t in rows.items()}


def test_whole_table_with_production_value(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = plain(rows, lines.MIN_DOCS)
    assert sum(want[d] != rows[d] for d in rows) > 100
    assert {r.doc_id: r.text for r in lines.drop_lines(docs).collect()} == want


def test_large_groups_of_copies_keep_their_text(spark):
    """Copies, equal ones and edited ones, beside unlike documents: no line of theirs goes, however many they are."""
    rows = {i: "\n".join(prose(12, "equal", k) for k in range(5)) for i in range(50)}
    rows |= {100 + i: "\n".join(prose(12, "edited", k) for k in range(9)) + f"\n{prose(3, 'own', i)}" for i in range(50)}
    rows |= {200 + i: prose(50, i) for i in range(20)}
    assert texts(spark, rows) == rows == plain(rows, lines.MIN_DOCS)


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "a line here"), (3, "\n \t\n"), (4, "word " * 60_000)] + [(10 + i, f"{prose(30, i)}\nshared line of theirs") for i in range(12)] + [(10, "other text\nshared line of theirs"), (11, f"{prose(30, 1)}\nshared line of theirs")]
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, line int, leaf string, class int")
    got = lines.drop_lines(docs)
    assert got.columns == docs.columns
    want = [(d, t if t is None or d is None else t.removesuffix("\nshared line of theirs")) for d, t in rows]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert lines.drop_lines(docs.limit(0)).collect() == [] and lines.line_report(docs.limit(0)).collect() == []
