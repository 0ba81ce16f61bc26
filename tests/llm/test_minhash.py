"""Near duplicates against brute force over all pairs."""

import random
import re

import pytest

from inkfold.llm import minhash


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """component by id, from every pair that shares a shingle."""
    of = {d: sets(t) for d, t in texts.items()}
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    by = {}
    for d in sorted(of):
        for x in of[d]:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for i, b in enumerate(ds) for a in ds[:i]}
    for a, b in sorted(pairs):
        both = len(of[a] & of[b])
        if 100 * both >= 75 * len(of[a] | of[b]):
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    return {d: (len(of[d]), root(d)) for d in texts}


def check(rows, texts):
    want = brute(texts)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == sorted((d, n, c, d == c) for d, (n, c) in want.items())


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(minhash.near_duplicates(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_chains_groups_and_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(60):  # a group of near copies, edited apart
        own = list(base)
        for _ in range(2):
            own[rng.randrange(120)] = word()
        texts[10 + i] = " ".join(own)
    chain = [word() for _ in range(100)]
    for i in range(12):  # each link close to the next only
        texts[200 + i] = " ".join(chain[4 * i :] + [f"{w}{i // 20}" for w in chain[: 4 * i]])
    shared = [word() for _ in range(60)]
    for i in range(40):  # half in common, not similar
        texts[300 + i] = " ".join(shared + [word() for _ in range(60)])
    texts |= {400: None, 401: "", 402: "one two", 403: "One  TWO", 404: "É one two three", 405: "é one two three", 406: "x " * 3000, 407: "x " * 7}
    docs = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, node int")
    check(minhash.near_duplicates(docs).collect(), texts)
    with_null = docs.union(spark.createDataFrame([(None, "one two", 0), (402, "one two", 0)], docs.schema))
    got = minhash.near_duplicates(with_null).collect()
    assert len(got) == len(texts) + 2 and [r.kept for r in got if r.doc_id is None] == [True]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    test_chains_groups_and_odd_rows(spark)


def test_long_lists_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LONG", 3)
    test_chains_groups_and_odd_rows(spark)


def test_members_of_a_group_bring_the_lists_they_keep(spark, monkeypatch):
    """Rows that meet lists grow as a group of near copies does, and are fewer than the group's 160 postings a member."""
    monkeypatch.setattr(minhash, "LONG", 8)
    dealt, met = minhash._dealt, []

    def counted(rows, key, *rest):
        met.append(rows.count() if key == "list" else 0)
        return dealt(rows, key, *rest)

    monkeypatch.setattr(minhash, "_dealt", counted)
    made = {}
    for n in (80, 160):
        met.clear()
        texts = lookalikes(n, 2)
        check(minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
        made[n] = sum(met)
    assert made[160] <= 2.2 * made[80] and made[160] <= 110 * 160, made


def test_skipped_lists_by_definition(spark, monkeypatch):
    """What each node keeps of its lists, with long lists skipped while they are posted or after."""
    texts = lookalikes(40, 3) | {100 + i: t for i, t in lookalikes(6, 1, 8).items()} | {200: "one two three four five six"}
    lists = {d: [(i << 32) | (int(v) & 0xFFFFFFFF) for i, v in enumerate(minhash.signature(minhash.shingles(t)))] for d, t in texts.items()}
    of = {}
    for d, own in lists.items():
        for x in own:
            of.setdefault(x, []).append(d)
    want = set()
    for d, own in lists.items():
        shared = sorted((x for x in own if len(of[x]) > 1), key=lambda x: (-len(of[x]), x))
        want |= {(x, d, min(of[x])) for x in shared[74:]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes = minhash._signatures(docs).withColumnRenamed("doc_id", "node")
    for long in (3, 256):
        monkeypatch.setattr(minhash, "LONG", long)
        got = minhash._skipped(nodes, 75, minhash.Scratch(spark, "skipped")).collect()
        assert len(got) == len(want) and {(r["list"], r.node, r.least) for r in got} == want
    few = minhash._sharing(nodes, minhash._sizes(minhash._postings(nodes, "heads")), 32, 12)
    assert {r.node for r in few.collect()} == {d for d, own in lists.items() if sum(len(of[x]) > 1 for x in own[:32]) >= 12}


def test_long_lists_are_met_without_a_join(spark, monkeypatch):
    """A group of near copies joins lists once, with the lists its members keep: 54 at most each."""
    dealt, met = minhash._dealt, []

    def counted(rows, key, *rest):
        met.append(rows.count() if key == "list" else 0)
        return dealt(rows, key, *rest)

    monkeypatch.setattr(minhash, "_dealt", counted)
    texts = lookalikes(150, 2)
    check(minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    assert 0 < sum(met) <= 54 * 150, met


@pytest.mark.parametrize("rows", [1, 60, 600, 100_000])
def test_skipped_lists_where_tasks_know_some(spark, monkeypatch, rows):
    """Tasks know `rows` lists at most, the longest; what nodes keep is the same, and members of the group post few lists more than that."""
    texts = {d - 40: t for d, t in (lookalikes(80, 3) | {100 + i: t for i, t in lookalikes(6, 1, 8).items()}).items()}
    lists = {d: [(i << 32) | (int(v) & 0xFFFFFFFF) for i, v in enumerate(minhash.signature(minhash.shingles(t)))] for d, t in texts.items()}
    of, want, posted, known, once = {}, set(), [], [], minhash._unskipped
    for d, own in lists.items():
        for x in own:
            of.setdefault(x, []).append(d)
    for d, own in lists.items():
        want |= {(x, d, min(of[x])) for x in sorted((x for x in own if len(of[x]) > 1), key=lambda x: (-len(of[x]), x))[74:]}

    def counted(nodes, of_tasks, *rest):
        out = once(nodes, of_tasks, *rest)
        posted.append(out.count())
        known.append(len(of_tasks))
        return out

    monkeypatch.setattr(minhash, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(minhash, "_unskipped", counted)
    nodes = minhash._signatures(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).withColumnRenamed("doc_id", "node")
    got = minhash._skipped(nodes, 75, minhash.Scratch(spark, "skipped")).collect()
    assert len(got) == len(want) and {(r["list"], r.node, r.least) for r in got} == want
    assert known[0] <= rows and (posted[0] == len(want) if rows == 100_000 else posted[0] <= 128 * len(texts))
    alike = nodes.coalesce(1)
    assert minhash._postings(alike, "signature").count() == len(of) == minhash._sizes(minhash._postings(nodes, "signature")).count()


def test_few_known_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(minhash, "LONG", 3)
    test_chains_groups_and_odd_rows(spark)


def test_dealt_join_is_the_join(spark, monkeypatch):
    """Rows of one long key go to many parts, and none is lost or doubled; null keys stay in a left join."""
    monkeypatch.setattr(minhash, "LONG", 10)
    rows = [(k, i) for i in range(500) for k in (7, i % 50, None)]
    left = spark.createDataFrame(rows, "key long, node long")
    found = left.filter("key is not null and key <> 49").groupBy("key").count().withColumnRenamed("count", "n")
    joined = minhash._dealt(left, "key", "node", found, found, len(rows))
    assert sorted((r.key, r.node) for r in joined.collect()) == sorted(r for r in rows if r[0] not in (None, 49))
    outer = minhash._dealt(left, "key", "node", found, found, len(rows), "left").collect()
    assert sorted(map(str, ((r.key, r.node) for r in outer))) == sorted(map(str, rows))
    assert {r.n for r in outer if r.key in (None, 49)} == {None}


def test_exact_way(spark):
    """matches=1, collide=0 finds every link of brute force, where a high match threshold loses some."""
    texts = lookalikes(150, 3, 11) | {1000 + i: t for i, t in lookalikes(60, 4, 12).items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(minhash.near_duplicates(docs, matches=1, collide=0).collect(), texts)
    want = {d: c for d, (_, c) in brute(texts).items()}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, matches=118).collect()} != want
    with pytest.raises(ValueError, match="matches"):
        minhash.near_duplicates(docs, matches=0)


def lookalikes(n, changed, seed=3):
    """Copies of one text, each with words of its own at `changed` of 200 places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base = [word() for _ in range(200)]
    texts = {}
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(200), changed):
            own[at] = word()
        texts[i] = " ".join(own)
    return texts


def test_unlinked_lookalikes(spark, monkeypatch):
    """Thousands of documents with similarities of about 0.5 to 0.74: tables stay linear in the documents, however many pairs there are."""
    texts = lookalikes(3000, 5)
    rows = {}
    saved = minhash.Scratch.save

    def save(self, df, name, partitions=None):
        out = saved(self, df, name, partitions)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "save", save)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    sets_of = {d: minhash.shingles(t) for d, t in texts.items()}
    held = random.Random(1).sample(sorted(texts), 40)
    like = [len(set(sets_of[a]) & set(sets_of[b])) / len(set(sets_of[a]) | set(sets_of[b])) for a in held for b in held if a < b]
    assert sum(0.5 < x < 0.75 for x in like) > 0.9 * len(like)
    want, up = {}, minhash.linked_pairs(minhash._Sets([{"node": d, "component": d, "codes": s.tobytes()} for d, s in sets_of.items()]), None)
    for a, b in zip(*up, strict=True):
        x, y = want.get(a, a), want.get(b, b)
        want = want | {d: min(x, y) for d in (a, b, x, y)} | {d: min(x, y) for d, c in want.items() if c in (x, y)}
    assert {r.doc_id: r.component_id for r in got} == {d: want.get(d, d) for d in texts}
    per_document = {"posted": 128}
    assert all(n <= per_document.get(name, 54) * len(texts) for name, n in rows.items()), rows


def test_links_inside_a_block():
    """linked_pairs against every pair of sets."""
    texts = lookalikes(120, 4) | {200 + i: t for i, t in lookalikes(60, 2, 9).items()}
    blocks = [{"node": d, "component": d, "codes": minhash.shingles(t).tobytes()} for d, t in texts.items()]

    def groups(pairs):
        up = {d: d for d in texts}
        for a, b in pairs:
            x, y = up[int(a)], up[int(b)]
            up = {d: min(x, y) if c in (x, y) else c for d, c in up.items()}
        return up

    want = {d: c for d, (_, c) in brute(texts).items()}
    inside = minhash.linked_pairs(minhash._Sets(blocks), None)
    assert groups(zip(*inside, strict=True)) == want
    halves = blocks[::2], blocks[1::2]
    parts = [minhash.linked_pairs(minhash._Sets(h), None) for h in halves] + [minhash.linked_pairs(*map(minhash._Sets, halves))]
    assert groups(p for x in parts for p in zip(*x, strict=True)) == want
