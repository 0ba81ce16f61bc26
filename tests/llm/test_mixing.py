"""Mixing against a plain queue in memory: texts, sources and ids in, words taken out."""

import hashlib
import math
import re
from collections import defaultdict

from inkfold.llm import mixing


def plain_targets(sizes: dict) -> dict:
    """Weights 3, 1, 2 round the sources; 150 % of all words; a target stops at twice its source, the excess shared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    open_, left, target = set(order), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def plain_mix(rows: list[tuple], packet: int = 16) -> list[dict]:
    """rows: (doc_id, source, text). What each row gives to the mix, by copy."""
    of = defaultdict(list)
    for i, (d, s, text) in enumerate(rows):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        of[s].append((hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest(), words, i))
    target = plain_targets({s: sum(w for _, w, _ in q) for s, q in of.items()})
    queue = []
    for s, q in of.items():
        at, total = 0, sum(w for _, w, _ in q)
        for copy in range(2):
            for place, (key, words, i) in enumerate(sorted(q), 1):
                long = at < target[s] < at + words
                for p in range(max(1, math.ceil(words / packet)) if long else 1):
                    n = min(packet, words - p * packet) if long else words
                    v = (at + p * packet + n) / target[s] if total else 0.0
                    queue.append((v, "" if s is None else f"={s}", key, place, copy, p, n, i))
                at += words
    left, taken = round(sum(target.values())), defaultdict(int)
    for *_, copy, _, n, i in sorted(queue, key=lambda x: (x[0], x[1].encode(), *x[2:])):
        taken[i, copy] += min(n, left)
        left -= min(n, left)
    return [{"target": target[s], "taken": taken[i, 0] + taken[i, 1], "copies": [taken[i, 0], taken[i, 1]]} for i, (_, s, _) in enumerate(rows)]


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want = {r[0]: x for r, x in zip(rows, plain_mix(rows), strict=True)}
    got = mixing.taken_words(docs)
    assert {r.doc_id: r.taken for r in got.collect()} == {d: x["taken"] for d, x in want.items()}
    assert all(math.isclose(r.target, want[r.doc_id]["target"], rel_tol=1e-12) for r in got.collect())
    assert len({len(x["copies"]) for x in want.values()}) == 1 and any(x["copies"][1] for x in want.values())


def test_cases(spark):
    rows = [(i, "w " * (i % 9), ["a", "b", "é", None][i % 4], 1, "x") for i in range(200)]
    rows += [(300, None, "a", 1, "x"), (301, "", "z", 1, "x"), (301, "", "z", 1, "x"), (None, "one", "b", 1, "x"), (7, "w " * 7, None, 1, "x"), (400, "long " * 40_000, "huge", 1, "x"), (401, "w", "huge", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string")
    got = mixing.taken_words(docs).collect()
    want = plain_mix([(d, s, t) for d, t, s, *_ in rows])
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(d), len((t or "").split()), x["taken"]) for (d, t, *_), x in zip(rows, want, strict=True))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    of, target, source = defaultdict(int), {}, {str(r[0]): r[2] for r in rows}
    for r in got:
        of[source[str(r.doc_id)]] += r.taken
        target[source[str(r.doc_id)]] = r.target
    assert all(abs(of[s] - t) <= 2 * mixing.PACKET for s, t in target.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken_words(docs.repartition(7)).collect()), key=str)
    mix = mixing.mix(docs).collect()
    assert [r.v_finish for r in mix] == sorted(r.v_finish for r in mix) and sum(r.taken for r in mix) == sum(x["taken"] for x in want)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and {r.taken for r in whole.collect()} == {"x"}
    assert mixing.taken_words(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []
    empty = docs.filter("doc_id in (300, 301)")
    assert {r.taken for r in mixing.taken_words(empty).collect()} == {0}


def test_plan_sorts_by_range(spark):
    docs = spark.createDataFrame([(i, "w " * i, "s") for i in range(1, 30)], "doc_id long, text string, source string")
    plan = []
    saved = mixing.Scratch.save

    def save(self, df, name, partitions=None):
        plan.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return saved(self, df, name, partitions)

    mixing.Scratch.save = save
    try:
        mixing.taken_words(docs).collect()
    finally:
        mixing.Scratch.save = saved
    text = dict(plan)["queue"]
    assert "RepartitionByExpression [v_finish" in text and "ASC NULLS FIRST" in text
