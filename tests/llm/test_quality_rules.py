"""Quality rules against plain Python and SQL, on odd texts, and on labelled documents."""

import random
import re

import duckdb
import pytest

from inkfold.llm import queries
from inkfold.llm.rules import METRICS, RULES, STOP_WORDS, Rule, judge, keep_passing, quality_report, rules_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STOPS = {*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}


def plain(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    letter = lambda w: any(c.isalpha() for c in w)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_shouts": len(re.findall("[A-ZÄÖÜ]{2,}", text)), "n_letter_words": sum(map(letter, words)), "n_stop_words": sum(w in STOPS for w in words), "n_lines": len(lines),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines), "n_cut_lines": sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines),
    }


def texts():
    rng = random.Random(7)
    pieces = ["the", "Der", "word", "a", "b", "|", "##", "12", "ÄÖ", "OK", "é", "x...", "-", "•", "\n", "\n\n", "\t", "\x0b", " ", "\x85", "\u2028", "…", "*", "end."]
    made = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randrange(80))) for _ in range(150)]
    return [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a b c d e\nf\ta b c d e", "a\r\nb\r\na\r\n", "same\nsame\nsame", *made, "long words here " * 60_000, "#" * 500_000]


def test_metrics(spark):
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts())]
    got = {r.doc_id: r.asDict() for r in judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("own.doc_id", *METRICS).collect()}
    for i, t, *_ in rows:
        assert {k: got[i][k] for k in METRICS} == plain(t), t and t[:200]


def test_cases(spark):
    frame = spark.createDataFrame([(None, "x", None, None, None), (3, None, None, None, None), (3, None, None, None, None)], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_report(frame).collect()) == [(0, 1, True, False), (3, 0, True, False), (3, 0, True, False)]
    assert quality_report(frame.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "the word of " + " ".join(f"w{i}x" for i in range(40)), "a", "b", 3)], "doc_id long, text string, own string, n_words string, `failed.x` int")
    assert keep_passing(clash).columns == clash.columns and keep_passing(clash).collect() == clash.collect()


def test_tables_of_rules(spark):
    rules = [("few", "n_words", None, 3, None, None), ("dense", "n_symbols", "n_words", None, 50, 2), ("none", "n_lines", None, None, None, None)]
    table = spark.createDataFrame(rules, "name string, part string, whole string, least int, most int, words int")
    assert rules_of(table) == (Rule("few", "n_words", least=3), Rule("dense", "n_symbols", "n_words", most=50, words=2), Rule("none", "n_lines"))
    docs = spark.createDataFrame([(1, "# a", None, None, None), (2, "# # a b", None, None, None), (3, "# # # a", None, None, None)], SCHEMA)
    assert {r.doc_id: r.failed for r in quality_report(docs, rules_of(table)).collect()} == {1: "few", 2: "", 3: "dense"}
    assert [r.failed for r in quality_report(docs, ()).collect()] == [""] * 3 and RULES[:2] == (Rule("few_words", "n_words", least=10), Rule("repeats", "n_repeat_words", "n_words", most=20))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = c.sql(queries.ORACLE["op12_rules"])
    got = queries.QUERIES["op12_rules"](spark, f"/root/testdata/{sf}")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_labelled_documents(spark):
    """Junk goes, and no good document but by the base rules."""
    d = "/root/testdata/sf0.1"
    judged = quality_report(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept, r.base_failed): r["count"] for r in judged.groupBy("quality", "kept", "base_failed").count().collect()}
    assert n.get((1, False, False), 0) == 0
    assert n.get((0, True, False), 0) <= 0.02 * sum(v for k, v in n.items() if k[0] == 0)


def test_plan_is_one_projection(spark):
    plan = quality_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
