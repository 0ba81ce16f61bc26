"""Conversation repair against a search over all edits, written from the contract alone."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from inkfold.llm import queries
from inkfold.llm.conversations import damaged, repair, repaired_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
WS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The cheapest edits by best-first search over edit strings, cheapest and ASCII-least first; what may follow is told by trying the pattern."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(WS)
        faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, i, shown = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in shown)
        allowed = tuple(bool(PATTERN.fullmatch(roles + rest)) for rest in ("", "a", "ua", "sua"))
        if (i, allowed) in done or not any(allowed):
            continue
        done.add((i, allowed))
        if i == len(rows) and allowed[0]:
            break
        moves = [(3, "I", i, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            moves.append((4, "D", i + 1, None))
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                moves += [(more, "K", i + 1, rows[i][2:])] if rows[i][2] else []
                moves += [(more + 3, "R", i + 1, (r, rows[i][3])) for r in ("user", "assistant")]
        for price, letter, to, row in moves:
            heapq.heappush(heap, (cost + price, audit + letter, to, shown if row is None else (*shown, row)))
    text = "\n".join(f"{r}:{t}" for r, t in shown)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), list(shown)


def plain(rows):
    after = plain_damage(rows)
    return {c: plain_repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def random_rows(seed, convs=60):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "and then", "", " \n", "Why?", "é。", "a. \t", " .", "x\n.\n"]
    for c in range(convs):
        for t in range(rng.randrange(7)):
            turn = rng.choice([t, t, t, t + 3, max(0, t - 1), None])
            rows.append((c if c % 13 else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"]), rng.choice([*texts, None])))
    return rows


def collected(frame):
    got = {}
    for r in frame.collect():
        assert r.conv_id not in got
        got[r.conv_id] = tuple(r)[1:]
    return got


@pytest.mark.parametrize(("rows", "chars"), [(4096, 1 << 20), (2, 1 << 20), (4096, 12), (0, 0)])
def test_all_edits(spark, rows, chars):
    """The second to last spill some or all conversations."""
    data = random_rows(rows + 1)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = plain(data)
    assert collected(repair(damaged(frame), rows, chars)) == {c: w for c, (w, _) in want.items()}
    if chars != 12:
        shown = {}
        for r in sorted(repaired_rows(damaged(frame), rows, chars).collect(), key=lambda r: r.place):
            shown.setdefault(r.conv_id, []).append((r.role, r.text))
        assert shown == {c: s for c, (_, s) in want.items() if s}


def test_long_texts_and_giant(spark):
    """A conversation of many rows and one of long texts: solved in the buffer and spilled, the same."""
    rng = random.Random(4)
    data = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{t}.", "so"])) for t in range(9000)]
    data += [(2, t, ("user", "assistant")[t % 2], f"{t} " + "word " * 200_000 + ".") for t in range(6)]
    frame = spark.createDataFrame(data, SCHEMA)
    got = collected(repair(damaged(frame)))
    assert got == collected(repair(damaged(frame), 1 << 30, 1 << 40)) and got[1][5] > 0
    assert got[2] == plain([r for r in data if r[0] == 2])[2][0]


def test_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(empty)).count() == 0 and repaired_rows(damaged(empty)).count() == 0
    clash = spark.createDataFrame([(1, 1, "user", "Hi.", 9, "x", True)], SCHEMA + ", seq int, no_id string, live boolean")
    nothing = hashlib.sha256(b"").hexdigest()
    assert collected(repair(damaged(clash))) == collected(repair(damaged(clash.select("conv_id", "turn", "role", "text"))))
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert collected(repair(damaged(lost))) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    far = spark.createDataFrame([(5, -(2**63), "user", "a."), (5, 2**63 - 1, "user", "b.")], SCHEMA)
    assert collected(repair(damaged(far))).keys() == {5}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = c.sql(queries.ORACLE["op11_conversations"])
    got = queries.QUERIES["op11_conversations"](spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_sql_on_odd_rows(spark, tmp_path):
    data = [r for r in random_rows(9, 40) if r[2] != ""]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(map(tuple, queries.QUERIES["op11_conversations"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(c.sql(queries.ORACLE["op11_conversations"]).fetchall(), key=key)
