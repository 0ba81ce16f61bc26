"""Conversation structure repair by secondary-sorted streaming and a dynamic program.

Rows are repartitioned by conversation and sorted by turn; a task streams them and carries one conversation's state from
Arrow batch to Arrow batch. A repaired conversation's roles are nothing, or an optional system row and then pairs of user
and assistant. The cheapest edits (keep, rerole, delete, insert) come from a dynamic program over four places in that
pattern: START, SYSTEM, USER (an answer is due) and ANSWERED. It runs from the last row to the first. What it carries is,
for each place, the cost of the rest and the rank of the rest's edit string among the four, so that ties go to the ASCII-least
string without any string being held; a row leaves a backpointer of 16 bits. Then the edits are read forward.

Scale: one shuffle. Conversations of up to BUFFER_ROWS rows and BUFFER_CHARS letters are solved where they stand. A giant
one is not held: its numbered rows go to a table in the shared folder as they stream by, duplicates are told by a
grouped minimum of row numbers (spread over all tasks by the digest of the text), the backward pass spills its backpointers into a second table, and the
forward pass meets them row by row. So a task holds a buffer, whatever a conversation's length; only its digest
(SHA-256 is sequential) and its audit (one cell of the result) make one task go over all rows of one conversation. A lost executor
costs the tasks it ran: both tables are in the shared folder.

Defined cases: null role and null text are one space; a null turn sorts first and counts as one space in the damage's key; a null conv_id is
a conversation of its own; rows of one turn are ordered by role and text after damage; empty texts are blank; an empty role, and one with another initial than s, u or a, can't be kept
(rerole or delete); very long texts are hashed as they stream; repeated rows are duplicates; numbers beyond 64 bits wrap round; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch

BUFFER_ROWS, BUFFER_CHARS = 4096, 4_000_000
START, SYSTEM, USER, ANSWERED = range(4)
#: Where a row leads, by place and initial of its role; and the one role that may be inserted or given at a place.
LEADS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWERED, (ANSWERED, "u"): USER}
AFTER, GIVEN = (USER, USER, ANSWERED, USER), ("user", "user", "assistant", "user")
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, KEEP, REROLE = range(3)
LETTERS, COSTS, INSERT_COST = "DKR", (4, 0, 3), 3
LEGAL = {"su", "ua", "au"}
WHITE = r"\x20\x09-\x0D"
#: Cost of the rest and rank of its edit string, by place, where no row is left.
END = ((0, 0), (2 * INSERT_COST, 2), (INSERT_COST, 1), (0, 0))
GAPS, TOTALS = -2, -1  # row numbers of what is known of a whole giant conversation
OUT = "no_id boolean, conv_id long, seq long, role string, text string, fault int, code int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@cache
def step(rest: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
    """(the rest from this row on, what its costs are less by, backpointer) from the rest after it. rest: (cost, rank) by place; the least cost is 0."""
    own = []
    for place in range(4):
        moves = [(COSTS[DELETE] + rest[place][0], (LETTERS[DELETE], rest[place][1]), DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = 3 if fault == TRUNCATED else 0
            for action, to in ((KEEP, LEADS.get((place, initial))), (REROLE, AFTER[place])):
                if to is not None:
                    moves.append((COSTS[action] + more + rest[to][0], (LETTERS[action], rest[to][1]), action))
        own.append(min(moves))
    best = []
    for place in range(4):
        at, ways = place, []
        for inserted in range(3):  # after two, the place is one that was passed already
            cost, edits, action = own[at]
            ways.append((INSERT_COST * inserted + cost, ("I",) * inserted + edits, 3 * inserted + action))
            at = AFTER[at]
        best.append(min(ways))
    least = min(b[0] for b in best)
    order = sorted({b[1] for b in best})
    return tuple((b[0] - least, order.index(b[1])) for b in best), least, sum(b[2] << 4 * place for place, b in enumerate(best))


def initial_of(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "-"


class Repaired:
    """Reads edits forward: audit and digest of the repaired rows, or these rows themselves."""

    def __init__(self, keep_rows: bool):
        self.place, self.audit, self.digest, self.n = START, bytearray(), hashlib.sha256(), 0
        self.rows: list[dict] | None = [] if keep_rows else None

    def _row(self, role: str, text: str, edit: str) -> None:
        if self.rows is not None:
            self.rows.append({"seq": self.n, "role": role, "text": text, "audit": edit})
        else:
            self.digest.update((f"\n{role}:" if self.n else f"{role}:").encode())
            self.digest.update(text.encode())
        self.n += 1

    def taken(self) -> list[dict]:
        """The rows since the last call."""
        out, self.rows = self.rows, []
        return out

    def _insert(self, times: int) -> None:
        for _ in range(times):
            self._row(GIVEN[self.place], "", "I")
            self.place = AFTER[self.place]
            self.audit += b"I"

    def add(self, code: int, role: str, text: str) -> None:
        inserted, action = divmod(code >> 4 * self.place & 15, 3)
        self._insert(inserted)
        self.audit += LETTERS[action].encode()
        if action == KEEP:
            self._row(role, text, LETTERS[action])
            self.place = LEADS[self.place, initial_of(role)]
        elif action == REROLE:
            self._row(GIVEN[self.place], text, LETTERS[action])
            self.place = AFTER[self.place]

    def end(self) -> tuple[str, str]:
        self._insert({SYSTEM: 2, USER: 1}.get(self.place, 0))
        return self.audit.decode(), self.digest.hexdigest()


def _long(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


class _Conversation:
    """The rows of one conversation as they stream by, held up to the buffer's size."""

    def __init__(self, key: tuple[bool, int], rows: int, chars: int, keep_rows: bool):
        self.key, self.most_rows, self.most_chars, self.keep_rows = key, rows, chars, keep_rows
        self.held, self.chars, self.n, self.giant = [], 0, 0, False
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.before = None

    def add(self, no_turn: bool, turn: int, role: str, text: str, fault: int) -> list[dict]:
        if not no_turn and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        own = initial_of(role)
        self.illegal += self.before is not None and self.before + own not in LEGAL
        self.before = own
        self.held.append((self.n, role, text, fault))
        self.n, self.chars = self.n + 1, self.chars + len(text)
        if not self.giant and len(self.held) <= self.most_rows and self.chars <= self.most_chars:
            return []
        self.giant = True
        out = [self._with(seq=n, role=role, text=text, fault=fault) for n, role, text, fault in self.held]
        self.held = []
        return out

    def _with(self, **values) -> dict:
        return {"no_id": self.key[0], "conv_id": self.key[1], **values}

    def end(self) -> list[dict]:
        known = {"gaps": 0 if self.first is None else _long(self.last - self.first + 1 - self.turns), "illegal": self.illegal}
        if self.giant:
            return [self._with(seq=GAPS, **known)]
        seen, faults = set(), []
        for _, role, text, fault in self.held:
            faults.append(fault if fault == BLANK else DUPLICATE if (role, text) in seen else fault)
            seen.add((role, text))
        rest, cost, codes = END, 0, []
        for (_, role, _, _), fault in zip(reversed(self.held), reversed(faults), strict=True):
            rest, more, code = step(rest, initial_of(role), fault)
            cost += more
            codes.append(code)
        repaired = Repaired(self.keep_rows)
        for (_, role, text, _), code in zip(self.held, reversed(codes), strict=True):
            repaired.add(code, role, text)
        audit, digest = repaired.end()
        if self.keep_rows:
            return [self._with(**row) for row in repaired.taken()]
        return [self._with(**known, blank=faults.count(BLANK), duplicate=faults.count(DUPLICATE), truncated=faults.count(TRUNCATED), cost=cost + rest[START][0], audit=audit, repaired_sha256=digest)]


def _frame(rows: list[dict]):
    import pandas as pd

    frame = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return frame.astype({c: "Int64" for c in ("conv_id", "seq", "fault", "code", *COUNTS)} | {"no_id": bool})


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and live: the rows after damage; a dropped row stays as one that is not live, so that its conversation is known.

    By the checksum of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes out its ends of sentences, 3 repeats it, 4 gives it to the user.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(times).alias("time")).drop("time")


def _streamed(rows: DataFrame, buffer_rows: int, buffer_chars: int, keep_rows: bool) -> DataFrame:
    """Results (a report, or repaired rows with their edit in `audit`) of conversations that fit the buffer; of others the numbered rows (seq from 0) and a row GAPS, both with no audit."""
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    open_end = ~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")
    fault = F.when(blank, BLANK).when(open_end, TRUNCATED).otherwise(NO_FAULT)
    no_id, no_turn = F.col("conv_id").isNull(), F.col("turn").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)  # noqa: E731  pandas has no null integers
    sent = rows.select(no_id.alias("no_id"), zero("conv_id"), no_turn.alias("no_turn"), zero("turn"), "role", "text", "live", fault.alias("fault"))
    ordered = sent.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", F.col("no_turn").desc(), "turn", "role", "text")

    def stream(it: Iterator) -> Iterator:
        own = None
        for batch in it:
            out = []
            for no_id, conv, no_turn, turn, role, text, live, fault in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if own is None or own.key != (no_id, conv):
                    if own is not None:
                        out += own.end()
                    own = _Conversation((no_id, conv), buffer_rows, buffer_chars, keep_rows)
                if live:
                    out += own.add(no_turn, turn, role, text, fault)
            if out:
                yield _frame(out)
        if own is not None:
            yield _frame(own.end())

    return ordered.mapInPandas(stream, OUT)


def _backward(rows: DataFrame) -> DataFrame:
    """A row for each of the giant conversations' rows, with its backpointer in `code`, and a row TOTALS. rows: no_id, conv_id, seq, initial, fault."""

    def stream(it: Iterator) -> Iterator:
        key, rest, cost, found = None, END, 0, None
        for batch in it:
            out = []
            for no_id, conv, seq, initial, fault in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if (no_id, conv) != key:
                    key, rest, cost, found = (no_id, conv), END, 0, [0, 0, 0, 0]
                rest, more, code = step(rest, initial, fault)
                cost, found[fault] = cost + more, found[fault] + 1
                out.append({"no_id": no_id, "conv_id": conv, "seq": seq, "code": code})
                if seq == 0:
                    out.append({"no_id": no_id, "conv_id": conv, "seq": TOTALS, "cost": cost + rest[START][0], "blank": found[BLANK], "duplicate": found[DUPLICATE], "truncated": found[TRUNCATED]})
            if out:
                yield _frame(out)

    return rows.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", F.col("seq").desc()).mapInPandas(stream, OUT)


def _forward(rows: DataFrame, keep_rows: bool) -> DataFrame:
    """Results of the giant conversations. rows: OUT's columns, GAPS and TOTALS first."""

    def stream(it: Iterator) -> Iterator:
        key, known, repaired = None, {}, None

        def result() -> list[dict]:
            if key is None:
                return []
            audit, digest = repaired.end()
            rest = repaired.taken() if keep_rows else [known | {"audit": audit, "repaired_sha256": digest}]
            return [{"no_id": key[0], "conv_id": key[1], **row} for row in rest]

        for batch in it:
            out = []
            columns = {c: batch[c].tolist() for c in ("no_id", "conv_id", "seq", "code", "role", "text", *COUNTS)}
            for i, seq in enumerate(columns["seq"]):
                if (columns["no_id"][i], columns["conv_id"][i]) != key:
                    out += result()
                    key, known, repaired = (columns["no_id"][i], columns["conv_id"][i]), {}, Repaired(keep_rows)
                if seq == GAPS:
                    known |= {c: columns[c][i] for c in ("gaps", "illegal")}
                elif seq == TOTALS:
                    known |= {c: columns[c][i] for c in ("blank", "duplicate", "truncated", "cost")}
                else:
                    repaired.add(columns["code"][i], columns["role"][i], columns["text"][i])
                    out += [{"no_id": key[0], "conv_id": key[1], **row} for row in repaired.taken()] if keep_rows else []
            if out:
                yield _frame(out)
        if key is not None:
            yield _frame(result())

    known = {c: F.coalesce(c, F.lit(0)) for c in ("code", *COUNTS)}
    return rows.withColumns(known).repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "seq").mapInPandas(stream, OUT)


def _giants(spilled: DataFrame, scratch: Scratch, keep_rows: bool) -> DataFrame:
    """Results of the conversations whose rows were spilled."""
    key = ["no_id", "conv_id", "seq"]
    rows = spilled.filter(F.col("seq") >= 0)
    first = rows.groupBy("no_id", "conv_id", "role", F.sha2("text", 256)).agg(F.min("seq").alias("seq")).select(*key, F.lit(True).alias("first"))
    again = F.col("first").isNull() & (F.col("fault") != BLANK)
    judged = rows.select(*key, "role", "fault").join(first, key, "left")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    pointers = scratch.save(_backward(judged.select(*key, initial.alias("initial"), F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))), "backpointers")
    both = rows.drop("code").join(pointers.filter(F.col("seq") >= 0).select(*key, "code"), key)
    return _forward(both.unionByName(pointers.filter(F.col("seq") == TOTALS)).unionByName(spilled.filter(F.col("seq") == GAPS)), keep_rows)


def _repaired(rows: DataFrame, buffer_rows: int, buffer_chars: int, keep_rows: bool) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "conversations")
    streamed = scratch.save(_streamed(rows, buffer_rows, buffer_chars, keep_rows), "streamed")
    done, spilled = streamed.filter("audit is not null"), streamed.filter("audit is null")
    if not spilled.isEmpty():
        done = done.unionByName(_giants(spilled, scratch, keep_rows))
    return done.withColumn("conv_id", F.when(~F.col("no_id"), F.col("conv_id")))


def repair(rows: DataFrame, buffer_rows: int = BUFFER_ROWS, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row a conversation. rows: conv_id, turn, role, text, live."""
    return _repaired(rows, buffer_rows, buffer_chars, False).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repaired_rows(rows: DataFrame, buffer_rows: int = BUFFER_ROWS, buffer_chars: int = BUFFER_CHARS) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (K, R or I): the repaired conversations themselves. rows: conv_id, turn, role, text, live."""
    return _repaired(rows, buffer_rows, buffer_chars, True).select("conv_id", F.col("seq").alias("place"), "role", "text", F.col("audit").alias("edit"))
