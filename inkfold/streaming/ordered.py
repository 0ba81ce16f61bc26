"""Keyed state over rows in the order of their event time, whatever order the batches bring them in.

Rows wait in list state until the watermark has passed them: then no earlier one can come, and they are folded into the key's own state in
order. Timers do this: one at the earliest waiting row, and one where the fold asks for it. State is the waiting rows of the watermark's delay and one
small value; both are in the RocksDB state store, so a restart goes on where the checkpoint is. Rows later than the watermark are dropped
by Spark (as are event times of 1970-01-01T00:00:00 and before): the delay has to cover the disorder of the source.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkfold.operators.contrib import MAX_ATTEMPTS


def _frame(columns: list[str], rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=columns, dtype=object)


class Ordered(StatefulProcessor):
    """Subclasses give WAITING (schema of waiting rows, `ms` first), STATE, OUT, and fold."""

    WAITING: str
    STATE: str
    OUT: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.own = handle.getValueState("own", self.STATE)
        self.columns = [c.split()[0] for c in self.WAITING.split(", ")]

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new = []
        for batch in rows:
            new += zip(*(batch[c].tolist() for c in self.columns), strict=True)
        self.waiting.appendList([tuple(None if v != v else v for v in row) for row in new])
        self.handle.registerTimer(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        upto = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] <= upto else rest).append(tuple(row))
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(row[0] for row in rest))
            else:
                self.waiting.clear()
        due.sort(key=lambda row: [(v is not None, v) for v in row])
        out = self.fold(key, due, tuple(self.own.get()) if self.own.exists() else None, upto)
        if out:
            yield _frame(self.OUT, out)

    def fold(self, key, due: list[tuple], state: tuple | None, upto: int) -> list[tuple]:
        """Rows to give out; due may be empty, when a timer that an earlier fold set has come."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Buckets(Ordered):
    """Token buckets of a shard's keys, least recently seen first: idle ones go after the time to live, the oldest beyond the cap."""

    WAITING = "ms long, ts double, seq long, key long"
    STATE = "keys array<long>, tokens array<double>, seen array<double>"
    OUT = ["key", "seq", "allowed"]

    def __init__(self, rate: float, burst: int, ttl: float, cap: int):
        self.rate, self.burst, self.ttl, self.cap = rate, float(burst), ttl, cap

    def fold(self, key, due, state, upto):
        held: OrderedDict[int, tuple[float, float]] = OrderedDict(zip(state[0], zip(state[1], state[2], strict=True), strict=True) if state else ())
        out = []
        for _, ts, seq, own in due:
            while held and ts - next(iter(held.values()))[1] > self.ttl:
                held.popitem(last=False)
            tokens, last = held.pop(own, (self.burst, ts))
            tokens = min(self.burst, tokens + max(ts - last, 0.0) * self.rate)
            allowed = tokens >= 1
            held[own] = (tokens - allowed, ts)
            if len(held) > self.cap:
                held.popitem(last=False)
            out.append((own, seq, allowed))
        if due:
            self.own.update((list(held), [t for t, _ in held.values()], [s for _, s in held.values()]))
        return out


class Throttle(Ordered):
    """A progress row passes if `gap` ms are over since the one shown last and its percent is another or unknown (below 0); before a pause of `idle` ms the last row always comes out."""

    WAITING = "ms long, ts double, percent int"
    STATE = "shown_ms long, shown int, last_ms long, last_ts double, last int, pending boolean"
    OUT = ["key", "ts", "percent"]

    def __init__(self, gap: int, idle: int):
        self.gap, self.idle = gap, idle

    def fold(self, key, due, state, upto):
        shown_ms, shown, last_ms, last_ts, last, pending = state or (None, None, None, None, None, False)
        out = []
        for ms, ts, percent in [*due, (upto + 1, None, None)]:  # what comes next is after the watermark
            if pending and ms - last_ms > self.idle:
                out.append((key[0], last_ts, last))
                shown_ms, shown, pending = last_ms, last, False
            if ts is None:
                break
            pending = shown_ms is not None and (ms - shown_ms < self.gap or percent >= 0 and percent == shown)
            if not pending:
                out.append((key[0], ts, percent))
                shown_ms, shown = ms, percent
            last_ms, last_ts, last = ms, ts, percent
        if last_ms is not None:
            self.own.update((shown_ms, shown, last_ms, last_ts, last, pending))
        if pending:
            self.handle.registerTimer(last_ms + self.idle)
        return out


class Delivery(StatefulProcessor):
    """Attempts, success and last error of a shard's records; a failure sets a timer for the next try, which gives the record out as due.

    Every outcome that counts takes one of MAX_ATTEMPTS, in order: so of those of a record that one batch brings, none after the MAX_ATTEMPTS earliest can count, and they don't wait.
    A record's state is a row of the shard's map, and waiting rows and retries are lists of the shard: the calls to the state store are a few for each shard and batch, and three for each record at most when its rows are due.
    """

    WAITING = ["ms", "known", "seq", "ok", "error", "named", "id"]
    OUT = ["id", "ms", "attempts", "synced", "last_error", "due"]

    def __init__(self, delay):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, known boolean, seq long, ok boolean, error string, named boolean, id long")
        self.retries = handle.getListState("retries", "ms long, named boolean, id long")
        self.own = handle.getMapState("own", "named boolean, id long", "attempts long, synced boolean, last_error string, due_ms long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for named, own, attempts, synced, error in zip(*(initialState[c].tolist() for c in ("named", "id", "attempts", "synced", "last_error")), strict=True):
            self.own.updateValue((named, own), (int(attempts), bool(synced), None if error != error else error, None))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new = []
        for batch in rows:
            first = batch.sort_values(self.WAITING[:5], na_position="first").groupby(["named", "id"], sort=False).head(MAX_ATTEMPTS)
            new += zip(*(first[c].tolist() for c in self.WAITING), strict=True)
        if new:
            self.waiting.appendList([tuple(None if v != v else v for v in row) for row in new])
            self.handle.registerTimer(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        upto = timerValues.getCurrentWatermarkInMs()
        due, later = self._taken(self.waiting, upto)
        retries, rest = self._taken(self.retries, upto)
        out, by = [], {}
        due.sort(key=lambda row: [(v is not None, v) for v in row])
        for *row, named, own in due:
            by.setdefault((named, own), []).append(row)
        for own, found in by.items():
            rest += self._charged(own, found, out)
        now = [r for r in rest if r[0] <= upto]
        for ms, *own in [*retries, *now]:
            attempts, synced, error, due_ms = self._state(tuple(own))
            if due_ms == ms:
                self.own.updateValue(tuple(own), (attempts, synced, error, None))
                out.append((own[1] if own[0] else None, ms, attempts, synced, error, True))
        rest = [r for r in rest if r[0] > upto]
        for held, left, changed in ((self.waiting, later, due), (self.retries, rest, retries or by)):
            if changed and left:
                held.put(left)
            elif changed:
                held.clear()
        if (due or retries) and (later or rest):
            self.handle.registerTimer(min(r[0] for r in [*later, *rest]))
        if out:
            yield _frame(self.OUT, out)

    @staticmethod
    def _taken(held, upto: int) -> tuple[list[tuple], list[tuple]]:
        """A list's rows up to the watermark, and the others."""
        due, rest = [], []
        for row in held.get() if held.exists() else ():
            (due if row[0] <= upto else rest).append(tuple(row))
        return due, rest

    def _state(self, own: tuple) -> tuple:
        return tuple(self.own.getValue(own) or (0, False, None, None))

    def _charged(self, own: tuple, due: list, out: list) -> list[tuple]:
        """Charges a record with its due rows; its retry, if there is to be one."""
        attempts, synced, error, due_ms = self._state(own)
        before = attempts
        for ms, _, _, ok, why in due:
            if synced or attempts >= MAX_ATTEMPTS:
                break
            attempts, synced, error = attempts + 1, ok, None if ok else why
            due_ms = None if ok or attempts >= MAX_ATTEMPTS else ms + self.delay(attempts)
            at = ms
        if attempts == before:
            return []
        self.own.updateValue(own, (attempts, synced, error, due_ms))
        out.append((own[1] if own[0] else None, at, attempts, synced, error, False))
        return [] if due_ms is None else [(due_ms, *own)]

    def close(self) -> None:
        pass


class Pages(StatefulProcessor):
    """A document's pages by number, newest reading first; its text comes out when it has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "seq long, shown string")
        self.text = handle.getValueState("text", "text string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        newest: dict[int, tuple] = {}
        for batch in rows:
            for page, seq, shown in zip(*(batch[c].tolist() for c in ("page", "seq", "shown")), strict=True):
                found = (seq, shown if isinstance(shown, str) else None)
                newest[page] = max(newest.get(page, found), found, key=lambda f: (f[0], f[1] is not None, f[1] or ""))
        for page, found in newest.items():
            held = self.pages.getValue((page,)) if self.pages.containsKey((page,)) else None
            if held is None or (found[0], found[1] is not None, found[1] or "") >= (held[0], held[1] is not None, held[1] or ""):
                self.pages.updateValue((page,), found)
        shown = sorted((page[0], own[1]) for page, own in self.pages.iterator() if own[1] is not None)
        text = "\n\n".join(f"--- Page {page + 1} ---\n{own}" for page, own in shown)
        if not self.text.exists() or self.text.get()[0] != text:
            self.text.update((text,))
            yield _frame(["doc", "text"], [(key[0], text)])

    def close(self) -> None:
        pass
