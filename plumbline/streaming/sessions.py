"""Calls of recorded sessions as a stream: a reorder buffer that releases settled calls by number, and flushes at a session's end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.sessions import ANSWER, CALL, CLOSE, END, INVALID, NO_RESPONSE, RELEASED, UNANSWERED

#: The state store that transformWithState needs; set it as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "called boolean, tool string, req string, settled boolean, resp string, status string, reason string"
COLUMNS = [c.split()[0] for c in RELEASED.split(", ")]


class Reorder(StatefulProcessor):
    """State of one tape: the next number to release, the events held for it and later numbers, and the last session's end."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "idx long")
        self.held = handle.getMapState("held", "idx long", HELD)
        self.end = handle.getValueState("end", "idx long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.next.get()[0] if self.next.exists() else 1
        changed: dict[int, list] = {}
        for frame in rows:
            for e in frame.sort_values("at", kind="stable").to_dict("records"):
                e = {k: None if pd.isna(v) else v for k, v in e.items()}
                if e["idx"] is None or e["idx"] < start:
                    continue
                idx = int(e["idx"])
                if e["kind"] == END:
                    self._ends(idx, int(e["at"].timestamp() * 1000) if e["at"] is not None else timerValues.getCurrentWatermarkInMs())
                    continue
                if idx not in changed:
                    changed[idx] = list(self.held.getValue((idx,))) if self.held.containsKey((idx,)) else [False, None, None, False, None, None, None]
                self._take(changed[idx], e)
        for idx, row in changed.items():
            self.held.updateValue((idx,), tuple(row))
        yield self._frame(key[0], self._in_order(start))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, due = self.end.get()
        out, start = [], self.next.get()[0] if self.next.exists() else 1
        if expiredTimerInfo.getExpiryTimeInMs() >= due:
            for idx, row in sorted((int(k[0]), list(v)) for k, v in self.held.iterator()):
                if idx <= last:
                    out += [(idx, row)] if row[0] else []
                    self.held.removeKey((idx,))
            start = max(start, last + 1)
            self.end.clear()
        yield self._frame(key[0], out + self._in_order(start))

    def close(self) -> None:
        pass

    def _ends(self, idx: int, at: int) -> None:
        due = at + self.grace_ms
        if self.end.exists():
            last, before = self.end.get()
            self.handle.deleteTimer(before)
            idx, due = max(idx, last), max(due, before)
        self.end.update((idx, due))
        self.handle.registerTimer(due)

    @staticmethod
    def _take(row: list, e: dict) -> None:
        called, _, _, settled, _, status, _ = row
        if e["kind"] == CALL and not called:
            row[0:3] = [True, e["tool"], e["req"]]
            if e["status"] == INVALID:
                row[3:7] = [True, None, INVALID, None]
        elif e["kind"] == ANSWER and (not settled or status == UNANSWERED):
            row[3:7] = [True, e["resp"], e["status"], None]
        elif e["kind"] == CLOSE and not settled:
            row[3:7] = [True, None, UNANSWERED, e["reason"]]

    def _in_order(self, idx: int) -> list[tuple[int, list]]:
        """Takes out the settled calls from idx on, up to the first number that holds back."""
        out = []
        while self.held.containsKey((idx,)):
            row = list(self.held.getValue((idx,)))
            if not (row[0] and row[3]):
                break
            out.append((idx, row))
            self.held.removeKey((idx,))
            idx += 1
        self.next.update((idx,))
        return out

    @staticmethod
    def _frame(tape: str, found: list[tuple[int, list]]) -> pd.DataFrame:
        rows = [(tape, i, tool, req, resp, status, reason) if settled else (tape, i, tool, req, None, UNANSWERED, NO_RESPONSE) for i, (_, tool, req, settled, resp, status, reason) in found]
        return pd.DataFrame(rows, columns=COLUMNS)


def release(events: DataFrame, delay: str = "1 hour", grace_ms: int = 0) -> DataFrame:
    """operators.sessions.committed as a stream of events (EVENTS): a row goes out as soon as nothing before it is open.

    Events may come in any order within `delay`, an answer before its call too.
    A session's end takes effect once the watermark is `grace_ms` past it: then
    its open calls go out as unanswered, and numbers without calls stay gaps.
    Only open calls and what they hold back are kept. A row that has gone out
    is final, so of repeats the first to come counts, and an answer that comes
    behind a close counts only while the call is still held.
    """
    known = events.where(F.col("tape").isNotNull() & F.col("kind").isin(CALL, ANSWER, CLOSE, END)).withWatermark("at", delay)
    return known.groupBy("tape").transformWithStateInPandas(Reorder(grace_ms), RELEASED, "append", "eventTime")
