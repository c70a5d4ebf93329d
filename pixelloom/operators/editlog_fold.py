"""One undo stack over one or more edit logs (session, seq, op in edit / undo / redo, and the log that an edit goes to). Undo takes back the
last standing edit of whichever log, redo brings back the last one taken back, a new edit drops what could be redone.

A session is a list of edits and a place in it: what stands lies before the place, what can be redone behind it, so that each event moves
the place by one and costs the same however long the session is. Sessions are dealt by their key and read in order as a stream: of a
session, only the list is in memory, never its events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ship

class Stack:
    """Edits (log, seq) in order, and how many of them stand."""

    def __init__(self) -> None:
        self.entries: list[tuple[str | None, int]] = []
        self.standing = 0

    def apply(self, op: str, log: str | None, seq: int) -> tuple[str | None, int] | None:
        """The edit that an event adds, takes back or brings back; None if there is none."""
        if op == "edit":
            del self.entries[self.standing :]
            self.entries.append((log, seq))
            self.standing += 1
            return self.entries[-1]
        if op == "undo" and self.standing:
            self.standing -= 1
            return self.entries[self.standing]
        if op == "redo" and self.standing < len(self.entries):
            self.standing += 1
            return self.entries[self.standing - 1]
        return None


class _Replay:
    """(session, edits, undos, redos, standing, redoable, last_edit) of each session."""

    schema = "edits int, undos int, redos int, standing int, redoable int, last_edit long"

    def __init__(self, session) -> None:
        self.session, self.stack, self.counts = session, Stack(), {"edit": 0, "undo": 0, "redo": 0}

    def event(self, op: str, log: str | None, seq: int) -> None:
        self.counts[op] = self.counts.get(op, 0) + 1
        self.stack.apply(op, log, seq)

    def end(self) -> list[tuple]:
        s = self.stack
        return [(self.session, *(self.counts[k] for k in ("edit", "undo", "redo")), s.standing, len(s.entries) - s.standing, s.entries[s.standing - 1][1] if s.standing else None)]


class _Route:
    """(session, seq, op, log, edit_seq): where each event went, with no log where it had no effect."""

    schema = "seq long, op string, log string, edit_seq long"

    def __init__(self, session) -> None:
        self.session, self.stack, self.rows = session, Stack(), []

    def event(self, op: str, log: str | None, seq: int) -> None:
        self.rows.append((self.session, seq, op, *(self.stack.apply(op, log, seq) or (None, None))))

    def end(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _folded(log: DataFrame, kind: Callable, tag: str | None) -> DataFrame:
    events = log.select("session", "seq", "op", (F.col(tag) if tag else F.lit(None).cast("string")).alias("log"))
    schema = f"session {events.schema['session'].dataType.simpleString()}, {kind.schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, True
        for batch in batches:
            out = []
            for session, seq, op, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or session != now.session:
                    out += [] if first else now.end()
                    now, first = kind(session), False
                now.event(op, name, seq)
            if kind is _Route and now:
                out += now.end()
            yield _rows(out, names, batch.schema.field(0).type, kind)
        if now:
            yield _rows(now.end(), names, batch.schema.field(0).type, kind)

    return events.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, schema)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _rows(rows: list[tuple], names: list[str], session: pa.DataType, kind: Callable) -> pa.RecordBatch:
    types = [session, *(_TYPES[c.split()[1]] for c in kind.schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def replayed(log: DataFrame) -> DataFrame:
    """(session, edits, undos, redos, standing, redoable, last_edit): state after the last event of each session."""
    return _folded(log, _Replay, None)


def routed(log: DataFrame, tag: str = "log") -> DataFrame:
    """(session, seq, op, log, edit_seq) of every event: the log that it acted on, and the edit that it added, took back or brought back.
    An undo goes to the log of the last edit that stands, whatever its own tag says. Null where there was nothing to undo or redo."""
    return _folded(log, _Route, tag)


ship(__name__)
