"""Undo and redo on live edit logs, as keyed state that is written entry by entry. A session's state is its list of edits, one row for each
place, and the place that it has reached: an event reads and writes one place, however long the session is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..plans.shared import ship

#: Keyed state needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Undo(StatefulProcessor):
    def __init__(self, every: bool, session: str, keep_ms: int | None) -> None:
        self.every, self.session, self.keep = every, session, keep_ms

    def init(self, handle) -> None:
        own = () if self.keep is None else (self.keep,)
        self.entries = handle.getMapState("entries", "place int", "log string, seq long", *own)
        self.reached = handle.getValueState("reached", "standing int, total int", *own)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        standing, total = self.reached.get() if self.reached.exists() else (0, 0)
        out = []
        for seq, op, log in pd.concat(list(rows)).sort_values("seq")[["seq", "op", "log"]].itertuples(index=False):
            hit = None
            if op == "edit":
                hit = (log, int(seq))
                self.entries.updateValue((standing,), hit)
                standing += 1
                total = standing
            elif op == "undo" and standing:
                standing -= 1
                hit = self.entries.getValue((standing,))
            elif op == "redo" and standing < total:
                hit = self.entries.getValue((standing,))
                standing += 1
            out.append((key[0], int(seq), op, *(hit or (None, None))))
        self.reached.update((standing, total))
        if self.every:
            frame = pd.DataFrame(out, columns=[self.session, "seq", "op", "log", "edit_seq"])
            yield frame.astype({"edit_seq": "Int64"})
        else:
            last = self.entries.getValue((standing - 1,))[1] if standing else None
            yield pd.DataFrame({self.session: [key[0]], "standing": [standing], "redoable": [total - standing], "last_edit": pd.array([last], "Int64")})

    def close(self) -> None:
        pass


def _processed(events: DataFrame, every: bool, keep_ms: int | None) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = events.schema["session"].dataType.simpleString()
    schema = f"session {kind}, seq long, op string, log string, edit_seq long" if every else f"session {kind}, standing int, redoable int, last_edit long"
    grouped = events.groupBy("session")
    return grouped.transformWithStateInPandas(_Undo(every, "session", keep_ms), schema, "Append" if every else "Update", "None" if keep_ms is None else "ProcessingTime")


def replayed(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(session, standing, redoable, last_edit) after each trigger, of events (session, seq, op, log). Events of a trigger are taken in
    order; triggers must come in order, as a log's files do. keep_ms: how long a place is kept that is not written to again; with it the
    stream goes on for ever, as places can run out at any time."""
    return _processed(events, False, keep_ms)


def routed(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(session, seq, op, log, edit_seq) of each event, as operators.editlog_fold.routed: the log that it acted on, and the edit that it added,
    took back or brought back."""
    return _processed(events, True, keep_ms)


ship(__name__)
