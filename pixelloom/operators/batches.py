"""Arrow batches of sorted rows, cut where a group ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from ..plans.shared import ship


def whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """The columns of rows that are sorted by a key, and where each group begins, some whole groups at a time: what goes on in the next
    batch is held over, so that a task keeps a batch and a group."""
    held: list[pa.RecordBatch] = []

    def columns() -> tuple[dict[str, np.ndarray], np.ndarray]:
        table = pa.Table.from_batches(held)
        found = {c: table.column(c).to_numpy() for c in table.column_names}
        return found, np.flatnonzero(np.append(True, np.logical_or.reduce([found[c][1:] != found[c][:-1] for c in key])))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            found, begin = columns()
            if len(begin) > 1:
                yield {c: v[: begin[-1]] for c, v in found.items()}, begin[:-1]
                held = pa.Table.from_batches(held).slice(int(begin[-1])).to_batches()
    if held:
        yield columns()


ship(__name__)
