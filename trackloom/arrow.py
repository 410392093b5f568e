"""Arrow batches of one task cut into groups, so that a task holds one group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come ordered by integer keys, as one table for each run of equal keys; only that run is held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        begins = np.concatenate([[0], np.flatnonzero(change) + 1, [b.num_rows]])
        for at, end in zip(begins[:-1], begins[1:], strict=True):
            here = tuple(c[at] for c in cols)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(b.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def ordinals(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The place of each value in their order (bytes for text), equal values alike."""
    import pyarrow.compute as pc

    return pc.rank(values, tiebreaker="dense").to_numpy().astype(np.int64)
