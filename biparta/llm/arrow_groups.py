"""Small helpers for tasks that read Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of one part of a batch.
PART_BYTES = 4_000_000


def parts(b: pa.RecordBatch, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts and binaries hold about ``limit`` bytes; a row is never cut."""
    size = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > at:
            yield b.slice(at, end - at)


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal key values; the input is sorted by them. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(k)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            last = key
    if held:
        yield pa.Table.from_batches(held)

