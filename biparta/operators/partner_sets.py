"""Sets of numbered members.

A set has a row per bucket of BITS members (a batch of Arrow rows may cut one in two). Its container lists the
places of its members in the bucket, 16 bits each, or is a bitmap where that is shorter: small sets cost what
they hold, and no container is larger than a bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 8 * 4096
MAP_BYTES = BITS // 8


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def partner_sets(placed: DataFrame, owner: str) -> DataFrame:
    """``(owner, bucket, items)`` from distinct rows ``(owner, bit)``; owners that are null have none."""
    rows = placed.filter(F.col(owner).isNotNull()).select(owner, F.floor(F.col("bit") / BITS).alias("bucket"), F.pmod("bit", F.lit(BITS)).cast("int").alias("place"))
    schema = T.StructType([rows.schema[owner], rows.schema["bucket"], T.StructField("items", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first = np.flatnonzero(_starts([b.column(0), b.column(1)]))
            place = b.column(2).to_numpy(zero_copy_only=False).astype("<u2")
            items = []
            for lo, hi in zip(first, [*first[1:], len(place)], strict=True):
                if 2 * (hi - lo) < MAP_BYTES:
                    items.append(place[lo:hi].tobytes())
                else:
                    flags = np.zeros(BITS, bool)
                    flags[place[lo:hi]] = True
                    items.append(np.packbits(flags).tobytes())
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _binary(items)], names=schema.names)

    return rows.repartition(owner, "bucket").sortWithinPartitions(owner, "bucket", "place").mapInArrow(run, schema)
