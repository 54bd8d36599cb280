"""Per-key state of event streams in Spark's own state store.

A stateful query writes the keys that a micro-batch changed, below its batch number: a batch
that is run again after a failure replaces its own rows, and the current state is the last
row of each key. State, offsets and changes lie in one folder; a query that is started
again with that folder goes on where it stopped.

Rows of a hot key are reduced inside each Arrow batch before the shuffle, where the operator
lets them be.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Stateful processors need the state store that keeps its rows on disk.
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "__batch"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store on disk."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ON_DISK)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(query_writer, checkpoint: str) -> None:
    """Run a stream writer until all available input is done."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, folder: str, mode: str = "update", after: Callable[[int], None] | None = None, split_by: tuple[str, ...] = ()) -> DataFrame:
    """Write every micro-batch of ``stream`` below its number and return all of them with ``__batch``.

    ``after(batch_id)`` is called when the rows of a batch are written.
    """
    spark, path = stream.sparkSession, f"{folder}/batches"
    # a stream without any row still has a table
    spark.createDataFrame([], stream.schema).write.mode("overwrite").partitionBy(*split_by).parquet(f"{path}/{BATCH}=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*split_by).parquet(f"{path}/{BATCH}={batch_id}")
        if after:
            after(batch_id)

    with disk_state(spark):
        run_available(stream.writeStream.outputMode(mode).foreachBatch(step), f"{folder}/checkpoint")
    return read_batches(spark, folder, stream.schema)


def read_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(BATCH, LongType())).parquet(f"{folder}/batches")


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key."""
    fields = [c for c in changes.columns if c not in (*keys, BATCH)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(BATCH)).alias("s"))
    return last.select(*keys, *[F.col("s").getField(f).alias(f) for f in fields])


def state_of(spark: SparkSession, folder: str, batch_id: int | None = None) -> DataFrame:
    """State of a query as its store holds it after a batch (the last one if not named): ``key, value``."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    with disk_state(spark):
        return reader.load(f"{folder}/checkpoint").select("key", "value")


DECAYED = "id bigint, last_ts double, state double, n bigint"


def partial_sums(rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``id, ts, value`` to one decayed sum per id and Arrow batch; a missing value counts as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            ts, value = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            last = np.full(len(ids), -np.inf)
            np.maximum.at(last, at, ts)
            state = np.bincount(at, np.nan_to_num(value) * np.exp(-rate * (last[at] - ts)), len(ids))
            columns = [pa.array(ids, pa.int64()), pa.array(last), pa.array(state), pa.array(np.bincount(at, minlength=len(ids)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "last_ts", "state", "n"])

    return run


class DecayedSum(StatefulProcessor):
    """Merges partial sums into a key's sum at its last time."""

    def __init__(self, rate: float):
        self.rate = rate

    def init(self, handle) -> None:
        self.total = handle.getValueState("total", "last_ts double, state double, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        last, state, n = self.total.get() if self.total.exists() else (-math.inf, 0.0, 0)
        for part in rows:
            end = max(last, float(part["last_ts"].max()))
            fresh = part["state"] * np.exp(-self.rate * (end - part["last_ts"]))
            state = state * math.exp(-self.rate * (end - last)) + float(fresh.sum())
            last, n = end, n + int(part["n"].sum())
        self.total.update((last, state, n))
        yield pd.DataFrame({"id": [key[0]], "last_ts": [last], "state": [state], "n": [n]})

    def close(self) -> None:
        pass


class LateRows(StatefulProcessor):
    """Marks rows older than the last time of their key in earlier micro-batches."""

    def __init__(self, time: str, flag: str):
        self.time, self.flag = time, flag

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "last_ts double")

    def handleInputRows(self, key, rows, timerValues):
        known = self.last.get()[0] if self.last.exists() else None
        newest = known
        for row in rows:
            at = row[self.time]
            late = key[0] is not None and at is not None and known is not None and at < known
            if at is not None and (newest is None or at > newest):
                newest = at
            yield Row(**row.asDict(), **{self.flag: late})
        if newest is not None:
            self.last.update((float(newest),))

    def close(self) -> None:
        pass


def newest_first(keys: list[str], order: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last ``k`` rows per key of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([(c, "ascending") for c in keys] + [(c, "descending") for c in order])
            codes = [t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in keys]
            fresh = np.ones(t.num_rows, bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            place = np.arange(t.num_rows)
            turn = place - np.maximum.accumulate(np.where(fresh, place, 0))
            yield from t.filter(pa.array(turn < k)).to_batches()

    return run


class LastRows(StatefulProcessor):
    """A list of a key's last ``k`` rows."""

    def __init__(self, schema: str, keys: list[str], order: list[str], k: int):
        self.schema, self.keys, self.order, self.k = schema, keys, order, k

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        names = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        places = [names.index(o) for o in self.order]
        # rows without a value come last
        age = lambda row: tuple((row[p] is not None, row[p]) for p in places)
        old = list(self.kept.get()) if self.kept.exists() else []
        kept = [tuple(r) for r in heapq.nlargest(self.k, chain(old, rows), key=age)]
        self.kept.put(kept)
        yield Row(**dict(zip(self.keys, key, strict=True)), rows=[Row(**dict(zip(names, r, strict=True))) for r in kept])

    def close(self) -> None:
        pass


def packed_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, time, order`` to one row per id and Arrow batch, with lists of both."""
    for b in batches:
        ids, ts, order = (b.column(i).to_numpy() for i in range(3))
        by = np.argsort(ids, kind="stable")
        known, first = np.unique(ids[by], return_index=True)
        cuts = pa.array(np.append(first, len(ids)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x[by])) for x in (ts, order)]
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), *lists], names=["id", "times", "orders"])


MONITOR = "id bigint, n bigint, last_ts double, goes_back bigint, repeats bigint"


class OrderMonitor(StatefulProcessor):
    """Counts a key's steps back in time against all that came before, and repeated times of a batch."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n bigint, last_ts double, goes_back bigint, repeats bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        n, last, back, repeats = self.seen.get() if self.seen.exists() else (0, -math.inf, 0, 0)
        times, orders = [], []
        for part in rows:
            times += [np.asarray(x, float) for x in part["times"]]
            orders += [np.asarray(x, np.int64) for x in part["orders"]]
        ts = np.concatenate(times)[np.argsort(np.concatenate(orders), kind="stable")]
        before = np.maximum.accumulate(np.append(last, ts))
        n, back, repeats = n + len(ts), back + int((ts < before[:-1]).sum()), repeats + len(ts) - len(np.unique(ts))
        last = float(before[-1])
        self.seen.update((n, last, back, repeats))
        yield pd.DataFrame({"id": [key[0]], "n": [n], "last_ts": [last], "goes_back": [back], "repeats": [repeats]})

    def close(self) -> None:
        pass
