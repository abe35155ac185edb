"""Keyed state in event order: one step function for streams and batches.

A step gets a key, its rows in order of time and the key's state, and gives its output rows and the new state. In a
stream with a timestamp the rows of a key wait in list state until the watermark has passed them, so a result hangs
neither on the order of arrival nor on triggers or Arrow batches; a timer at the newest row of each trigger wakes them.
A stream whose order is no timestamp has no watermark: all rows of a trigger are put in order together. A batch is one
sort, walked through with the state carried along.

Rows of one time are ordered by their other columns, nulls first. Rows behind the watermark are dropped, as everywhere
in Structured Streaming. The state store must be RocksDB (`live.drained` sees to that; elsewhere set
spark.sql.streaming.stateStore.providerClass before the query starts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 hour"
#: (key, rows in order, state or None) to (output rows, state); rows and state are tuples.
Step = Callable[[tuple, list[tuple], tuple | None], tuple[list[tuple], tuple]]


def in_order(row: tuple) -> list[tuple]:
    return [(x is not None, x) for x in row]


class InOrder(StatefulProcessor):
    """Rows are (time, others...), after the time in milliseconds where `wait` holds them until the watermark has passed it."""

    def __init__(self, columns: list[str], schema: T.StructType, state: str, step: Step, out: list[str], wait: bool):
        self.columns, self.schema, self.kind, self.step, self.out, self.wait = columns, schema, state, step, out, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.kind)
        if self.wait:
            self.rows = handle.getListState("rows", self.schema)  # milliseconds first

    def worked(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        out, state = self.step(tuple(key), sorted(rows, key=in_order), tuple(self.held.get()) if self.held.exists() else None)
        self.held.update(state)
        for row in out:
            yield Row(**dict(zip(self.out, row, strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if not self.wait:
            yield from self.worked(key, new)
            return
        new = [r for r in new if r[0] is not None]
        if new:
            self.rows.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for r in self.rows.get():
            (due if r[0] <= passed else rest).append(tuple(r))
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        if due:
            yield from self.worked(key, [r[1:] for r in due])

    def close(self) -> None:
        pass


def stepped(df: DataFrame, keys: list[str], ts: str, values: list[str], step: Step, state: str, schema: str, mode: str = "append", late: str = LATE) -> DataFrame:
    """The output of `step` over the rows (ts, *values) of each key in order of time; `schema` is that of its rows."""
    columns = [ts, *values]
    rows = df.select(*keys, *columns)
    out = [f.name for f in T.StructType.fromDDL(schema).fields]
    if not df.isStreaming:
        return replayed(rows, keys, columns, step, schema, mode)
    wait = isinstance(df.schema[ts].dataType, T.TimestampType)
    watched = rows
    if wait:
        columns = ["at_ms", *columns]
        watched = rows.withColumn("at_ms", F.unix_millis(ts)).withWatermark(ts, late)
    processor = InOrder(columns, T.StructType([watched.schema[c] for c in columns]), state, step, out, wait)
    return watched.groupBy(*keys).transformWithState(processor, schema, mode, "eventTime" if wait else "none")


def replayed(rows: DataFrame, keys: list[str], columns: list[str], step: Step, schema: str, mode: str) -> DataFrame:
    """A batch: one shuffle by key and one sort; a key's rows come in pieces with its state between them, so none is held whole.

    In update mode the last output row of a key counts.
    """
    fields = T.StructType.fromDDL(schema).fields
    names, target = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, None, []
        for batch in batches:
            found = list(zip(*[batch.column(c).to_pylist() for c in [*keys, *columns]], strict=True))
            out: list[tuple] = []
            start = 0
            for i in range(1, len(found) + 1):
                if i < len(found) and found[i][: len(keys)] == found[start][: len(keys)]:
                    continue
                if found[start][: len(keys)] != key:
                    out += last
                    key, state, last = found[start][: len(keys)], None, []
                given, state = step(key, [r[len(keys) :] for r in found[start:i]], state)
                if mode == "update":
                    last = given[-1:] or last
                else:
                    out += given
                start = i
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], target[i]) for i in range(len(names))], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], target[i]) for i in range(len(names))], names=names)

    return dealt.mapInArrow(run, schema)

