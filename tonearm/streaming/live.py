"""Structured Streaming operators (ids M of the survey). State is bounded by watermarks of LATE, which batches do not need.

Each function takes a streaming (or a batch) DataFrame and returns one, so that the batch twin of a query is the same
code; only sinks and triggers differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonearm.functions.frames import together
from tonearm.functions.music import multiplier
from tonearm.sources.versions import Versions
from tonearm.streaming.backlog import Backlog
from tonearm.streaming.ordered import LATE, ROCKS, stepped


def read_table(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; files_per_trigger bounds a batch."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def live_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """M1: counts that are given again when they change (update mode)."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, ts: str, quiet: str = "1.5 seconds") -> DataFrame:
    """M4: bursts of events ended by so much quiet; one action for each."""
    late = events.withWatermark(ts, LATE) if events.isStreaming else events
    out = late.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(settings: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """M5: settings that differ from the one before, in order of time; a key's first value is no change."""
    kinds = dict(settings.dtypes)

    def step(k: tuple, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        out = []
        for at, v in rows:
            if state is not None and v != state[0]:
                out.append((*k, at, v))
            state = (v,)
        return out, state

    return stepped(settings, [key], ts, [value], step, f"last {kinds[value]}", f"{key} {kinds[key]}, {ts} {kinds[ts]}, {value} {kinds[value]}")


def attributed_skips(transitions: DataFrame, skips: DataFrame, after: str = "20 seconds") -> DataFrame:
    """M8: skips during a transition, or up to 20 s after it; stream-stream with watermarks, or a batch join.

    transitions: user, start, end, a, b, strategy; skips: user, at; further columns of both are kept. The interval bounds the state on both sides.
    """
    if transitions.isStreaming:
        transitions, skips = transitions.withWatermark("start", LATE), skips.withWatermark("at", LATE)
    t = transitions.withColumnRenamed("user", "t_user")
    inside = (F.col("user") == F.col("t_user")) & (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end") + F.expr(f"INTERVAL {after}"))
    kind = F.when(F.col("at") <= F.col("end"), "DURING").otherwise("JUST_AFTER")
    return t.join(skips, inside).withColumn("kind", kind).drop("t_user")


def once(reports: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """M9: each (a, b, strategy) once within the watermark."""
    if reports.isStreaming:
        return reports.withWatermark(ts, LATE).dropDuplicatesWithinWatermark(keys)
    return reports.groupBy(*keys).agg(F.min(ts).alias(ts))


def once_lru(reports: DataFrame, group: str, key: str, ts: str, most: int = 256) -> DataFrame:
    """M9, exact: in order of time, a report is dropped while its key is among the last `most` new keys of its group."""
    kinds = dict(reports.dtypes)

    def step(k: tuple, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        seen, out = dict.fromkeys(state[0] if state else ()), []
        for at, v in rows:
            if v not in seen:
                out.append((*k, v, at))
                seen[v] = None
                if len(seen) > most:
                    del seen[next(iter(seen))]
        return out, (list(seen),)

    return stepped(reports, [group], ts, [key], step, f"seen array<{kinds[key]}>", f"{group} {kinds[group]}, {key} {kinds[key]}, {ts} {kinds[ts]}")


def running_multipliers(ratings: DataFrame, keys: list[str], rating: str, implicit: str, reset: Column | None = None, ts: str | None = None) -> DataFrame:
    """Tallies and multipliers as ratings come. With `reset` (rows that clear what their key has learned) and `ts`, only what came after the last reset counts.

    A stream without resets is one running aggregation; with them each key's tallies are state that a reset clears.
    """
    soft = F.coalesce(F.col(implicit), F.lit(False))
    if reset is not None and ratings.isStreaming:
        return _with_resets(ratings.withColumns({"__soft": soft, "__reset": F.coalesce(reset, F.lit(False))}), keys, rating, ts)
    rows = ratings
    if reset is not None:
        last = ratings.filter(reset).groupBy(*keys).agg(F.max(ts).alias("__last"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        renamed = last.withColumnsRenamed({k: f"__{k}" for k in keys})
        rows = ratings.join(renamed, same, "left").filter(~F.coalesce(reset, F.lit(False)) & (F.col("__last").isNull() | (F.col(ts) > F.col("__last")))).drop("__last", *[f"__{k}" for k in keys])
    sums = rows.groupBy(*keys).agg(
        F.count_if(~soft).alias("n"), F.coalesce(F.sum(F.when(~soft, F.col(rating))), F.lit(0.0)).alias("sum"),
        F.count_if(soft).alias("implicit_n"), F.coalesce(F.sum(F.when(soft, F.col(rating))), F.lit(0.0)).alias("implicit_sum"),
    )
    return sums.withColumn("multiplier", multiplier(F.col("n"), F.col("sum"), F.col("implicit_n"), F.col("implicit_sum")))


def _with_resets(rows: DataFrame, keys: list[str], rating: str, ts: str) -> DataFrame:
    kinds = dict(rows.dtypes)

    def step(k: tuple, part: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        n, total, soft_n, soft_total = state or (0, 0.0, 0, 0.0)
        for _, reset, soft, value in part:
            if reset:
                n, total, soft_n, soft_total = 0, 0.0, 0, 0.0
            elif soft:
                soft_n, soft_total = soft_n + 1, soft_total + (value or 0.0)
            else:
                n, total = n + 1, total + (value or 0.0)
        state = (n, total, soft_n, soft_total)
        return [(*k, *state)], state

    tally = "n long, sum double, implicit_n long, implicit_sum double"
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + tally
    sums = stepped(rows.withColumn(rating, F.col(rating).cast("double")), keys, ts, ["__reset", "__soft", rating], step, tally, schema, "update")
    return sums.withColumn("multiplier", multiplier(F.col("n"), F.col("sum"), F.col("implicit_n"), F.col("implicit_sum")))


def combined(views: dict[str, tuple[DataFrame, str, str]], ts: str = "ts") -> DataFrame:
    """M2: the latest value of several live views side by side: (view, value, ts); views: name to (rows, value column, time column)."""
    rows = [df.select(F.lit(name).alias("view"), F.col(value).cast("string").alias("value"), F.col(at).alias(ts)) for name, (df, value, at) in views.items()]
    both = together(*rows)
    return both.groupBy("view").agg(F.max_by("value", F.struct(ts, "value")).alias("value"), F.max(ts).alias(ts))


def last_used(log: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """The latest value of each key."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def merging(path: str, keys: list[str], buckets: int = 64, sequence: str | None = None) -> Callable[[DataFrame, int], None]:
    """M2, M3: a foreachBatch function that merges each batch into a table of versions; of rows with one key the one with the greatest `sequence` stays (without one the later batch's).

    Readers take `Versions(spark, path, keys).read()`: all of a batch or nothing of it. A repeated batch changes nothing.
    """
    return lambda batch, number: Versions(batch.sparkSession, path, keys, sequence, buckets).merge(batch, number)


def working(path: str, key: str, analyse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int = 1000, tries: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts a batch in a durable queue and works on it round by round, `most` rows at a time; see `Backlog`."""
    return lambda batch, number: Backlog(batch.sparkSession, path, key, analyse, schema, most, tries).sink(batch, number)


def pruned(rows: DataFrame, ts: str, keep: str) -> DataFrame:
    """Rows no older than `keep` before the newest."""
    newest = rows.agg(F.max(ts).alias("__newest"))
    return rows.join(F.broadcast(newest), F.col(ts) >= F.col("__newest") - F.expr(f"INTERVAL {keep}"), "left_semi")


def drained(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """M3, M6: everything that is there now, then stop (available-now trigger). A query keeps the settings it began with: the state store is set for its start alone."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        conf.set(name, before)
