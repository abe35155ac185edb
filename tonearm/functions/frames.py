"""Helpers on whole DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tonearm-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Tables:
    """Written tables that cut lineage; they live in the shared folder, so a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Takes the files of written tables away (an empty table takes their place); none may be read after that."""
        for name in names:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}")


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1.2 takes a union of frames that are partitioned by one key for partitioned by it, also where adaptive
    execution has dealt their partitions differently, and leaves out the shuffle that a window by that key needs: its
    result is wrong then. This turns that off for the session; earlier versions ignore the setting.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def small_methods(spark: SparkSession) -> None:
    """Java does not compile methods over 8,000 bytes but interprets them, and a fused stage with many long expressions is one
    such method. With this limit Spark leaves such stages unfused, so that each expression is a method that Java compiles.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all cores by key, for rows that are few or short but mean much work: Spark sizes tasks by bytes, and
    would give all of a small file or shuffle to one of them. A stated number of partitions stays as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def together(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, columns by name, safe for windows and groupings that follow."""
    plain_unions(frames[0].sparkSession)
    return reduce(DataFrame.unionByName, frames)


def by_runs(df: DataFrame, keys: list[str], order: list[str], work: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """Groups worked on one after another in the tasks that hold them: one shuffle by key, one sort, batches streamed.

    For rules that are sequential within a group where groups are many and small: no call and no frame for each of them.
    `work` gets a group's columns as lists, in order, and gives rows.
    """
    return in_runs(df.repartition(*keys).sortWithinPartitions(*keys, *order), keys, work, schema)


def in_runs(dealt: DataFrame, keys: list[str], work: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """The same for rows that lie together by key and in order already, as those behind a sort within partitions by them do."""
    names = dealt.columns

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def solved(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            columns = {n: rows[n].tolist() for n in names}
            out, start = [], 0
            for end in ends:
                out += work({n: c[start:end] for n, c in columns.items()})
                start = end
            return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for k in keys:
                a, b = rows[k], rows[k].shift()
                new |= ((a != b) & ~(a.isna() & b.isna())).to_numpy()
            new[0] = False
            ends = np.flatnonzero(new)
            if len(ends):
                yield solved(rows.iloc[: ends[-1]], ends)
            held = rows.iloc[ends[-1] if len(ends) else 0 :].reset_index(drop=True)
        if held is not None and len(held):
            yield solved(held, np.array([len(held)]))

    return dealt.mapInPandas(stream, schema)
