"""A durable work queue: rows that wait, are claimed, done or have failed, in a table of versions.

Each trigger offers its rows and then works; a round claims at most `most` rows (fewest tries first), analyses them and
writes what came of each, and rounds go on until nothing waits, so a limit spreads work over rounds and never loses
any. A claim counts as a try before the work begins: a round that dies is found as claimed rows and taken up again, and
a row that kills its worker ends as failed after `tries`. All steps are numbered merges, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.sources.versions import Versions

OWN = ("status", "tries", "error", "offered", "step")


class Backlog:
    """`analyse` gets frames of the offered columns and gives rows of `schema`: the key, results, and `error` (null for good ones)."""

    def __init__(self, spark: SparkSession, path: str, key: str, analyse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int = 1000, tries: int = 3, buckets: int = 64):
        self.spark, self.key, self.analyse, self.schema, self.most, self.tries = spark, key, analyse, schema, most, tries
        self.table = Versions(spark, path, [key], "step", buckets)
        self.results = [f for f in T.StructType.fromDDL(schema).fields if f.name not in (key, "error")]

    def step(self) -> int:
        return self.table.manifest()[1] + 1

    def offer(self, rows: DataFrame, number: int) -> None:
        """Rows of batch `number`; keys that are known already keep what they have."""
        if taken := {c.lower() for c in rows.columns} & {*OWN, *(f.name.lower() for f in self.results)}:
            raise ValueError(f"columns of the queue's own: {sorted(taken)}")
        step, known = self.step(), self.table.read()
        new = rows.dropDuplicates([self.key])
        if known is not None:
            if not known.filter(F.col("offered") >= number).isEmpty():
                return  # a replay
            new = new.join(known.select(self.key), self.key, "left_anti")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in self.results}
        self.table.merge(new.withColumns(empty | {"status": F.lit("waiting"), "tries": F.lit(0), "error": F.lit(None).cast("string"), "offered": F.lit(number).cast("long"), "step": F.lit(step).cast("long")}), step)

    def work(self) -> int:
        """One round; gives the number of rows that it claimed."""
        known = self.table.read()
        if known is None:
            return 0
        step = self.step()
        tired = known.filter((F.col("status") == "claimed") & (F.col("tries") >= self.tries))
        open_ = known.filter(F.col("status").isin("waiting", "claimed") & (F.col("tries") < self.tries)).orderBy("tries", "offered", self.key).limit(self.most)
        claimed = open_.withColumns({"status": F.lit("claimed"), "tries": F.col("tries") + 1, "step": F.lit(step).cast("long")})
        dead = tired.withColumns({"status": F.lit("failed"), "error": F.coalesce("error", F.lit("its worker died")), "step": F.lit(step).cast("long")})
        self.table.merge(claimed.unionByName(dead), step)
        mine = self.table.read().filter((F.col("step") == step) & (F.col("status") == "claimed"))
        n = mine.count()
        if n:
            names = [f.name for f in self.results]
            done = mine.drop(*names, *OWN).mapInPandas(self.analyse, self.schema).withColumnRenamed("error", "problem").withColumn("came", F.lit(True))
            both = mine.drop(*names).join(done, self.key, "left")
            problem = F.when(F.col("came").isNull(), F.lit("no result")).otherwise(F.col("problem"))
            status = F.when(problem.isNull(), "done").when(F.col("tries") >= self.tries, "failed").otherwise("waiting")
            self.table.merge(both.withColumns({"error": problem, "status": status, "step": F.lit(step + 1).cast("long")}).drop("problem", "came"), step + 1)
        return n

    def sink(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: everything that is offered is worked on, however small a round."""
        self.offer(batch, number)
        while self.work():
            pass

    def progress(self) -> DataFrame:
        """(status, n, tries) so far."""
        return self.table.read().groupBy("status").agg(F.count("*").alias("n"), F.sum("tries").alias("tries"))
