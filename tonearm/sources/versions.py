"""Tables in versions: a merge writes new files beside the old ones and is made visible by one manifest file.

Rows lie in buckets by a hash of their keys. A version is a manifest of one row a bucket, which says in what folder
that bucket's rows are; a merge writes the buckets it touches into folders of its own and then the manifest, a single
file that Spark's committer puts in place by one rename. A reader takes the newest manifest, so it sees all of a merge
or nothing of it; files of a merge that stopped are never looked at and are overwritten when it is run again. Each
manifest carries the number of the last batch that is in it: a batch that is replayed changes nothing.

Of rows with one key the one with the greatest sequence stays, wherever it comes from; of equal sequences the later
batch's, within a batch that with the greater hash. Columns that come later are null in earlier rows, columns that a
batch lacks are null in its rows. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Versions:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], sequence: str | None = None, buckets: int = BUCKETS):
        """`sequence` orders the rows of a key; without one a later batch wins."""
        self.spark, self.path, self.keys, self.sequence, self.buckets = spark, path.rstrip("/"), keys, sequence, buckets

    def manifest(self) -> tuple[int, int, dict[int, str]]:
        """(version, last batch, folder by bucket) of the newest version; version 0 has nothing."""
        try:
            every = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return 0, -1, {}
            raise
        rows = every.filter(F.col("version") == every.agg(F.max("version")).first()[0]).collect()  # a row a bucket
        return rows[0].version, rows[0].batch, {r.bucket: r.folder for r in rows if r.bucket >= 0}

    def read(self) -> DataFrame | None:
        """The newest version; nothing before the first."""
        folders = self.manifest()[2]
        return self.of(sorted(folders.values())) if folders else None

    def of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, batch: DataFrame, number: int) -> None:
        """One batch in one step; `number` grows from batch to batch, a number that is in already is passed over."""
        version, last, folders = self.manifest()
        if number <= last:
            return
        version += 1
        names = {n.lower() for n in batch.columns}
        bucket, place = (next(c for c in (f"{n}{'_' * i}" for i in range(99)) if c.lower() not in names) for n in ("bucket", "place"))
        at = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        staged = f"{self.path}/data/version={version}"
        batch.withColumn(bucket, at).write.mode("overwrite").parquet(f"{staged}/new")  # read twice below
        new = self.spark.read.parquet(f"{staged}/new")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # `buckets` at most
        known = [folders[b] for b in touched if b in folders]
        rows = new.drop(bucket).withColumn(place, F.lit(1))
        if known:
            rows = self.of(sorted(known)).withColumn(place, F.lit(0)).unionByName(rows, allowMissingColumns=True)
        order = [*([F.col(self.sequence)] if self.sequence else []), F.col(place), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != place])
        best = rows.groupBy(*self.keys).agg(F.max_by(row, F.struct(*order)).alias(place)).select(f"{place}.*")
        best.withColumn(bucket, at).write.mode("overwrite").partitionBy(bucket).parquet(f"{staged}/rows")
        folders |= {b: f"data/version={version}/rows/{bucket}={b}" for b in touched}
        self.commit(version, number, folders)

    def commit(self, version: int, batch: int, folders: dict[int, str]) -> None:
        rows = [(version, batch, b, f) for b, f in sorted(folders.items())] or [(version, batch, -1, "")]
        one = self.spark.createDataFrame(rows, "version int, batch long, bucket int, folder string").coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.path}/manifest/at={version}")
