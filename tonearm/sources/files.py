"""Sources and sinks: file listings, fingerprints, JSON documents, CSV and JSON reports (ids A7-A16 of the survey)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tonearm.functions.frames import together

HEAD, TAIL = 1 << 20, 1 << 16


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """Path, length and time of files at any depth; contents are not read, as their column is pruned."""
    globs = "*.{" + ",".join(sorted({*extensions, *(e.upper() for e in extensions)})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    return files.select("path", "length", "modificationTime").dropDuplicates(["path"])


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 over size, time, the first MiB and the last 64 KiB of each file (binaryFile rows)."""
    head = F.substring(F.col("content"), 1, HEAD)
    tail = F.expr(f"substring(content, greatest(1, length(content) - {TAIL - 1}), {TAIL})")
    wide = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))  # eight bytes, the highest first
    mark = F.concat(wide(F.col("length")), wide(F.unix_millis("modificationTime")), head, tail)
    return files.select("path", F.sha2(mark, 256).alias("fingerprint"))


def content_hash(samples: DataFrame, key: str, i: str, x: str, stride: int) -> DataFrame:
    """Hash of every stride-th sample, quantised to 16 bits, in order."""
    q = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(x))) * 32767 + 0.5).cast("int")
    picked = samples.filter(F.col(i) % stride == 0).select(key, F.struct(F.col(i).alias("i"), q.alias("q")).alias("s"))
    ordered = picked.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return ordered.select(key, F.sha2(F.array_join(F.transform("s", lambda s: s["q"].cast("string")), ","), 256).alias("hash"))


def analysed(sources: DataFrame, cache: DataFrame, keys: list[str], analyse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Cached analyses by key, the misses analysed by the function given, both together."""
    hits = sources.select(*keys).join(cache, keys)
    misses = sources.join(cache.select(*keys), keys, "left_anti")
    return together(hits, misses.mapInPandas(analyse, hits.schema))


def read_documents(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """JSON documents, one file each, gzip or plain; corrupt ones are misses, and so are those whose key is not their file's name (without endings) or, as `write_documents` lays them out, their folder's by digest."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    whole = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = raw.select("file", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    folder = F.regexp_extract("file", r"/document=([0-9a-f]+)/[^/]*$", 1)
    stem = F.url_decode(F.regexp_extract("file", r"([^/]*?)(?:\.json)?(?:\.gz)?$", 1))
    own = F.col(f"d.{key}").cast("string")
    good = parsed.filter(F.col("d._corrupt").isNull() & F.when(folder != "", F.sha1(own) == folder).otherwise(own == stem))
    return good.select(*[F.col(f"d.{f.name}") for f in schema.fields])


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """Every row as a JSON document in a gzip file of its own, in a folder named by its key's SHA-1; a key that is there is replaced, all others stay.

    Rows without a key are left out; of rows with one key the one whose text is the greatest is written.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns]))
    rows = documents.filter(F.col(key).isNotNull()).groupBy(F.sha1(F.col(key).cast("string")).alias("document")).agg(F.max(text).alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").option("lineSep", " ").partitionBy("document").text(path)


def report_rows(values: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per report, a value and a verdict column for each metric id; the ids are given, so no extra pass."""
    wide = values.groupBy(*keys).pivot("metric", metrics).agg(F.first("value").alias("value"), F.first("verdict").alias("verdict"))
    return wide


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows as JSON text; numbers that are not finite are null."""
    fine = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*fine), {"ignoreNullFields": "false"}).alias("json"))


def score_matrix(best: DataFrame) -> DataFrame:
    """(a, b, strategy, score) in order, to be written as CSV."""
    return best.select("a", "b", "strategy", F.round("score", 4).alias("score")).orderBy("a", "b")
