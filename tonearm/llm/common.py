"""Shared helpers: tables by folder, written tables in the cluster's shared folder, batch sizes, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.frames import Tables as Tables  # for the operators, as the helpers below

#: ASCII white space as a Java class body: what separates words in the quality and duplicate operators.
SPACE = r"\x20\x09-\x0D"
#: Rows a Python task takes from Arrow at once: texts may be long, so few.
BATCH_ROWS = 256
#: Elements that running() appends to one array, and characters of a block of text.
RUN, BLOCK = 256, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no other has, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session: plans are lazy, so the setting must outlive the call.

    It bounds memory where texts are long, and no result of the library hangs on it.
    """
    if 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        return
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is (lower() would fold other scripts as well)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative op along an array of whole numbers (0 or more), one for each element.

    Arrays grow within chunks only, so the cost is in proportion to the length.
    """
    none = F.expr("cast(array() as array<int>)")
    along = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x))))
    chunk = lambda v: lambda i: along(F.slice(v, i * RUN + 1, F.lit(RUN)))
    shifted = lambda ahead: lambda part, i: F.transform(part, lambda x: op(F.coalesce(F.get(ahead, i - 1), F.lit(0)), x))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), chunk(v))
        joined = let(parts, lambda p: let(along(F.transform(p, lambda x: F.element_at(x, -1))), lambda ahead: F.flatten(F.transform(p, shifted(ahead)))))
        return F.when(F.size(v) <= RUN, along(v)).otherwise(joined)

    return let(values, whole)


def spans_of(text: Column, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern: array of (start, end, match), code points, end exclusive.

    split() gives the texts between the matches, regexp_extract_all() the matches; their lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda gap, x: F.length(gap) + F.length(x))
        return F.zip_with(m, running(steps, lambda a, b: a + b), lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("found")))

    return let(found, placed)


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK characters, for `cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in blocks: only the blocks that hold them are gone through."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.slice(blocks, first + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(held, ""), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def strings(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts as Python strings, null as empty."""
    for batch in batches:
        yield batch, [x or "" for x in batch.column(column).to_pylist()]
