"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment.

A passage is a benchmark text, or each overlapping window of it where it is long. A document holds a passage of m
characters if some part of the document is within k = m * budget edits of it. Then both share at least
m + 1 - q - k q character q-grams, and the places of these lie on at most k + 1 neighbouring diagonals. So the grams
of a text that occur in any passage are found first, stretches with too few of them are left, the others' hits are
counted in overlapping bands of 2 (k + 1) diagonals, and bands that meet the bound are aligned in full.
Letters count in lower case and white-space characters as spaces; places are those of the text.

Passages go to the tasks in blocks of at most BLOCK_CHARS characters. A benchmark of one block is one pass over the
documents; a larger one is searched block by block, each block's finds written by text digest before the next block is
read, and all finds joined to the documents at the end: no more than one block is in the driver or a task at a time.

Finds never reach over two texts of a batch, so they don't hang on which rows stand next to one another.

Cases: a null or short text holds nothing; passages shorter than `least` or null are left out; those under Q characters
(with a lower `least`) are searched for literally, and those under 16 are found as they are only (their edit budget is
0), so such an item marks every text that holds it; an empty benchmark marks nothing; repeated rows are marked each,
repeated passages once for each item; a very long text costs its length; ties between regions are all given, in order;
other columns stay as they are, but for the named output, which replaces a column of that name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.common import Tables, fresh, small_batches, table

Q = 8
WINDOW = 128
BUDGET = 0.08
BLOCK_CHARS = 2_000_000
#: Characters between the texts of a batch: more than any stretch that is aligned, so no find reaches over two texts.
GAP = 2 * WINDOW
#: A multiple of all widths that half a band may have.
STEP = math.lcm(*range(1, int(WINDOW * BUDGET) + 2))
SLOTS = 1 << 20
#: Characters that a passage must have.
LEAST = Q
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
REGION = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits")])
REGION_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")]))


def codes_of(text: str) -> np.ndarray:
    """A text's code points in lower case (ASCII only where others would change the length), white space as space."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(ASCII_LOWER)
    codes = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    return np.where(codes - np.uint32(9) < 5, np.uint32(32), codes)


def shown(text: str) -> str:
    """The text that codes_of() gives the code points of."""
    return codes_of(text).astype("<u4").tobytes().decode("utf-32-le")


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place, by doubling (Q is a power of two)."""
    h, width, factor = codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while width < Q:
        h = h[:-width] * np.uint64(factor) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        factor = (factor * factor + 2) % 2**64
        width *= 2
    return h * np.uint64(0xFF51AFD7ED558CCD)


class Passages:
    """The passages of one block of benchmark texts and the index of their grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item: list[int] = []
        self.codes: list[np.ndarray] = []
        self.short = [(item, shown(text)) for item, text in items if 0 < len(text) < Q]
        for item, text in items:
            codes = codes_of(text)
            n = len(codes)
            if n < Q:
                continue
            for at in [0] if n <= WINDOW else sorted({*range(0, n - WINDOW, WINDOW // 2), n - WINDOW}):
                self.item.append(item)
                self.codes.append(codes[at : at + WINDOW])
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.minimum((self.m * BUDGET).astype(np.int64), (self.m - Q) // Q)  # the bound stays 1 or more
        self.least = self.m + 1 - Q - self.k * Q
        if self.item:
            self.reach, self.bound = int((self.m + self.k).max()), int(self.least.min())
            all_grams = np.concatenate([grams(c) for c in self.codes])
            order = np.argsort(all_grams, kind="stable")
            self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
            self.passage = np.repeat(np.arange(len(self.m)), self.m - Q + 1)[order]
            self.offset = np.concatenate([np.arange(n - Q + 1) for n in self.m])[order]
            self.slots = np.zeros(SLOTS, bool)
            self.slots[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the (item, start, end, edits) of the passages that it holds, as if it were alone.

        The texts are laid out with GAP borders between them: bands and stretches are shorter, so each is of one text.
        """
        out: list[list] = [[] for _ in texts]
        for item, short in self.short:
            for found, text in zip(out, texts, strict=True):
                plain, at = shown(text), -1
                while (at := plain.find(short, at + 1)) >= 0:
                    found.append((item, at, at + len(short), 0))
        if not self.item:
            return [sorted(set(x)) for x in out]
        border = np.full(GAP, 0xFFFFFFFF, np.uint32)
        parts = [x for t in texts for x in (codes_of(t), border)]
        starts = np.cumsum([0] + [len(t) + GAP for t in texts])
        codes = np.concatenate(parts)
        if len(codes) < Q:
            return [sorted(set(x)) for x in out]
        h = grams(codes)
        near = np.flatnonzero(self.slots[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.grams, h[near])
        at[at == len(self.grams)] = 0
        known = self.grams[at] == h[near]
        places, at = near[known], at[known]
        if len(places) < self.bound:
            return [sorted(set(x)) for x in out]
        # Stretches that have as many hits as the least bound within the longest reach.
        ahead = places[self.bound - 1 :] - places[: len(places) - self.bound + 1] < self.reach
        dense = np.zeros(len(places) + 1, np.int32)
        runs = np.flatnonzero(ahead)
        np.add.at(dense, runs, 1)
        np.add.at(dense, runs + self.bound, -1)
        dense = np.cumsum(dense[:-1]) > 0
        places, at = places[dense], at[dense]
        if not len(places):
            return [sorted(set(x)) for x in out]
        counts = self.count[at]
        hits = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        passage = self.passage[hits]
        # Diagonals of a text start at a multiple of all band widths, so its bands are the same wherever it lies.
        doc = np.searchsorted(starts, places, "right") - 1
        lines = np.cumsum([STEP, *(-(-(np.diff(starts) + GAP) // STEP) * STEP)])
        diagonal = np.repeat(places - starts[doc] + lines[doc], counts) - self.offset[hits] + WINDOW

        def place(line: np.ndarray, width: np.ndarray) -> np.ndarray:
            """Where in the codes a diagonal starts; `width` is how far below a text's first one it may be."""
            d = np.searchsorted(lines, line + width, "right") - 1
            return line - lines[d] + starts[d] - WINDOW

        # Passages that stand there as they are: all their grams on one diagonal.
        exact, n = np.unique((passage << 40) | diagonal, return_counts=True)
        exact = exact[n >= self.m[exact >> 40] + 1 - Q]
        for key in exact:
            p, at = int(key >> 40), int(place(key & ((1 << 40) - 1), 0))
            if at >= 0 and np.array_equal(codes[at : at + self.m[p]], self.codes[p]):
                doc = int(np.searchsorted(starts, at, "right")) - 1
                out[doc].append((self.item[p], int(at - starts[doc]), int(at + self.m[p] - starts[doc]), 0))
        # All others: the hits in overlapping bands of diagonals.
        band = diagonal // (self.k[passage] + 1)
        keys = np.concatenate([(passage << 40) | band, (passage << 40) | (band - 1)])
        keys, n = np.unique(keys, return_counts=True)
        passage, band = keys >> 40, keys & ((1 << 40) - 1)
        low = band * (self.k[passage] + 1)
        within = np.append(exact, np.iinfo(np.int64).max)[np.searchsorted(exact, (passage << 40) | low)] < ((passage << 40) | (low + 2 * self.k[passage] + 2))
        full = (n >= self.least[passage]) & ~within
        passage = passage[full]
        low = place(low[full], self.k[passage] + 1)
        for m, k in sorted(set(zip(self.m[passage].tolist(), self.k[passage].tolist(), strict=True))):
            alike = np.flatnonzero((self.m[passage] == m) & (self.k[passage] == k))
            edits = self.align(codes, m, k, np.stack([self.codes[p] for p in passage[alike]]), low[alike])
            for i, e in zip(alike[edits <= k], edits[edits <= k], strict=True):
                lo, hi = int(low[i]) - (k + 1), int(low[i]) + m + 3 * (k + 1)  # all that was aligned
                doc = int(np.searchsorted(starts, hi - 1, "right")) - 1  # the one text that the stretch reaches
                if doc < len(texts):
                    out[doc].append((self.item[passage[i]], int(max(0, lo - starts[doc])), int(min(len(texts[doc]), hi - starts[doc])), int(e)))
        return [sorted(set(x)) for x in out]

    def align(self, codes: np.ndarray, m: int, k: int, patterns: np.ndarray, lows: np.ndarray) -> np.ndarray:
        """The least edits between each passage (a row) and a part of the codes that starts on its band's diagonals; row by row, all bands at once."""
        width = 4 * k + 4  # the band of 2 (k + 1) diagonals, k + 1 more on either side
        columns = np.arange(width)
        places = lows[:, None] - (k + 1) + columns[None, :]
        least = np.zeros(places.shape, np.int64)
        for i in range(m):
            x = places + i
            inside = (x >= 0) & (x < len(codes))
            cost = (codes[np.where(inside, x, 0)] != patterns[:, i : i + 1]) | ~inside
            step = least + cost
            step[:, :-1] = np.minimum(step[:, :-1], least[:, 1:] + 1)  # a character of the passage is missing
            least = np.minimum.accumulate(step - columns, axis=1) + columns  # characters of the text are too many
        return least.min(axis=1)


def passages_of(benchmark: DataFrame, item: str = "item_id", passage: str = "text", least: int = LEAST) -> DataFrame:
    """(item, passage): the distinct texts of a benchmark, or their overlapping windows where they are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t[at : at + WINDOW]) for i, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for at in ([0] if len(t) <= WINDOW else sorted({*range(0, len(t) - WINDOW, WINDOW // 2), len(t) - WINDOW}))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["item", "passage"])

    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(passage).alias("passage")).filter(F.col("item").isNotNull() & (F.length("passage") >= max(1, least)))
    return items.mapInArrow(run, "item long, passage string").distinct()


def finder(rows: list[tuple[int, str]], spark: SparkSession, text: str, names: list[str], added: str, hits_only: bool) -> tuple[Broadcast, Callable]:
    """A function over batches that adds the regions of one block's passages to the named columns; the block is broadcast."""
    sent = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(sent.value)
        for batch in batches:
            found = passages.find([x or "" for x in batch.column(text).to_pylist()])
            regions = pa.array([[dict(zip(("item_id", "start", "end", "edits"), r, strict=True)) for r in x] for x in found], REGION_ARROW)
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], regions], names=[*names, added])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_())) if hits_only else out

    return sent, run


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "regions", item: str = "item_id", passage: str = "text", least: int = LEAST) -> DataFrame:
    """docs with an array of (item_id, start, end, edits): the benchmark passages that a text holds, region by region."""
    spark = docs.sparkSession
    small_batches(spark)
    passages = passages_of(benchmark, item, passage, least)
    chars = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    docs = docs.drop(out)
    if not chars:
        return docs.withColumn(out, F.array().cast(T.ArrayType(REGION)))
    name = fresh("regions", docs.columns)
    added = T.StructField(name, T.ArrayType(REGION))
    if chars <= BLOCK_CHARS:
        _, run = finder([tuple(r) for r in passages.collect()], spark, text, docs.columns, name, False)
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, added])).withColumnRenamed(name, out)
    tables, blocks = Tables(spark, "decontaminate"), -(-chars // BLOCK_CHARS)
    passages = tables.write(passages, "passages")
    part = lambda: F.pmod(F.xxhash64("item", "passage"), F.lit(blocks))
    while passages.groupBy(part().alias("block")).agg(F.sum(F.length("passage")).alias("n")).agg(F.max("n")).first()[0] > max(BLOCK_CHARS, WINDOW):
        blocks *= 2
    texts = docs.select(F.sha2(text, 256).alias("digest"), F.col(text).alias("whole")).filter("whole is not null")
    for block in range(blocks):
        rows = [tuple(r) for r in passages.filter(part() == block).collect()]  # at most BLOCK_CHARS characters
        sent, run = finder(rows, spark, "whole", ["digest"], name, True)
        marks = tables.write(texts.mapInArrow(run, T.StructType([T.StructField("digest", T.StringType()), added])), "marks", "append")
        sent.destroy()
    found = marks.select("digest", F.explode(name).alias("region")).groupBy("digest").agg(F.array_sort(F.collect_set("region")).alias(name))
    key = fresh("digest", docs.columns)
    joined = docs.withColumn(key, F.sha2(text, 256)).join(found.withColumnRenamed("digest", key), key, "left")
    return joined.select(*[joined[f"`{c}`"] for c in docs.columns], F.coalesce(name, F.array().cast(T.ArrayType(REGION))).alias(out))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, with their own columns."""
    out = fresh("regions", docs.columns)
    return mark(docs, benchmark, text, out).filter(F.size(out) == 0).drop(out)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark passages that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        (F.size("regions") > 0).alias("contaminated"),
        F.size("regions").cast("long").alias("n_regions"),
        F.array_sort(F.array_distinct("regions.item_id")).alias("item_ids"),
        "regions",
    )
