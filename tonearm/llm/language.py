"""Language identification with a bit-sliced Bloom filter over character n-grams.

Every slot of the filter is a bitmask of languages; the AND of an n-gram's slots gives all languages that (may) hold
it, in one look-up for all languages. Of a text, each language's hits are counted, corrected for the chance that a
filter as full as the language's says yes to anything, and the largest corrected share decides.

A language's n-grams are those that make up at least RARE of its own and whose share is at least DISTINCT times the
largest share in any language; they are counted in Spark over a bounded, hashed sample of labelled texts.

Cases: a null text, or one without a letter, is `und` with score 0; a text without a known n-gram gets the language
of most training texts with score 0; ties go to the first language by name; labels that are null teach nothing, and
without labels all is `und`; repeated rows are judged each; empty tables give empty tables; other columns stay, but for columns
of the outputs' names, which the outputs replace. A very long text costs its length, and all of it is read. Any number
of languages: each 64 of them take one more mask for a slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.common import small_batches, table

SIZES = (1, 2, 3, 4)
#: Parts that a language's texts are dealt to by hash, and the texts of each part that the filter is fitted on at most.
PARTS, PART_TEXTS = 256, 8
RARE, DISTINCT = 2e-5, 0.2
#: Slots (one byte each for up to 8 languages) and slots per n-gram.
SLOTS, HASHES = 1 << 20, 3
#: Languages of one mask.
MASK = 64
BREAK = np.uint32(32)


def codes_of(text: str) -> np.ndarray:
    """Lower-case letters, with everything else as a space and spaces in a row as one."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    known = np.unique(codes)
    letter = np.array([chr(c).isalpha() for c in known])
    codes = np.where(letter[np.searchsorted(known, codes)], codes, BREAK)
    return codes[np.append(True, (codes[1:] != BREAK) | (codes[:-1] != BREAK))]


def grams_of(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of SIZES but the bare space."""
    out, wide = [], codes.astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for size in range(1, max(SIZES) + 1):
        h = (h[: len(wide) - size + 1] + wide[size - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if size in SIZES:
            out.append((h if size > 1 else h[codes != BREAK]) * np.uint64(0xFF51AFD7ED558CCD) ^ np.uint64(size))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    """HASHES slots of each n-gram, from disjoint or mixed bits of its hash."""
    return [((grams * np.uint64(factor)) >> np.uint64(44)).astype(np.int64) for factor in (1, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)[:HASHES]]


@dataclass(frozen=True)
class Filter:
    languages: tuple[str, ...]
    masks: tuple[bytes, ...]  # for each MASK languages, SLOTS masks
    widths: tuple[str, ...]  # their types
    false: tuple[float, ...]  # chance of a false yes for each language
    usual: int  # the language of most training texts

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """How many n-grams each language holds: popcounts by language, from how often each mask occurs."""
        slots, out = slots_of(grams), []
        for block, width in zip(self.masks, self.widths, strict=True):
            masks = np.frombuffer(block, width)
            found = masks[slots[0]]
            for s in slots[1:]:
                found = found & masks[s]
            values, counts = np.unique(found, return_counts=True)
            bits = (values[:, None] >> np.arange(8 * values.itemsize, dtype=width)[None, :]) & values.dtype.type(1)
            out.append((bits * counts[:, None]).sum(axis=0)[:MASK])
        return np.concatenate(out)[: len(self.languages)]

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        false = np.array(self.false)
        for text in texts:
            codes = codes_of(text or "")
            if not self.languages or not (codes != BREAK).any():
                names.append("und")
                scores.append(0.0)
                continue
            grams = grams_of(codes)
            hits = self.hits(grams)
            true = np.maximum(0.0, (hits - len(grams) * false) / (1 - false))
            best = int(np.argmax(true))
            if true[best] <= 0:
                names.append(self.languages[self.usual])
                scores.append(0.0)
            else:
                names.append(self.languages[best])
                scores.append(float(min(1.0, true[best] / len(grams))))
        return names, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filter:
    """A filter from labelled texts: n-grams are counted by language in Spark, those a language keeps set its bit."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = tuple(sorted(counts))
    widths = tuple(next(w for w, n in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if len(languages) - at <= n or n == MASK) for at in range(0, len(languages), MASK))
    if not languages:
        return Filter((), (), (), (), 0)
    # Only hashes are ranked, in parts of each language, so that no task ranks a whole one; copies of a text count once.
    hashed = rows.withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h")
    ranked = hashed.select("lang", "h").distinct().withColumn("place", F.row_number().over(order))
    chosen = ranked.filter(F.col("place") <= PART_TEXTS).select("lang", "h")  # at most PARTS times PART_TEXTS for each language
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = np.array(batch.column(0).to_pylist(), object)
            for name in np.unique(langs.astype(str)):
                grams, n = np.unique(np.concatenate([grams_of(codes_of(t)) for t in texts[langs == name]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    shares = grams.join(F.broadcast(totals), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    of_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("held"))  # an entry for each language
    good = F.filter("held", lambda x: (x["share"] >= RARE) & (x["share"] >= DISTINCT * F.col("top")))
    kept = of_gram.select("gram", F.explode(good).alias("x")).select("gram", "x.lang").toArrow()  # at most 1 / RARE n-grams for each language, whatever the corpus
    at = np.searchsorted(np.array(languages, object), np.array(kept["lang"].to_pylist(), object)) if len(kept) else np.zeros(0, np.int64)
    slots = slots_of(kept["gram"].to_numpy().view(np.uint64))
    blocks, fill = [], []
    for k, width in enumerate(widths):
        masks = np.zeros(SLOTS, width)
        own = at // MASK == k
        for s in slots:
            np.bitwise_or.at(masks, s[own], np.left_shift(masks.dtype.type(1), (at[own] % MASK).astype(width)))
        blocks.append(masks.tobytes())
        fill += [float(((masks >> masks.dtype.type(i)) & masks.dtype.type(1)).mean()) for i in range(min(MASK, len(languages) - k * MASK))]
    usual = max(range(len(languages)), key=lambda i: (counts[languages[i]], -i))
    return Filter(languages, tuple(blocks), widths, tuple(f**HASHES for f in fill), usual)


def identify(docs: DataFrame, model: Filter, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of a text and its score (corrected share of n-grams known to it)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(lang, score)
    sent = spark.sparkContext.broadcast(model)  # SLOTS bytes or a few times that
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.decide(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the filter is fitted on those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
