"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is its UTF-8 bytes taken as the digits of a number, modulo four primes of 31 bits, next to its
length. A chunk acts on the fingerprint before it as x -> x * base^length + hash, so the hashes of chunks that were
worked on apart, anywhere, combine by length-shifted arithmetic. Texts of up to CHUNK characters are one chunk, hashed
where they are read; longer ones are cut, their chunks dealt out to all tasks, hashed in parallel and combined.

Equal fingerprints are candidates only. Their texts are compared chunk by chunk: equal chunks of one fingerprint and
number collapse where they are read, before anything is shuffled, so a group of any size sends one chunk a task; a
fingerprint with two different chunks at one number is a collision, and its texts are told apart as they are. Which
documents are read for that is told by a filter of FILTER_BITS bits over the shared fingerprints, a broadcast of fixed
size; what it lets through beyond them costs time and changes nothing.

Equal means equal after each run of ASCII white space is one space. Cases: null text counts as empty, and empty texts
equal one another; of repeated rows (one id and text) one stays, and each has a row in the result; rows without an id
come after all others, and one of a group that has no id at all stays; an empty table gives no rows; a very long text
is never held whole in Python; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.common import SPACE, Tables, fresh, small_batches, table

#: Code points of a chunk.
CHUNK = 1 << 16
PRIMES = (2**31 - 1, 2**31 - 19, 2**31 - 61, 2**31 - 69)
FILTER_BITS = 1 << 26
KEY = ["f1", "f2", "n_bytes"]
#: Bits of one value of bitmap_construct_agg.
BITMAP = 32_768


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def base_of(prime: int) -> int:
    return 2 + 1_103_515_245 % (prime - 3)


@cache
def powers(prime: int) -> np.ndarray:
    """base^k modulo a prime, from the highest k of a chunk down to 0."""
    out, base = np.ones(1, np.uint64), base_of(prime)
    while len(out) < 4 * CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[4 * CHUNK - 1 :: -1].copy()


def chunk_hash(chunk: bytes, primes: tuple[int, ...] = PRIMES) -> list[int]:
    """The hash of at most 4 * CHUNK bytes modulo each prime (sums stay under 2^57)."""
    digits = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return [int(powers(p)[4 * CHUNK - len(chunk) :] @ digits) % p for p in primes]


def packed(hashes: list) -> tuple:
    """Four residues as two whole numbers of 62 bits; fewer are filled up with zeros."""
    a, b, c, d = [*hashes, 0, 0, 0, 0][:4]
    return a * 2**31 + b, c * 2**31 + d


def short_prints(rows: DataFrame, primes: tuple[int, ...], shared: object = None) -> DataFrame:
    """(..., chunk) with the fingerprint of the chunk as f1, f2; with `shared`, only those that it may hold, with the chunk."""
    names = rows.columns if shared else rows.columns[:-1]
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes if n in names), "f1 long", "f2 long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared else None
        for batch in batches:
            prints = [packed(chunk_hash(x, primes)) for x in batch.column("chunk").cast(pa.binary()).to_pylist()]
            columns = [pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], names=[*names, "f1", "f2"])
            if bits is not None:
                at = columns[0].to_numpy() % FILTER_BITS
                out = out.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            yield out

    return rows.mapInArrow(run, schema)


def long_chunks(texts: DataFrame) -> DataFrame:
    """The chunks of long texts, dealt out to all tasks: (doc_id, text_sha256, n_bytes, number, chunk, copies)."""
    cut = texts.select("doc_id", "text_sha256", "n_bytes", F.posexplode(F.regexp_extract_all("chunk", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("number", "chunk"))
    return cut.groupBy("doc_id", "text_sha256", "n_bytes", "number", "chunk").agg(F.count("*").alias("copies"))


def long_prints(chunks: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, copies, f1, f2) of texts from their chunks, hashed apart and combined in order."""
    steps = [f"{c}{i}" for i in range(4) for c in "hg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for x in batch.column("chunk").cast(pa.binary()).to_pylist():
                hashes = chunk_hash(x, primes)
                pairs = [v for p, h in zip(primes, hashes, strict=True) for v in (h, pow(base_of(p), len(x), p))]
                parts.append(pairs + [0] * (8 - len(pairs)))
            names = [n for n in batch.schema.names if n != "chunk"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array([p[i] for p in parts], pa.int64()) for i in range(8)]], names=[*names, *steps])

    schema = ", ".join([*(f"{n} {t}" for n, t in chunks.dtypes if n != "chunk"), *(f"{s} long" for s in steps)])
    parts = chunks.mapInArrow(run, schema)
    ordered = F.array_sort(F.collect_list(F.struct("number", *steps)))
    none = F.struct(*[F.lit(0).cast("long").alias(f"h{i}") for i in range(4)])
    shifted = lambda acc, x: F.struct(*[((acc[f"h{i}"] * x[f"g{i}"] + x[f"h{i}"]) % (primes[i] if i < len(primes) else 1)).alias(f"h{i}") for i in range(4)])
    whole = parts.groupBy("doc_id", "text_sha256", "n_bytes", "copies").agg(F.aggregate(ordered, none, shifted).alias("h"))
    return whole.select("doc_id", "text_sha256", "n_bytes", "copies", (F.col("h.h0") * 2**31 + F.col("h.h1")).alias("f1"), (F.col("h.h2") * 2**31 + F.col("h.h3")).alias("f2"))


def texts_of(docs: DataFrame, id: str, text: str, long: bool) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, chunk) of the texts of one chunk, or of the longer ones (whole, as chunk)."""
    size = F.coalesce(F.length(text), F.lit(0))
    some = docs.filter(size > CHUNK if long else size <= CHUNK).select(F.col(id).cast("long").alias("doc_id"), normalised(text).alias("chunk"))
    return some.select("doc_id", F.sha2("chunk", 256).alias("text_sha256"), F.octet_length("chunk").cast("long").alias("n_bytes"), "chunk")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """(doc_id, text_sha256, f1, f2, n_bytes, copies) for every id and text; copies counts the rows that are alike in both."""
    short = short_prints(texts_of(docs, id, text, False), primes).withColumn("copies", F.lit(1).cast("long"))
    long = long_prints(long_chunks(texts_of(docs, id, text, True)), primes)
    both = short.select("doc_id", "text_sha256", *KEY, "copies").unionByName(long.select("doc_id", "text_sha256", *KEY, "copies"))
    return both.groupBy("doc_id", "text_sha256", *KEY).agg(F.sum("copies").alias("copies"))


def filter_of(shared: DataFrame) -> bytes:
    """FILTER_BITS bits, one set for each shared fingerprint: built by the tasks in pieces of 4 KB."""
    at = shared.select((F.col("f1") % FILTER_BITS).alias("at"))
    rows = at.groupBy(F.expr(f"at div {BITMAP}").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r.piece * BITMAP // 8 : (r.piece + 1) * BITMAP // 8] = r.bits
    return bytes(out)


def collisions(docs: DataFrame, prints: DataFrame, shared: DataFrame, id: str, text: str, primes: tuple[int, ...]) -> DataFrame:
    """The shared fingerprints (KEY) of texts that differ, by comparison chunk by chunk."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(shared))
    short = short_prints(texts_of(docs, id, text, False).select("n_bytes", "chunk"), primes, sent).select(*KEY, F.lit(0).alias("number"), "chunk")
    chunks = long_chunks(texts_of(docs, id, text, True))
    of_long = prints.join(shared.select(*KEY), KEY, "left_semi").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_"), "f1", "f2")
    long = chunks.join(of_long, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_sha256") == F.col("sha_"))).select(*KEY, "number", "chunk")
    different = short.unionByName(long).groupBy(*KEY, "number", "chunk").agg(F.count("*").alias("n"))
    return different.groupBy(*KEY, "number").agg(F.count("*").alias("n")).filter("n > 1").select(*KEY).distinct()


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row per document: doc_id, keep_id (least id of its group), group_size, kept, text_sha256."""
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession, "exact")
    prints = tables.write(fingerprints(docs, id, text, primes), "prints")
    shared = prints.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).filter("group_size > 1")
    shared = tables.write(shared, "shared")
    collided = tables.write(collisions(docs, prints, shared, id, text, primes), "collided")
    if collided.isEmpty():
        sizes = prints.join(shared, KEY, "left")
    else:
        # Texts of a collided fingerprint are their own keys.
        mark = collided.withColumn("collided", F.lit(True))
        shared = tables.write(shared.join(mark, KEY, "left"), "marked")
        marked = tables.write(prints.join(shared, KEY, "left"), "all")
        bad = marked.filter("collided").select("doc_id", "text_sha256", *KEY, "copies")
        whole = docs.select(F.col(id).cast("long").alias("id_"), normalised(text).alias("body")).withColumn("sha_", F.sha2("body", 256)).dropDuplicates(["id_", "sha_"])
        named = tables.write(bad.join(whole, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_sha256") == F.col("sha_"))).drop("id_", "sha_"), "bodies")
        own = named.groupBy(*KEY, "body").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
        columns = ["doc_id", "text_sha256", "copies", "keep_id", "group_size"]
        sizes = marked.filter("collided is null").select(columns).unionByName(named.join(own, [*KEY, "body"]).select(columns))
    alone = F.col("group_size").isNull()
    row = sizes.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", "copies").alias("group_size"), "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return row.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns; of repeated rows one, whichever its other columns are."""
    sha, other = fresh("sha", docs.columns), fresh("kept_id", docs.columns)
    kept = groups(docs, id, text).filter("kept").select(F.col("doc_id").alias(other), F.col("text_sha256").alias(f"{other}_sha"))
    named = docs.withColumn(sha, F.sha2(normalised(text), 256))
    found = named.join(kept, named[id].cast("long").eqNullSafe(kept[other]) & (named[sha] == kept[f"{other}_sha"]), "left_semi")
    return found.dropDuplicates([id, sha]).drop(sha)


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group of equal texts that stays."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH bodies AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
sized AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER (PARTITION BY body, doc_id) AS copy FROM bodies)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(body) AS text_sha256 FROM sized"""
