"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join, links confirmed on full sets.

A signature has slots of 16 bits. It is split into chunks of four slots; with m chunks, two signatures that differ in
fewer than 2 m slots have, by pigeonhole, a chunk with at most one differing slot, so enumerating each chunk's four
one-slot errors (keys of the other three slots) meets every pair under that distance. The distance threshold is
2 m - 1 slots, so all pairs under it meet, without exception; m is the least for which two sets at the similarity
threshold are over it with a chance of at most MISS.

Groups of copies stay small work: equal sets are one class from the start; within a key's bucket every class is
compared with the bucket's least class only, and links are confirmed on the full shingle sets and joined to
components. Buckets that still hold several components are then searched without loss by prefix filtering: two sets
over the threshold share a token among their first ones in any fixed order, so only classes of different components
that share such a token, at places where the threshold can still be met, and whose parity bitmaps allow it, are
compared. These filters are exact: they only leave out pairs that cannot meet the threshold. No cap, no all-pairs bucket.
This completion is beside the index, for the pairs within a bucket that its least class is not linked with; `links`
gives the links of either.

Cases: a null or wordless text has no shingles and is linked with nothing; fewer words than a shingle count as one
shingle; rows with a null id are linked with nothing and kept; repeated rows share their component, and all of them
are kept or none; empty tables give empty tables; other columns are not looked at. Ids are whole numbers. Ties between
copies go to the least id. A very long text costs its length, and its set (eight bytes a shingle) must fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.common import Tables, small_batches, table
from tonearm.llm.components import components

CHUNK = 4
#: Chance that two sets at the similarity threshold differ in more slots than the index allows.
MISS = 1e-6
#: Rows whose token counts are sampled to learn which tokens are frequent; they only choose the order of the prefix filter.
ORDER_SAMPLE = 2000
ORDER_SLOTS = 1 << 20
PARITIES = 32
MASK = np.uint64(0xFFFF)


class WordHashes(dict):
    """Word to 64-bit hash, remembered; it starts anew beyond a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
    return np.unique(out)


def plan_of(percent: int) -> tuple[int, int]:
    """Chunks m, and the slots 2 m - 1 in which signatures may differ: the fewest that a pair at the threshold keeps to but for MISS."""
    differ, chunks = 1 - percent / 100, 2

    def over(m: int) -> float:
        return sum(math.comb(m * CHUNK, k) * differ**k * (1 - differ) ** (m * CHUNK - k) for k in range(2 * m, m * CHUNK + 1))

    while over(chunks) > MISS:
        chunks += 1
    return chunks, 2 * chunks - 1


def signature(tokens: np.ndarray, slots: int) -> bytes:
    rng = np.random.default_rng(20_011)
    flips = rng.integers(0, 2**63, slots, dtype=np.uint64)
    factors = rng.integers(0, 2**63, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = (tokens[at : at + 4096][None, :] ^ flips[:, None]) * factors[:, None]
        best = np.minimum(best, (part ^ (part >> np.uint64(29))).min(axis=1))
    return (mix(best) & MASK).astype("<u2").tobytes()


def signatures(docs: DataFrame, size: int, slots: int) -> DataFrame:
    """docs (id, text) to (id, n, key, sig): set size, 128-bit digest of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(x, size, hashes) for x in batch.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            sigs = pa.array([signature(s, slots) if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, keys, sigs], names=["id", "n", "key", "sig"])

    return docs.mapInArrow(run, "id long, n long, key binary, sig binary")


def index_keys(classes: DataFrame, chunks: int) -> DataFrame:
    """(rep, sig) to (bucket, rep): for every chunk and every slot that may be wrong, the key of the other slots.

    A key is 48 bits of one chunk and slot, so that it says which signatures agree on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(reps), chunks, CHUNK).astype(np.uint64)
            for c in range(chunks):
                for wrong in range(CHUNK):
                    rest = [s for s in range(CHUNK) if s != wrong]
                    packed = np.full(len(reps), 0, np.uint64)
                    for s in rest:
                        packed = (packed << np.uint64(16)) | sigs[:, c, s]
                    bucket = mix(packed ^ mix(np.uint64([c * CHUNK + wrong + 1]))[0])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(reps)], names=["bucket", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


def near_signatures(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, sig_a, sig_b) to the (a, b) whose signatures differ in at most so many slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((left != right).sum(axis=1) <= most))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, text, key) to (rep, tokens): sorted 64-bit tokens, where the text's set is the one asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(x, size, hashes).tobytes() for x in batch.column(1).to_pylist()]
            right = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "tokens"]).filter(pa.array(right, pa.bool_()))

    return docs.select("rep", "text", "key").mapInArrow(run, "rep long, tokens binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) to those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(t.as_buffer(), np.uint64) for t in (left, right))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                if len(x) > len(y):
                    x, y = y, x
                places = np.searchsorted(y, x)
                places[places == len(y)] = 0
                both = int((y[places] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return with_b.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def frequent_tokens(sets: DataFrame) -> bytes:
    """One bit for each of ORDER_SLOTS token slots: is it frequent in a sample of at most ORDER_SAMPLE sets?

    Fixed in size (128 KB). It only orders tokens, so neither the sample nor a clash changes a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(batch.column(0).to_pylist())
            slots, counts = np.unique(np.frombuffer(found, np.uint64) % np.uint64(ORDER_SLOTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["slot", "n"])

    chosen = sets.select("rep").orderBy(F.xxhash64("rep")).limit(ORDER_SAMPLE)  # ids only; the sets follow by a join
    sample = sets.join(F.broadcast(chosen), "rep").select("tokens")
    rows = sample.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n >= 8").select("slot").collect()
    bits = np.zeros(ORDER_SLOTS, bool)
    bits[[r[0] for r in rows]] = True
    return np.packbits(bits).tobytes()


def parities(tokens: np.ndarray, rows: int) -> np.ndarray:
    """PARITIES longs of 64 parities each, repeated for so many rows."""
    slots = 64 * PARITIES
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % slots, minlength=slots) & 1
    return np.repeat(np.packbits(odd.astype(np.uint8)).view(np.int64)[:, None], rows, axis=1)


def prefixes(sets: DataFrame, percent: int, frequent: bytes) -> DataFrame:
    """(rep, label, tokens) to (token, rep, label, n, at): the first tokens in the order (frequent, hash), enough to meet any partner.

    p0 to p31 are the parities of the tokens' counts in 2048 slots: two sets differ in at least as many tokens as parities.
    """

    names = ["token", "rep", "label", "n", "at", *[f"p{i}" for i in range(PARITIES)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for rep, label, buffer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = np.frombuffer(buffer, np.uint64)
                n = len(tokens)
                first = n - (percent * n + 99) // 100 + 1
                order = np.lexsort((tokens, bits[tokens % np.uint64(ORDER_SLOTS)]))[:first]
                for column, values in zip(out, (tokens[order].view(np.int64), np.full(len(order), rep), np.full(len(order), label), np.full(len(order), n), np.arange(len(order)), *parities(tokens, len(order))), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)

    return sets.select("rep", "label", "tokens").mapInArrow(run, ", ".join(f"{n} long" for n in names))


class Links(NamedTuple):
    """Written tables: signatures (id, n, key, sig), classes of equal sets (key, rep, sig), confirmed links (a, b) that the
    index met, those that the completion of open buckets added, and components (label, least) by representatives."""

    tables: Tables
    signatures: DataFrame
    classes: DataFrame
    indexed: DataFrame
    completed: DataFrame
    own: DataFrame
    joined: DataFrame


def links(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> Links:
    """The links of near-duplicates between class representatives, and what they join."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "minhash")
    chunks, most = plan_of(percent)
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sigs = tables.write(signatures(texts, shingle, chunks * CHUNK), "signatures")
    real = sigs.filter("n > 0 and id is not null")
    classes = tables.write(real.groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")

    keys = index_keys(classes, chunks)
    leaders = tables.write(keys.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1").drop("size"), "leaders")
    shared = tables.write(keys.join(leaders, "bucket"), "shared")
    star = shared.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    sig_of = lambda c: classes.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    pairs = tables.write(near_signatures(star.join(sig_of("b"), "b").join(sig_of("a"), "a"), most), "pairs")
    needed = shared.select("rep").distinct().join(classes.select("rep", "key"), "rep")
    # Repeated rows give a set once: below, tokens are told apart by which sets hold them.
    sets = tables.write(full_sets(texts.withColumnRenamed("id", "rep").join(needed, "rep"), shingle).dropDuplicates(["rep"]), "sets")
    indexed = tables.write(confirmed(pairs, sets, percent), "links")
    labels = components(indexed, tables, "first")

    # Buckets with several components: search them without loss.
    own = labels.select(F.col("node").alias("rep"), "label")
    located = tables.write(shared.select("bucket", "rep").join(own, "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label")), "located")
    open_ = tables.write(located.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket"), "open")
    left = located.join(open_, "bucket", "left_semi").select("rep", "label").distinct()
    left = tables.write(left.join(sets, "rep").select("rep", "label", "tokens"), "left")
    first = tables.write(prefixes(left, percent, frequent_tokens(left)), "prefixes")
    # Tokens that stand in the same prefixes lead to the same pairs: the first of them, in the order of all, is enough,
    # as a pair's first common token is the first of those that stand in the same prefixes as it does.
    held = first.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2"), F.min_by("at", "rep").alias("at")
    )
    mixed = tables.write(held.filter("low < high").groupBy("n", "h1", "h2").agg(F.min_by("token", "at").alias("token")).select("token"), "mixed")
    first = tables.write(first.join(mixed, "token", "left_semi"), "candidates")
    x, y = first.alias("x"), first.alias("y")
    differ = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(PARITIES))
    may = F.expr(f"x.label < y.label and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {100 + percent} * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n) and {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & may).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = tables.write(confirmed(rest, sets, percent), "more")
    ends = more.join(own.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a", "left").join(own.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), tables, "second")

    return Links(tables, sigs, classes, indexed, more, own, joined.select(F.col("node").alias("label"), F.col("label").alias("least")))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the least id that links reach), kept (id = component_id)."""
    tables, sigs, classes, _, _, own, joined = links(docs, id, text, shingle, percent)
    reached = classes.select("key", "rep").join(own, "rep", "left").select("key", F.coalesce("label", "rep").alias("label")).join(joined, "label", "left")
    reached = tables.write(reached.select("key", F.coalesce("least", "label").alias("component_id")), "reached")
    tables.drop("shared", "located", "sets", "left", "prefixes", "candidates")  # the large ones; none is read from here on
    linked = sigs.select("id", "n", "key").join(reached, "key", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return linked.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
