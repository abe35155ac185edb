"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

Postings are built in a single pass. A task numbers and counts the terms of the documents it reads in memory; at
BLOCK_BYTES they are spilled as a run: sorted by language, hash shard and term, with postings by source, a block of
BLOCK_TERMS terms a row. A shard's blocks arrive ordered by their first term; a heap merges
those that are open, so each term's counts in all runs come together and its frequencies are summed. Terms in fewer
than `least` documents end there. What a shard holds open is at most its own blocks; there are as many shards as
shuffle partitions.

A pair of sources differs by the sum over all kept terms of abs(p - q). Terms that neither has give one value each,
those that one has are summed from the sorted rates of that source (running sums, looked up at the other's rate of a
missing term); postings then are streamed once for corrections of the pairs that share a term, summed in the task in
square tables of TILE sources before anything is shuffled. Nothing is as wide as sources times terms.

All arithmetic is exact: rates by long division in base 1000, good for counts to 9 * 10^15.

Cases: null text, language or source counts as ''; a source without terms has rates like any other; a language without
kept terms has pairs of value 0 and no terms; a source that is alone in its language has no pairs; ties rank by the
item's UTF-8 bytes; repeated rows count each; a very long text is read in pieces of PIECE bytes; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm.common import Tables, small_batches, table

#: The same as [^\x00-\x40\x5B-\x60\x7B-\x7F]+ on characters: ASCII letters and everything beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5
#: Bytes of memory that make a block full: by TERM_BYTES a term and TOKEN_BYTES a term of a document.
BLOCK_BYTES, TERM_BYTES, TOKEN_BYTES = 160_000_000, 160, 40
BLOCK_TERMS = 512
PIECE = 1 << 20
TILE = 512
BLOCK = "shard int, lang string, first binary, terms array<binary>, dfs array<long>, ends array<int>, names array<string>, sources array<int>, counts array<long>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, piece by piece; pieces end where a term does."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = TERM.match(text, end)
            end = cut.end() if cut else end
        yield TERM.findall(text[at:end].lower())  # bytes: A-Z only
        at = end


class Part:
    """One language of a block: terms by number, and each document's distinct terms with their counts."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.sources: dict[str, int] = {}
        self.docs: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, source: str, text: bytes) -> None:
        ids = [np.fromiter(map(self.terms.__getitem__, terms), np.int32, len(terms)) for terms in terms_of(text)]
        terms, counts = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.docs.append((self.sources.setdefault(source, len(self.sources)), terms, counts))
        self.tokens += len(terms)

    def rows(self, lang: str, shards: int) -> Iterator[pa.RecordBatch]:
        """A run in order of shard and term: a row for at most BLOCK_TERMS terms of one shard."""
        if not self.terms:
            return
        terms, names = pa.array(self.terms, pa.binary()), np.array(list(self.sources), object)
        ordered = pc.array_sort_indices(terms).to_numpy()
        shard = np.fromiter(map(zlib.crc32, self.terms), np.uint32, len(terms))[ordered] % shards
        by_shard = np.argsort(shard, kind="stable")
        ordered, shard = ordered[by_shard], shard[by_shard]
        place = np.empty(len(terms), np.int64)
        place[ordered] = np.arange(len(terms))
        at = place[np.concatenate([t for _, t, _ in self.docs])]
        dfs = np.bincount(at, minlength=len(terms))
        keys = at * len(names) + np.repeat([s for s, _, _ in self.docs], [len(t) for _, t, _ in self.docs])
        by_key = np.argsort(keys)
        keys, first = np.unique(keys[by_key], return_index=True)
        counts = np.add.reduceat(np.concatenate([c for _, _, c in self.docs])[by_key], first)
        at, sources = keys // len(names), keys % len(names)
        ends = np.cumsum(np.bincount(at, minlength=len(terms)))
        new = np.flatnonzero(np.diff(shard)) + 1
        cuts = [c for lo, hi in zip([0, *new], [*new, len(terms)], strict=True) for c in range(lo, hi, BLOCK_TERMS)] + [len(terms)]
        ordered_terms = terms.take(pa.array(ordered))
        for lo in range(0, len(cuts) - 1, 1024):
            some = cuts[lo : lo + 1025]
            spans = [(0 if a == 0 else int(ends[a - 1]), int(ends[b - 1])) for a, b in itertools.pairwise(some)]
            local = [np.unique(sources[x:y], return_inverse=True) for x, y in spans]
            lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(np.asarray(offsets) - offsets[0], pa.int32()), values)
            x, y = spans[0][0], spans[-1][1]
            offsets = [x, *(e for _, e in spans)]
            columns = [
                pa.array(shard[some[:-1]], pa.int32()), pa.array([lang] * len(spans)), ordered_terms.take(pa.array(some[:-1])), lists(ordered_terms[some[0] : some[-1]], some), lists(pa.array(dfs[some[0] : some[-1]], pa.int64()), some),
                lists(pa.array(np.concatenate([ends[a:b] - s for (s, _), (a, b) in zip(spans, itertools.pairwise(some), strict=True)]), pa.int32()), some),
                pa.array([names[u].tolist() for u, _ in local], pa.list_(pa.string())), lists(pa.array(np.concatenate([i for _, i in local]), pa.int32()), offsets), lists(pa.array(counts[x:y], pa.int64()), offsets),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK.split(", ")])


class Block:
    """Postings of all languages until memory is full."""

    def __init__(self) -> None:
        self.parts: dict[str, Part] = defaultdict(Part)
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        part = self.parts[lang]
        terms, tokens = len(part.terms), part.tokens
        part.add(source, text)
        self.bytes += (len(part.terms) - terms) * TERM_BYTES + (part.tokens - tokens) * TOKEN_BYTES

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        for lang, part in self.parts.items():
            yield from part.rows(lang, shards)


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """docs (text, lang, source) to the blocks of all runs."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for text, lang, source in zip(*[batch.column(n) for n in ("text", "lang", "source")], strict=True):
                block.add(lang.as_py(), source.as_py(), text.as_py())
                if block.bytes >= BLOCK_BYTES:
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    empty = F.lit("")
    return docs.select(F.coalesce("text", empty).cast("binary").alias("text"), F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).mapInArrow(index, BLOCK)


class Opened:
    """A block that the merge has begun: its terms, and their postings as arrays until they are asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        held = {n: batch.column(n)[i].values for n in ("terms", "dfs", "ends", "names", "sources", "counts")}
        self.terms = held["terms"].to_pylist()
        self.dfs, self.ends = (held[n].to_numpy().tolist() for n in ("dfs", "ends"))
        self.held, self.lists = held, None

    def postings(self, at: int) -> Iterator[tuple[str, int]]:
        if self.lists is None:
            names = np.array(self.held["names"].to_pylist(), object)
            self.lists = names[self.held["sources"].to_numpy()].tolist(), self.held["counts"].to_numpy().tolist()
        sources, counts = self.lists
        span = slice(self.ends[at - 1] if at else 0, self.ends[at])
        return zip(sources[span], counts[span], strict=True)


def merged(blocks: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
    """(lang, term, documents, counts by source) of the terms in `least` documents, of blocks ordered by shard, language and first term.

    A heap holds the place in every open block; a term is whole once the next block begins after it.
    """
    heap: list[tuple[bytes, int]] = []
    opened: dict[int, tuple[Opened, int]] = {}
    current, number = None, 0

    def before(first: bytes | None) -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
        while heap and (first is None or heap[0][0] < first):
            term, df, parts = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                n = heap[0][1]
                block, at = opened[n]
                df += block.dfs[at]
                parts.append((block, at))
                if at + 1 < len(block.terms):
                    opened[n] = block, at + 1
                    heapq.heapreplace(heap, (block.terms[at + 1], n))
                else:
                    heapq.heappop(heap)
                    del opened[n]
            if df >= least:
                counts: dict[str, int] = defaultdict(int)
                for block, at in parts:
                    for source, count in block.postings(at):
                        counts[source] += count
                yield current[1], term, df, counts

    for batch in blocks:
        for i, (shard, lang, first) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("shard", "lang", "first")], strict=True)):
            if (shard, lang) != current:
                yield from before(None)
                current = shard, lang
            yield from before(first)
            opened[number] = Opened(batch, i), 0
            heapq.heappush(heap, (first, number))
            number += 1
    yield from before(None)


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, sources, counts): the terms in at least `least` documents of a language, with their counts."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs(docs, shards).repartitionById(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for lang, term, _, counts in merged(batches, least):
            out.append({"lang": lang, "term": term.decode(), "total": sum(counts.values()), "sources": list(counts), "counts": list(counts.values())})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(merge, "lang string, term string, total long, sources array<string>, counts array<long>")


def rate(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / whole), exactly: long division, three digits at a time."""
    rest, out = count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return out + 1


def rated(docs: DataFrame, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(lang, source, n, v, p0) of every group, p0 the rate of a missing term; (lang, term, source, p, p0, q) of every posting."""
    kept = tables.write(postings(docs, least), "postings")
    each = kept.select("lang", "term", "total", F.inline(F.arrays_zip("sources", "counts"))).withColumnsRenamed({"sources": "source", "counts": "count"})
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n").alias("n"), zero("v").alias("v"), zero("all").alias("all"))
    whole = F.nullif(F.col("n") + SMOOTH * F.col("v"), F.lit(0))
    groups = tables.write(groups.withColumn("whole", whole).withColumn("p0", zero(rate(F.lit(0).cast("long"), F.col("whole")))), "groups")
    p = each.join(groups, ["lang", "source"]).withColumn("p", rate(F.col("count"), F.col("whole"))).withColumn("q", rate(F.col("total"), F.col("all") + SMOOTH * F.col("v")))
    return groups, tables.write(p.select("lang", "term", "source", "p", "p0", "q"), "rates")


def one_sided(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b: what the terms that neither or only one of two sources has add, taking all terms of each for its own.

    The rates of a source and the rates of a missing term in all others, in one order: running sums up to each of the latter.
    """
    two = groups.select("lang", "source", "p0", "v").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("at")), "lang").filter("source <> item")
    nothing = F.when(F.col("source") < F.col("item"), F.col("v") * F.abs(F.col("p0") - F.col("at"))).otherwise(F.lit(0).cast("long"))
    asked = two.select("lang", "source", "item", "at", "p0", nothing.alias("nothing"), F.lit(0).cast("long").alias("n"))
    known = rates.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("n")).select("lang", "source", F.lit(None).cast("string").alias("item"), "at", F.lit(None).cast("long").alias("p0"), F.lit(0).cast("long").alias("nothing"), "n")
    one = Window.partitionBy("lang", "source")
    upto = one.orderBy("at")  # rows of one rate together; those at the rate asked for differ by 0
    n, np_ = F.col("n"), F.col("n") * F.col("at")
    sums = together(asked, known).select("*", F.sum(n).over(upto).alias("low_n"), F.sum(np_).over(upto).alias("low_np"), F.sum(n).over(one).alias("all_n"), F.sum(np_).over(one).alias("all_np")).filter("item is not null")
    apart = F.expr("(all_np - low_np) - at * (all_n - low_n) + at * low_n - low_np - all_n * abs(p0 - at)")
    return sums.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), (apart + F.col("nothing")).alias("value"))


class Corrections:
    """Sums by pair of sources of one language, in a square table for up to `tile` of them."""

    def __init__(self, tile: int) -> None:
        self.names: list[str] = []
        self.index: dict[str, int] = {}
        self.sums = np.zeros((tile, tile), np.int64)

    def places(self, names: list[str]) -> np.ndarray | None:
        """The places of the names, or nothing where they don't all fit."""
        new = [n for n in names if n not in self.index]
        if len(self.names) + len(new) > len(self.sums):
            return None
        for n in new:
            self.index[n] = len(self.names)
            self.names.append(n)
        return np.array([self.index[n] for n in names])

    def add(self, a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> None:
        """One term: for each source of a with each of b, the true difference in place of what one_sided() took for it."""
        more = np.abs(pa_[:, None] - pb) - np.abs(pa_[:, None] - b0) - np.abs(pb - a0[:, None]) + np.abs(a0[:, None] - b0)
        self.sums[a[:, None], b] += np.triu(more, 1) if a is b else more

    def rows(self, lang: str) -> list[tuple[str, str, str, int]]:
        return [(lang, *sorted((self.names[i], self.names[j])), int(self.sums[i, j])) for i, j in np.argwhere(self.sums)]


def summed(terms: Iterator[tuple[str, list[str], np.ndarray, np.ndarray]], tile: int = TILE, langs: int = 8) -> Iterator[list[tuple[str, str, str, int]]]:
    """Corrections of a stream of (lang, sources, p, p0), a term each: sums whenever a table is full or more than `langs` languages are open, and at the end."""
    held: dict[str, Corrections] = {}
    for lang, sources, p, p0 in terms:
        parts = [slice(i, i + tile // 2) for i in range(0, len(sources), tile // 2)]
        for i, one in enumerate(parts):
            for other in parts[i:]:
                names = sources[one] if other is one else sources[one] + sources[other]
                if lang not in held:
                    if len(held) == langs:
                        full = next(iter(held))
                        yield held.pop(full).rows(full)
                    held[lang] = Corrections(tile)
                if (at := held[lang].places(names)) is None:
                    yield held[lang].rows(lang)
                    held[lang] = Corrections(tile)
                    at = held[lang].places(names)
                a = at[: len(sources[one])]
                held[lang].add(a, a if other is one else at[len(a) :], p[one], p[other], p0[one], p0[other])
    for lang, table_ in held.items():
        yield table_.rows(lang)


def corrections(rates: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b: what one_sided() has too much for the terms that both sources have, summed in each task."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
        for batch in batches:
            ends = batch.column("sources").offsets.to_numpy()
            p, p0 = (batch.column(c).values.to_numpy() for c in ("p", "p0"))
            for i, (lang, sources) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("sources").to_pylist(), strict=True)):
                yield lang, sources, p[ends[i] : ends[i + 1]], p0[ends[i] : ends[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in summed(terms(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], names=["lang", "a", "b", "value"])

    whole = rates.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("all")).filter(F.size("all") > 1)
    columns = whole.select("lang", F.col("all.source").alias("sources"), F.col("all.p").alias("p"), F.col("all.p0").alias("p0"))
    return columns.mapInArrow(run, "lang string, a string, b string, value long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source): all pairs, and the terms each source uses most beyond its language."""
    small_batches(docs.sparkSession)
    groups, rates = rated(docs, least, Tables(docs.sparkSession, "divergence"))
    sums = together(one_sided(groups, rates), corrections(rates)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", F.inline(both), "value").withColumn("rank", F.row_number().over(order))
    more = rates.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pairs, "pair").unionByName(row(terms, "term"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and the terms that set sources apart, over all documents."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
whole AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp LEFT JOIN counted USING (lang, source) GROUP BY ALL),
rate AS (SELECT k.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (w.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
FROM kept k JOIN grp g USING (lang) JOIN langs l USING (lang) JOIN whole w ON w.lang = k.lang AND w.source = g.source LEFT JOIN counted c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM rate a JOIN rate b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
out AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', term, p - q FROM rate WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM out QUALIFY part = 'pair' OR rank <= 50"""
