"""Source divergence: index, merge, rates and pair sums, against plain counting in whole numbers."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tonearm.llm import divergence

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def brute(rows, least, top):
    docs = [(lower(t or ""), g or "", s or "") for t, g, s in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(text)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g for _, g, _ in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted({s for _, g, s in docs if g == lang}, key=str.encode)

        def rates(c, kept=kept):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // whole for t in kept}

        q = rates(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: rates(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, divergence.op13_divergence(spark, SF).collect())) == sorted(con.execute(divergence.ORACLE_SQL).fetchall())


def test_sources_of_all_kinds(spark):
    rng = random.Random(2)
    words = ["Aa", "b", "É", "é", "漢字", "x1y", "don't", "ÄÖ", "zz"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(" ".join(rng.choices(words[: 5 + i % 14], k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "hot", "hot", "hot", "Ä"])) for i in range(400)]
    rows += [(None, "en", "empty"), ("", "en", None), ("12 34", "fr", "x"), (None, "fr", "y"), ("only", "it", "alone")] + rows[:50]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "text string, lang string, source string, TERM string").repartition(5)
    for least in (5, 30, 10_000):
        assert sorted(map(tuple, divergence.audit(docs, least, 4).collect())) == brute(rows, least, 4)


def test_runs_merge(spark):
    """Many small runs, hot and rare terms, against one count."""
    rng = random.Random(4)
    blocks, want, df = [], defaultdict(Counter), Counter()
    for _ in range(40):
        block = divergence.Block()
        for _ in range(rng.randrange(4)):
            text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30))
            source = rng.choice([f"s{i}" for i in range(100)])
            block.add("en", source, text.encode())
            for t, n in Counter(text.split()).items():
                want[t][source] += n
                df[t] += 1
        blocks += list(block.run(1))
    whole = pa.Table.from_batches(blocks).sort_by([("shard", "ascending"), ("lang", "ascending"), ("first", "ascending")])
    for least in (1, 40):
        got = {t.decode(): (n, dict(c)) for _, t, n, c in divergence.merged(iter(whole.to_batches(max_chunksize=7)), least)}
        assert got == {t: (df[t], dict(c)) for t, c in want.items() if df[t] >= least}


def test_blocks_of_a_run(monkeypatch):
    """Shards, places and postings of a run whose blocks have few terms, many sources among them."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    rng = random.Random(7)
    block, want = divergence.Block(), defaultdict(Counter)
    for i in range(300):
        words = [rng.choice("pqrstuvwxyz") * rng.randrange(1, 9) for _ in range(rng.randrange(20))]
        block.add(rng.choice(["de", "en"]) if i else "fr", f"s{i % 90}", " ".join(words).encode())
    for lang, part in block.parts.items():
        names = list(part.sources)
        terms = list(part.terms)
        for s, ids, counts in part.docs:
            for t, n in zip(ids, counts, strict=True):
                want[lang, terms[t]][names[s]] += int(n)
    rows = [r for b in block.run(5) for r in b.to_pylist()]
    assert all(len(r["terms"]) <= 3 and r["terms"] == sorted(r["terms"]) and r["first"] == r["terms"][0] and {zlib.crc32(t) % 5 for t in r["terms"]} == {r["shard"]} for r in rows)
    got = {(r["lang"], t): {r["names"][r["sources"][j]]: r["counts"][j] for j in range(lo, hi)} for r in rows for t, lo, hi in zip(r["terms"], [0, *r["ends"]], r["ends"], strict=False)}
    assert got == {k: dict(c) for k, c in want.items()}


def test_long_text_in_pieces():
    text = ("wörd " * 300_000 + "x" * 3_000_000 + " End").encode()
    assert [t for part in divergence.terms_of(text) for t in part] == divergence.TERM.findall(text.lower())


def test_tables_of_any_size():
    """Corrections do not hang on how many sources or languages a table holds."""
    rng = np.random.default_rng(1)
    terms = []
    for lang in ("a", "b", "c") * 60:
        of = rng.choice(30, rng.integers(2, 25), replace=False)
        terms.append((lang, [f"s{i}" for i in of], rng.integers(0, 100, len(of)), of))
    want = Counter()
    for lang, names, p, p0 in terms:
        for i in range(len(p)):
            for j in range(i):
                want[(lang, *sorted((names[i], names[j])))] += int(abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p[j] - p0[i]) + abs(p0[i] - p0[j]))
    for tile, langs in ((64, 8), (8, 8), (30, 1)):
        got = Counter()
        for rows in divergence.summed(iter(terms), tile, langs):
            for lang, a, b, v in rows:
                got[lang, a, b] += v
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_rates_are_exact(spark):
    rng = random.Random(6)
    pairs = [(c, c + rng.randrange(1, 10**15)) for c in (rng.randrange(10**rng.randrange(1, 15)) for _ in range(500))]
    rows = spark.createDataFrame(pairs, "c long, n long").withColumn("r", divergence.rate(F.col("c"), F.col("n") + 5)).collect()
    assert all(r.r == 1 + 10**9 * (r.c + 5) // (r.n + 5) for r in rows)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
