"""Exact duplicates: fingerprints, collisions, long texts and edges, against grouping the texts themselves."""

import hashlib
import random
import re

import duckdb
import pytest

from tonearm.llm import exact

SF = "/root/testdata/sf0.001"


def brute(rows):
    bodies = {}
    for i, text in rows:
        bodies.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for body, ids in bodies.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = set()
        for i in ids:
            out.append((i, keep, len(ids), i == keep and i not in seen, hashlib.sha256(body.encode()).hexdigest()))
            seen.add(i)
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert found(exact.op12_exact(spark, SF)) == sorted(con.execute(exact.ORACLE_SQL).fetchall(), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["ab", "ba", "é", "漢", "🎵", "x" * 40]
    hot = " ".join(rng.choices(words, k=200))
    long = "".join(rng.choices(words, k=90_000)) + " end"  # many chunks
    out = [(i, hot.replace(" ", rng.choice([" ", "\t", " \n "]))) for i in range(300)]
    out += [(i, " ".join(rng.choices(words, k=2))) for i in range(300, 600)]
    out += [(600, long), (601, long.replace(" ", "\n\n")), (602, long + "!"), (603, long[:-1]), (603, long), (603, long), (None, long)]
    out += [(604, None), (605, ""), (606, " "), (607, "\t\n"), (608, " " * 70_000 + "a"), (609, " a"), (610, "\x00a"), (611, "a"), (612, " a")]
    return out + [(None, "only"), (None, "only"), (7, hot), (7, hot), (613, "twice"), (613, "twice"), (614, "one id"), (614, "two texts")]


def test_groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(exact.groups(docs)) == brute(rows)


def test_collisions_are_told_apart(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact.groups(docs, primes=(5,))) == brute(rows)  # five fingerprints a length


def test_chunks_combine(spark):
    rng = random.Random(5)
    a, b = rng.randbytes(70_000), rng.randbytes(999)
    for p, x, y, both in zip(exact.PRIMES, exact.chunk_hash(a), exact.chunk_hash(b), exact.chunk_hash(a + b), strict=True):
        assert both == (x * pow(exact.base_of(p), len(b), p) + y) % p
        assert x == int.from_bytes(b"") + sum(d * pow(exact.base_of(p), len(a) - 1 - k, p) for k, d in enumerate(a)) % p


def test_filter_has_every_shared_fingerprint(spark):
    values = [random.Random(1).randrange(2**62) for _ in range(5000)] + [0, 32_767, 32_768, exact.FILTER_BITS - 1]
    bits = exact.filter_of(spark.createDataFrame([(v,) for v in values], "f1 long"))
    held = {v % exact.FILTER_BITS for v in values}
    assert {8 * i + j for i, x in enumerate(bits) if x for j in range(8) if x >> j & 1} == held


def test_deduplicate_keeps_columns(spark):
    rows = [(3, "a  b", 1, "x"), (2, "a b", 2, "y"), (2, "a b", 3, "z"), (5, None, 4, None), (4, "", 5, "q"), (None, "c", 6, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha int, KEPT_ID string")
    got = exact.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.filter("doc_id is not null").collect()) == [(2, "a b"), (4, "")] and got.filter("doc_id is null").count() == 1


def test_empty(spark):
    assert exact.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
