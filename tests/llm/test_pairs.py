"""Near-duplicates, benchmark passages and the pipeline, against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tonearm.llm import decontaminate, minhash
from tonearm.llm.common import Tables
from tonearm.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, words, rng):
    """Copies of one text with more and more words changed: links over several steps, and copies that are linked with nothing."""
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(8)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op4_minhash(spark, SF).collect()}
    assert got == brute_components(rows, 3, 85)


def test_hot_groups_and_edges(spark):
    rng = random.Random(1)
    texts = near_copies(150, 80, rng) + near_copies(60, 40, rng) + ["same text here and there"] * 30 + ["A b", "a  B", "a", None, "", " \n", "é É", "É é"]
    rows = list(enumerate(texts))
    extra = [(i, t, "x") for i, t in rows] + [(3, rows[3][1], "x"), (None, rows[3][1], "x")]
    df = spark.createDataFrame(extra, "doc_id long, text string, component_id string")
    got = minhash.near_duplicates(df, shingle=3, percent=85).collect()
    want = brute_components(rows, 3, 85)
    assert len(got) == len(extra)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_of_hot_groups(spark):
    """Two variants whose buckets are all led by longer texts, which neither is linked with, keep their link where rows are repeated."""
    rng, rows = random.Random(7), []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts = [base + [f"x{rng.randrange(10**6)}" for _ in range(16)] for _ in range(20)]
        texts += [[*base[:at], "y", *base[at + 1 :]] for at in (20, 60)]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_components(rows, 3, 85)
    assert sum(c != i for i, (_, c) in want.items()) == 6
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df.union(df), shingle=3, percent=85).collect()
    assert len(got) == 2 * len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_index_meets_all_under_its_distance():
    """By pigeonhole: signatures that differ in no more slots than allowed agree on a key, wherever they differ."""
    for percent in (80, 85, 90):
        chunks, most = minhash.plan_of(percent)
        assert most == 2 * chunks - 1
        rng = np.random.default_rng(percent)
        for differ in range(most + 1):
            one = rng.integers(0, 2**16, chunks * minhash.CHUNK, dtype=np.uint16)
            other = one.copy()
            at = rng.permutation(len(one))[:differ]
            other[at] ^= 1
            keys = []
            for sig in (one, other):
                parts = sig.reshape(chunks, minhash.CHUNK)
                keys.append({(c, w, tuple(np.delete(parts[c], w))) for c in range(chunks) for w in range(minhash.CHUNK)})
            assert keys[0] & keys[1]


def test_links_by_index_and_completion(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame([*rows, (-1, "very long text " * 100_000)], "doc_id long, text string")
    found = minhash.links(df, shingle=3, percent=85)
    assert found.indexed.count() > 0
    sets = {r.rep for r in found.classes.collect()}
    assert {x for r in found.indexed.union(found.completed).collect() for x in (r.a, r.b)} <= sets
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == {-1: -1, **{i: c for i, (_, c) in brute_components(rows, 3, 85).items()}}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 200: 200}


def edit_distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_passages_against_full_alignment():
    rng = random.Random(3)
    letters = "abcdefgh ijkl"
    items = [(i, "".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate((20, 40, 100, 128, 9))]
    passages = decontaminate.Passages(items)
    texts = []
    for _ in range(120):
        item = rng.choice(items)[1]
        text = list(item)
        for _ in range(rng.randrange(max(2, len(item) // 8))):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "z", text[at] + "q"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(50))) + "".join(text).upper() + "xy")
    for text, found in zip(texts, passages.find(texts), strict=True):
        low = text.lower()
        want = {i for (i, item), k in zip(items, passages.k, strict=True) if edit_distance(item, low) <= k}
        assert want <= {r[0] for r in found}
        for item, start, end, edits in found:
            assert edit_distance(items[item][1], low[start:end]) <= edits <= passages.k[item]


def test_documents_with_passages(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in decontaminate.op2_decontaminate(spark, SF).collect()}
    for i, text in texts.items():
        held = {k for k, t in items.items() if t in text}
        assert held <= set(got[i].item_ids) and got[i].contaminated == bool(got[i].item_ids)
    assert sum(r.contaminated for r in got.values()) < 0.2 * len(got)


def test_passage_edges(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a passage of the benchmark that is long enough to count"), (2, None), (3, "tiny"), (None, "x" * 50)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "A  PASSAGE of the benchmark that is long enough to count"), (3, "A  PASSAGE of the benchmark that is long enough to count"), (4, "tiny"), (5, "clean " * 20_000)]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, regions string, item_id int")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 4, 5]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows) and decontaminate.clean(docs.limit(0), bench).count() == 0
    clash = docs.withColumnsRenamed({"regions": "digest", "item_id": "whole"})
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 20)  # several blocks, one after another
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 4, 5]
    assert decontaminate.mark(clash, bench, out="found").columns == [*clash.columns, "found"]
    assert sorted(r.doc_id for r in decontaminate.clean(clash, bench).collect()) == [1, 2, 4, 5]


def test_large_benchmarks_in_blocks(spark, monkeypatch):
    """A benchmark over the bound gives the same regions for all documents as one block does."""
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda: sorted((r.doc_id, [tuple(x) for x in r.regions]) for r in decontaminate.mark(docs.select("doc_id", "text"), bench).collect())
    want = rows()
    assert any(x for _, x in want)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4000)
    assert rows() == want


def test_texts_of_a_batch_are_alone(spark):
    """A passage that ends one text and begins the next is in neither, and no find hangs on the neighbours."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij klmno") for _ in range(90))
    held = decontaminate.Passages([(1, passage)])
    assert held.find([f"one {passage[:45]}", f"{passage[45:]} two", passage[:45], passage[45:]]) == [[], [], [], []]
    long = "".join(rng.choice("pqrs tuvw") for _ in range(400))
    held = decontaminate.Passages([(1, passage), (2, long), (3, passage[:20])])
    texts = []
    for _ in range(300):
        whole = rng.choice([passage, long])
        a = rng.randrange(len(whole))
        text = list(whole[a : a + rng.randrange(len(whole))])
        for _ in range(rng.randrange(8)):
            text[rng.randrange(len(text) + 1) : rng.randrange(len(text) + 1)] = rng.choice(["", "x", "yz"]) if rng.random() < 0.5 else []
        texts.append("".join(text))
    together = held.find(texts)
    assert together == [held.find([t])[0] for t in texts] and sum(map(bool, together)) > 20
    rng.shuffle(texts)
    assert held.find(texts) == [held.find([t])[0] for t in texts]


def test_any_partitioning(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda n: sorted((r.doc_id, [tuple(x) for x in r.regions]) for r in decontaminate.mark(docs.select("doc_id", "text").repartition(n), bench).collect())
    assert rows(1) == rows(50)


def test_short_items_literally(spark):
    held = decontaminate.Passages([(1, "Yes"), (2, "a  b")])
    assert held.find(["no, yes. YESyes", "A\t b", ""]) == [[(1, 4, 7, 0), (1, 9, 12, 0), (1, 12, 15, 0)], [(2, 0, 4, 0)], []]
    docs = spark.createDataFrame([(1, "oh yes"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "yes"), (6, "")], "item_id long, text string")
    assert [len(r.regions) for r in decontaminate.mark(docs, bench).orderBy("doc_id").collect()] == [0, 0]
    assert [len(r.regions) for r in decontaminate.mark(docs, bench, least=1).orderBy("doc_id").collect()] == [1, 0]


def test_whole_table_against_full_alignment(spark):
    """Every document of the smallest table against every passage, with the plain edit distance."""
    items = [(r.item, r.passage) for r in decontaminate.passages_of(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()]
    passages = decontaminate.Passages(items)
    got = {r.doc_id: r for r in decontaminate.op2_decontaminate(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500").limit(60).collect():
        low = "".join(map(chr, decontaminate.codes_of(r.text or "")))
        grams = {low[i : i + 4] for i in range(len(low) - 3)}
        want = set()
        for (item, passage), k in zip(items, passages.k, strict=True):
            p = "".join(map(chr, decontaminate.codes_of(passage)))
            if sum(p[i : i + 4] in grams for i in range(len(p) - 3)) >= len(p) - 3 - 4 * k and edit_distance(p, low) <= k:
                want.add(item)
        assert set(got[r.doc_id].item_ids) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 5"))  # nulls, an empty text, repeated rows
    tables, columns, before = Tables(spark, "stages"), docs.columns, docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = tables.write(stage(spark, before, SF), str(number))
        if number < 4:
            assert after.columns == columns, name
        if name == "near-duplicates":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").distinct().collect()]
            want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if c == i}
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        if name == "secret scan":
            assert after.count() == before.count() and after.filter(F.col("n_chars") != F.length("text")).count() == 0
            assert after.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
        before = after
    assert before.filter("n_tokens = size(ids)").count() == before.count() > 0
    assert corpus_pipeline.run(spark, SF).columns == before.columns


def test_pipeline_on_empty_and_clashing_tables(spark):
    """Empty tables pass all stages; columns named like those used inside, and a very long text, are kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        assert after.count() == 0
        if number < 4:
            assert after.columns == docs.columns
            before = after
    long = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    more = docs.limit(60).unionByName(spark.createDataFrame([(10**6, long, "en", "s", len(long))], docs.schema))
    for name in ("kept_id", "digest", "regions", "benchmark_regions_found", "row", "spans", "whole", "kept", "component_id", "rule", "text_"):
        more = more.withColumn(name, F.lit(name))
    before = more
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, before, SF)
        assert after.columns == more.columns, number
        before = Tables(spark, f"clash{number}").write(after, "t")
    out = before.collect()
    assert out and all(r.kept_id == "kept_id" and r.digest == "digest" and r.row == "row" for r in out)
    assert corpus_pipeline.STAGES[4][1](spark, before, SF).count() == len(out)
