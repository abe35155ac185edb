"""Secrets, quality rules, licences, languages, byte pairs: against brute force on whole tables, and edge cases."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonearm.llm import bpe, language, licence, quality, secret

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rows = [(1, None, "x", "a"), (2, "", "x", "b"), (3, LONG, None, "c"), (4, "one two", "x", None), (4, "one two", "x", None), (None, "token: abcdef0 ü", "x", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, `row` string")


def base_secrets(text):
    found = []
    kinds = (("assign", re.compile(secret.ASSIGN, re.ASCII), lambda m: len(m[2]) >= 6), ("access", re.compile(secret.ACCESS), lambda m: len(m[0]) >= 20), ("hex", re.compile(secret.HEX), lambda m: len(m[0]) >= 24))
    for order, (kind, pattern, good) in enumerate(kinds):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if good(m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_secrets_of_all_documents(spark, docs):
    got = {r.doc_id: r for r in secret.op1_secrets(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = base_secrets(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == base
        assert got[i].n_assign == sum(s.startswith("assign") for s in base)


def test_secret_edges(spark, docs, odd):
    model = secret.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    tricky = 'password=short token="12345" secret:: 🎉 api_key = abcdef TOKEN=ABCDEF1 AKIA0 ' + "f" * 24 + " Password='a.b-c=d"
    df = spark.createDataFrame([(1, tricky)], "doc_id long, text string")
    spans = secret.find(df, model).first().spans
    assert [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind != "random"] == base_secrets(tricky)
    out = secret.redact(odd, model).collect()
    assert len(out) == odd.count() and out[0]["text"] is None and "[SECRET] ü" in [r["text"] for r in out]
    assert secret.redact(odd, model).columns == odd.columns
    rng = random.Random(5)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(200)]
    found = secret.find(spark.createDataFrame([(f"x {k} y",) for k in keys], "text string"), model)
    assert found.filter("size(spans) = 1 and spans[0].kind = 'random'").count() >= 195
    # Ordinary is what the sample has: long words of the corpus, and runs of its words joined by signs.
    words = [w for r in docs.limit(50).collect() for w in re.findall("[a-z]{5,}", r.text or "")]
    plain = ["Bundesausbildungsfoerderungsgesetz", *["_".join(words[i : i + 4]) for i in range(0, 400, 4)], *["".join(words[i : i + 4]) for i in range(0, 400, 4)]]
    assert secret.find(spark.createDataFrame([(w,) for w in plain], "text string"), model).filter("size(spans) > 0").count() <= 0.02 * len(plain)
    labelled = {
        False: ["getUserAccountBalanceFromDatabase", "src/main/java/org/example/Handler", "https://www.example.com/path/to/page", "LoremIpsumDolorSitAmetConsectetur", "config_option_value_default_name"],
        True: ["a3JzZGxma2pzZGxrZmpzbGRrZmo0", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "xK9mQ2vR7tLp4WzN"],
    }
    for random_, names in labelled.items():
        assert secret.find(spark.createDataFrame([(n,) for n in names], "text string"), model).filter("size(spans) > 0").count() == (len(names) if random_ else 0)
    empty = secret.train(docs.limit(0))
    assert secret.find(docs.limit(0), empty).count() == 0 and set(empty.ratios) == {0.0}


def test_secrets_of_very_long_texts(spark):
    """A run of a million characters and a text of 100,000 spans take seconds: time grows with the length."""
    model = secret.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(1)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    many = " ".join(f"token={i:08d} x é" for i in range(100_000))
    df = spark.createDataFrame([(1, run), (2, many), (3, "🎉" * 9000 + many[:5000])], "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r.text for r in secret.redact(df, model).collect()}
    assert time.monotonic() - began < 60
    assert out == {1: "[SECRET]", 2: " ".join(["[SECRET] x é"] * 100_000), 3: "🎉" * 9000 + re.sub("token=[0-9]{6,}", "[SECRET]", many[:5000])}


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_and_rules(spark, docs, odd):
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text or "" for r in docs.collect()] + ["a b c d e a b c d e a b", "\n\n x \n x \n", "a b \x0bc", LONG, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in quality.judge(df, rules).select("row.doc_id", *quality.COUNTS, "base_failed", "kept").withColumnRenamed("doc_id", "id").collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == statistics(text)
        assert not (r.base_failed and r.kept)
    assert quality.keep(odd, rules).columns == odd.columns
    assert quality.judge(odd, rules).count() == odd.count()
    nothing = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").limit(0))
    assert nothing.rules == [] and quality.judge(docs.limit(0), nothing).count() == 0


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    rules = quality.fit(docs, train)
    judged = quality.judge(docs, rules).select("row.doc_id", "kept", "base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert rules.rules
    assert sum(r.kept == (r.quality == 1) for r in judged) >= 0.95 * len(judged)


def base_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for phrase, label in licence.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def test_licences(spark, docs, odd):
    got = {r.doc_id: r for r in licence.op9_licences(spark, SF).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base_licences(r.text or "")
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    mit = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(11, f"Some code. {mit.upper()} (the Software)"), (11, f"Some code. {mit.upper()} (the Software)"), (12, mit.replace("granted", "denied")), (13, "MIT MIT-License mitKlicense CC/BY"), (14, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    idf = licence.frequencies(df.unionByName(docs.select("doc_id", "text")))
    got = {r.doc_id: r for r in licence.scan(df, idf).collect()}
    assert licence.scan(df, idf).count() == df.count()
    assert [f.label for f in got[11].found] == ["mit"] and got[12].found == []
    assert [p.label for p in got[13].places] == ["mit", "cc-by"]
    assert licence.scan(df.limit(0), licence.frequencies(df.limit(0))).count() == 0


def test_licences_that_are_common(spark):
    """A licence in most or all files keeps its label."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    for others in (0, 3):
        rows = [(i, f"{mit} {i}") for i in range(6)] + [(10 + i, "plain words") for i in range(others)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: [f.label for f in r.found] for r in licence.scan(df, licence.frequencies(df)).collect()}
        assert got == {i: ["mit"] if i < 10 else [] for i, _ in rows}


def test_licences_among_others(spark, docs):
    """Every template is found in a text that holds all of them, and amid rarer licence words, once or many times."""
    whole = ". ".join(f"Part {i}: {text}" for i, (_, text, _) in enumerate(licence.TEMPLATES))
    amid = "fee charge person purpose subject domain binary forms copy conditions permitted provided unencumbered mozilla noncommercial foundation"
    rows = [(1, whole), (2, f"{amid}. Released under the MIT License"), (3, f"{amid}, licensed under the GNU General Public License version 2"), (4, f"{amid} under the license"), (5, "x released under the MIT license " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for corpus in (df, df.unionByName(docs.select("doc_id", "text"))):
        got = {r.doc_id: r.found for r in licence.scan(df, licence.frequencies(corpus)).collect()}
        assert {f.label for f in got[1]} == {label for label, _, _ in licence.TEMPLATES}
        assert [{f.label for f in got[i]} for i in (2, 3, 4)] == [{"mit"}, {"gpl-2.0"}, set()]
        assert [f.start for f in got[5]] == list(range(3, 120_000, 6)) and {f.score for f in got[5]} == {1.0}


def brute_labels(text, idf):
    """(label, start of the mandatory phrase) by the definition: every place where a template could begin is looked at by itself."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    out = set()
    for label, wording, key in licence.TEMPLATES:
        own, phrase = wording.split(), key.split()
        rare = sorted(set(own), key=lambda w: (-idf[w], w))[:12]
        offset = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        for start in range(len(words)):
            if words[start : start + len(phrase)] == phrase:
                begin = start - offset
                agree = {x for i, x in enumerate(own) if x in rare and begin + i >= 0 and words[begin + i : begin + i + 1] == [x]}
                if len(agree) >= (len(rare) if len(rare) <= 6 else 0.8 * len(rare)):
                    out.add((label, start))
    return out


def test_a_phrase_alone_is_no_licence(spark, docs):
    """Mandatory phrases amid other words: what the text lacks of a template counts."""
    texts = [
        "this text is not under the mit license at all", "we refuse the gnu affero general public license", "see either version 2 1 of the license", "not the apache license version 2 0 but ours",
        *[f"about {k} and nothing else" for _, t, k in licence.TEMPLATES if k != t],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licence.frequencies(docs.select("doc_id", "text"))
    assert {r.doc_id: [f.label for f in r.found] for r in licence.scan(df, idf).collect() if r.found} == {}
    whole = spark.createDataFrame([(i, f"Intro. {t.upper()}!") for i, (_, t, _) in enumerate(licence.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: {f.label: f.score for f in r.found} for r in licence.scan(whole, idf).collect()}
    assert all(got[i].get(label) == 1.0 for i, (label, _, _) in enumerate(licence.TEMPLATES))
    assert licence.scan(whole, idf).select("doc_id", "found").selectExpr("doc_id", "explode(found)").count() >= len(licence.TEMPLATES)


def test_labels_against_brute_force(spark, docs):
    rng = random.Random(8)
    texts = [r.text or "" for r in docs.collect()]
    for _ in range(150):  # templates whole, cut, with words changed, amid each other and ordinary text
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(licence.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["the", "licence", "x", "software"])
            parts += [" ".join(words[: rng.choice([len(words), rng.randrange(1, len(words) + 1)])]), " ".join(rng.choice(texts).split()[: rng.randrange(30)])]
        texts.append(". ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = licence.frequencies(df)
    got = {r.doc_id: {(f.label, f.start) for f in r.found} for r in licence.scan(df, idf).collect()}
    assert got == {i: brute_labels(t, idf) for i, t in enumerate(texts)} and sum(map(bool, got.values())) > 80


def test_languages(spark, odd):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.op8_language(spark, sf).collect()
    out = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(truth) and sum(out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    model = language.train(spark.createDataFrame([("der die das und", "de"), ("the and of", "en"), (None, "xx"), ("zz", None)], "text string, lang string"))
    assert model.languages == ("de", "en")
    got = language.identify(spark.createDataFrame([("the of",), ("und das",), (None,), ("12 !?",), ("日本",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "de"]
    assert language.identify(odd, model).count() == odd.count()
    none = language.train(spark.createDataFrame([], "text string, lang string"))
    assert [r.lang_pred for r in language.identify(odd, none).collect()] == ["und"] * odd.count()


def test_many_languages_ties_and_clashes(spark):
    """More languages than one mask holds, each of its own letters; ties go to the first by name; output names replace columns."""
    letters = [chr(0x4E00 + i) for i in range(150)]
    model = language.train(spark.createDataFrame([(f"{c}{c} {c}", f"l{i:03d}") for i, c in enumerate(letters)], "text string, lang string"))
    assert len(model.languages) == 150 and model.widths == ("u8", "u8", "u4")
    df = spark.createDataFrame([(c, "x", 1) for c in letters] + [(letters[90] + letters[20], "x", 1), (letters[0] * 200_000, "x", 1)], "text string, lang_pred string, score int")
    got = language.identify(df, model)
    assert got.columns == ["text", "lang_pred", "score"]
    assert [r.lang_pred for r in got.collect()] == [f"l{i:03d}" for i in range(150)] + ["l020", "l000"]


def brute_languages(labelled, texts):
    """The same n-grams and shares in sets instead of a filter: what the filter should say but for its false yeses."""
    grams = {}
    for lang, text in labelled:
        grams.setdefault(lang, Counter()).update(language.grams_of(language.codes_of(text)).tolist())
    totals = {lang: sum(c.values()) for lang, c in grams.items()}
    shares = {lang: {g: n / totals[lang] for g, n in c.items()} for lang, c in grams.items()}
    top = Counter()
    for c in shares.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    held = {lang: {g for g, x in c.items() if x >= language.RARE and x >= language.DISTINCT * top[g]} for lang, c in shares.items()}
    out = []
    for text in texts:
        found = language.grams_of(language.codes_of(text)).tolist()
        out.append(max(sorted(held), key=lambda lang: sum(g in held[lang] for g in found)))
    return out


def test_languages_against_sets(spark, docs):
    labelled = [(r.lang, r.text) for r in docs.filter("lang is not null and doc_id % 2 = 0").select("lang", "text").distinct().collect()]
    texts = [r.text for r in docs.filter("doc_id % 2 = 1 and text rlike '\\\\p{L}'").collect()]
    model = language.train(docs.filter("doc_id % 2 = 0"))
    got = [r.lang_pred for r in language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    assert sum(a == b for a, b in zip(got, brute_languages(labelled, texts), strict=True)) >= 0.99 * len(texts)


def test_byte_pairs(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, content = Tokenizer.from_file(path), bpe.read_tokenizer(path)
    rng = random.Random(2)
    letters = "aabbethe in on  \n\t'sré日本🎉 <|endoftext|>0123½²٣!?.-_‍\x00\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["", "a" * 3000, "<|endoftext|>x<|endoftext|><|endoftext|>", " <|endoftext|> ", "  " * 500, LONG]
    df = docs.select("text").unionByName(odd.select("text")).unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in bpe.decode(bpe.encode(df, content), content).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    broken = spark.createDataFrame([([rng.randrange(50_257) for _ in range(9)],) for _ in range(200)] + [(None,), ([],)], "ids array<int>")
    for r in bpe.decode(broken, content).collect():
        assert r.decoded == library.decode(r.ids or [], skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), content).count() == 0
    clash = odd.withColumnsRenamed({"spans": "ids", "row": "decoded"})
    both = bpe.encode(clash, content, decoded="decoded")
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and both.filter("decoded <> coalesce(text, '')").count() == 0 and both.count() == odd.count()
    got = bpe.op7_bpe(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.filter(F.col("n_tokens") < 1).count() == 0
