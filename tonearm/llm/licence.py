"""Licence scans: exact base phrases, and a positional index of rare licence words.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower case. Inverse document
frequencies, counted over the whole corpus, choose the words that the index lists: of each template the RARE rarest,
with their places. A text's licence words among these are looked up; a word's place in the text less its place in a
template is where the template would begin. A beginning is a label if the template's mandatory phrase stands at its own
place from there and enough of the template's listed words agree on it, those that the text lacks counting against it:
all of them for templates of up to SHORT words, else SHARE of them. The score is the share that agrees.

Cases: a null text counts as empty; texts without words have no label and score 0; repeated rows share their result;
an empty table gives an empty table; other columns, whatever their names, are left out of `scan`'s result; words that
are equally frequent are looked up by name; a very long text costs its words, and its licence words once more.
"""

from __future__ import annotations

import json
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.common import table

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, public licence wording, and the phrase of it that must stand in place.
TEMPLATES = [
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "names of its contributors may be used to endorse or promote products"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "either version 2 of the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "either version 2 1 of the license"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
]
RARE, SHARE, SHORT = 12, 0.8, 6

WORDS = sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def lowered(text: Column) -> Column:
    """lower() also folds other scripts, which changes no ASCII word, but for two signs replaced before."""
    return F.lower(F.regexp_replace(text, "[\u0130\u212a]", "é"))


def words_of(lower: Column) -> Column:
    return F.array_remove(F.split(lower, GAP, -1), "")


def places(words: Column, phrase: list[str]) -> Column:
    """Where a phrase's words stand one after another, from 0."""
    starts = F.transform(words, lambda w, i: F.when((w == phrase[0]) & reduce(Column.__and__, [F.get(words, i + k) == p for k, p in enumerate(phrase[1:], 1)], F.lit(True)), i))
    return F.array_compact(starts)


def frequencies(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every licence word over all documents (a few hundred numbers)."""
    found = docs.select(F.array_intersect(words_of(lowered(F.coalesce(F.col(text), F.lit("")))), F.lit(WORDS)).alias("found"))
    counts = found.select(F.explode(F.concat("found", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}
    return {w: log((seen.get("", 0) + 1) / (seen.get(w, 0) + 1)) for w in WORDS}


def scan(docs: DataFrame, idf: dict[str, float], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, places (of base phrases: label, start), found (of templates: label, start, score); one pass, no shuffle."""
    step = docs.select(F.col(id).alias("id"), lowered(F.coalesce(F.col(text), F.lit(""))).alias("lower"))
    step = step.select("id", words_of(F.col("lower")).alias("words"), "lower")
    hint = "(" + "|".join(GAP.join(p.split()) for p in BASE) + ")"
    base = F.concat(*[_labelled(p, label) for p, label in BASE.items()])
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    rare, keys = rarest(idf), [k.split() for _, _, k in TEMPLATES]
    # A label needs its mandatory phrase: texts that have none are left to the base phrases. The rarest word of each phrase is asked for first.
    some = F.arrays_overlap("words", F.lit(sorted({min(k, key=lambda w: (-idf[w], w)) for k in keys})))
    spoken = "(" + "|".join(sorted({GAP.join(k) for k in keys})) + ")"
    places_ = F.when(F.arrays_overlap("words", F.lit(sorted({p.split()[-1] for p in BASE}))) & F.col("lower").rlike(hint), F.sort_array(base)).otherwise(none)
    step = step.select("id", F.size("words").cast("long").alias("n_words"), places_.alias("places"), F.when(F.when(some, F.col("lower").rlike(spoken)), F.col("words")).alias("words"))
    step = step.select(F.inline(F.array(F.struct("id", "n_words", "places", "words"))))  # a fence: what follows uses each several times
    index = {w: [(n, i) for n, (_, t, _) in enumerate(TEMPLATES) for i, x in enumerate(t.split()) if x == w and w in rare[n]] for w in sorted(set().union(*rare))}
    postings = F.from_json(F.lit(_json(index)), "map<string,array<struct<template:int,at:int>>>")  # a few hundred, whatever the corpus
    # The mandatory phrase, at its own place from the beginning.
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), c["template"])
    start = lambda c: c["begin"] + pick([_index(t.split(), k.split()) for _, t, k in TEMPLATES], c)
    phrase = lambda c: F.when((start(c) >= 0) & (F.get("words", start(c)) == pick([k[0] for k in keys], c)), F.slice("words", start(c) + 1, F.size(pick(keys, c))))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda h: F.map_contains_key(postings, h["word"]))
    begins = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h["word"]), lambda p: F.struct(p["template"].alias("template"), (h["place"] - p["at"]).alias("begin"), h["word"].alias("word")))))
    spoken_at = F.filter(begins, lambda c: F.coalesce(phrase(c) == pick(keys, c), F.lit(False)))
    step = step.select("id", "n_words", "places", F.sort_array(spoken_at).alias("begins"))
    step = step.select("id", "n_words", "places", _agreements("begins").alias("agree"))
    good = F.filter("agree", lambda c: c["agree"] >= pick([needed(len(r)) for r in rare], c))
    found = F.sort_array(F.transform(good, lambda c: F.struct(pick([label for label, _, _ in TEMPLATES], c).alias("label"), start(c).cast("int").alias("start"), (c["agree"] / pick([len(r) for r in rare], c)).alias("score"))))
    empty = F.expr("cast(array() as array<struct<label:string,start:int,score:double>>)")
    return step.select(F.inline(F.array(F.struct(F.col("id").alias(id), "n_words", "places", F.coalesce(found, empty).alias("found")))))


def rarest(idf: dict[str, float]) -> list[set[str]]:
    """Of each template its RARE words with the highest inverse document frequency, equal ones by name."""
    return [set(sorted(set(t.split()), key=lambda w: (-idf[w], w))[:RARE]) for _, t, _ in TEMPLATES]


def needed(words: int) -> int:
    """How many of a template's listed words must agree."""
    return words if words <= SHORT else ceil(SHARE * words)


def _agreements(name: str) -> Column:
    """Sorted (template, begin, word) to (template, begin, agree): different words for each beginning; one run along the array."""
    longest = max(len(t.split()) for _, t, _ in TEMPLATES)  # no place of a template is met twice from one beginning
    same = lambda x, y: (x["template"] == y["template"]) & (x["begin"] == y["begin"])
    run = lambda x, i: F.filter(F.slice(name, i + 1, longest), lambda y: same(x, y))
    first = lambda x, i: (i == 0) | ~same(x, F.get(name, i - 1))
    agree = lambda x, i: F.size(F.array_distinct(F.transform(run(x, i), lambda y: y["word"])))
    found = F.transform(name, lambda x, i: F.when(first(x, i), F.struct(x["template"].alias("template"), x["begin"].alias("begin"), agree(x, i).alias("agree"))))
    return F.filter(found, lambda c: c.isNotNull())


def _json(index: dict[str, list[tuple[int, int]]]) -> str:
    return json.dumps({w: [{"template": n, "at": i} for n, i in found] for w, found in index.items()})


def _index(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _labelled(phrase: str, label: str) -> Column:
    return F.transform(places(F.col("words"), phrase.split()), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of every document, and the labels that the index adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, frequencies(docs))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform("found", lambda f: f["label"])
    text = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).cast("long").alias("last_word"),
        text(base).alias("base_labels"),
        text(F.concat(base, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )
