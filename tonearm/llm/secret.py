"""Secret scans: three base patterns, and character Markov models that find other random strings.

The base patterns label the samples: what they match are random strings, the other identifiers of a sample of
documents are ordinary ones. From both, transitions between characters are counted (in Spark, over the sample), and a
candidate, a run of 12 or more key characters, is scored by the sum of log-likelihood ratios of its transitions. It is
a secret where the sum is at least THRESHOLD and the mean at least MEAN; candidates within a base span are left to it.
The ordinary sample also joins words of the corpus as programmers do (camel case, snake case, paths), so that the
model knows such names. It is one array of 68 x 68 numbers, whatever the corpus.

Cases: a null text counts as empty and has no span; repeated rows are scanned each; without samples of both kinds the
model finds nothing and the base stays; an empty table gives an empty table; other columns, whatever their names, are
kept in `find` (inside `row`) and `redact`. Very long texts, runs and numbers of spans cost in proportion to their
length: characters, spans and masked parts are each gone through once.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm.common import blocks_of, cut, let, running, spans_of, table

#: The base patterns (kind, pattern, characters that its last group must have).
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex")
#: The same spans at less cost where only long runs count: a shorter run holds no longer one.
LONG_ACCESS, LONG_HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_ASSIGN = 6

ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{12,}"
ORDINARY = "[A-Za-z0-9+/_.=-]{6,}"
#: Documents whose ordinary identifiers are counted, at most, chosen by hash of the id.
SAMPLE_DOCS = 2000
THRESHOLD, MEAN, SMOOTHING = 12.0, 0.5, 0.5
EVENTS = "array<struct<start:int,order:int,end:int,found:string>>"


def none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")


def found(text: Column, pattern: str) -> Column:
    """spans_of() where there is a match at all; most texts have none."""
    return F.when(text.rlike(pattern), spans_of(text, pattern)).otherwise(none())


def base_spans(text: Column) -> list[Column]:
    """Per kind: array of (start, end, found)."""
    assigned = F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= LEAST_ASSIGN)
    return [assigned, found(text, LONG_ACCESS), found(text, LONG_HEX)]


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of transitions, row by row in the order of ALPHABET."""

    ratios: tuple[float, ...]

    def score(self, word: Column) -> Column:
        """The sum over a word's transitions, positive where it looks random; the word is cut into characters once."""
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")
        places = F.transform(F.split(word, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
        both = lambda acc, i: F.coalesce(F.get(table, acc["last"] * len(ALPHABET) + i), F.lit(0.0))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, both(acc, i)).otherwise(0.0)).alias("sum"))
        return F.aggregate(places, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def transitions(words: DataFrame) -> DataFrame:
    """(random, word, n) to (random, pair, n): how often one character follows another."""
    letters = words.filter(F.length("word") > 1).select("random", "n", F.split("word", "").alias("letters"))
    pairs = F.zip_with(F.slice("letters", F.lit(1), F.size("letters") - 1), F.slice("letters", F.lit(2), F.size("letters") - 1), lambda a, b: F.concat(a, b))
    return letters.select("random", "n", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))


def joined(words: Column) -> Column:
    """Identifiers as programmers make them of words that follow one another: camel case, snake case, paths, keys with dashes."""
    three = lambda i: F.slice(words, i * 3 + 1, 3)
    camel = lambda w: F.concat(F.lower(F.get(w, F.lit(0))), F.initcap(F.get(w, F.lit(1))), F.initcap(F.get(w, F.lit(2))))
    made = lambda w, i: F.when(i % 4 == 0, camel(w)).when(i % 4 == 1, F.array_join(w, "_")).when(i % 4 == 2, F.array_join(w, "/")).otherwise(F.array_join(w, "-"))
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / 3).cast("int") - 1), lambda i: made(three(i), i))).otherwise(F.expr("cast(array() as array<string>)"))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Markov:
    """The model from what the base patterns match in all documents, and ordinary identifiers of at most SAMPLE_DOCS of them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id).alias("sample_id"), whole.alias("whole"))
    assigned, access, hexes = base_spans(F.col("whole"))
    secrets = F.concat(F.transform(assigned, lambda s: F.regexp_extract(s["found"], ASSIGN, 2)), F.transform(access, lambda s: s["found"]), F.transform(hexes, lambda s: s["found"]))
    positive = texts.select(F.explode(F.array_distinct(secrets)).alias("word")).select(F.lit(True).alias("random"), "word")
    chosen = texts.select("sample_id").orderBy(F.xxhash64("sample_id"), "sample_id").limit(SAMPLE_DOCS).distinct()
    sample = texts.join(F.broadcast(chosen), "sample_id")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("whole", ASSIGN, " "), LONG_ACCESS, " "), LONG_HEX, " ")
    held = sample.select(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0)).alias("plain"), F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("words"))
    negative = held.select(F.explode(F.concat("plain", joined(F.col("words")))).alias("word")).select(F.lit(False).alias("random"), "word")
    words = together(positive, negative).groupBy("random", "word").agg(F.count("*").alias("n"))
    counts = {(r["random"], r["pair"]): r["n"] for r in transitions(words).collect()}  # two tables of 68 x 68 at most
    if {r for r, _ in counts} != {True, False}:
        return Markov(tuple([0.0] * len(ALPHABET) ** 2))

    def logs(random: bool) -> list[float]:
        out = []
        for a in ALPHABET:
            row = [counts.get((random, a + b), 0) + SMOOTHING for b in ALPHABET]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return Markov(tuple(p - q for p, q in zip(logs(True), logs(False), strict=True)))


def find(docs: DataFrame, model: Markov, text: str = "text") -> DataFrame:
    """row (the document as a struct) and spans: (kind, start, end) by start, then kind as listed; the model's kind is `random`."""
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", whole.alias("whole"))
    assigned, access, hexes = base_spans(F.col("whole"))
    step = step.select("row", assigned.alias("assign"), access.alias("access"), hexes.alias("hex"), found(F.col("whole"), CANDIDATE).alias("candidates"))
    labelled = [_labelled(kind, order) for order, kind in enumerate(KINDS)]
    step = step.select("row", "candidates", F.concat(*labelled).alias("base"))
    # What lies within one base span is left to it: along all by start, far is the furthest end of a base span so far.
    events = F.concat(F.transform("base", lambda b: _event(b, 0, F.lit(None).cast("string"))), F.transform("candidates", lambda c: _event(c, 1, c["found"])))
    ends = lambda all_: running(F.transform(all_, lambda e: F.when(e["order"] == 0, e["end"]).otherwise(0)), F.greatest)
    beyond = let(F.sort_array(events), lambda all_: F.zip_with(all_, ends(all_), lambda e, far: F.when((e["order"] == 1) & (far < e["end"]), e)))
    step = step.select("row", "base", F.when(F.size("candidates") > 0, F.array_compact(beyond)).otherwise(F.array().cast(EVENTS)).alias("free"))
    scored = F.transform("free", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), model.score(c["found"]).alias("score")))
    step = step.select("row", "base", scored.alias("scored"))
    random = F.filter("scored", lambda c: (c["score"] >= THRESHOLD) & (c["score"] >= MEAN * (c["end"] - c["start"])))
    more = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("order"), F.lit("random").alias("kind"), c["end"].alias("end")))
    spans = F.transform(F.sort_array(F.concat("base", more)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # inline() is a fence: a filter on the spans would else be pushed below and the spans be worked out twice.
    return step.select("row", F.inline(F.array(F.struct(spans.alias("spans")))))


def _labelled(kind: str, order: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _event(span: Column, order: int, found: Column) -> Column:
    return F.struct(span["start"].alias("start"), F.lit(order).alias("order"), span["end"].alias("end"), found.alias("found"))


def redact(docs: DataFrame, model: Markov, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of a text (overlapping ones together) replaced by a mask; other texts and columns stay as they are.

    The text is cut into blocks once and each part between masks is taken from the blocks that hold it.
    """
    whole = F.col("row")[text]

    def masked(blocks: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        parts = F.transform("spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(blocks, before(i), s["start"]), F.lit(mask))))
        return F.concat(F.array_join(F.array_compact(parts), ""), cut(blocks, F.element_at(ends, -1), F.length(whole)))

    new = let(blocks_of(whole), lambda blocks: let(running(F.transform("spans", lambda s: s["end"]), F.greatest), lambda ends: masked(blocks, ends)))
    columns = [F.when(F.size("spans") > 0, new).otherwise(whole).alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return find(docs, model, text).select(*columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = find(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return spans.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("random"))
