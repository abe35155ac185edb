"""Quality rules: statistics of each text and a learned, ordered list of threshold conjunctions, all as Spark expressions.

`with_statistics` adds the statistics, `learn` fits a decision list by sequential covering on labelled rows: it grows a
conjunction of thresholds condition by condition on two thirds of the rows by information gain, prunes it on the last
third, takes the rows it covers away and goes on. All candidate conditions are counted in one Spark aggregation.
`RuleList.verdict` emits the rules as one ordered conditional expression.

Cases: a null text counts as empty; without words all counts are 0 and the base rule fails the text; labels that are
null, or whose document is missing, teach nothing; without labels of both kinds the list is empty and keeps all that
the base keeps; repeated rows are judged each; an empty table gives an empty table; other columns, whatever their
names, are kept by `keep` and left out by `judge`; of conditions that gain alike the one last by name is taken; a very
long text costs its length (and its windows' sort, where some repeat).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm.common import SPACE, table

#: Labelled rows that the rules are fitted on at most, chosen by hash of the id; all other work covers all rows.
LABELLED = 20_000
#: Thresholds tried for each statistic, rules, conditions of a rule, the precision a rule must have and the rows it must cover.
THRESHOLDS, RULES, CONDITIONS, PRECISION, SUPPORT = 12, 8, 3, 0.9, 5
WINDOW = 5
#: Words in repeated windows that the base rule allows, in percent, and the words it asks for.
REPEATED_PERCENT, LEAST_WORDS = 20, 10

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions may ask of a text: shares, so that a rule means the same for short and long ones, and its length.
FEATURES = {
    "length": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
}


def with_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """docs as a struct `row`, with the statistics of a text beside it; every text is cut into words once.

    Words in repeated windows: each window of five words is hashed (64 bits); texts without an equal pair, most of
    them, end there. In the others the windows are sorted with their places, those with an equal neighbour are kept,
    and the words that they cover are counted from the distances of their places.
    """
    whole = F.coalesce(text, F.lit(""))
    step = docs.select(F.struct("*").alias("row"), whole.alias("whole"))
    lines = F.filter(F.split("whole", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    step = step.select("row", "whole", F.array_remove(F.split("whole", f"[{SPACE}]+", -1), "").alias("words"), lines.alias("lines"))
    word = lambda i: F.get(F.col("words"), i)
    hashes = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[word(i + k) for k in range(1, WINDOW)]))
    step = step.select("row", "whole", "words", "lines", hashes.alias("hashes"))
    step = step.select("*", F.array_join("words", "").alias("letters"), (F.size(F.array_distinct("hashes")) < F.size("hashes")).alias("repeats"))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select("*", F.when(F.col("repeats"), placed).alias("placed"))
    near = lambda i: F.get(F.col("placed"), i)["h"]
    twice = F.filter("placed", lambda x, i: F.coalesce(x["h"] == near(i + 1), F.lit(False)) | F.coalesce((i > 0) & (x["h"] == near(F.greatest(i - 1, F.lit(0)))), F.lit(False)))
    step = step.select("row", "whole", "words", "lines", "letters", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("places"))
    covered = F.aggregate(F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x)
    count = lambda pattern: F.regexp_count("letters", F.lit(pattern)).cast("long")
    statistics = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length("letters").cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_capitals"),
        count("[0-9]").alias("n_digits"),
        count("[!?.,;:]").alias("n_marks"),
    )
    # inline() is a fence: a filter on a statistic would else be pushed below, and each statistic worked out anew for it.
    return step.select("row", F.inline(F.array(statistics)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class RuleList:
    """Ordered rules; the first that holds rejects, all else is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The 1-based number of the first rule that holds, else 0."""
        out = F.lit(0)
        for number in range(len(self.rules), 0, -1):
            out = F.when(reduce(Column.__and__, [c.column() for c in self.rules[number - 1]]), F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{n}. reject if " + " and ".join(map(str, rule)) for n, rule in enumerate(self.rules, 1))


def tallies(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(bad, good) rows under every candidate condition: one aggregation by (statistic, bin), summed up along its bins."""
    names = list(cuts)
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"bin_{n}").alias("bin")) for i, n in enumerate(names)])).alias("x")
    found: dict[tuple[int, int], list[int]] = {}
    for r in rows.select("bad", bins).groupBy("x.feature", "x.bin", "bad").count().collect():  # statistics times bins times two
        found.setdefault((r["feature"], r["bin"]), [0, 0])[r["bad"]] += r["count"]
    out = {}
    for i, n in enumerate(names):
        total = [sum(found.get((i, k), (0, 0))[bad] for k in range(len(cuts[n]) + 1)) for bad in (0, 1)]
        below = [0, 0]
        for k, threshold in enumerate(cuts[n]):
            below = [below[bad] + found.get((i, k), (0, 0))[bad] for bad in (0, 1)]
            out[Condition(n, False, threshold)] = (below[1], below[0])
            out[Condition(n, True, threshold)] = (total[1] - below[1], total[0] - below[0])
    return out


def count(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.count_if(F.col("bad") == 1), F.count_if(F.col("bad") == 0)).first()
    return row[0], row[1]


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that keeps p of p0 bad and n of n0 good rows."""
    from math import log2

    return p * (log2((p + 1) / (p + n + 2)) - log2((p0 + 1) / (p0 + n0 + 2))) if p else -1.0


def holds(conditions: list[Condition] | tuple[Condition, ...]) -> Column:
    return reduce(Column.__and__, [c.column() for c in conditions], F.lit(True))


def learn(rows: DataFrame) -> RuleList:
    """rows (bad 0/1, fold, features) to rules for bad; `fold` deals a third of them to pruning.

    Thresholds are exact quantiles of the rows, which are LABELLED at most: the same rows give the same rules.
    """
    names = list(FEATURES)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    shares = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile(n, F.array(*map(F.lit, shares))).alias(n) for n in names]).collect()
    cuts = {n: sorted({float(t) for row in quantiles for t in row[n] or ()}) for n in names}
    bin_of = lambda n: F.size(F.filter(F.lit(cuts[n]), lambda t: t < F.col(n))).alias(f"bin_{n}")
    binned = rows.select("*", *[bin_of(n) for n in names if cuts[n]])
    binned = binned.persist(StorageLevel.MEMORY_AND_DISK)
    cuts = {n: c for n, c in cuts.items() if c}
    out = RuleList()
    while cuts and len(out.rules) < RULES:
        left = binned.filter(out.verdict() == 0)
        grow, prune = left.filter("fold < 2"), left.filter("fold = 2")
        rule: list[Condition] = []
        p0, n0 = count(grow)
        while n0 and p0 >= SUPPORT and len(rule) < CONDITIONS:
            found = tallies(grow.filter(holds(rule)), cuts)
            best = max(found, key=lambda c: (gain(*found[c], p0, n0), str(c)))
            if gain(*found[best], p0, n0) <= 0 or found[best] == (p0, n0):
                break
            rule.append(best)
            p0, n0 = found[best]
        if not rule:
            break
        heads = [tuple(rule[: k + 1]) for k in range(len(rule))]
        worth = {h: (p - n) / (p + n) if p + n else -1.0 for h in heads for p, n in [count(prune.filter(holds(h)))]}
        best_head = max(heads, key=lambda h: (worth[h], -len(h)))
        p, n = count(left.filter(holds(best_head)))
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        out.rules.append(best_head)
    binned.unpersist()
    rows.unpersist()
    return out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality") -> RuleList:
    """Rules from labels (quality 0 or 1) of at most LABELLED documents; their ids are few by that bound, so they are sent to all tasks."""
    chosen = labels.filter(F.col(quality).isin(0, 1) & F.col(id).isNotNull())
    chosen = chosen.select(F.col(id).alias("label_id"), (1 - F.col(quality)).alias("bad")).orderBy(F.xxhash64("label_id"), "label_id", "bad").limit(LABELLED)
    texts = docs.select(F.col(id).alias("label_id"), F.col(text).alias("label_text")).join(F.broadcast(chosen), "label_id")
    stats = with_statistics(texts, F.col("label_text")).filter(~base_failed())
    fold = F.pmod(F.xxhash64("row.label_id", F.lit(3)), F.lit(3)).alias("fold")
    return learn(stats.select(F.col("row.bad").alias("bad"), fold, *[F.expr(e).alias(n) for n, e in FEATURES.items()]))


def judge(docs: DataFrame, rules: RuleList, text: str = "text") -> DataFrame:
    """row (the document as a struct), its statistics, base_failed, rule (number of the rule that rejects, else 0), kept."""
    stats = with_statistics(docs, F.col(text))
    seen = stats.select("row", *COUNTS, base_failed().alias("base_failed"), *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    seen = seen.withColumn("rule", rules.verdict())
    return seen.select("row", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep(docs: DataFrame, rules: RuleList, text: str = "text") -> DataFrame:
    """The documents that the base and the rules keep, with their own columns."""
    return judge(docs, rules, text).filter("kept").select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("row.doc_id", *COUNTS, "base_failed", "kept", "rule")
