"""Feedback and quality analytics (ids D9-D22, D28-D29, E8, K of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions.music import multiplier, verdict
from tonearm.functions.frames import together

SEVERITY = ("PASS", "WARN", "FAIL")


def severity(v: Column) -> Column:
    return F.when(v == "FAIL", 2).when(v == "WARN", 1).when(v == "PASS", 0)


def verdict_of(s: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITY)), s)


def judged(values: DataFrame, thresholds: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """K1: metric values with their verdicts; thresholds (metric, warn_at, fail_at, lower_is_worse) are one small row for each metric."""
    both = values.join(F.broadcast(thresholds), metric)
    return both.withColumn("verdict", verdict(F.col(value), F.col("warn_at"), F.col("fail_at"), F.col("lower_is_worse")))


def rolled_up(verdicts: DataFrame, group: list[str]) -> DataFrame:
    """Worst verdict, failures and warnings of each report; installable where nothing failed."""
    s = severity(F.col("verdict"))
    out = verdicts.groupBy(*group).agg(F.max(s).alias("worst"), F.count_if(s == 2).alias("failures"), F.count_if(s == 1).alias("warnings"))
    return out.withColumn("installable", F.col("worst") < 2).withColumn("worst", verdict_of(F.col("worst")))


def strategy_stats(rows: DataFrame, strategy: str, verdict: str, seconds: str) -> DataFrame:
    """Chosen, FAIL, WARN, rates and median time of each strategy."""
    v = F.col(verdict)
    return rows.groupBy(strategy).agg(
        F.count("*").alias("chosen"), F.count_if(v == "FAIL").alias("fail"), F.count_if(v == "WARN").alias("warn"),
        F.avg((v == "FAIL").cast("double")).alias("fail_rate"), F.percentile(seconds, 0.5).alias("median_seconds"),
    )


def metric_stats(rows: DataFrame, metric: str, verdict: str) -> DataFrame:
    """Verdicts counted for each metric; the three columns are named, so no pass to find them."""
    return rows.groupBy(metric).agg(*[F.count_if(F.col(verdict) == v).alias(v.lower()) for v in SEVERITY])


def distribution(rows: DataFrame, group: list[str], x: str, gate: float) -> DataFrame:
    """Least, 10th, median, 90th and largest value by interpolation, and how many lie below the gate."""
    q = F.percentile(x, F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.9, 1.0))))
    out = rows.groupBy(*group).agg(q.alias("q"), F.count_if(F.col(x) < gate).alias("below"))
    return out.select(*group, *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "p10", "median", "p90", "high"))], "below")


def histogram(rows: DataFrame, group: list[str], x: str, buckets: int = 5) -> DataFrame:
    """Counts in equal buckets of 0..1, the last one closed."""
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col(x) * buckets)))
    return rows.groupBy(*group).agg(*[F.count_if(b == i).alias(f"b{i}") for i in range(buckets)])


def tally(ratings: DataFrame, group: list[str], rating: str, implicit: str) -> DataFrame:
    """Explicit and implicit ratings counted and summed; partial sums before the shuffle."""
    soft = F.coalesce(F.col(implicit), F.lit(False))
    return ratings.groupBy(*group).agg(
        F.count_if(~soft).alias("n"), F.coalesce(F.sum(F.when(~soft, F.col(rating))), F.lit(0.0)).alias("sum"),
        F.count_if(soft).alias("implicit_n"), F.coalesce(F.sum(F.when(soft, F.col(rating))), F.lit(0.0)).alias("implicit_sum"),
    )


def learned(tallies: DataFrame) -> DataFrame:
    """The shrunk multiplier of each tally."""
    return tallies.withColumn("multiplier", multiplier(F.col("n"), F.col("sum"), F.col("implicit_n"), F.col("implicit_sum")))


def in_bucket_order(rows: DataFrame, strategy: str, bucket: str, buckets: list[str]) -> DataFrame:
    """Rows by strategy, then in the buckets' fixed order."""
    place = F.array_position(F.array(*map(F.lit, buckets)), F.col(bucket))
    return rows.withColumn("bucket_order", place.cast("int")).orderBy(strategy, "bucket_order")


def worst_first(rows: DataFrame, n: int) -> DataFrame:
    """Errors first, then by verdict, failures, warnings, index."""
    return rows.orderBy(F.col("error").isNull(), F.desc(severity(F.col("verdict"))), F.desc("failures"), F.desc("warnings"), "index").limit(n)


def first_report_wins(reports: list[DataFrame], keys: list[str]) -> DataFrame:
    """Metrics of several reports, the first one wins for each key."""
    both = reports[0].withColumn("__turn", F.lit(0))
    for turn, more in enumerate(reports[1:], 1):
        both = together(both, more.withColumn("__turn", F.lit(turn)))
    rest = [c for c in reports[0].columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__turn").alias("__row")).select(*keys, "__row.*")


def level_matched(rows: DataFrame, group: list[str], level: str, limit: float = 12.0) -> DataFrame:
    """Gain that brings each row down to the quietest of its group, clamped."""
    low = rows.groupBy(*group).agg(F.min(level).alias("__low"))
    return rows.join(low, group).withColumn("gain", F.greatest(F.lit(-limit), F.col("__low") - F.col(level))).drop("__low")


def regressions(golden: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """K4: metrics whose verdict got worse, or that are new and do not pass."""
    g = golden.select(*keys, F.col("verdict").alias("before"))
    a = actual.select(*keys, F.col("verdict").alias("after"))
    both = a.join(g, keys, "left")
    return both.filter((severity(F.col("after")) > severity(F.col("before"))) | (F.col("before").isNull() & (F.col("after") != "PASS")))


def series_gap(golden: DataFrame, actual: DataFrame, keys: list[str], i: str, x: str, limit: float) -> DataFrame:
    """Root mean square difference of two series over their common places, their lengths, and whether they agree."""
    g, a = golden.select(*keys, i, F.col(x).alias("g")), actual.select(*keys, i, F.col(x).alias("a"))
    both = g.join(a, [*keys, i], "full_outer")
    d = F.col("g") - F.col("a")
    usable = F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d * d)
    out = both.groupBy(*keys).agg(F.sqrt(F.avg(usable)).alias("rmse"), F.count("g").alias("n_golden"), F.count("a").alias("n_actual"))
    return out.withColumn("same", (F.coalesce("rmse", F.lit(0.0)) <= limit) & (F.col("n_golden") == F.col("n_actual")))


def rmse(a: Column, b: Column) -> Column:
    """K3: root mean square difference of two arrays over their common length; places that are no number are left out."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    fine = F.filter(pairs, lambda d: d.isNotNull() & ~F.isnan(d) & (d != float("inf")))
    return F.when(F.size(fine) > 0, F.sqrt(F.aggregate(fine, F.lit(0.0), lambda s, d: s + d) / F.size(fine)))


def golden_cells(golden: DataFrame, actual: DataFrame, keys: list[str], envelope_limit: float = 0.5, spectrum_limit: float = 1.0, strict: bool = False) -> DataFrame:
    """Cells (plan, envelope, spectrum, hash) against their golden ones: what differs, cell by cell; an outer join, so missing cells show."""
    parts = ("plan", "envelope", "spectrum", "hash")
    g = golden.select(*keys, F.lit(True).alias("__g"), *[F.col(p).alias(f"g_{p}") for p in parts])
    a = actual.select(*keys, F.lit(True).alias("__a"), *[F.col(p).alias(f"a_{p}") for p in parts])
    both = g.join(a, keys, "full_outer").withColumns({"envelope_rmse": rmse(F.col("g_envelope"), F.col("a_envelope")), "spectrum_rmse": rmse(F.col("g_spectrum"), F.col("a_spectrum"))})
    over = lambda n, limit: (F.coalesce(n, F.lit(0.0)) > limit)
    why = [
        ("not rendered", F.col("__a").isNull()), ("no golden", F.col("__g").isNull()), ("plan", ~F.col("g_plan").eqNullSafe(F.col("a_plan"))),
        ("envelope", over("envelope_rmse", envelope_limit)), ("spectrum", over("spectrum_rmse", spectrum_limit)), ("length", F.size("g_envelope") != F.size("a_envelope")),
    ]
    if strict:
        why.append(("hash", ~F.col("g_hash").eqNullSafe(F.col("a_hash"))))
    missing = F.col("__a").isNull() | F.col("__g").isNull()
    texts = [F.when(F.coalesce(x, F.lit(False)) & (F.lit(True) if n in ("not rendered", "no golden") else ~missing), F.lit(n)) for n, x in why]
    return both.select(*keys, "envelope_rmse", "spectrum_rmse", F.array_compact(F.array(*texts)).alias("differs"))


def accuracy(cases: DataFrame) -> DataFrame:
    """K7: an accuracy bench over all cases: tempo, octave errors, beats, downbeats, keys (and relative ones), trims, tuning.

    cases: bpm, true_bpm, f, phase, true_phase, tonic, minor, true_tonic, true_minor, trim, true_trim (seconds), cents, true_cents.
    """
    err = F.abs(F.col("bpm") / F.col("true_bpm") - 1)
    octave = F.least(*[F.abs(F.col("bpm") / (F.col("true_bpm") * k) - 1) for k in (0.5, 2.0)]) <= 0.01
    exact = (F.col("tonic") == F.col("true_tonic")) & (F.col("minor") == F.col("true_minor"))
    shift = F.when(F.col("true_minor"), 3).otherwise(-3)
    relative = (F.col("minor") != F.col("true_minor")) & (F.pmod(F.col("true_tonic") + shift, F.lit(12)) == F.col("tonic"))
    trim, cents = F.abs(F.col("trim") - F.col("true_trim")), F.abs(F.col("cents") - F.col("true_cents"))
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(err <= 0.01).alias("tempo_ok"), F.count_if((err > 0.01) & octave).alias("octave_errors"), F.avg("f").alias("mean_f"),
        F.count_if(F.col("phase") == F.col("true_phase")).alias("phase_ok"), F.count_if(exact).alias("key_ok"), F.count_if(relative).alias("key_relative"),
        F.count_if(trim <= 0.05).alias("trim_ok"), F.max(trim).alias("worst_trim"), F.avg(cents).alias("mean_cents"),
    )


def coverage(golden: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """K5: cells on one or both sides: added, removed, or their states."""
    g, a = golden.select(*keys, F.col("state").alias("before")), actual.select(*keys, F.col("state").alias("after"))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return g.join(a, keys, "full_outer").withColumn("change", state)


def bench_summary(cases: DataFrame) -> DataFrame:
    """Counts within tolerance, octave errors, beat F and errors, over all cases."""
    err = F.abs(F.col("bpm") / F.col("true_bpm") - 1)
    octave = F.least(*[F.abs(F.col("bpm") / (F.col("true_bpm") * k) - 1) for k in (0.5, 2.0)]) <= 0.01
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(err <= 0.01).alias("tempo_ok"), F.count_if((err > 0.01) & octave).alias("octave_errors"),
        F.avg("f").alias("mean_f"), F.min("f").alias("min_f"), F.avg(err).alias("mean_error"), F.max(err).alias("max_error"),
    )


def votes_to_ratings(votes: DataFrame) -> DataFrame:
    """K9: the first vote of a session rates the winner up and each other strategy down."""
    one = votes.groupBy("session_id").agg(F.min_by(F.struct("winner", "candidates"), F.struct("at", "winner")).alias("v")).select("session_id", "v.*")
    each = one.select("session_id", "winner", F.explode(F.array_distinct("candidates")).alias("strategy"))
    return each.select("session_id", "strategy", F.when(F.col("strategy") == F.col("winner"), 1.0).otherwise(0.0).alias("rating"))


def quota_sample(pairs: DataFrame, sources: list[tuple[str, Column, int]], total: int) -> DataFrame:
    """The best of each source up to its quota, a pair once (its first source), the rest filled in the same order; `pair` is the key.

    The quota is the feature; each source is a top-k, so nothing is ranked over all pairs.
    """
    taken = None
    for turn, (name, order, quota) in enumerate(sources):
        pool = pairs if taken is None else pairs.join(taken.select("pair"), "pair", "left_anti")
        best = pool.orderBy(order, "pair").limit(quota).withColumn("source", F.lit(name)).withColumn("turn", F.lit(turn))
        taken = best if taken is None else together(taken, best)
    return taken.orderBy("turn", "pair").limit(total)


def sweep_axis(lo: float, hi: float, steps: int) -> Column:
    """The points of an axis."""
    return F.array(*[F.lit(lo + (hi - lo) * k / max(1, steps - 1)) for k in range(steps)])


def adjacent_same(df: DataFrame, group: list[str], order: list[str], who: str) -> DataFrame:
    """Neighbours by the same artist; blank names match nobody."""
    w = Window.partitionBy(*group).orderBy(*order)
    name = F.lower(F.trim(F.col(who)))
    same = (name != "") & (name == F.lead(name).over(w))
    return df.select(*group, same.alias("same")).groupBy(*group).agg(F.count_if(F.col("same")).alias("adjacent"))


def grid(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """Every combination of a few axes' values, one exploded literal after another; as many rows as the lists' product."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
    return out


def sweep(runs: DataFrame, axes: list[str], metric: str) -> DataFrame:
    """K8: one metric's points over the grid, in the order of its axes, with the metrics' ids that each run had.

    runs: axes, metric, value, verdict. Points that have no finite value are left out.
    """
    fine = (F.col("metric") == metric) & ~F.isnan("value") & (F.abs("value") != float("inf"))
    points = runs.groupBy(*axes).agg(F.max(F.when(fine, F.col("value"))).alias("value"), F.max(severity(F.col("verdict"))).alias("s"), F.sort_array(F.collect_set("metric")).alias("metrics"))
    return points.filter("value is not null").select(*axes, "value", verdict_of(F.col("s")).alias("worst"), "metrics").orderBy(*axes)


def metric_ids(reports: DataFrame, group: list[str], metric: str, order: list[str]) -> DataFrame:
    """The metric ids of each group as first seen, and how many there are; ids are reduced to their first place before they are gathered."""
    seen = reports.groupBy(*group, metric).agg(F.min(F.struct(*order)).alias("at"))
    held = seen.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("at", F.col(metric).alias("m")))).alias("h"))
    return held.select(*group, F.transform("h", lambda x: x["m"]).alias("metrics"), F.size("h").alias("n"))


def by_strategy(rows: DataFrame, strategy: str, name: str) -> DataFrame:
    """Names grouped by strategy for display, sorted."""
    return rows.groupBy(strategy).agg(F.sort_array(F.collect_set(name)).alias("names"))


def pair_pool(tracks: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """A pool of ordered pairs of different tracks: all of them where there are `most` at most, else about `most` drawn at random.

    The pool's size is the feature. Each track draws its share of partners by rank, so no pair that isn't drawn is made.
    """
    n = tracks.count()
    ranked = tracks.select(F.col(key).alias("k"), F.xxhash64(F.lit(seed), key).alias("h"))
    if n * (n - 1) <= most:
        return ranked.select(F.col("k").alias("a")).join(ranked.select(F.col("k").alias("b")), F.col("a") != F.col("b"))
    slots = 1 << 20
    own = ranked.select("k", F.pmod("h", F.lit(slots)).alias("slot"))
    share = F.lit(most / n)
    draws = F.floor(share).cast("int") + (F.pmod(F.xxhash64(F.lit(seed + 1), "k"), F.lit(1_000_000)) / 1e6 < share - F.floor(share)).cast("int")
    drawn = own.withColumn("d", draws).filter("d > 0").select("k", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("i"))
    drawn = drawn.select(F.col("k").alias("a"), F.pmod(F.xxhash64(F.lit(seed), "k", "i"), F.lit(slots)).alias("want"))
    # The partner is the first track at or after the slot drawn: one sort by slot range, the next slot carried back.
    marks = own.groupBy("slot").agg(F.min("k").alias("b"))
    ranges = 64
    cut = lambda c: F.floor(F.col(c) / (slots // ranges)).cast("int")
    both = drawn.select(cut("want").alias("r"), F.col("want").alias("s"), F.lit(0).alias("kind"), "a", F.lit(None).cast(marks.schema["b"].dataType).alias("b"))
    both = together(both, marks.select(cut("slot").alias("r"), F.col("slot").alias("s"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["b"].dataType).alias("a"), "b"))
    firsts = marks.groupBy(cut("slot").alias("r")).agg(F.min_by("b", "slot").alias("first"))  # 64 rows at most
    ahead = Window.partitionBy("r").orderBy("s", "kind").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("b", F.first("b", ignorenulls=True).over(ahead)).filter("kind = 0")
    later = firsts.select((F.col("r") - 1).alias("r"), F.col("first"))
    found = near.join(F.broadcast(later), "r", "left").select("a", F.coalesce("b", "first").alias("b"))
    return found.filter("b is not null and a <> b").distinct()


def evaluation(rows: DataFrame, strategy: str, limit: float) -> DataFrame:
    """K6: an evaluation's last step: verdicts over all pairs, rates, the strategies chosen, and whether the gate holds.

    rows: strategy, verdict, error. A pair whose rendering failed counts as a FAIL.
    """
    bad = F.col("error").isNotNull() | (F.col("verdict") == "FAIL")
    out = rows.agg(F.count("*").alias("pairs"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(bad).alias("fails"), F.count_if(~bad & (F.col("verdict") == "WARN")).alias("warns"), F.count_distinct(strategy).alias("strategies"))
    rate = lambda n: F.when(F.col("pairs") > 0, F.col(n) / F.col("pairs")).otherwise(0.0)
    return out.select("*", rate("fails").alias("fail_rate"), rate("warns").alias("warn_rate"), (rate("fails") <= limit).alias("passes"))
