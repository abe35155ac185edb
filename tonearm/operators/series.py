"""Time-series operators over long tables (key, i, x), all keys at once (ids E4-E22, C13-C17 and L of the survey).

Every window is partitioned by the series' key, so one series is one task's sort, and no operator looks across keys.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from tonearm.functions.frames import together


#: Ranges that mid_rank() deals all values to.
RANGES = 256


def along(key: str, i: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(i)


def mid_rank(df: DataFrame, x: str, group: list[str] | None = None) -> DataFrame:
    """Quantile of each value among all, ties at their middle; .5 for a single row.

    Values are counted first, so that only distinct values are ranked, range by range, and no window spans all rows.
    A null value has no quantile and counts for none; null group keys are a group of their own.
    """
    keys = group or []
    values = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("__n"))
    if keys:
        below = F.sum("__n").over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
        ranked = values.withColumn("__lo", F.coalesce(below, F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    else:
        cuts = values.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)])).first()[0] or []  # RANGES - 1 numbers
        edges = F.lit([float(c) for c in cuts]).cast("array<double>")
        ranges = values.withColumn("__part", F.size(F.filter(edges, lambda c: c < F.col(x).cast("double"))))
        within = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = ranges.groupBy("__part").agg(F.sum("__n").alias("__sum"))  # RANGES rows at most
        before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__sum").over(Window.partitionBy()))
        ranked = ranges.withColumn("__in", within).join(F.broadcast(before.drop("__sum")), "__part").withColumn("__lo", F.col("__before") + F.col("__in"))
    rank = F.when(F.col("__all") <= 1, 0.5).otherwise((F.col("__lo") + (F.col("__n") - 1) / 2) / (F.col("__all") - 1))
    found = ranked.select(*[F.col(c).alias(f"__{c}") for c in (*keys, x)], rank.alias("quantile"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys] + [F.col(x) == F.col(f"__{x}")]
    return df.join(found, reduce(Column.__and__, same), "left").drop(*[f"__{c}" for c in (*keys, x)])


def block_rms(df: DataFrame, key: str, i: str, x: str, width: int) -> DataFrame:
    """L1: root mean square of whole blocks."""
    block = F.floor(F.col(i) / width).alias("block")
    return df.groupBy(key, block).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.count("*").alias("n")).filter(F.col("n") == width).drop("n")


def moving_mean(df: DataFrame, key: str, i: str, x: str, width: int) -> DataFrame:
    """Mean of the last `width` rows, full windows only."""
    w = along(key, i).rowsBetween(-(width - 1), 0)
    return df.withColumn("mean", F.avg(x).over(w)).withColumn("__n", F.count("*").over(w)).filter(F.col("__n") == width).drop("__n")


def hold_step(df: DataFrame, key: str, i: str, x: str, hold: int = 3) -> DataFrame:
    """The step that holds for `hold` rows on both sides: least after less largest before, or the other way, whichever is larger."""
    after, before = along(key, i).rowsBetween(0, hold - 1), along(key, i).rowsBetween(-hold, -1)
    full = (F.count("*").over(after) == hold) & (F.count("*").over(before) == hold)
    up = F.min(x).over(after) - F.max(x).over(before)
    down = F.min(x).over(before) - F.max(x).over(after)
    return df.withColumn("step", F.when(full, F.greatest(F.lit(0.0), up, down)))


def local_rms(df: DataFrame, key: str, i: str, rms: str, n: str, width: int) -> DataFrame:
    """Root mean square of the blocks around each block, without its own, by their sample counts."""
    w = along(key, i).rowsBetween(-width, width)
    energy = F.col(rms) * F.col(rms) * F.col(n)
    rest = F.sum(F.col(n)).over(w) - F.col(n)
    return df.withColumn("around", F.when(rest > 0, F.sqrt(F.greatest(F.lit(0.0), F.sum(energy).over(w) - energy) / rest)))


def differences(df: DataFrame, key: str, i: str, x: str, span: int = 5) -> DataFrame:
    """First difference, and second difference at a span."""
    w = along(key, i)
    return df.withColumn("d1", F.col(x) - F.lag(x).over(w)).withColumn("d2", F.lag(x, span).over(w) - 2 * F.col(x) + F.lead(x, span).over(w))


def prefix_energy(df: DataFrame, key: str, i: str, x: str) -> DataFrame:
    """E14."""
    return df.withColumn("energy", F.sum(F.col(x) * F.col(x)).over(along(key, i).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, key: str, i: str, hit: Column) -> DataFrame:
    """Runs of rows for which `hit` holds: (key, start, end, length), with whether they touch an end of the series."""
    whole = Window.partitionBy(key)
    step = df.select(key, F.col(i).alias("i"), hit.alias("hit"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("i"))
    step = step.select("*", place.alias("place"), F.count("*").over(whole).alias("n"))
    step = step.filter("hit").withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    runs = step.groupBy(key, "island").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("length"), F.min("place").alias("p0"), F.max("place").alias("p1"), F.first("n").alias("n"))
    return runs.select(key, "start", "end", "length", ((F.col("p0") == 1) | (F.col("p1") == F.col("n"))).alias("at_end"))


def silence_gap(df: DataFrame, key: str, i: str, hit: Column) -> DataFrame:
    """The longest silent run inside each series."""
    return islands(df, key, i, hit).filter("not at_end").groupBy(key).agg(F.max("length").alias("gap"))


def running_max(df: DataFrame, key: str, i: str, x: str, width: int, floor: float = 0.1) -> DataFrame:
    """X over the largest value around it, the divisor floored at a share of the series' largest."""
    near = F.max(x).over(along(key, i).rowsBetween(-width, width))
    whole = F.max(x).over(Window.partitionBy(key))
    by = F.greatest(near, floor * whole)
    return df.withColumn("scaled", F.when(by > 0, F.col(x) / by).otherwise(0.0))


def peaks(df: DataFrame, key: str, i: str, x: str, width: int, k: float, distance: int = 0, strict: bool = False) -> DataFrame:
    """Local maxima above mean + k deviations around them; within `distance` the larger ones win, in order of height.

    The last of several equal values counts as the maximum, with `strict` none of them.
    """
    w, near = along(key, i), along(key, i).rowsBetween(-width, width)
    before, after = (F.coalesce(c.over(w), F.lit(float("-inf"))) for c in (F.lag(x), F.lead(x)))
    rise = F.col(x) > before if strict else F.col(x) >= before
    fall = F.col(x) > after
    high = F.col(x) > F.avg(x).over(near) + k * F.coalesce(F.stddev_pop(x).over(near), F.lit(0.0))
    found = df.withColumn("__peak", rise & fall & high).filter("__peak").drop("__peak")
    if distance <= 1:
        return found

    def spaced(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[float] = []
        keep = []
        for place in rows.sort_values([x, i], ascending=[False, True]).index:
            at = rows.at[place, i]
            if all(abs(at - t) >= distance for t in taken):
                taken.append(at)
                keep.append(place)
        return rows.loc[sorted(keep)]

    return found.groupBy(key).applyInPandas(spaced, found.schema)


def spaced_first(df: DataFrame, key: str, i: str, gap: int) -> DataFrame:
    """Of rows closer than `gap` to the last one kept, only the first; a running rule, so one series at a time."""

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows, last, keep = rows.sort_values(i), None, []
        for at in rows[i]:
            keep.append(last is None or at - last >= gap)
            last = at if keep[-1] else last
        return rows[keep]

    return df.groupBy(key).applyInPandas(first, df.schema)


def smoothed(df: DataFrame, key: str, i: str, x: str) -> DataFrame:
    """Median of three points; ends stay as they are."""
    w = along(key, i)
    three = F.array(F.lag(x).over(w), F.col(x), F.lead(x).over(w))
    return df.withColumn("smooth", F.when(F.exists(three, lambda v: v.isNull()), F.col(x)).otherwise(F.get(F.sort_array(three), 1)))


def without_outliers(df: DataFrame, key: str, x: str, k: float = 3.0) -> DataFrame:
    """Rows within k median absolute deviations of their series' median; rows of a null key are a series too, null values go."""

    def beside(rows: DataFrame, value: Column, name: str) -> DataFrame:
        found = rows.groupBy(F.col(key).alias("__key")).agg(F.percentile(value, 0.5).alias(name))
        return rows.join(found, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")

    spread = beside(beside(df, F.col(x), "__m"), F.abs(F.col(x) - F.col("__m")), "__d")
    return spread.filter(F.abs(F.col(x) - F.col("__m")) <= k * 1.4826 * F.col("__d")).drop("__m", "__d")


def largest_jump(df: DataFrame, key: str, i: str, x: str) -> DataFrame:
    """Where the series rises most between neighbours; only rises count."""
    rise = df.withColumn("jump", F.col(x) - F.lag(x).over(along(key, i))).filter("jump > 0")
    return rise.groupBy(key).agg(F.max_by(i, F.struct("jump", (-F.col(i)).alias("first"))).alias("at"), F.max("jump").alias("jump"))


def first_last(df: DataFrame, key: str, i: str, hit: Column) -> DataFrame:
    """First and last row for which a predicate holds."""
    return df.groupBy(key).agg(F.min(F.when(hit, F.col(i))).alias("first"), F.max(F.when(hit, F.col(i))).alias("last"))


def as_of(points: DataFrame, grid: DataFrame, key: str, at: str, frame: str, beat: str) -> DataFrame:
    """The (fractional) beat at each point: interpolated between beats, extrapolated at the edges.

    One sort per key of the union of both, the last beat before and the first after carried along: no range join.
    """
    a = points.select(key, F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("b"), F.struct(*points.columns).alias("row"))
    g = grid.select(key, F.col(frame).alias("t"), F.lit(0).alias("kind"), F.col(beat).cast("double").alias("b"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    whole = together(a, g)
    order = Window.partitionBy(key).orderBy("t", "kind")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    mark = F.when(F.col("kind") == 0, F.struct("t", "b"))
    second = F.lag(mark).over(Window.partitionBy(key, "kind").orderBy("t"))
    third = F.lead(mark).over(Window.partitionBy(key, "kind").orderBy("t"))
    whole = whole.withColumn("mark", mark).withColumn("before", F.when(F.col("kind") == 0, second)).withColumn("after", F.when(F.col("kind") == 0, third))
    spot = F.when(F.col("kind") == 0, F.struct("mark", "before", "after"))
    whole = whole.withColumn("p", F.last(spot, True).over(back)).withColumn("n", F.first(spot, True).over(ahead)).filter("kind = 1")
    lo = F.when(F.col("p").isNull(), F.col("n.mark")).when(F.col("n").isNull(), F.coalesce(F.col("p.before"), F.col("p.mark"))).otherwise(F.col("p.mark"))
    hi = F.when(F.col("p").isNull(), F.coalesce(F.col("n.after"), F.col("n.mark"))).when(F.col("n").isNull(), F.col("p.mark")).otherwise(F.col("n.mark"))
    whole = whole.withColumn("lo", lo).withColumn("hi", hi)
    span = F.col("hi.t").cast("double") - F.col("lo.t").cast("double")
    value = F.when(span == 0, F.col("lo.b")).otherwise(F.col("lo.b") + (F.col("t").cast("double") - F.col("lo.t").cast("double")) / span * (F.col("hi.b") - F.col("lo.b")))
    return whole.select("row.*", value.alias("beat"))


def nearest_within(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, tolerance: float) -> DataFrame:
    """For each point the nearest mark within the tolerance, reuse allowed; a band join on buckets as wide as the tolerance."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    m = marks.select(F.col(key).alias("__k"), F.col(mark).alias("__m"), F.explode(F.array(bucket(mark) - 1, bucket(mark), bucket(mark) + 1)).alias("__b"))
    d = F.abs(F.col(at) - F.col("__m"))
    near = points.select(key, at).distinct().withColumn("__b2", bucket(at)).join(m, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__b2"))).filter(d <= tolerance)
    best = near.groupBy(key, at).agg(F.min_by("__m", F.struct(d.alias("d"), F.col("__m").alias("m"))).alias("nearest"))
    return points.join(best, [key, at], "left")


def away_from(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, guard: float) -> DataFrame:
    """C17: points without a mark within the guard."""
    return nearest_within(points, marks, key, at, mark, guard).filter("nearest is null").drop("nearest")


def matched_within(truth: DataFrame, found: DataFrame, key: str, at: str, tolerance: float) -> DataFrame:
    """One-to-one matches: each true event, in order, takes the nearest free estimate within the tolerance; series by series."""
    both = together(truth.select(key, at, F.lit(True).alias("true")), found.select(key, at, F.lit(False).alias("true")))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        free = np.sort(rows.loc[~rows["true"], at].to_numpy(float))
        taken, hits, low = np.zeros(len(free), bool), 0, 0
        for t in np.sort(rows.loc[rows["true"], at].to_numpy(float)):
            while low < len(free) and (taken[low] or free[low] < t - tolerance):  # never near a later event either
                low += 1
            end = int(np.searchsorted(free, t + tolerance, "right"))
            near = np.flatnonzero(~taken[low:end]) + low
            if len(near):
                taken[near[int(np.argmin(np.abs(free[near] - t)))]] = True  # of equal distances the earlier one
                hits += 1
        n_true, n_found = int(rows["true"].sum()), int((~rows["true"]).sum())
        p, r = (hits / n if n else 0.0 for n in (n_found, n_true))
        return pd.DataFrame({key: [rows[key].iloc[0]], "hits": [hits], "precision": [p], "recall": [r], "f": [2 * p * r / (p + r) if p + r else 0.0]})

    return both.groupBy(key).applyInPandas(match, f"{key} {dict(truth.dtypes)[key]}, hits long, precision double, recall double, f double")


def gated_loudness(df: DataFrame, key: str, power: str, absolute: float, relative: float) -> DataFrame:
    """Mean power over the absolute gate, then over the relative gate below that mean."""
    loud = df.filter(F.col(power) > absolute)
    first = loud.withColumn("__mean", F.avg(power).over(Window.partitionBy(key)))
    return first.filter(F.col(power) > F.col("__mean") * relative).groupBy(key).agg(F.avg(power).alias("loudness"), F.count("*").alias("blocks"))


def loudness_range(df: DataFrame, key: str, i: str, level: str) -> DataFrame:
    """10th to 95th value by rounded index, of the levels within 20 of their series' mean.

    The mean is summed along the series, so a level that lies on the gate does not depend on how rows arrive.
    """
    whole = along(key, i).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gated = df.withColumn("__mean", F.avg(level).over(whole)).filter(F.col(level) >= F.col("__mean") - 20)
    values = gated.groupBy(key).agg(F.sort_array(F.collect_list(level)).alias("v"))
    at = lambda q: F.get("v", F.floor(q * (F.size("v") - 1) + 0.5).cast("int"))
    return values.select(key, (at(0.95) - at(0.10)).alias("range"))


def fade(df: DataFrame, key: str, i: str, level: str, tail: float) -> DataFrame:
    """Slope and range of the level over the last `tail` of each series."""
    last = df.withColumn("__end", F.max(i).over(Window.partitionBy(key))).filter(F.col(i) > F.col("__end") - tail)
    return last.groupBy(key).agg(F.regr_slope(level, i).alias("slope"), (F.max(level) - F.min(level)).alias("range"), F.count("*").alias("n"))


def min_max_bins(df: DataFrame, key: str, i: str, x: str, bins: int) -> DataFrame:
    """Least and largest value of each of a fixed number of display bins."""
    n = df.join(df.groupBy(key).agg((F.max(i) + 1).alias("__n")), key)
    return n.groupBy(key, F.floor(F.col(i) * bins / F.col("__n")).cast("int").alias("bin")).agg(F.min(x).alias("low"), F.max(x).alias("high"))


def phase(df: DataFrame, key: str, beat: str, x: str, period: int) -> DataFrame:
    """The phase of largest mean, and its margin over the next."""
    means = df.groupBy(key, F.pmod(F.col(beat), F.lit(period)).cast("int").alias("phase")).agg(F.avg(x).alias("mean"))
    ranked = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), "phase"))).alias("r"))
    return ranked.select(key, F.col("r")[0]["phase"].alias("phase"), F.when(F.size("r") > 1, F.get("r", 1)["m"] - F.get("r", 0)["m"]).otherwise(0.0).alias("margin"))


def line_fit(df: DataFrame, key: str, i: str, x: str, weight: str | None = None) -> DataFrame:
    """Weighted least squares x = slope i + start, from sums alone."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = df.groupBy(key).agg(F.sum(w).alias("w"), F.sum(w * F.col(i)).alias("wi"), F.sum(w * F.col(x)).alias("wx"), F.sum(w * F.col(i) * F.col(i)).alias("wii"), F.sum(w * F.col(i) * F.col(x)).alias("wix"))
    d = F.col("w") * F.col("wii") - F.col("wi") * F.col("wi")
    slope = F.when(d != 0, (F.col("w") * F.col("wix") - F.col("wi") * F.col("wx")) / d)
    return s.select(key, slope.alias("slope"), ((F.col("wx") - slope * F.col("wi")) / F.col("w")).alias("start"))


#: What every beat weighs beside its support, what support and how many beats make a seed, re-fits after the first, how many deviations and how many seconds from the line a beat may be, milliseconds and share of the weight of a rigid grid.
WEIGHT_FLOOR, SEED_SUPPORT, SEED_BEATS, REFITS, DEVIATIONS, LEAST_CUT, RIGID_MS, RIGID_SHARE = 0.05, 0.25, 8, 3, 3 * 1.4826, 0.006, 8.0, 0.7


def robust_fit(df: DataFrame, key: str, i: str, x: str, support: str) -> DataFrame:
    """The grid of every series of beats: (key, kind RIGID or FLEX, period, start, residual_ms, share, bpm).

    Weighted least squares x = period i + start. The first fit takes the heaviest run of well-supported beats, where
    there is one; each re-fit takes the beats within a weighted median deviation of the line before. All series are
    fitted at once: the re-fits are windows by one key, unrolled, so there is one shuffle. A grid is rigid if little is
    left between its beats and the line, and most of the weight is on it; only then it has a tempo of its own.
    """
    one = Window.partitionBy(key)
    w = F.col("w")
    rows = df.select(key, F.col(i).cast("double").alias("i"), F.col(x).cast("double").alias("x"), (F.coalesce(F.col(support).cast("double"), F.lit(0.0)) + WEIGHT_FLOOR).alias("w"))
    strong = w - WEIGHT_FLOOR >= SEED_SUPPORT
    rows = rows.withColumn("run", F.when(strong, F.row_number().over(one.orderBy("i")) - F.sum(strong.cast("int")).over(one.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))))
    run = Window.partitionBy(key, "run")
    seed = F.when(F.col("run").isNotNull() & (F.count("*").over(run) >= SEED_BEATS), F.struct(F.round(F.sum("w").over(run), 9).alias("w"), (-F.min("i").over(run)).alias("first")))
    rows = rows.withColumn("seed", seed).withColumn("best", F.max("seed").over(one))
    rows = rows.select(key, "i", "x", "w", F.sum("w").over(one).alias("all"), (F.col("best").isNull() | F.col("seed").eqNullSafe(F.col("best"))).alias("inside"), *[F.lit(None).cast("double").alias(c) for c in ("period", "start", "residual", "on")])
    for turn in range(REFITS + 1):
        on = lambda c: F.sum(F.when(F.col("inside"), c)).over(one)
        sums = {"sw": on(w), "sk": on(w * F.col("i")), "st": on(w * F.col("x")), "skk": on(w * F.col("i") * F.col("i")), "skt": on(w * F.col("i") * F.col("x")), "n": F.count_if("inside").over(one)}
        rows = rows.withColumns(sums).withColumn("d", F.col("sw") * F.col("skk") - F.col("sk") * F.col("sk"))
        fits = (F.col("n") >= 2) & (F.col("d") > 1e-12)
        period = F.when(fits, (F.col("sw") * F.col("skt") - F.col("sk") * F.col("st")) / F.col("d")).otherwise(F.col("period"))
        rows = rows.withColumn("period", period).withColumn("start", F.when(fits, (F.col("st") - F.col("period") * F.col("sk")) / F.col("sw")).otherwise(F.col("start")))
        rows = rows.withColumn("res", F.abs(F.col("x") - (F.col("start") + F.col("period") * F.col("i"))))
        left = F.sqrt(F.sum(F.when(F.col("inside"), w * F.col("res") * F.col("res"))).over(one) / F.col("sw")) * 1000
        rows = rows.withColumn("residual", F.when(fits, left).otherwise(F.col("residual"))).withColumn("on", F.when(fits, F.col("sw")).otherwise(F.col("on")))
        if turn < REFITS:
            so_far = F.sum("w").over(one.orderBy("res", "i").rowsBetween(Window.unboundedPreceding, 0))
            rows = rows.withColumn("mid", F.when(so_far >= F.col("all") / 2, F.col("res")))
            cut = F.greatest(DEVIATIONS * F.min("mid").over(one), F.lit(LEAST_CUT))
            rows = rows.withColumn("inside", F.when(fits, F.col("res") <= cut).otherwise(F.col("inside")))
        rows = rows.select(key, "i", "x", "w", "all", "inside", "period", "start", "residual", "on")
    found = rows.groupBy(key).agg(*[F.first(c).alias(c) for c in ("period", "start", "residual", "on", "all")])
    share = F.coalesce(F.col("on") / F.col("all"), F.lit(0.0))
    rigid = F.coalesce((F.col("period") > 0) & (F.col("residual") < RIGID_MS) & (share >= RIGID_SHARE), F.lit(False))
    return found.select(key, F.when(rigid, "RIGID").otherwise("FLEX").alias("kind"), "period", "start", F.col("residual").alias("residual_ms"), share.alias("share"), F.when(rigid, 60 / F.col("period")).alias("bpm"))


def z_scored(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns less their series' mean, over its deviation (0 where it has none)."""
    w = Window.partitionBy(key)
    return df.withColumns({f"{c}_z": F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0) for c in columns})


def novelty(df: DataFrame, key: str, i: str, features: list[str], kernel: int) -> DataFrame:
    """Checkerboard novelty along the diagonal of the self-similarity matrix.

    Each row sees the 2 kernel vectors around it through one window; unit vectors make the kernel's sum the difference
    of two sums, |before|^2 + |after|^2 - 2 before . after, so nothing is joined and no pair is built.
    """
    v = F.array(*[F.col(c).cast("double") for c in features])
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    norm = F.sqrt(total(v, lambda x: x * x))
    unit = df.select(key, F.col(i).alias("i"), F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("u"))
    order = along(key, "i")
    side = {}
    for name, lo, hi in (("before", -kernel, -1), ("after", 0, kernel - 1)):
        side[name] = F.array(*[F.coalesce(F.sum(F.col("u")[d]).over(order.rowsBetween(lo, hi)), F.lit(0.0)) for d in range(len(features))])
    summed = unit.select(key, "i", side["before"].alias("before"), side["after"].alias("after"))
    product = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y), lambda z: z)
    score = product("before", "before") + product("after", "after") - 2 * product("before", "after")
    return summed.select(key, "i", (score / (4 * kernel * kernel)).alias("novelty"))


def autocorrelation(df: DataFrame, key: str, i: str, x: str, lags: list[int]) -> DataFrame:
    """Mean product of a series with itself at each lag; one pass, as the lags are few."""
    w = along(key, i)
    step = df.select(key, i, x, *[F.lead(x, n).over(w).alias(f"__l{n}") for n in lags])
    sums = step.groupBy(key).agg(*[F.avg(F.col(x) * F.col(f"__l{n}")).alias(f"__a{n}") for n in lags])
    return sums.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"__a{n}").alias("r")) for n in lags])).alias("z")).select(key, "z.*")


def tracked_beats(df: DataFrame, key: str, i: str, x: str, period: float, tightness: float = 100.0) -> DataFrame:
    """Beats by dynamic programming over onset strengths; a running rule, so one series is one group."""
    def track(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(i)
        v = rows[x].to_numpy(float)
        score, back = v.copy(), np.full(len(v), -1)
        lo, hi = max(1, round(period / 2)), round(2 * period)
        for t in range(len(v)):
            past = np.arange(max(0, t - hi), max(0, t - lo + 1))
            if len(past):
                tried = score[past] - tightness * np.log((t - past) / period) ** 2
                best = int(np.argmax(tried))
                if tried[best] > 0:
                    score[t], back[t] = v[t] + tried[best], past[best]
        beats, t = [], int(np.argmax(score)) if len(v) else -1
        while t >= 0:
            beats.append(t)
            t = back[t]
        beats = beats[::-1]
        return pd.DataFrame({key: rows[key].iloc[0], "beat": range(len(beats)), i: rows[i].to_numpy()[beats]})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(track, f"{key} {kinds[key]}, beat long, {i} {kinds[i]}")


def artifact_events(df: DataFrame, key: str, i: str, x: str, jump: float, silent: float, clip: float) -> DataFrame:
    """(key, kind, start, length, value): level jumps, clipped runs, silent gaps."""
    steps = hold_step(df, key, i, x).filter(F.col("step") > jump).select(key, F.lit("level_jump").alias("kind"), F.col(i).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.col("step").alias("value"))
    clipped = islands(df, key, i, F.col(x) >= clip).select(key, F.lit("clip").alias("kind"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.lit(clip).alias("value"))
    gaps = islands(df, key, i, F.col(x) <= silent).filter("not at_end").select(key, F.lit("silence").alias("kind"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.lit(silent).alias("value"))
    return together(steps, clipped, gaps)


def chroma(peaks_: DataFrame, key: str, hertz: str, power: str, harmonics: int = 4) -> DataFrame:
    """Pitch-class energy of spectral peaks, each counted for the notes it may be a harmonic of, normalised."""
    parts = peaks_.select(key, power, F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("h"), F.col(hertz).alias("__f"))
    note = F.pmod(F.floor(12 * F.log2(F.col("__f") / F.col("h") / 440.0) + 9.5), F.lit(12)).cast("int")
    sums = parts.groupBy(key, note.alias("pc")).agg(F.sum(F.col(power) / F.col("h")).alias("energy"))
    whole = F.sum("energy").over(Window.partitionBy(key))
    return sums.withColumn("energy", F.when(whole > 0, F.col("energy") / whole).otherwise(0.0))


#: Key profiles of Krumhansl and Kessler, from the tonic on.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def key_correlations(chroma_: DataFrame, key: str) -> DataFrame:
    """(key, tonic, minor, r): correlation of each chroma with the 24 rotated profiles."""
    spark = chroma_.sparkSession
    rows = [(t, m, pc, float(p[(pc - t) % 12])) for m, p in ((False, MAJOR), (True, MINOR)) for t in range(12) for pc in range(12)]
    profiles = spark.createDataFrame(rows, "tonic int, minor boolean, pc int, weight double")  # 288 fixed rows
    return chroma_.join(F.broadcast(profiles), "pc").groupBy(key, "tonic", "minor").agg(F.corr("energy", "weight").alias("r"))


def key_estimate(chroma_: DataFrame, key: str) -> DataFrame:
    """The best of 24 rotated profiles by correlation; strength (r + 1) / 2, and the margin over the runner-up."""
    r = key_correlations(chroma_, key)
    ranked = r.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("n"), "tonic", "minor"))).alias("__k"))
    first, second = F.get("__k", 0), F.get("__k", 1)
    return ranked.select(key, first["tonic"].alias("tonic"), first["minor"].alias("minor"), ((1 - first["n"]) / 2).alias("strength"), (second["n"] - first["n"]).alias("margin"))
