"""Beats, bars, sections, tempo and spectra of all tracks at once (ids C14, D23, E17, I2, L16, L18, L23, L24, L26, L29-L31, L33).

Tables are long (key, beat or bar or frame, values); what looks along a track is partitioned by its key.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.music import bar_of_beat, coerce, nearest_start, parabolic, slice_mean, sorted_quantile
from tonearm.functions.frames import together

#: What counts as drums there or absent, as voices, and the shares of the section rules.
DRUMS_PRESENT, DRUMS_ABSENT, VOCALS_PRESENT = 0.5, 0.35, 0.5
LOW_ENERGY, OUTRO_DROP, TOP_QUANTILE, DROP_JUMP, BUILD_RISE = 0.6, 0.8, 0.75, 0.2, 0.15
#: Third-octave bands from 20 Hz to 20 kHz; the 18th is at 1 kHz.
BANDS, BAND_OF_1K = 31, 17


def spread(beats: DataFrame, bars: DataFrame, key: str, beat: str, bar: str, values: list[str], phase: Column, per_bar: int = 4) -> DataFrame:
    """C14: each beat with its bar's values; beats before the first or after the last bar have those of the nearest: an equi-join on the clamped bar."""
    ends = bars.groupBy(key).agg(F.min(bar).alias("__lo"), F.max(bar).alias("__hi"))
    placed = beats.join(ends, key).withColumn("__bar", F.greatest("__lo", F.least("__hi", bar_of_beat(F.col(beat), phase, per_bar))))
    held = bars.select(key, F.col(bar).alias("__bar"), *values)
    return placed.join(held, [key, "__bar"], "left").drop("__lo", "__hi", "__bar")


def edge_means(bars: DataFrame, tracks: DataFrame, key: str, bar: str, values: list[str], window: int = 8) -> DataFrame:
    """Means over the window of bars before a track's mix-out and from its mix-in on: tail_x, head_x.

    tracks: key, out_bar, in_bar (null: the end, the start). A tail that would be empty is the first window; a head ends
    no later than the track.
    """
    n = bars.groupBy(key).agg((F.max(bar) + 1).alias("__n"))
    t = tracks.join(n, key)
    end = F.greatest(F.lit(0), F.least(F.coalesce("out_bar", "__n"), F.col("__n")))
    empty = end <= 0
    head = F.greatest(F.coalesce("in_bar", F.lit(0)), F.lit(0))
    head = F.when(head > F.col("__n") - window, F.greatest(F.lit(0), F.col("__n") - window)).otherwise(head)
    spans = t.select(key, F.when(empty, 0).otherwise(F.greatest(F.lit(0), end - window)).alias("t0"), F.when(empty, F.least("__n", F.lit(window))).otherwise(end).alias("t1"), head.alias("h0"), F.least("__n", head + window).alias("h1"))
    inside = lambda a, b: (F.col(bar) >= F.col(a)) & (F.col(bar) < F.col(b))
    means = [F.avg(F.when(inside(a, b), F.col(v))).alias(f"{name}_{v}") for name, a, b in (("tail", "t0", "t1"), ("head", "h0", "h1")) for v in values]
    return bars.join(spans, key).groupBy(key).agg(*means)


def rooms(beats: Column, last_downbeat: Column, first_downbeat: Column, mix_out: Column, mix_in: Column, first_section_end: Column, per_bar: int = 4) -> Column:
    """(outro_beats, intro_beats) of a track, -1 meaning an unknown cue.

    Without a mix-out, sixteen bars before the last downbeat; without a mix-in, the first section's end, else eight bars.
    """
    last = F.when(last_downbeat >= 0, last_downbeat).otherwise(beats - 1)
    out = F.when(mix_out >= 0, mix_out).otherwise(F.greatest(F.lit(0), last - 16 * per_bar))
    into = F.when(mix_in >= 0, mix_in).when(first_section_end.isNotNull(), first_section_end).otherwise(8 * per_bar)
    none = beats <= 0
    return F.struct(
        F.when(none, 0).otherwise(F.greatest(F.lit(0), last - out)).cast("int").alias("outro_beats"),
        F.when(none, 0).otherwise(F.least(beats, F.greatest(F.lit(0), into - F.greatest(F.lit(0), first_downbeat)))).cast("int").alias("intro_beats"),
    )


def sections(beats: DataFrame, bounds: DataFrame, key: str, beat: str, start: str, energy: str, drums: str, vocals: str) -> DataFrame:
    """(key, section, start, end, label, energy, drums, vocals) of the sections that begin at `bounds`.

    Beats are dealt to sections by one sort of both (the last start carried along), means are summed along the section, so
    they do not depend on how its beats are grouped, and labels come from each section, its neighbours and its track's
    largest and upper-quartile energy.
    """
    marks = bounds.select(key, F.col(start).alias("b"), F.lit(0).alias("kind"), *[F.lit(None).cast("double").alias(v) for v in ("e", "d", "v")])
    rows = beats.select(key, F.col(beat).alias("b"), F.lit(1).alias("kind"), F.col(energy).cast("double").alias("e"), F.col(drums).cast("double").alias("d"), F.col(vocals).cast("double").alias("v"))
    w = Window.partitionBy(key).orderBy("b", "kind").rowsBetween(Window.unboundedPreceding, 0)
    dealt = together(marks, rows).withColumn("start", F.last(F.when(F.col("kind") == 0, F.col("b")), True).over(w)).filter("kind = 1 and start is not null")
    held = dealt.groupBy(key, "start").agg((F.max("b") + 1).alias("end"), F.sort_array(F.collect_list(F.struct("b", "e", "d", "v"))).alias("beats"))
    of = lambda c: F.transform("beats", lambda x: x[c])
    held = held.select(key, "start", "end", of("e").alias("es"), *[F.filter(of(c), lambda x: x.isNotNull()).alias(c) for c in ("e", "d", "v")])
    held = held.select(key, "start", "end", "es", *[slice_mean(F.col(c), F.lit(0), F.size(c)).alias(n) for c, n in (("e", "energy"), ("d", "drums"), ("v", "vocals"))])
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("start")
    es = F.col("es")
    n = F.size("es")
    part = F.floor(n / 4).cast("int")
    rise = F.when(n >= 4, F.coalesce(slice_mean(es, n - part, n) - slice_mean(es, F.lit(0), part), F.lit(0.0)) >= BUILD_RISE).otherwise(False)
    step = held.select(key, "start", "end", "energy", "drums", "vocals", rise.alias("rises"), (F.row_number().over(order) - 1).alias("section"), F.count("*").over(whole).alias("n"), F.max("energy").over(whole).alias("most"), F.sort_array(F.collect_list("energy").over(whole)).alias("all"))
    step = step.withColumn("top", (F.col("energy") >= sorted_quantile(F.col("all"), TOP_QUANTILE)) & (F.col("most") > 0))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.col(c))
    step = step.withColumns({"pe": before("energy"), "pd": before("drums"), "next_top": F.coalesce(F.lead("top").over(order), F.lit(False))})
    e, d, i, many = F.col("energy"), F.col("drums"), F.col("section"), F.col("n") >= 2
    low = e < LOW_ENERGY * F.col("most")
    label = (
        F.when((i == 0) & many & (low | (d < DRUMS_ABSENT)), "INTRO")
        .when((i == F.col("n") - 1) & many & ((e < OUTRO_DROP * F.col("pe")) | low | ((d < DRUMS_ABSENT) & (F.col("pd") >= DRUMS_ABSENT))), "OUTRO")
        .when(F.col("top") & (d >= DRUMS_ABSENT) & (i > 0) & (e - F.col("pe") >= DROP_JUMP), "DROP")
        .when(F.col("top"), "CHORUS")
        .when((i > 0) & (i < F.col("n") - 1) & low & (d < DRUMS_ABSENT), "BREAKDOWN")
        .when(F.col("next_top") & F.col("rises"), "BUILD")
        .otherwise("VERSE")
    )
    return step.select(key, i.cast("int").alias("section"), "start", "end", label.alias("label"), "energy", "drums", "vocals")


def boundaries(peaks: DataFrame, key: str, beat: str, beats: Column, phase: Column, per_bar: int = 4) -> DataFrame:
    """(key, start): 0 and the peaks of novelty snapped to their nearest downbeat, inside the track, each once."""
    snapped = peaks.select(key, nearest_start(F.col(beat), phase, per_bar).alias("start"), beats.alias("__n")).filter((F.col("start") > 0) & (F.col("start") < F.col("__n"))).select(key, "start")
    return together(snapped, peaks.select(key, F.lit(0).cast("long").alias("start"))).distinct()


def last_mean(i: str, x: str, end: str, n: int) -> Column:
    """The mean of a series' last n values, summed along the series: an aggregate that does not depend on how rows arrive."""
    held = F.sort_array(F.collect_list(F.when(F.col(i) > F.col(end) - n, F.struct(F.col(i).alias("i"), F.col(x).cast("double").alias("x")))))
    return slice_mean(F.transform(held, lambda z: z["x"]), F.lit(0), F.size(held))


def intro_type(first: Column, body: Column, head_energy: Column, head_drums: Column, trim_seconds: Column, has_vocals: Column) -> Column:
    """The kind of a track's opening, by the first rule that holds; first: struct of energy, drums, vocals of the first section."""
    return (
        F.when(body.isNull() | (body <= 0), "UNKNOWN").when((trim_seconds > 1.0) & (first["energy"] < 0.1), "SILENCE").when((head_drums >= DRUMS_PRESENT) & (head_energy >= 0.7 * body), "COLD_START")
        .when(has_vocals & (first["vocals"] >= VOCALS_PRESENT) & (first["drums"] < DRUMS_ABSENT), "VOCAL_INTRO").when(first["drums"] < DRUMS_ABSENT, "AMBIENT_INTRO").when(first["energy"] < 0.85 * body, "BEAT_INTRO").otherwise("UNKNOWN")
    )


def outro_type(last: Column, body: Column, tail_drums: Column, fade_out: Column, hard_stop: Column, has_vocals: Column) -> Column:
    """The kind of a track's ending, by the first rule that holds."""
    return (
        F.when(fade_out, "FADE_OUT").when(hard_stop, "HARD_STOP").when(body.isNull() | (body <= 0), "UNKNOWN").when(has_vocals & (last["vocals"] >= VOCALS_PRESENT) & (last["drums"] < DRUMS_ABSENT), "VOCAL_OUTRO")
        .when((last["drums"] < DRUMS_ABSENT) | (tail_drums < DRUMS_ABSENT), "AMBIENT_OUTRO").when(tail_drums >= DRUMS_PRESENT, "BEAT_OUTRO").otherwise("UNKNOWN")
    )


def metrical_level(strengths: DataFrame, key: str, beat: str, low: str, mid: str, broad: str, bpm: Column, block: int = 8) -> DataFrame:
    """(key, low_balance, broad_balance, mid_ratio, high_ratio, halve): is the tracked level twice the beat?

    strengths: flux at each beat by band. In whole blocks of beats, the sums at even and odd places are compared; the
    parity with more low flux counts as the beat. All are sums by block, then by track.
    """
    high = F.greatest(F.lit(0.0), F.col(broad) - F.col(low) - F.col(mid))
    odd = F.pmod(F.col(beat), F.lit(block)) % 2 == 1
    sides = [F.sum(F.when(odd if o else ~odd, x)).alias(f"{n}{int(o)}") for n, x in (("l", F.col(low)), ("m", F.col(mid)), ("b", F.col(broad)), ("h", high)) for o in (False, True)]
    blocks = strengths.groupBy(key, F.floor(F.col(beat) / block).alias("__b")).agg(*sides, F.count("*").alias("n")).filter(F.col("n") == block)
    even_first = F.col("l0") >= F.col("l1")
    on = lambda n: F.when(even_first, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
    off = lambda n: F.when(even_first, F.col(f"{n}1")).otherwise(F.col(f"{n}0"))
    both = lambda n: F.col(f"{n}0") + F.col(f"{n}1")
    even = lambda n: F.when(both(n) > 0, F.least(f"{n}0", f"{n}1") / F.greatest(f"{n}0", f"{n}1") * both(n))
    sums = blocks.groupBy(key).agg(*[F.sum(even(n)).alias(f"num_{n}") for n in "lb"], *[F.sum(both(n)).alias(f"den_{n}") for n in "lb"], *[F.sum(on(n)).alias(f"on_{n}") for n in "mh"], *[F.sum(off(n)).alias(f"off_{n}") for n in "mh"])
    balance = lambda n: F.when(F.col(f"den_{n}") > 0, F.col(f"num_{n}") / F.col(f"den_{n}")).otherwise(1.0)
    ratio = lambda n: F.when(F.col(f"on_{n}") > 0, F.col(f"off_{n}") / F.col(f"on_{n}")).when(F.col(f"off_{n}") > 0, float("inf")).otherwise(0.0)
    out = sums.select(key, balance("l").alias("low_balance"), balance("b").alias("broad_balance"), ratio("m").alias("mid_ratio"), ratio("h").alias("high_ratio"), (F.col("den_l") > 0).alias("__low"))
    halve = F.col("__low") & (F.col("low_balance") < 0.35) & (F.col("broad_balance") < 0.65) & (F.col("mid_ratio") < 0.5) & (F.col("high_ratio") < 1.0) & (bpm / 2 >= 55.0)
    return out.withColumn("halve", halve).drop("__low")


def tempo(df: DataFrame, key: str, i: str, x: str, win: int, hop: int, least_lag: int, most_lag: int, seconds: float, prior_bpm: float = 120.0, octaves: float = 0.9, preferred: tuple[float, float] = (70.0, 180.0), switch: float = 0.6) -> DataFrame:
    """(key, lag, bpm, confidence): tempo from onset strengths x, `seconds` apart, whose places are 0, 1, 2, ...

    Windows of `win` places are autocorrelated (mean removed, by unbiased lag, over their own power), averaged by their
    strength, weighted by a log-normal prior and summed over harmonics; a best lag outside the preferred tempi gives way
    to its half or double. Windows are arrays of a fixed length, so no row is joined with another.
    """
    size = df.groupBy(key).agg((F.max(i) + 1).alias("__n"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.col("__n") - win) / hop).cast("int")), lambda k: k * hop)
    own = df.join(size.filter(F.col("__n") >= win), key)
    dealt = own.select(key, i, x, F.explode(F.filter(starts, lambda s: (s <= F.col(i)) & (s > F.col(i) - win))).alias("__s"))
    held = dealt.groupBy(key, "__s").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(i).alias("i"), F.col(x).cast("double").alias("x")))), lambda z: z["x"]).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, z: s + z)
    held = held.select(key, "__s", "v", total("v").alias("strength")).withColumn("c", F.transform("v", lambda z: z - F.col("strength") / win))
    held = held.withColumn("power", total(F.transform("c", lambda z: z * z)))
    lags = F.sequence(F.lit(1), F.lit(most_lag))
    shifted = lambda lag: total(F.zip_with(F.slice("c", F.lit(1), win - lag), F.slice("c", lag + 1, win - lag), lambda p, q: p * q)) / (win - lag) / (F.col("power") / win)
    held = held.filter("power > 1e-12").select(key, "strength", F.transform(lags, shifted).alias("a"))
    means = held.groupBy(key).agg(*[(F.sum(F.col("strength") * F.get("a", lag - 1)) / F.sum("strength")).alias(f"__a{lag}") for lag in range(1, most_lag + 1)], F.sum("strength").alias("__w")).filter("__w > 0")
    prior = lambda lag: exp(-0.5 * (log2(60.0 / (lag * seconds) / prior_bpm) / octaves) ** 2)
    step = means.select(key, F.array(*[F.greatest(F.col(f"__a{lag}"), F.lit(0.0)) * prior(lag) for lag in range(1, most_lag + 1)]).alias("w"))
    at = lambda name, lag: F.get(name, F.lit(lag - 1))
    near = lambda c: F.greatest(F.lit(0.0), *[at("w", j) for j in range(max(1, c - 1), min(most_lag, c + 1) + 1)])
    sums = [F.lit(0.0) if lag < least_lag else reduce(Column.__add__, [at("w", lag), *[near(k * lag) / k for k in (2, 3, 4) if k * lag <= most_lag]]) for lag in range(1, most_lag + 1)]
    step = step.select(key, "w", F.array(*sums).alias("h"))
    high = [F.when((at("h", lag) > 0) & (at("h", lag) >= (at("h", lag - 1) if lag > 1 else F.lit(0.0))) & (at("h", lag) > (at("h", lag + 1) if lag < most_lag else F.lit(0.0))), F.struct((-at("h", lag)).alias("n"), F.lit(lag).alias("lag"))) for lag in range(least_lag, most_lag + 1)]
    step = step.select(key, "w", "h", F.array_sort(F.array_compact(F.array(*high))).alias("peaks")).filter(F.size("peaks") > 0)
    first = F.get("peaks", F.lit(0))
    bpm = 60.0 / (first["lag"] * seconds)
    other = F.when(bpm < preferred[0], first["lag"] / 2.0).when(bpm > preferred[1], first["lag"] * 2.0)
    close = F.get(F.filter("peaks", lambda p: F.abs(p["lag"] - other) <= F.greatest(F.lit(1.0), 0.04 * other)), F.lit(0))
    usable = (60.0 / (other * seconds)).between(*preferred) & (close["n"] <= switch * first["n"])
    step = step.withColumn("best", F.when(F.coalesce(usable, F.lit(False)), close).otherwise(first))
    lag = F.col("best")["lag"]
    around = lambda k: F.get("w", lag - 1 + k)
    refined = lag + F.when((lag - 1 >= 1) & (lag + 1 <= most_lag), parabolic(around(-1), around(0), around(1))).otherwise(0.0)
    related = lambda p: reduce(Column.__or__, [F.abs(p["lag"] - lag * r) <= F.greatest(F.lit(1.0), 0.05 * lag * r) for r in (1.0, 2.0, 0.5, 3.0, 1 / 3, 1.5, 2 / 3)])
    rival = F.coalesce(F.get(F.filter("peaks", lambda p: ~related(p)), F.lit(0))["n"], F.lit(0.0))
    return step.select(key, refined.alias("lag"), (60.0 / (refined * seconds)).alias("bpm"), coerce(1 - rival / F.col("best")["n"], 0.0, 1.0).alias("confidence"))


def tuning(peaks: DataFrame, key: str, hertz: str, weight: str, low: float = 100.0, high: float = 4000.0, smooth: int = 5, radius: int = 10) -> DataFrame:
    """(key, cents, confidence): how far a track is tuned off, from the cents of its spectral peaks, counted in a circle of 100."""
    cents = 1200 * F.log2(F.col(hertz) / 440.0)
    off = cents - 100 * F.rint(cents / 100)
    bin_ = F.pmod(F.floor(F.when(off >= 50, off - 100).otherwise(off) + 50), F.lit(100)).cast("int")
    counted = peaks.filter(F.col(hertz).between(low, high)).groupBy(key, bin_.alias("bin")).agg(F.sum(weight).alias("w"))
    held = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("m"), F.sum("w").alias("all")).filter("all > 0")
    held = held.select(key, "all", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("h"))
    around = lambda b, width, f: F.aggregate(F.sequence(F.lit(-width), F.lit(width)), F.lit(0.0), lambda s, d: s + f(F.get("h", F.pmod(b + d, F.lit(100)).cast("int")), d))
    smoothed = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda b: F.struct((-F.round(around(b, smooth, lambda w, d: w * (smooth + 1 - F.abs(d))), 9)).alias("n"), b.alias("b")))  # sums that differ by their order alone are equal
    held = held.withColumn("best", F.array_min(smoothed)["b"])
    held = held.withColumns({"num": around(F.col("best"), radius, lambda w, d: w * (F.col("best") + d)), "den": around(F.col("best"), radius, lambda w, d: w)})
    centre = F.when(F.col("den") > 0, F.col("num") / F.when(F.col("den") > 0, F.col("den"))).otherwise(F.col("best")) - 49.5
    uniform = (2 * radius + 1) / 100
    wrapped = F.when(centre >= 50, centre - 100).when(centre < -50, centre + 100).otherwise(centre)
    return held.select(key, wrapped.alias("cents"), coerce((F.col("den") / F.col("all") - uniform) / (1 - uniform), 0.0, 1.0).alias("confidence"))


def band_levels(bins: DataFrame, key: str, frame: str, hertz: str, power: str, floor: float = -120.0) -> DataFrame:
    """(key, band, level): power spectra averaged over a track's frames and summed by third-octave band, in dB.

    A bin's band is the one whose centre is nearest by ratio, an expression; so bands need no range join.
    """
    band = F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor(10 * F.log10(F.col(hertz) / 1000.0) + 0.5) + BAND_OF_1K)).cast("int")
    frames = bins.groupBy(key).agg(F.count_distinct(frame).alias("__frames"))
    sums = bins.filter(F.col(hertz) > 0).groupBy(key, band.alias("band")).agg(F.sum(power).alias("p"))
    mean = F.col("p") / F.col("__frames")
    return sums.join(frames, key).select(key, "band", F.when(mean > 0, F.greatest(10 * F.log10(F.when(mean > 0, mean)), F.lit(floor))).otherwise(floor).alias("level"))


def centroid(bins: DataFrame, key: str, hertz: str, power: str) -> DataFrame:
    """(key, centroid): the mean frequency by power; 0 for silence."""
    return bins.groupBy(key).agg(F.coalesce(F.sum(F.col(hertz) * F.col(power)) / F.nullif(F.sum(power), F.lit(0.0)), F.lit(0.0)).alias("centroid"))


def texture(bins: DataFrame, key: str, bin_: str, magnitude: str) -> DataFrame:
    """(key, bin, median): the median magnitude of each bin over a track's frames."""
    return bins.groupBy(key, bin_).agg(F.percentile(magnitude, 0.5).alias("median"))


def edge_keys(whole: DataFrame, region: DataFrame, key: str, margin: float = 0.1) -> DataFrame:
    """(key, tonic, minor): the key of a track's opening or ending, where it is another and fits clearly better than the whole track's.

    whole, region: (key, tonic, minor, r), the correlations of all 24 keys with each chroma.
    """
    best = lambda df: df.groupBy(key).agg(F.max_by(F.struct("tonic", "minor", "r"), F.struct("r", (-F.col("tonic")).alias("t"), (~F.col("minor")).alias("m"))).alias("k"))
    own = best(whole).select(key, F.col("k.tonic").alias("tonic"), F.col("k.minor").alias("minor"))
    there = region.join(own, [key, "tonic", "minor"]).select(key, "tonic", "minor", F.col("r").alias("__r"))
    both = best(region).join(there, key)
    other = (F.col("k.tonic") != F.col("tonic")) | (F.col("k.minor") != F.col("minor"))
    return both.filter(other & (F.col("k.r") - F.col("__r") > margin)).select(key, F.col("k.tonic").alias("tonic"), F.col("k.minor").alias("minor"))


def summary(tracks: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """A track's features in one row; parts have a row for a track at most, and keep those that lack one."""
    return reduce(lambda left, part: left.join(part, key, "left"), parts, tracks)
