"""Column functions on tempo, key, level and energy (ids H7-H23, H36-H40 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Camelot numbers by tonic (C = 0), and key scores by Camelot distance.
CAMELOT_MAJOR = (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1)
CAMELOT_MINOR = (5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10)
KEY_BY_DISTANCE = (1.0, 0.85, 0.5, 0.35, 0.1)
NOTES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def coerce(x: Column, lo: float, hi: float) -> Column:
    """Clamped to lo..hi; NaN, which Spark orders above all numbers, gives lo."""
    return F.when(F.isnan(x), F.lit(lo)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    return coerce((x - lo) / (hi - lo), 0.0, 1.0)


def db(x: Column, floor: float = -120.0) -> Column:
    return F.when(x > 0, F.greatest(20 * F.log10(x), F.lit(floor))).otherwise(F.lit(floor))


def linear(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def lufs(power: Column) -> Column:
    """Loudness of a mean power; -inf for none."""
    return F.when(power > 0, -0.691 + 10 * F.log10(power)).otherwise(F.lit(float("-inf")))


def power(level: Column) -> Column:
    return F.pow(F.lit(10.0), (level + 0.691) / 10)


def tempo_relation(bpm_a: Column, bpm_b: Column) -> Column:
    """(relation, ratio): SAME, HALF or DOUBLE, whichever brings b / a closest to 1; SAME, then HALF, on ties."""
    r = bpm_b / bpm_a
    same, half, double = F.abs(F.ln(r)), F.abs(F.ln(r / 2)), F.abs(F.ln(r * 2))
    is_half = (half < same) & (half <= double)
    is_double = (double < same) & (double < half)
    return F.struct(F.when(is_half, "HALF").when(is_double, "DOUBLE").otherwise("SAME").alias("relation"), F.when(is_half, r / 2).when(is_double, r * 2).otherwise(r).alias("ratio"))


def parse_key(c: Column) -> Column:
    """(tonic, minor) of names such as F#m, Bb minor, C; null where there is none."""
    text = F.translate(F.trim(c), "♯♭", "#b")
    note = F.upper(F.regexp_extract(text, r"^([A-Ga-g])([#b]?)\s*(m|min|minor|maj|major)?$", 1))
    sign = F.regexp_extract(text, r"^([A-Ga-g])([#b]?)", 2)
    mode = F.regexp_extract(text, r"^([A-Ga-g])([#b]?)\s*(m|min|minor|maj|major)?$", 3)
    base = F.lit(None).cast("int")
    for name, semitone in NOTES.items():
        base = F.when(note == name, semitone).otherwise(base)
    tonic = F.pmod(base + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0), F.lit(12))
    return F.when(note != "", F.struct(tonic.cast("int").alias("tonic"), mode.isin("m", "min", "minor").alias("minor")))


def camelot(tonic: Column, minor: Column) -> Column:
    table = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod(tonic, F.lit(12)).cast("int"))
    return F.when(minor, table(CAMELOT_MINOR)).otherwise(table(CAMELOT_MAJOR))


def camelot_code(number: Column, minor: Column) -> Column:
    return F.concat(number.cast("string"), F.when(minor, "A").otherwise("B"))


def camelot_distance(number_a: Column, minor_a: Column, number_b: Column, minor_b: Column) -> Column:
    """Steps around the wheel, and one for another mode: 0 to 7."""
    d = F.pmod(number_a - number_b, F.lit(12))
    return (F.least(d, 12 - d) + (minor_a != minor_b).cast("int")).cast("int")


def best_shift(tonic_a: Column, minor_a: Column, tonic_b: Column, minor_b: Column, limit: int) -> Column:
    """(distance, shift) of the pitch shift within the limit that brings b closest to a: the smallest, then the upward one on ties."""
    shifts = [0, *[s for m in range(1, limit + 1) for s in (m, -m)]]
    here = camelot(tonic_a, minor_a)
    tried = [F.struct(camelot_distance(here, minor_a, camelot(tonic_b + s, minor_b), minor_b).alias("distance"), F.lit(n).alias("turn"), F.lit(s).alias("shift")) for n, s in enumerate(shifts)]
    return F.array_min(F.array(*tried))


def energy_proxy(level: Column, bpm: Column, percussive: Column) -> Column:
    """Energy of a track, comparable across tracks: .4 loudness, .3 tempo, .3 percussiveness; unknown parts are neutral."""
    loud = F.when(level.isNull() | F.isnan(level) | (F.abs(level) == float("inf")), 0.0).otherwise(ramp(level, -20.0, -6.0))
    tempo = F.when(bpm > 0, ramp(bpm, 70.0, 170.0)).otherwise(0.5)
    return 0.4 * loud + 0.3 * tempo + 0.3 * F.coalesce(coerce(percussive, 0.0, 1.0), F.lit(0.5))


def arc_target(arc: str, k: Column, n: Column) -> Column:
    """The energy quantile wanted at place k of n; NaN for a flat arc."""
    p = F.when(n <= 1, 0.0).otherwise(k / (n - 1))
    if arc == "rising":
        return p
    if arc == "wave":
        return 0.5 - 0.5 * F.cos(2 * F.pi() * k / 10)
    if arc == "peak":
        return F.when(p <= 0.7, 0.15 + 0.85 * p / 0.7).otherwise(1 - 0.6 * (p - 0.7) / (1 - 0.7))
    return F.lit(float("nan"))


def jitter(a: Column, b: Column, seed: Column, strategy: Column) -> Column:
    """1 ± 5 % from the first 53 bits of a SHA-256 of (a, b, seed, strategy)."""
    text = F.concat_ws("\x00", a.cast("string"), b.cast("string"), seed.cast("string"), strategy)
    bits = F.shiftright(F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long"), 3)
    return 1 + 0.05 * (2 * (bits / float(1 << 53)) - 1)


def normalise_gain(level: Column, peak: Column, target: float = -14.0, ceiling: float = -1.0) -> Column:
    """(gain, peak_limited): gain to the target, no more than the true peak allows; 0 for silence."""
    silent = level.isNull() | F.isnan(level) | (level == float("-inf"))
    wanted, allowed = target - level, ceiling - peak
    limited = ~silent & ~F.isnan(peak) & (allowed < wanted)
    return F.struct(F.when(silent, 0.0).when(limited, allowed).otherwise(wanted).alias("gain"), F.coalesce(limited, F.lit(False)).alias("peak_limited"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length, in double precision; 1 where one is empty or has no power."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))
    total = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(total(x, x) * total(y, y))
    return F.when((n <= 0) | (norm <= 0), 1.0).otherwise(total(x, y) / norm)


def verdict(value: Column, warn: Column, fail: Column, lower_is_worse: Column) -> Column:
    """PASS, WARN or FAIL by an upper or a lower threshold; a value that is no number fails."""
    bad = value.isNull() | F.isnan(value)
    over = lambda limit: F.when(lower_is_worse, value < limit).otherwise(value > limit)
    return F.when(bad | over(fail), "FAIL").when(over(warn), "WARN").otherwise("PASS")


def multiplier(n: Column, total: Column, implicit_n: Column, implicit_sum: Column) -> Column:
    """Learned multiplier .5 to 1.5, shrunk to 1 by four pseudo-ratings; implicit signals count a quarter, two ratings at most."""
    w = F.least(0.25 * implicit_n, F.lit(2.0))
    mass = F.when(implicit_n == 0, 0.0).otherwise(implicit_sum * (w / implicit_n))
    return coerce(0.5 + (2.0 + total + mass) / (4.0 + n + w), 0.5, 1.5)


def bar_of_beat(beat: Column, phase: Column, per_bar: int = 4) -> Column:
    """The bar of a beat, negative before the first downbeat."""
    return F.floor((beat - phase) / per_bar).cast("long")


def beat_of_bar(bar: Column, phase: Column, per_bar: int = 4) -> Column:
    """A bar's first beat."""
    return (bar * per_bar + phase).cast("long")


def starts_at(beat: Column, phase: Column, every: int = 4) -> Column:
    """Is a beat the first of a bar (or, with `every` beats, of a phrase)?"""
    return F.pmod(beat - phase, F.lit(every)) == 0


def next_start(beat: Column, phase: Column, every: int = 4) -> Column:
    """The first start at or after a (fractional) beat."""
    return (F.ceil((beat - phase) / every) * every + phase).cast("long")


def previous_start(beat: Column, phase: Column, every: int = 4) -> Column:
    """The last start at or before a (fractional) beat."""
    return (F.floor((beat - phase) / every) * every + phase).cast("long")


def nearest_start(beat: Column, phase: Column, every: int = 4) -> Column:
    """The nearest start; the earlier one on ties."""
    before, after = previous_start(beat, phase, every), next_start(beat, phase, every)
    return F.when(beat - before <= after - beat, before).otherwise(after)


def parabolic(before: Column, here: Column, after: Column) -> Column:
    """How far a peak lies from its middle point, -.5 to .5, by the parabola through three points; 0 where they curve upwards."""
    curve = before - 2 * here + after
    return F.when(curve < 0, coerce(0.5 * (before - after) / F.when(curve < 0, curve), -0.5, 0.5)).otherwise(0.0)


def slice_mean(values: Column, start: Column, end: Column) -> Column:
    """The mean of an array's elements from start to end (exclusive, from 0); null where there are none."""
    part = F.slice(values, F.greatest(start, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(end, F.size(values)) - F.greatest(start, F.lit(0))))
    return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part))


def sorted_quantile(values: Column, q: float) -> Column:
    """The interpolated quantile of a sorted array; 0 where it is empty."""
    at = q * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    x, y = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return F.when(F.size(values) > 0, x + (at - low) * (y - x)).otherwise(0.0)
