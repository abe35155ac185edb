"""Quality of sampled signals, all tracks at once (ids L2, L4, L6, L8, L11-L13, C20 of the survey).

Signals are long tables (key, i, x) of decoded samples. Blocks are sums by block number, so only a track's blocks are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.music import db
from tonearm.operators.series import along, away_from, local_rms, spaced_first

#: Levels in dB at which sound begins, and begins again after it first stopped; the floor of level curves.
SOUND, AGAIN, FLOOR = -60.0, -54.0, -80.0


def level(power: Column, floor: float = -120.0) -> Column:
    """dB of a mean square."""
    return db(F.sqrt(power), floor)


def block_power(df: DataFrame, key: str, i: str, x: str, width: int, whole: bool = True) -> DataFrame:
    """(key, block, power, n): mean squares of blocks; with `whole` only of full ones."""
    out = df.groupBy(key, F.floor(F.col(i) / width).alias("block")).agg(F.avg(F.col(x) * F.col(x)).alias("power"), F.count("*").alias("n"))
    return out.filter(F.col("n") == width) if whole else out


def clicks(df: DataFrame, key: str, i: str, x: str, width: int, around: int, rise: float, least: float, marks: DataFrame | None = None, mark: str = "at", guard: float = 0.0) -> DataFrame:
    """L2: (key, block, step): blocks of a high-passed, differenced signal whose largest step stands out from the blocks around them.

    A step counts from `least` on and from `rise` times the local root mean square, away from marks (known onsets), and
    once within three blocks.
    """
    blocks = df.groupBy(key, F.floor(F.col(i) / width).alias("block")).agg(F.max(F.abs(F.col(x))).alias("step"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.count("*").alias("n"))
    near = local_rms(blocks, key, "block", "rms", "n", around)
    loud = near.filter((F.col("n") == width) & (F.col("step") >= least) & ~((F.coalesce("around", F.lit(0.0)) > 0) & (F.col("step") < rise * F.col("around"))))
    found = loud.select(key, "block", "step", (F.col("block") * width + width // 2).cast("double").alias("__at"))
    if marks is not None:
        found = away_from(found, marks, key, "__at", mark, guard)
    return spaced_first(found.drop("__at"), key, "block", 3)


def health(df: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """L4: (key, clipped, not_finite, dc_offset_db): samples at full scale, samples that are no number, the largest channel mean; one pass."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    clipped = sum((F.count_if((F.abs(F.col(c)) >= 1.0) & ~bad(F.col(c))) + F.count_if(F.abs(F.col(c)) == float("inf")) for c in channels), F.lit(0))
    wrong = sum((F.count_if(bad(F.col(c))) for c in channels), F.lit(0))
    means = [F.abs(F.avg(c)) for c in channels]
    return df.groupBy(key).agg(clipped.alias("clipped"), wrong.alias("not_finite"), db(F.greatest(*means) if len(means) > 1 else means[0]).alias("dc_offset_db"))


def stereo_minimum(df: DataFrame, key: str, i: str, left: str, right: str, width: int, floor: float = 1e-3) -> DataFrame:
    """(key, correlation): the least correlation of two channels over windows that overlap by half, silent windows left out.

    Each half is summed once and joined to the next by lead(), so no sample is copied.
    """
    half = max(1, width // 2)
    x, y = F.col(left), F.col(right)
    sums = df.groupBy(key, F.floor(F.col(i) / half).alias("h")).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.count("*").alias("n"))
    w = along(key, "h")
    both = sums.select(key, "h", *[(F.col(c) + F.lead(c).over(w)).alias(c) for c in ("xy", "xx", "yy", "n")], (F.lead("h").over(w) == F.col("h") + 1).alias("joined"))
    full = both.filter(F.col("joined") & (F.col("n") == 2 * half)).filter(F.sqrt((F.col("xx") + F.col("yy")) / (4 * half)) > floor)
    c = F.when((F.col("xx") <= 0) & (F.col("yy") <= 0), 1.0).when((F.col("xx") <= 0) | (F.col("yy") <= 0), 0.0).otherwise(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return full.groupBy(key).agg(F.least(F.lit(1.0), F.min(c)).alias("correlation"))


def length_error(frames: Column, expected: Column) -> Column:
    """Percent by which a length is off; 0 where nothing was expected."""
    return F.when(expected <= 0, 0.0).otherwise(F.abs(frames - expected) * 100.0 / expected)


def tail_residual(rendered: DataFrame, source: DataFrame, key: str, i: str, x: str, tail: int) -> DataFrame:
    """(key, residual_db): energy of what is left of a signal's last samples without its source's, over the source's.

    Both are aligned at their ends. -inf where they are the same, 0 where the source is silent and the signal is not.
    """
    end = lambda df, name: df.join(df.groupBy(key).agg(F.max(i).alias("__end")), key).select(key, (F.col("__end") - F.col(i)).alias("__back"), F.col(x).alias(name)).filter(F.col("__back") < tail)
    both = end(rendered, "__a").join(end(source, "__b"), [key, "__back"])
    sums = both.groupBy(key).agg(F.sum(F.pow(F.col("__a") - F.col("__b"), 2)).alias("r"), F.sum(F.col("__b") * F.col("__b")).alias("s"))
    return sums.select(key, F.when(F.col("r") <= 0, float("-inf")).when(F.col("s") <= 0, 0.0).otherwise(10 * F.log10(F.when(F.col("s") > 0, F.col("r") / F.col("s")))).alias("residual_db"))


def trimmed(df: DataFrame, key: str, i: str, x: str, width: int, least: int = 5, sound: float = SOUND, again: float = AGAIN) -> DataFrame:
    """(key, trim_start, trim_end, silent): where sound begins and ends, in samples.

    A block is sound from `sound` dB on until it falls below; once it has fallen, only from `again` dB on. So up to the
    first fall the first loud block decides, and after it the last crossing of either threshold, carried along. Runs of
    fewer than `least` blocks don't count.
    """
    blocks = block_power(df, key, i, x, width, whole=False).select(key, "block", "n", level(F.col("power")).alias("l"))
    whole, w = Window.partitionBy(key), along(key, "block").rowsBetween(Window.unboundedPreceding, 0)
    step = blocks.withColumn("first", F.min(F.when(F.col("l") >= sound, F.col("block"))).over(whole))
    step = step.withColumn("fall", F.min(F.when((F.col("block") > F.col("first")) & (F.col("l") < sound), F.col("block"))).over(whole))
    crossing = F.last(F.when(F.col("l") >= again, True).when(F.col("l") < sound, False), ignorenulls=True).over(w)
    early = F.col("fall").isNull() | (F.col("block") < F.col("fall"))
    on = F.coalesce(F.when(early, F.col("block") >= F.col("first")).otherwise(crossing), F.lit(False))
    # One pass: rows that are no sound form runs of their own, so lengths need no second look at the blocks.
    step = step.select(key, "block", "n", on.alias("on"))
    placed = step.select("*", F.row_number().over(along(key, "block")).alias("place"), F.count_if("on").over(along(key, "block").rowsBetween(Window.unboundedPreceding, 0)).alias("sounds"))
    runs = placed.groupBy(key, "on", F.when(F.col("on"), F.col("place") - F.col("sounds")).alias("run")).agg(F.min("block").alias("start"), F.max("block").alias("end"), F.count("*").alias("length"), F.sum("n").alias("n"))
    counts = F.col("on") & (F.col("length") >= least) & F.col(key).isNotNull()
    out = runs.groupBy(key).agg(F.sum("n").alias("n"), F.min(F.when(counts, F.col("start"))).alias("a"), F.max(F.when(counts, F.col("end"))).alias("b"))
    return out.select(key, F.coalesce(F.col("a") * width, F.lit(0)).alias("trim_start"), F.when(F.col("a").isNull(), 0).otherwise(F.least((F.col("b") + 1) * width, F.col("n"))).cast("long").alias("trim_end"), F.col("a").isNull().alias("silent"))


def hard_stops(df: DataFrame, trims: DataFrame, key: str, i: str, x: str, last: int, reference: int, tolerance: float = 8.0) -> DataFrame:
    """(key, end_delta_db, hard_stop): the level of the last samples against the median of the blocks before them."""
    both = df.join(trims.filter("not silent").select(key, "trim_start", "trim_end"), key)
    back = F.floor((F.col("trim_end") - 1 - F.col(i)) / last)
    held = both.filter((F.col(i) >= F.greatest(F.col("trim_start"), F.col("trim_end") - last - reference)) & (F.col(i) < F.col("trim_end")))
    blocks = held.groupBy(key, back.alias("b")).agg(F.avg(F.col(x) * F.col(x)).alias("p"), F.count("*").alias("n")).filter((F.col("b") == 0) | (F.col("n") == last))
    ends = blocks.groupBy(key).agg(F.max(F.when(F.col("b") == 0, F.col("p"))).alias("e"), F.sort_array(F.collect_list(F.when(F.col("b") > 0, F.col("p")))).alias("r"))
    middle = F.get("r", F.floor(F.size("r") / 2).cast("int"))
    delta = F.when((F.size("r") > 0) & (F.col("e") > 0) & (middle > 0), 10 * F.log10(F.col("e") / F.when(middle > 0, middle)))
    return ends.select(key, delta.alias("end_delta_db"), F.coalesce(delta >= -tolerance, F.lit(False)).alias("hard_stop"))


def fade_outs(df: DataFrame, trims: DataFrame, key: str, i: str, x: str, rate: int, span: int, window: int, hop: int, slope: float = -1.5, drop: float = 10.0) -> DataFrame:
    """(key, slope, range, fade_out, fade_start): the line through the level curve of a track's end, and where its descent begins.

    The curve has a point each `hop` samples over `window` (a whole number of hops), from sums by hop: no sample is copied.
    """
    wide = window // hop
    both = df.join(trims.filter("not silent").select(key, "trim_start", "trim_end"), key).withColumn("__from", F.greatest("trim_start", F.col("trim_end") - span))
    held = both.filter((F.col(i) >= F.col("__from")) & (F.col(i) < F.col("trim_end")))
    sums = held.groupBy(key, "__from", F.floor((F.col(i) - F.col("__from")) / hop).alias("__k")).agg(F.sum(F.col(x) * F.col(x)).alias("__s"), F.count("*").alias("__n"))
    w = along(key, "__k").rowsBetween(0, wide - 1)
    curve = sums.select(key, "__from", "__k", F.sum("__s").over(w).alias("__s"), F.sum("__n").over(w).alias("__n"), F.count("*").over(w).alias("__c")).filter(F.col("__n") == window).filter(F.col("__c") == wide)
    curve = curve.select(key, "__from", "__k", F.greatest(level(F.col("__s") / window), F.lit(FLOOR)).alias("__l"))
    whole = Window.partitionBy(key).orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a track's end only, `span` samples
    curve = curve.select("*", F.max("__l").over(whole).alias("__top"), F.min_by("__k", F.struct((-F.col("__l")).alias("__l"), "__k")).over(whole).alias("__peak"))
    near = (F.col("__k") >= F.col("__peak")) & (F.col("__l") >= F.col("__top") - 3)
    fit = curve.groupBy(key).agg(F.count("*").alias("__points"), F.regr_slope("__l", F.col("__k") * (hop / rate)).alias("slope"), F.first("__top").alias("__top"), F.min("__l").alias("__low"), F.max(F.when(near, F.col("__k"))).alias("__last"), F.first("__from").alias("__from"))
    fading = F.coalesce((F.col("__points") >= 5) & (F.col("slope") < slope) & (F.col("__top") - F.col("__low") > drop), F.lit(False))
    enough = F.col("__points") >= 5
    return fit.filter(F.col(key).isNotNull()).select(
        key, F.when(enough, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("slope"), F.when(enough, F.col("__top") - F.col("__low")).otherwise(0.0).alias("range"), fading.alias("fade_out"),
        F.when(fading, F.col("__from") + F.col("__last") * hop + window // 2).otherwise(-1).cast("long").alias("fade_start"),
    )
