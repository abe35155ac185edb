"""What follows what: pair features, sub-scores, strategies, rules, ranked plans (ids C7, C8, C10-C12, J8, I of the survey).

Per-track parts are columns of the track table, so a pair is one join and one projection. Candidate pairs at scale
come from `candidate_pairs`, a band join; `all_pairs` gives them all where all are wanted, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.music import CAMELOT_MAJOR, CAMELOT_MINOR, KEY_BY_DISTANCE, best_shift, camelot, camelot_distance, coerce, cosine, jitter, tempo_relation
from tonearm.functions.frames import Tables, small_methods, spread

OUTROS = ("HARD_STOP", "FADE_OUT", "BEAT_OUTRO", "AMBIENT_OUTRO", "VOCAL_OUTRO", "UNKNOWN")
INTROS = ("BEAT_INTRO", "AMBIENT_INTRO", "VOCAL_INTRO", "COLD_START", "SILENCE", "UNKNOWN")
#: How well an outro (row) and an intro (column) suit a family of strategies.
PRIORS = {
    "beat": ((0.50, 0.30, 0.30, 0.40, 0.20, 0.40), (0.60, 0.50, 0.40, 0.40, 0.30, 0.50), (1.00, 0.80, 0.60, 0.70, 0.40, 0.70), (0.70, 0.60, 0.50, 0.50, 0.30, 0.50), (0.60, 0.50, 0.30, 0.50, 0.30, 0.50), (0.70, 0.60, 0.50, 0.50, 0.40, 0.60)),
    "cut": ((0.90, 0.50, 0.60, 1.00, 0.40, 0.70), (0.50, 0.30, 0.30, 1.00, 0.30, 0.50), (0.90, 0.50, 0.50, 1.00, 0.40, 0.70), (0.60, 0.40, 0.40, 1.00, 0.30, 0.50), (0.60, 0.40, 0.40, 1.00, 0.30, 0.50), (0.70, 0.40, 0.40, 1.00, 0.40, 0.60)),
    "structural": ((0.30, 0.60, 0.50, 0.30, 0.50, 0.40), (0.50, 1.00, 0.90, 0.30, 0.90, 0.70), (0.30, 0.50, 0.40, 0.20, 0.30, 0.40), (0.50, 0.95, 0.80, 0.30, 0.80, 0.70), (0.40, 0.80, 0.60, 0.30, 0.70, 0.60), (0.40, 0.70, 0.60, 0.30, 0.60, 0.50)),
    "bridge": ((0.60, 0.90, 0.80, 0.50, 0.80, 0.70), (0.60, 0.80, 0.70, 0.50, 0.70, 0.70), (0.50, 0.70, 0.60, 0.40, 0.60, 0.60), (0.70, 0.90, 0.80, 0.50, 0.80, 0.70), (0.60, 0.80, 0.70, 0.50, 0.70, 0.70), (0.60, 0.80, 0.70, 0.50, 0.70, 0.70)),
    "fade": ((0.50, 0.60, 0.60, 0.40, 0.60, 0.60), (0.60, 0.80, 0.70, 0.40, 0.70, 0.60), (0.40, 0.60, 0.50, 0.40, 0.60, 0.60), (0.60, 0.80, 0.70, 0.40, 0.70, 0.60), (0.50, 0.70, 0.50, 0.40, 0.60, 0.60), (0.60, 0.60, 0.60, 0.40, 0.60, 0.60)),
}
#: How well each kind of outro and of intro suits a strategy, by strategies that share them.
OUTRO_FIT = {
    "blend": {"BEAT_OUTRO": 1.0, "UNKNOWN": 0.8, "AMBIENT_OUTRO": 0.7, "VOCAL_OUTRO": 0.6, "FADE_OUT": 0.6, "HARD_STOP": 0.5},
    "stems": {"BEAT_OUTRO": 1.0, "AMBIENT_OUTRO": 0.7, "VOCAL_OUTRO": 0.7, "UNKNOWN": 0.6, "HARD_STOP": 0.5, "FADE_OUT": 0.4},
    "break": {"BEAT_OUTRO": 1.0, "UNKNOWN": 0.6, "AMBIENT_OUTRO": 0.5, "VOCAL_OUTRO": 0.5, "HARD_STOP": 0.5, "FADE_OUT": 0.3},
    "cut": {"HARD_STOP": 1.0, "BEAT_OUTRO": 0.95, "UNKNOWN": 0.75, "VOCAL_OUTRO": 0.7, "AMBIENT_OUTRO": 0.7, "FADE_OUT": 0.55},
    "minimal": {"FADE_OUT": 1.0, "AMBIENT_OUTRO": 0.95, "VOCAL_OUTRO": 0.7, "BEAT_OUTRO": 0.4, "UNKNOWN": 0.5, "HARD_STOP": 0.0},
    "freeze": {"AMBIENT_OUTRO": 1.0, "VOCAL_OUTRO": 0.8, "HARD_STOP": 0.7, "UNKNOWN": 0.5, "FADE_OUT": 0.4, "BEAT_OUTRO": 0.2},
    "bridge": {"HARD_STOP": 1.0, "AMBIENT_OUTRO": 0.7, "VOCAL_OUTRO": 0.7, "FADE_OUT": 0.6, "UNKNOWN": 0.4, "BEAT_OUTRO": 0.2},
}
INTRO_FIT = {
    "blend": {"BEAT_INTRO": 1.0, "UNKNOWN": 0.8, "AMBIENT_INTRO": 0.7, "VOCAL_INTRO": 0.5, "COLD_START": 0.45, "SILENCE": 0.3},
    "stems": {"BEAT_INTRO": 1.0, "AMBIENT_INTRO": 0.7, "VOCAL_INTRO": 0.7, "UNKNOWN": 0.6, "COLD_START": 0.5, "SILENCE": 0.3},
    "break": {"BEAT_INTRO": 1.0, "COLD_START": 0.7, "UNKNOWN": 0.6, "AMBIENT_INTRO": 0.5, "VOCAL_INTRO": 0.5, "SILENCE": 0.3},
    "cut": {"COLD_START": 1.0, "BEAT_INTRO": 0.95, "VOCAL_INTRO": 0.7, "UNKNOWN": 0.6, "AMBIENT_INTRO": 0.5, "SILENCE": 0.35},
    "minimal": {"AMBIENT_INTRO": 1.0, "SILENCE": 0.95, "VOCAL_INTRO": 0.85, "BEAT_INTRO": 0.45, "UNKNOWN": 0.5, "COLD_START": 0.0},
    "freeze": {"AMBIENT_INTRO": 1.0, "VOCAL_INTRO": 0.8, "BEAT_INTRO": 0.7, "COLD_START": 0.6, "UNKNOWN": 0.6, "SILENCE": 0.4},
    "bridge": {"AMBIENT_INTRO": 0.9, "SILENCE": 0.8, "VOCAL_INTRO": 0.6, "COLD_START": 0.5, "UNKNOWN": 0.4, "BEAT_INTRO": 0.2},
    "echo": {"BEAT_INTRO": 1.0, "COLD_START": 0.9, "AMBIENT_INTRO": 0.8, "VOCAL_INTRO": 0.6, "UNKNOWN": 0.6, "SILENCE": 0.5},
    "drop": {"BEAT_INTRO": 1.0, "COLD_START": 1.0, "VOCAL_INTRO": 0.6, "UNKNOWN": 0.5, "AMBIENT_INTRO": 0.4, "SILENCE": 0.0},
}
#: How showy a strategy is; those that are never used twice running; what a modifier adds.
AMBITION = {
    "crossfade": 0.1, "outroIntroMinimal": 0.2, "ambientBridge": 0.3, "beatMatchedBlend": 0.4, "phraseCut": 0.5, "bassSwap": 0.5, "harmonicBlend": 0.5,
    "stemSwap": 0.6, "filterSweep": 0.6, "echoOut": 0.6, "spectralFreezeBridge": 0.6, "drumBreakBridge": 0.7, "loopRollRiser": 0.9, "brakeStop": 0.9,
}
COOLDOWN = ("brakeStop", "loopRollRiser")
MODIFIER_BONUS = {"tempoGlide": 0.15, "textureCarry": 0.10}
MODIFIER_FROM = 0.3
#: What a track is taken to have where its table lacks the column.
TRACK_DEFAULTS = {"grid_beats": 64, "mix_in_beat": 0, "drop_beat": -1, "seconds": 180.0, "has_curve": True, "head_percussive": None, "onset_density": None, "texture_db": None}
NEEDED_BARS = {"beat": 8, "cut": 8, "structural": 4, "bridge": 2, "fade": 2}
#: A track's columns that the cost of a pair depends on.
COST_COLUMNS = ("bpm", "tonic", "minor", "lufs", "tail_energy", "head_energy", "tail_vocal", "head_vocal", "grid_confidence", "key_strength", "outro", "intro", "outro_beats", "intro_beats")


@dataclass(frozen=True)
class Prefs:
    """Settings that scores depend on, written into the plan as literals."""

    max_stretch: float = 8.0
    max_shift: int = 2
    energy: float = 0.5
    variety: float = 0.3
    seed: int = 1
    weights: dict[str, float] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()
    #: Bars that a beat-matched overlap should have; whether pitch stays where tempo is bent.
    overlap_bars: int = NEEDED_BARS["beat"]
    key_lock: bool = True

    def needed_beats(self, family: str, beats_per_bar: int = 4) -> int:
        """I4: beats that a plan of a family needs."""
        return (max(1, self.overlap_bars) if family == "beat" else NEEDED_BARS[family]) * beats_per_bar


def prior(family: str, outro: Column, intro: Column) -> Column:
    """The structural prior; unknown names count as UNKNOWN."""
    flat = F.array(*[F.lit(x) for row in PRIORS[family] for x in row])
    place = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)), F.lit(6)) - 1
    return F.get(flat, (place(OUTROS, outro) * 6 + place(INTROS, intro)).cast("int"))


def all_pairs(tracks: DataFrame, block: int = 2000) -> DataFrame:
    """Every ordered pair of a set of tracks, in blocks: only ids are dealt to blocks, and each pair of blocks is a join key.

    The result has the square of the set's rows, which is what is asked for; no side is broadcast, and no task holds more
    than two blocks of about `block` tracks. Where the best few partners are wanted, candidate_pairs() is the way.
    """
    blocks = max(1, -(-tracks.count() // block))
    own = F.pmod(F.xxhash64("track_id"), F.lit(blocks))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = tracks.select(F.struct("*").alias("a"), own.alias("__x"), others.alias("__y"))
    b = tracks.select(F.struct("*").alias("b"), own.alias("__y"), others.alias("__x"))
    return a.join(b, ["__x", "__y"]).filter("a.track_id <> b.track_id").select("a", "b")


#: Ids that a block of tracks alike has at most: what bounds a row's size in candidate_pairs().
ALIKE_BLOCK = 1024


def candidate_pairs(tracks: DataFrame, key: str, value: str, width: float, near: Column | None = None, same: tuple[str, ...] = (), also: dict[str, Column] | None = None) -> DataFrame:
    """Pairs whose values lie within `width`, by equal buckets of that width and their neighbours: an equi-join, no cross join.

    Columns in `same` are equal in both (null in neither) and keys of the join too. The result may be many times the tracks'
    rows, so tracks alike in all but the key are joined as blocks of keys, dealt to all cores by the join's keys, whatever
    their bytes, and pairs of blocks become pairs of tracks where they are used: nothing of the pairs' number is shuffled,
    sorted or held. They come by blocks and keys in order, which compresses well. also: further columns from a and b but
    for their keys, worked out once for each pair of blocks.
    """
    alike, also = [c for c in tracks.columns if c != key], also or {}
    block = F.floor((F.row_number().over(Window.partitionBy(*alike).orderBy(key)) - 1) / ALIKE_BLOCK)
    blocks = tracks.filter(F.col(key).isNotNull()).withColumn("__block", block).groupBy(*alike, "__block").agg(F.sort_array(F.collect_list(key)).alias("__keys"))
    bucket = F.floor(F.col(value) / width)
    deal = lambda side, buckets: spread(blocks.select(F.struct(*alike).alias(side), F.col("__keys").alias(f"__keys_{side}"), *[F.col(c).alias(f"__{c}") for c in same], buckets.alias("__b")), *[f"__{c}" for c in same], "__b")
    a, b = deal("a", bucket), deal("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    met = a.join(b, [*[f"__{c}" for c in same], "__b"]).filter(F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) <= width).withColumns(also)
    for side in ("a", "b"):
        met = met.select("*", F.explode(f"__keys_{side}").alias(f"__key_{side}")).drop(f"__keys_{side}")
    whole = lambda side: F.struct(*[(F.col(f"__key_{side}") if c == key else F.col(f"{side}.{c}")).alias(c) for c in tracks.columns]).alias(side)
    pairs = met.filter(F.col("__key_a") != F.col("__key_b")).select(whole("a"), whole("b"), *also)
    return pairs if near is None else pairs.filter(near)


#: Query vectors that are sent to all tasks at once.
QUERY_BLOCK = 4096
#: Vectors that are multiplied with a block at once: what bounds a task's memory, whatever the size of Arrow's batches.
VECTOR_SLICE = 256


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(a, b, place, cosine): the `most` nearest vectors of every query, by exact search against all of them.

    Queries go out in blocks of QUERY_BLOCK; with more than one, each block's finds are written before the next is read,
    so the driver and the tasks hold one block at a time, however many queries there are. Each batch of vectors is multiplied with a
    block at once and keeps its best few for each query, so no table of all pairs is made; the few are ranked at the end.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(key).alias("a"), F.col(vector).alias("v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    kind = vectors.schema[key].dataType.simpleString()
    out, tables = None, Tables(spark, "nearest") if blocks > 1 else None
    order = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    ranked_ = lambda df: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("a", "b", "place", "cosine")
    for block in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("a"), F.lit(blocks)) == block)
        rows = [(r["a"], list(r["v"])) for r in part.collect()]  # about QUERY_BLOCK rows
        sent = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            ids = np.array([a for a, _ in sent.value])
            unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
            wanted = unit(np.array([v for _, v in sent.value], float).reshape(len(ids), -1))
            best: tuple[np.ndarray, np.ndarray] | None = None  # cosines and ids of the best few so far, a row for each query
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, VECTOR_SLICE):
                    part = batch.slice(at, VECTOR_SLICE)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    c = wanted @ unit(np.array(part.column(1).to_pylist(), float)).T
                    c[ids[:, None] == own[None, :]] = -np.inf
                    b = np.broadcast_to(own, c.shape)
                    if best is not None:
                        c, b = np.concatenate([best[0], c], axis=1), np.concatenate([best[1], b], axis=1)
                    near = np.lexsort((b, -np.round(c, 9)), axis=1)[:, :most]
                    best = np.take_along_axis(c, near, axis=1), np.take_along_axis(b, near, axis=1)
            if best is not None:
                a, b, s = np.repeat(ids, best[0].shape[1]), best[1].ravel(), best[0].ravel()
                fine = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(a[fine]), pa.array(b[fine]), pa.array(s[fine])], names=["a", "b", "cosine"])

        found = ranked_(vectors.select(key, vector).mapInArrow(search, f"a {kind}, b {kind}, cosine double"))
        if tables is None:
            return found
        out = tables.write(found, "found", "append")
        sent.destroy()
    return out


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind an inline(): what is inferred from filters over derived columns, in every combination, would choke the optimiser."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def own_cost(beats: str, prefs: Prefs) -> Column:
    """what a track costs in any pair: an uncertain grid, a weak key, no room at the side that `beats` tells of."""
    wanted = float(prefs.needed_beats("beat"))
    grid, strength = coerce(F.col("grid_confidence"), 0.0, 1.0), coerce(F.col("key_strength"), 0.0, 1.0)
    alone = 0.10 * (1 - grid) + 0.08 * (1 - strength) + 0.05 * (1 - F.least(F.lit(1.0), F.greatest(F.col(beats), F.lit(0)) / wanted))
    return alone + F.when((grid < 0.5) | (F.col(beats) < wanted / 2), 0.25).otherwise(0.0)


def near_keys(prefs: Prefs, most: float) -> list[list[int]]:
    """for each of the 24 keys (twice the tonic, one more in minor) those whose key term may be `most` or less."""
    number = lambda k: (CAMELOT_MINOR if k % 2 else CAMELOT_MAJOR)[k // 2 % 12]
    shifts = range(-max(0, min(6, prefs.max_shift)), max(0, min(6, prefs.max_shift)) + 1)

    def distance(a: int, b: int) -> int:
        d = (number(a) - number(b)) % 12
        return min(d, 12 - d) + (a % 2 != b % 2)

    least = lambda a, b: 0.20 * (1 - max(0.6, *[KEY_BY_DISTANCE[min(4, distance(a, (b + 2 * s) % 24))] for s in shifts]))
    return [[b for b in range(24) if least(a, b) <= most + 1e-9] for a in range(24)]


def bounded_pairs(tracks: DataFrame, prefs: Prefs, most: float, item: str = "track_id") -> DataFrame:
    """(a, b): structs of all ordered pairs of tracks whose cost may be `most` or less, and few others.

    A pair costs at least what each of its tracks brings alone (own_cost) and what its tempo and key terms bring, so
    tracks beyond `most` are left out and the others joined by bands of tempo (the same, half or double) as wide as that
    term allows, and by the keys that it allows: one equi-join, each pair once. Of the pairs that meet, those whose plain terms
    are beyond `most` already are left out.
    """
    unknown = most >= 0.5  # what a pair costs where a value is not known
    fits = lambda cost: F.coalesce(cost <= most + 1e-9, F.lit(unknown))
    known = fenced(tracks).filter((F.col("bpm") > 0) & F.col(item).isNotNull())
    sigma, least = prefs.max_stretch / 1.5, 1 - (most + 1e-9) / 0.30
    octave = F.log2("bpm")
    reach = lambda best: sigma * math.sqrt(-math.log(min(1.0, least / best))) if least > 0 else 100.0
    width = -math.log2(max(1e-6, 1 - min(99.0, reach(1.0)) / 100)) if sigma > 0 else 1e-6
    width = max(width, 1e-6)
    shifts = (0, 1, -1) if least <= 0.85 else (0,)
    bin_of = lambda x: F.floor(x / width)
    bins = F.array_distinct(F.array(*[bin_of(octave + s) + n for s in shifts for n in (-1, 0, 1)])) if least > 0 else F.array(F.lit(0).cast("long"))
    keys = near_keys(prefs, most)
    by_key = not unknown and any(len(k) < 24 for k in keys)
    code = F.pmod(F.col("tonic"), F.lit(12)).cast("int") * 2 + F.col("minor").cast("int")
    here, near = (code, F.get(F.array(*[F.array(*map(F.lit, k)) for k in keys]), code)) if by_key else (F.lit(0), F.array(F.lit(0)))
    a = known.filter(fits(own_cost("outro_beats", prefs))).select(F.struct("*").alias("a"), F.explode(bins).alias("bin"), near.alias("near"))
    a = a.select("a", "bin", F.explode("near").alias("key"))
    b = known.filter(fits(own_cost("intro_beats", prefs))).select(F.struct("*").alias("b"), (bin_of(octave) if least > 0 else F.lit(0).cast("long")).alias("bin"), here.alias("key"))
    lower = lambda n: F.least(coerce(F.col(f"a.{n}"), 0.0, 1.0), coerce(F.col(f"b.{n}"), 0.0, 1.0))
    plain = 0.10 * (1 - lower("grid_confidence")) + 0.08 * (1 - lower("key_strength")) + 0.10 * F.coalesce(coerce(F.col("a.tail_vocal") * F.col("b.head_vocal"), 0.0, 1.0), F.lit(0.0))
    met = spread(a, "bin", "key").join(spread(b, "bin", "key"), ["bin", "key"])
    return met.filter((F.col(f"a.{item}") != F.col(f"b.{item}")) & fits(plain)).select("a", "b")


def best_pairs(tracks: DataFrame, prefs: Prefs, k: int = 10, item: str = "track_id", seeds: int = 8, decimals: int = 9) -> DataFrame:
    """the k ordered pairs of least cost among all pairs of a library: (a, b, cost), ties by id.

    Branch and bound: a few promising tracks of every band of tempo and key are paired, and the k-th best of their costs bounds
    the answer. Only tracks that may be within it are kept; of those alike in all that costs depend on, the first k + 1 by id,
    as each pair of a later one has k like it before it. The pairs within half the bound lower it, and only pairs that may be within
    what is left are ranked. Tracks without a tempo or an id are not ranked.
    """
    tracks = fenced(tracks)
    known = tracks.filter((F.col("bpm") > 0) & F.col(item).isNotNull())
    band, slack = F.floor(F.log2("bpm") * 24), 10.0**-decimals

    def ends(beats: str, name: str, by: list[Column]) -> DataFrame:
        first = Window.partitionBy(*by).orderBy(F.coalesce(own_cost(beats, prefs), F.lit(0.5)), item)
        few = known.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= seeds)
        return few.select(*[x.alias(f"__{i}") for i, x in enumerate(by)], F.struct(*known.columns).alias(name))

    def costs(pairs: DataFrame) -> DataFrame:
        s = sub_scores(features(pairs.select("a", "b"), prefs), prefs)
        return s.select(F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b"), F.round(pair_cost(s, prefs), decimals).alias("cost"))

    def bounded_by(pairs: DataFrame) -> float:
        some = [r.cost for r in costs(pairs).select("cost").orderBy("cost").limit(k).collect()]
        return some[-1] + slack if len(some) == k else float("inf")

    bound = float("inf")
    for by in ([band, F.col("tonic"), F.col("minor")], [band]):
        if bound == float("inf"):
            met = ends("outro_beats", "a", by).join(ends("intro_beats", "b", by), [f"__{i}" for i in range(len(by))])
            bound = bounded_by(met.filter(F.col(f"a.{item}") != F.col(f"b.{item}")))
    if bound == float("inf"):
        return costs(bounded_pairs(known, prefs, bound, item)).orderBy("cost", "a", "b").limit(k)
    fits = lambda beats: F.coalesce(own_cost(beats, prefs) <= bound + slack, F.lit(bound >= 0.5))
    alike = Window.partitionBy(*COST_COLUMNS).orderBy(item)
    kept = known.filter(fits("outro_beats") | fits("intro_beats")).withColumn("__n", F.row_number().over(alike)).filter(F.col("__n") <= k + 1).drop("__n")
    kept = Tables(tracks.sparkSession, "best-pairs").write(kept, "kept")
    if bound > slack:  # the bound of half the reach is the k-th best, or nearer to it than the first
        bound = min(bound, bounded_by(bounded_pairs(kept, prefs, bound / 2, item)))
    return costs(bounded_pairs(kept, prefs, bound, item)).orderBy("cost", "a", "b").limit(k)


def consecutive(order: DataFrame, group: list[str], position: list[str], columns: list[str]) -> DataFrame:
    """Each row with the one that follows it, by lead(), not by a self-join."""
    nxt = F.lead(F.struct(*columns)).over(Window.partitionBy(*group).orderBy(*position))
    return order.select(*group, F.struct(*columns).alias("a"), nxt.alias("b")).filter("b is not null")


def pinned(pairs: DataFrame, pins: DataFrame) -> DataFrame:
    """The pin of an exact pair, else of (a, *), else of (*, b)."""
    exact = pins.filter("a <> '*' and b <> '*'").select("a", "b", F.col("strategy").alias("p1"))
    any_b = pins.filter("a <> '*' and b = '*'").select("a", F.col("strategy").alias("p2"))
    any_a = pins.filter("a = '*' and b <> '*'").select("b", F.col("strategy").alias("p3"))
    return pairs.join(exact, ["a", "b"], "left").join(any_b, "a", "left").join(any_a, "b", "left").withColumn("pin", F.coalesce("p1", "p2", "p3")).drop("p1", "p2", "p3")


def layered(*params: Column) -> Column:
    """Maps of parameters laid over each other, the last one wins."""
    out = params[0]
    for more in params[1:]:
        out = F.map_zip_with(out, F.coalesce(more, F.create_map().cast("map<string,string>")), lambda k, x, y: F.coalesce(y, x))
    return out


def features(pairs: DataFrame, prefs: Prefs) -> DataFrame:
    """A pair (structs a, b of the track schema, its rooms worked out by structure.rooms) to its features."""
    small_methods(pairs.sparkSession)
    has = {side: set(pairs.schema[side].dataType.names) for side in ("a", "b")}
    own = lambda side, n: (F.col(f"{side}.{n}") if n in has[side] else F.lit(TRACK_DEFAULTS[n])).alias(f"{n}_{side}")
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    known = (a("bpm") > 0) & (b("bpm") > 0)
    tempo = F.when(known, tempo_relation(a("bpm"), b("bpm"))).otherwise(F.struct(F.lit("SAME").alias("relation"), F.lit(1.0).alias("ratio")))
    here = camelot(a("tonic"), a("minor"))
    distance = camelot_distance(here, a("minor"), camelot(b("tonic"), b("minor")), b("minor"))
    best = best_shift(a("tonic"), a("minor"), b("tonic"), b("minor"), max(0, min(6, prefs.max_shift)))
    audible = lambda c: c.isNotNull() & ~F.isnan(c) & (c > -100) & (c != float("inf"))
    step = pairs.select(
        "a", "b", tempo.alias("tempo"), distance.alias("camelot_distance"), F.when(distance <= 1, F.struct(distance.alias("distance"), F.lit(0).alias("turn"), F.lit(0).alias("shift"))).otherwise(best).alias("best")
    )
    return step.select(
        "a", "b", F.col("tempo.relation").alias("relation"), F.col("tempo.ratio").alias("ratio"), (F.abs(F.col("tempo.ratio") - 1) * 100).alias("stretch"),
        "camelot_distance", F.col("best.shift").alias("shift"), F.col("best.distance").alias("distance"),
        F.when(audible(a("lufs")) & audible(b("lufs")), b("lufs") - a("lufs")).otherwise(0.0).alias("loudness_delta"),
        F.coalesce(coerce(b("head_energy") - a("tail_energy"), -1.0, 1.0), F.lit(0.0)).alias("energy_delta"),
        F.coalesce(coerce(a("tail_vocal") * b("head_vocal"), 0.0, 1.0), F.lit(0.0)).alias("vocal_clash"),
        (cosine(a("outro_spectrum"), b("intro_spectrum")) if "outro_spectrum" in has["a"] else F.lit(1.0)).alias("similarity"),
        a("outro").alias("outro"), b("intro").alias("intro"), a("outro_beats").alias("outro_beats"), b("intro_beats").alias("intro_beats"),
        coerce(a("grid_confidence"), 0.0, 1.0).alias("grid_a"), coerce(b("grid_confidence"), 0.0, 1.0).alias("grid_b"),
        coerce(a("key_strength"), 0.0, 1.0).alias("key_a"), coerce(b("key_strength"), 0.0, 1.0).alias("key_b"),
        a("tail_low").alias("low_a"), b("head_low").alias("low_b"), a("tail_percussive").alias("percussive"), a("bpm").alias("bpm_a"),
        own("a", "grid_beats"), own("b", "grid_beats"), own("b", "mix_in_beat"), own("b", "drop_beat"), own("a", "seconds"), own("a", "has_curve"),
        own("b", "head_percussive"), own("a", "onset_density"), own("a", "texture_db"),
    )


def sub_scores(f: DataFrame, prefs: Prefs, beats_per_bar: int = 4) -> DataFrame:
    """Tempo, key, energy, vocal, grid, and by family struct and room."""
    sigma = prefs.max_stretch / 1.5
    octave = F.when(F.col("relation") == "SAME", 1.0).otherwise(0.85)
    exact = F.exp(-F.pow(F.col("stretch") / sigma, 2)) if sigma > 0 else F.when(F.col("stretch") <= 0, 1.0).otherwise(0.0)
    beat = F.exp(-F.pow(F.col("stretch") / max(0.5, sigma), 2))
    base = F.get(F.array(*map(F.lit, KEY_BY_DISTANCE)), F.least(F.greatest(F.col("distance"), F.lit(0)), F.lit(4)))
    weak = 1 - F.least("key_a", "key_b")
    columns = {
        "s_tempo": exact * octave, "s_tempo_beat": beat * octave, "s_key": base + (0.6 - base) * weak,
        "s_energy": F.exp(-F.pow(F.col("loudness_delta") / 6.0, 2)) * (1 - 0.5 * F.abs(F.col("energy_delta"))),
        "s_vocal": 1 - F.col("vocal_clash"), "s_grid": F.least("grid_a", "grid_b"),
        "matchable": (F.col("grid_a") >= 0.5) & (F.col("grid_b") >= 0.5),
    }
    for family in NEEDED_BARS:
        share = lambda c: F.least(F.lit(1.0), F.greatest(F.col(c), F.lit(0)) / float(prefs.needed_beats(family, beats_per_bar)))  # noqa: B023, E731
        columns[f"struct_{family}"] = prior(family, F.col("outro"), F.col("intro"))
        columns[f"room_{family}"] = share("outro_beats") * share("intro_beats")
    out = f.withColumns(columns)
    far = ~F.col("matchable") | (F.col("stretch") > prefs.max_stretch)
    return out.withColumn("far", far)


Blocker = tuple[str, Callable[[Prefs], Column]]


@dataclass(frozen=True)
class Strategy:
    """A strategy plug-in: its family, gates (why it can't be used) and score as columns of the scored pair."""

    id: str
    family: str
    score: Callable[[Prefs], Column]
    gates: tuple[Blocker, ...] = ()


c = F.col


def edge(table: dict[str, float], kind: Column) -> Column:
    out = F.lit(table["UNKNOWN"])
    for name, x in table.items():
        out = F.when(kind == name, x).otherwise(out)
    return out


def with_edges(scored: DataFrame) -> DataFrame:
    """What several strategies share, worked out once for each pair: how well the edges suit them, and their room."""
    o = {n: edge(t, c("outro")) for n, t in OUTRO_FIT.items()}
    i = {n: edge(t, c("intro")) for n, t in INTRO_FIT.items()}
    share = lambda x: F.least(F.lit(1.0), F.greatest(x, F.lit(0)) / 32.0)
    after_mix_in = F.when(c("grid_beats_b") > 0, F.greatest(c("grid_beats_b") - F.greatest(c("mix_in_beat_b"), F.lit(0)), F.lit(0))).otherwise(0)
    step = scored.withColumns({**{f"o_{n}": x for n, x in o.items()}, **{f"i_{n}": x for n, x in i.items()}, "near_room": share(c("outro_beats")) * share(c("intro_beats")), "deck_room": share(c("outro_beats")) * share(after_mix_in)})
    return step.withColumns({
        **{f"e_{n}": c(f"o_{n}") * c(f"i_{n}") for n in ("blend", "cut", "minimal", "bridge")},
        "e_stems": F.least("o_stems", "i_stems") * 0.5 + c("o_stems") * c("i_stems") * 0.5,
        "e_break": F.greatest("o_break", "i_break") * 0.6 + F.least("o_break", "i_break") * 0.4,
        "e_freeze": c("o_freeze") * 0.7 + c("i_freeze") * 0.3,
    })


def unless_far(x: float) -> Column:
    """1 where beats can't be matched, which is what a cut is for, else x."""
    return F.when(c("far"), 1.0).otherwise(x)


def rising() -> Column:
    return coerce(0.5 + 0.5 * ((c("energy_delta") + 1) / 2), 0.0, 1.0)


def low_end() -> Column:
    return F.least(F.lit(1.0), F.least("low_a", "low_b") / 0.3)


def drums() -> Column:
    """Percussiveness of both edges, .6 where it is not known."""
    known = lambda n: F.coalesce(coerce(c(n).cast("double"), 0.0, 1.0), F.lit(0.6))
    return known("percussive") * 0.7 + known("head_percussive_b") * 0.3


def too_far(p: Prefs) -> Column:
    over = coerce((c("stretch") - p.max_stretch) / max(0.5, 12.0 - p.max_stretch), 0.0, 1.0)
    return F.when(~c("matchable"), 1.0).when(c("stretch") > p.max_stretch, over).otherwise(0.0)


def harmonic() -> Column:
    return F.coalesce(1 - c("percussive"), F.lit(0.7))


MATCH: tuple[Blocker, ...] = (("not beat-matchable", lambda p: ~c("matchable")), ("stretch over the limit", lambda p: c("stretch") > p.max_stretch))
BEAT_GATES: tuple[Blocker, ...] = (*MATCH, ("no room", lambda p: c("near_room") < 0.5))
DECK_GATES: tuple[Blocker, ...] = (("no grid", lambda p: (c("grid_beats_a") < 2) | (c("grid_beats_b") < 2)), *MATCH, ("no room", lambda p: c("deck_room") < 0.5))
GRID_A: Blocker = ("no usable grid in a", lambda p: (c("grid_beats_a") <= 0) | (c("grid_a") < 0.5))
GRID_B: Blocker = ("no grid in b", lambda p: c("grid_beats_b") <= 0)
LANDING: Blocker = ("nothing to land on in b", lambda p: (c("grid_beats_b") <= 0) & (c("mix_in_beat_b") < 0))

#: Registry order decides ties. The weights, gates and limits.
STRATEGIES = (
    Strategy("crossfade", "fade", lambda p: F.when(c("far") | (c("distance") > 2), 0.3).otherwise(0.05)),
    Strategy("outroIntroMinimal", "structural", lambda p: (0.5 * c("e_minimal") + 0.2 * c("s_energy") + 0.15 * c("s_vocal") + 0.15 * F.least(F.lit(1.0), F.greatest(c("intro_beats"), F.lit(0)) / 4.0)) * F.when(c("has_curve_a"), 1.0).otherwise(0.8),
             (("a stops hard", lambda p: c("outro") == "HARD_STOP"), ("b starts cold", lambda p: c("intro") == "COLD_START"), ("a is shorter than the overlap", lambda p: c("seconds_a") < 4.0))),
    Strategy("phraseCut", "cut", lambda p: 0.4 * c("e_cut") + 0.25 * unless_far(0.55) + 0.2 * c("grid_a") + 0.15 * c("s_vocal"), (GRID_A, LANDING)),
    Strategy("beatMatchedBlend", "beat", lambda p: 0.3 * c("s_tempo_beat") + 0.15 * c("s_key") + 0.15 * c("s_energy") + 0.1 * (c("s_vocal") + c("s_grid") + c("e_blend") + c("near_room")), BEAT_GATES),
    Strategy("bassSwap", "beat", lambda p: 0.3 * c("s_tempo_beat") + 0.15 * low_end() + 0.1 * (c("s_key") + c("s_energy") + c("s_vocal") + c("s_grid") + c("near_room")) + 0.05 * c("e_blend"), BEAT_GATES),
    Strategy("stemSwap", "beat", lambda p: 0.25 * c("s_tempo") + 0.15 * c("s_key") + 0.1 * (c("s_energy") + c("s_vocal") + c("e_stems")) + 0.15 * c("s_grid") + 0.05 * c("deck_room") + 0.1 * 0.8, DECK_GATES),
    Strategy("drumBreakBridge", "beat", lambda p: 0.2 * c("s_tempo") + 0.1 * (c("s_key") + c("s_energy")) + 0.05 * (c("s_vocal") + c("deck_room")) + 0.15 * (c("s_grid") + c("e_break")) + 0.2 * drums(),
             (*DECK_GATES, ("tail not percussive", lambda p: c("percussive") <= 0.5))),
    Strategy("filterSweep", "cut", lambda p: 0.28 * unless_far(0.7) + 0.22 * c("near_room") + 0.18 * c("grid_a") + 0.14 * (1 - 0.4 * c("similarity")) + 0.1 * (1 - 0.5 * F.greatest(F.lit(0.0), c("low_a") + c("low_b") - 1)) + 0.08 * (1 - 0.5 * c("vocal_clash")),
             (GRID_A, GRID_B, ("less than a bar left", lambda p: c("outro_beats").between(0, 3)))),
    Strategy("echoOut", "cut", lambda p: (0.3 * unless_far(0.75) + 0.25 * c("i_echo") + 0.2 * c("grid_a") + 0.15 * (1 - 0.4 * F.greatest(F.lit(0.0), c("energy_delta"))) + 0.1 * (1 - 0.5 * c("vocal_clash"))) * F.when(c("bpm_a") < 80, 0.8).otherwise(1.0),
             (GRID_A, ("no tempo in a", lambda p: ~(c("bpm_a") > 0)))),
    Strategy("loopRollRiser", "cut", lambda p: 0.32 * c("i_drop") * F.when(c("drop_beat_b") >= 0, 1.0).otherwise(0.85) + 0.22 * rising() + 0.18 * c("grid_a") + 0.14 * unless_far(0.8) + 0.14 * (1 - abs(p.energy - 0.9)),
             (GRID_A, LANDING, ("energy wanted is low", lambda p: F.lit(p.energy < 0.4)), ("b starts silent", lambda p: c("intro") == "SILENCE"))),
    Strategy("harmonicBlend", "beat", lambda p: (0.25 * c("s_tempo_beat") + 0.3 * c("s_key") + 0.1 * (c("s_energy") + c("s_vocal") + c("s_grid") + c("near_room")) + 0.05 * c("e_blend")) * (1 - 0.05 * F.abs(c("shift"))),
             (*BEAT_GATES, ("shift over the limit", lambda p: F.abs(c("shift")) > p.max_shift), ("keys too far", lambda p: c("distance") > 1), ("keys too weak", lambda p: F.least("key_a", "key_b") < 0.6))),
    Strategy("spectralFreezeBridge", "structural", lambda p: 0.35 * c("e_freeze") + 0.2 * coerce(harmonic(), 0.0, 1.0) + 0.15 * F.coalesce(coerce(1 - c("onset_density_a").cast("double") / 2, 0.0, 1.0), F.lit(0.7)) + 0.15 * c("s_key") + 0.15 * F.exp(-F.pow(c("loudness_delta") / 6.0, 2)),
             (("tail too percussive", lambda p: harmonic() <= 0.6),)),
    Strategy("ambientBridge", "bridge", lambda p: 0.15 + 0.45 * F.greatest(too_far(p), F.when(c("distance") <= 1, 0.0).when(c("distance") == 2, 0.5).otherwise(1.0), coerce((c("e_bridge") - 0.7) / 0.3, 0.0, 1.0))),
    Strategy("brakeStop", "cut", lambda p: 0.3 * F.when(c("intro") == "COLD_START", 1.0).otherwise(0.85) + 0.22 * coerce((c("percussive") - 0.4) / 0.6, 0.0, 1.0) + 0.18 * rising() + 0.15 * (1 - abs(p.energy - 0.9)) + 0.1 * (0.5 + 0.5 * c("grid_a")) + 0.05,
             (("b neither starts cold nor on a beat", lambda p: ~c("intro").isin("COLD_START", "BEAT_INTRO")), ("energy wanted is low", lambda p: F.lit(p.energy < 0.5)), ("tail not percussive", lambda p: c("percussive") <= 0.4), ("a is too short to brake", lambda p: c("seconds_a") < 2.5))),
)
BLENDS = ("beatMatchedBlend", "bassSwap", "stemSwap", "drumBreakBridge", "harmonicBlend")


@dataclass(frozen=True)
class Modifier:
    """A modifier plug-in: how well it goes with a strategy (a column `strategy`) on a scored pair."""

    id: str
    score: Callable[[Prefs, Column], Column]


def tempo_glide(p: Prefs, strategy: Column) -> Column:
    ramp = coerce((c("stretch") - 0.5) / max(0.1, p.max_stretch - 0.5), 0.0, 1.0)
    fits = strategy.isin(*BLENDS) & (c("stretch") > 0.5) & (c("stretch") <= 2 * p.max_stretch) & c("matchable")
    return F.when(fits, coerce(ramp * F.least("grid_a", "grid_b"), 0.0, 1.0)).otherwise(0.0)


def texture_carry(p: Prefs, strategy: Column) -> Column:
    level = c("texture_db_a").cast("double")
    score = 0.55 * coerce((level + 45) / 25, 0.0, 1.0) + 0.45 * coerce((0.9 - c("similarity")) / 0.4, 0.0, 1.0)
    return F.when(strategy.eqNullSafe(F.lit("ambientBridge")) | level.isNull() | (level <= -45), 0.0).when(strategy == "spectralFreezeBridge", score * 0.5).otherwise(coerce(score, 0.0, 1.0))


MODIFIERS = (Modifier("tempoGlide", tempo_glide), Modifier("textureCarry", texture_carry))


#: I8: what a plan's fit is multiplied with, in this order.
FACTORS = ("weight", "energy", "variety", "bonus", "jitter", "learned")
#: How far jitter takes a score at most, and a little more for rounding.
JITTER = 0.05001


def energy_preference(strategy: str, energy: float) -> float:
    """I8: 1 less half the distance between the energy wanted and how showy a strategy is."""
    return min(1.0, max(0.0, 1 - abs(min(1.0, max(0.0, energy)) - AMBITION.get(strategy, 0.5)) * 0.5))


def variety(strategy: Column, previous: Column, penalty: float) -> Column:
    """Less for what was used just before, nothing for a showpiece used just before."""
    again = F.when(strategy.isin(*COOLDOWN), 0.0).otherwise(min(1.0, max(0.0, 1 - min(1.0, max(0.0, penalty)))))
    return F.when(strategy.eqNullSafe(previous) & previous.isNotNull(), again).otherwise(1.0)


def fitted(scored: DataFrame, prefs: Prefs, keys: list[str], strategies: tuple[Strategy, ...], why: bool = True) -> DataFrame:
    """The keys, what modifiers ask for, and each strategy's fit and blockers as columns fit_0, why_0, ...: every one worked out once.

    Without `why`, ok_0, ... in the place of blockers: whether the strategy can be used.
    """
    columns = {}
    for n, s in enumerate(strategies):
        if not why:
            fit = F.coalesce(coerce(s.score(prefs), 0.0, 1.0), F.lit(0.0))
            free = F.lit(s.id not in prefs.excluded or s.id == "crossfade")  # the floor is never excluded
            for _, gate in s.gates:
                free = free & ~F.coalesce(gate(prefs), F.lit(True))
            columns |= {f"fit_{n}": fit, f"ok_{n}": free}
            continue
        gates = F.array_compact(F.array(*[F.when(F.coalesce(g(prefs), F.lit(True)), F.lit(why)) for why, g in s.gates])) if s.gates else F.array().cast("array<string>")
        if s.id in prefs.excluded and s.id != "crossfade":  # the floor is never excluded
            gates = F.array_append(gates, F.lit("excluded"))
        columns |= {f"fit_{n}": F.coalesce(coerce(s.score(prefs), 0.0, 1.0), F.lit(0.0)), f"why_{n}": gates}
    asked = ("stretch", "matchable", "grid_a", "grid_b", "texture_db_a", "similarity")
    return with_edges(scored).select(*keys, *[n for n in asked if n not in keys], *[x.alias(n) for n, x in columns.items()])


def scores_of(scored: DataFrame, prefs: Prefs, keys: list[str], a: str, b: str, strategies: tuple[Strategy, ...] = STRATEGIES, modifiers: tuple[Modifier, ...] = MODIFIERS, previous: Column | None = None, learned: Column | None = None, rivals: list[list[int]] | None = None, exact: Column | None = None) -> DataFrame:
    """The keys, and each strategy's score, its factors and whether it can be used (ok and a fit over 0) as columns score_0, ok_0, fit_0, ...

    `rivals`: groups of strategies of which only the best is wanted, so that jitter is worked out, and a score given, only
    for those near the largest of their group; where `exact` holds, all have a score.
    """
    live = [m for m in modifiers if m.id not in prefs.excluded]
    more = {"__previous": previous, "__learned": learned}
    more = {n: x for n, x in more.items() if x is not None}
    step = fitted(scored.withColumns(more), prefs, [*keys, *more], strategies, why=False)
    usable = lambda n: F.col(f"ok_{n}") & (F.col(f"fit_{n}") > 0)
    goes = {f"goes_{n}_{m.id}": m.score(prefs, F.lit(s.id)) for n, s in enumerate(strategies) for m in live}
    step = step.select("*", *[x.alias(n) for n, x in goes.items()])
    factors = {}
    for n, s in enumerate(strategies):
        bonus = F.lit(1.0)
        for m in live:
            bonus = bonus + F.when(F.col(f"goes_{n}_{m.id}") > MODIFIER_FROM, F.col(f"goes_{n}_{m.id}") * MODIFIER_BONUS[m.id if m.id == "tempoGlide" else "textureCarry"]).otherwise(0.0)
        factors[f"bonus_{n}"] = bonus
        if previous is not None:
            factors[f"variety_{n}"] = variety(F.lit(s.id), F.col("__previous"), prefs.variety)
        if learned is not None:
            factors[f"learned_{n}"] = F.coalesce(F.element_at("__learned", F.lit(s.id)), F.lit(1.0))
    step = step.select("*", *[x.alias(n) for n, x in factors.items()])
    every = range(len(strategies))
    weight, showy = weights_of(prefs, strategies)
    step = step.select("*", *[(F.col(f"fit_{n}") * (weight[n] * showy[n]) * F.col(f"bonus_{n}")).alias(f"plain_{n}") for n in every])
    live_for = {n: usable(n) for n in every}
    if rivals is not None and learned is None:  # jitter changes a score by 5 % at most, so only those near the largest can be the best
        near = lambda n: F.col(f"plain_{n}") if previous is None else F.col(f"plain_{n}") * F.col(f"variety_{n}")
        step = step.select("*", *[largest([F.when(usable(n), near(n)) for n in group]).alias(f"__most_{g}") for g, group in enumerate(rivals)])
        for g, group in enumerate(rivals):
            most = F.col(f"__most_{g}")
            for n in group:
                close = (near(n) * (1 + JITTER) >= most * (1 - JITTER)) | (most <= 0)
                live_for[n] = usable(n) & (close if exact is None else close | exact)
    step = step.select("*", *[F.when(live_for[n], jitter(F.col(a), F.col(b), F.lit(prefs.seed), F.lit(s.id))).alias(f"jitter_{n}") for n, s in enumerate(strategies)])
    scores = []
    for n in every:
        score = F.col(f"plain_{n}") * F.col(f"jitter_{n}")
        score = score if previous is None else score * F.col(f"variety_{n}")
        scores.append((score if learned is None else score * F.col(f"learned_{n}")).alias(f"score_{n}"))
    return step.select("*", *scores)


def weights_of(prefs: Prefs, strategies: tuple[Strategy, ...] = STRATEGIES) -> tuple[list[float], list[float]]:
    """I8: each strategy's weight and energy preference."""
    return [max(0.0, float(prefs.weights.get(s.id, 1.0))) for s in strategies], [energy_preference(s.id, prefs.energy) for s in strategies]


def largest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def plans_of(scored: DataFrame, prefs: Prefs, keys: list[str], a: str, b: str, most: int | None = None, pin: Column | None = None, strategies: tuple[Strategy, ...] = STRATEGIES, modifiers: tuple[Modifier, ...] = MODIFIERS, previous: Column | None = None, learned: Column | None = None) -> DataFrame:
    """The usable strategies of each pair, the pinned one first, then by score, with their modifiers and the factors of the score.

    They are ranked within the row, so a ranking needs no shuffle and no window. `previous` is the strategy used just
    before, `learned` a map of strategies to multipliers (1 where it has none).
    """
    live = [m for m in modifiers if m.id not in prefs.excluded]
    every = range(len(strategies))
    single = most == 1 and pin is None
    held = keys if pin is None else [*keys, "__pin"]
    step = scores_of(scored if pin is None else scored.withColumn("__pin", pin), prefs, held, a, b, strategies, modifiers, previous, learned, [list(every)] if single else None)
    usable = lambda n: F.col(f"ok_{n}") & (F.col(f"fit_{n}") > 0)
    one = lambda name, n: F.col(f"{name}_{n}") if f"{name}_{n}" in step.columns else F.lit(1.0)
    weight, showy = weights_of(prefs, strategies)
    # What is the same for a strategy in every pair is looked up after the ranking.
    if single:
        first = step.withColumn("__first", F.greatest(*[F.col(f"score_{n}") for n in every]))
        best = first.withColumn("ordinal", F.coalesce(*[F.when(F.col(f"score_{n}") == F.col("__first"), n) for n in every]))
        pick = lambda of: F.get(F.array(*map(of, every)), F.col("ordinal"))
        own = lambda name: pick(lambda n: one(name, n) if name in ("variety", "learned") else F.col(f"{name}_{n}")).alias(name)
        taken = [*map(own, ("fit", "score", "variety", "bonus", "jitter", "learned")), *[pick(lambda n, m=m: F.col(f"goes_{n}_{m.id}")).alias(f"goes_{m.id}") for m in live]]
        step = best.select(*keys, F.when(F.col("ordinal").isNotNull(), F.array(F.struct("ordinal", *taken, F.lit(False).alias("pinned")))).alias("__plans"))
        count = F.lit(1)
    else:
        rows = []
        for n, s in enumerate(strategies):
            pinned = F.col("__pin").eqNullSafe(F.lit(s.id)) if pin is not None else F.lit(False)
            made = F.struct(
                (F.col(f"score_{n}") if pin is None else F.when(pinned, float("inf")).otherwise(F.col(f"score_{n}"))).alias("rank"), F.lit(-n).alias("turn"), F.lit(n).alias("ordinal"), F.col(f"fit_{n}").alias("fit"), F.col(f"score_{n}").alias("score"),
                one("variety", n).alias("variety"), F.col(f"bonus_{n}").alias("bonus"), F.col(f"jitter_{n}").alias("jitter"), one("learned", n).alias("learned"), pinned.alias("pinned"), *[F.col(f"goes_{n}_{m.id}").alias(f"goes_{m.id}") for m in live],
            )
            rows.append(F.when(usable(n), made))
        count = reduce(add, [F.coalesce(usable(n).cast("int"), F.lit(0)) for n in every])
        count = count if most is None else F.least(count, F.lit(most))
        # Sorted by the structs' own order, nulls last, without a comparator.
        step = step.select(*keys, F.slice(F.sort_array(F.array(*rows), asc=False), F.lit(1), count).alias("__plans"))
        count = F.lit(len(strategies))
    # Spark interprets what an explode is given, so the plans are a column before; were it given a bare column, a filter on its size would repeat all scores.
    found = step.select(*keys, F.posexplode(F.slice("__plans", F.lit(1), count)).alias("place", "s"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("s.ordinal"))
    goes_with = F.filter(F.array(*[F.struct(F.lit(m.id).alias("modifier"), F.col(f"s.goes_{m.id}").alias("score")) for m in live]), lambda m: m["score"] > MODIFIER_FROM) if live else F.expr("cast(array() as array<struct<modifier:string,score:double>>)")
    known = {"strategy": of([s.id for s in strategies]), "family": of([s.family for s in strategies]), "modifiers": goes_with, "weight": of(weight), "energy": of(showy)}
    return found.select(*keys, (F.col("place") + 1).alias("place"), *[known.get(n, F.col(f"s.{n}")).alias(n) for n in ("strategy", "ordinal", "family", "fit", "score", "modifiers", *FACTORS, "pinned")])


def first_plans(scored: DataFrame, prefs: Prefs, keys: list[str], a: str, b: str, groups: list[list[int]], strategies: tuple[Strategy, ...] = STRATEGIES, exact: Column | None = None) -> DataFrame:
    """Of each group of strategies the plan that plans_of() ranks first, as columns ordinal_0, place_0, ... of the groups; null where none can be used.

    All stays in the pair's row, so nothing is exploded. Places tell the groups' plans apart by rank; where `exact` holds they are
    the places among all plans of the pair.
    """
    step = scores_of(scored, prefs, keys, a, b, strategies, rivals=groups, exact=exact)
    top = step.select("*", *[largest([F.col(f"score_{n}") for n in group]).alias(f"top_{g}") for g, group in enumerate(groups)])
    which = lambda g, group: F.coalesce(*[F.when(F.col(f"score_{n}") == F.col(f"top_{g}"), n) for n in group]).alias(f"ordinal_{g}")
    top = top.select("*", *[which(g, group) for g, group in enumerate(groups)])
    ahead = lambda g, n: (F.col(f"score_{n}") > F.col(f"top_{g}")) | ((F.col(f"score_{n}") == F.col(f"top_{g}")) & (F.col(f"ordinal_{g}") > n))
    place = lambda g: F.when(F.col(f"ordinal_{g}").isNotNull(), reduce(add, [F.when(ahead(g, n), 1).otherwise(0) for n in range(len(strategies))], F.lit(1)))
    return top.select(*keys, *[F.col(f"ordinal_{g}") for g in range(len(groups))], *[place(g).alias(f"place_{g}") for g in range(len(groups))])


def candidates(scored: DataFrame, prefs: Prefs, keys: list[str], strategies: tuple[Strategy, ...] = STRATEGIES) -> DataFrame:
    """Pair x strategy in long form, with fit and blockers; one explode, no join."""
    rows = [F.struct(F.lit(s.id).alias("strategy"), F.lit(s.family).alias("family"), F.lit(n).alias("ordinal"), F.col(f"fit_{n}").alias("fit"), F.col(f"why_{n}").alias("blockers")) for n, s in enumerate(strategies)]
    found = fitted(scored, prefs, keys, strategies).select(*keys, F.explode(F.array(*rows)).alias("s"))
    return found.select(*keys, "s.*").withColumn("applicable", (F.size("blockers") == 0) & (F.col("fit") > 0))


def ranked(found: DataFrame, keys: list[str], pin: Column | None = None) -> DataFrame:
    """Plans of each pair: the pinned one first, then by score, registry order on ties."""
    first = F.lit(0) if pin is None else F.when(F.col("strategy") == pin, 0).otherwise(1)
    order = Window.partitionBy(*keys).orderBy(first, F.desc("score"), "ordinal")
    return found.filter("applicable").withColumn("place", F.row_number().over(order))


def best(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best strategy of each pair, by partial aggregation."""
    rank = F.struct("score", (-F.col("ordinal")).alias("ordinal"))
    return found.filter("applicable").groupBy(*keys).agg(F.max_by("strategy", rank).alias("strategy"), F.max("score").alias("score"))


def skipped(found: DataFrame, keys: list[str]) -> DataFrame:
    """Strategies that can't be used, with a row for every reason."""
    return found.filter("not applicable").select(*keys, "strategy", F.explode_outer("blockers").alias("reason"))


@dataclass(frozen=True)
class Rule:
    """A declarative strategy; None sets no limit."""

    id: str
    base: float
    needs_match: bool = False
    max_stretch: float | None = None
    max_distance: int | None = None
    outros: tuple[str, ...] | None = None
    intros: tuple[str, ...] | None = None
    energy: tuple[float, float] | None = None


def by_rules(scored: DataFrame, rules: list[Rule], keys: list[str], prefs: Prefs) -> DataFrame:
    """Every rule against every pair, as one projection and one explode."""
    rows = []
    for r in rules:
        why = [("stretch", c("stretch") > min(prefs.max_stretch, r.max_stretch if r.max_stretch is not None else prefs.max_stretch))]
        if r.needs_match:
            why.append(("not beat-matchable", ~c("matchable")))
        if r.max_distance is not None:
            why.append(("key distance", c("distance") > r.max_distance))
        if r.outros is not None:
            why.append(("outro", ~c("outro").isin(*r.outros)))
        if r.intros is not None:
            why.append(("intro", ~c("intro").isin(*r.intros)))
        if r.energy is not None:
            why.append(("energy", ~c("energy_delta").between(*r.energy)))
        blockers = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in why]))
        fit = (c("s_tempo") + c("s_key") + c("s_energy") + c("s_vocal")) / 4
        rows.append(F.struct(F.lit(r.id).alias("strategy"), blockers.alias("blockers"), (r.base * (0.5 + 0.5 * fit)).alias("fit")))
    return scored.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def pair_cost(scored: DataFrame, prefs: Prefs) -> Column:
    """Weighted distances of a scored pair, a penalty where no beat-matched move is possible; unknown tracks cost .5."""
    blocked = c("far") | (c("room_beat") < 0.5)
    total = (
        0.30 * (1 - c("s_tempo")) + 0.20 * (1 - c("s_key")) + 0.15 * (1 - c("s_energy")) + 0.10 * (1 - c("s_grid"))
        + 0.10 * (1 - c("struct_beat")) + 0.05 * (1 - c("room_beat")) + 0.10 * (1 - c("s_vocal")) + F.when(blocked, 0.25).otherwise(0.0)
    )
    return F.coalesce(total, F.lit(0.5))
