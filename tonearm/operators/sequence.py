"""Ordering many sets at once (ids J2-J9, D21, E4, H23): one bounded set is one group, groups run in parallel.

Sets over MOST items are cut by energy into blocks of a bounded size that are ordered in parallel and stitched in order,
or ordered online: one pass over a set's deck with a pool of bounded size.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.music import CAMELOT_MAJOR, CAMELOT_MINOR, KEY_BY_DISTANCE, arc_target
from tonearm.operators.pairs import COST_COLUMNS, INTROS, OUTROS, PRIORS, Prefs
from tonearm.functions.frames import spread, together

#: Items of a set that is ordered as a whole, penalties and weights of the objective, what a known best plan counts.
MOST, ARTIST_PENALTY, ARC_WEIGHT, PLANNER_BLEND, UNKNOWN_COST, ENOUGH = 500, 0.3, 0.5, 0.5, 0.5, 1e-9
#: Scale of the variety noise; online, what waiting for a whole pool is worth, how far from the arc a song may be, and what being further costs; items of a set whose costs the planner refines.
NOISE_SCALE, AGE_WEIGHT, ARC_BAND, OUT_OF_BAND, PLANNER_MOST = 0.6, 0.15, 0.2, 1.0, 24
#: Moves that a search may try.
BUDGET = 40_000_000


def objective(cost: Column, same_artist: Column, arc: str, quantile: Column, place: Column, n: Column) -> Column:
    """Pair cost, a penalty for the same artist, and distance to the energy arc: what `ordered` minimises, but for its noise."""
    off = F.lit(0.0) if arc == "flat" else ARC_WEIGHT * F.abs(quantile - arc_target(arc, place, n))
    return cost + F.when(same_artist, ARTIST_PENALTY).otherwise(0.0) + off


def refined(cost: Column, best: Column) -> Column:
    """Pair cost blended with the planner's best score, where one is known."""
    blend = PLANNER_BLEND * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), best))) + (1 - PLANNER_BLEND) * cost
    return F.when(best.isNull(), cost).otherwise(blend)


def blocks(items: DataFrame, group: str, energy: str, item: str, most: int = MOST) -> DataFrame:
    """Sets cut by energy into blocks of no more than about `most` items (columns `block`, `part`), with no window over a set.

    Approximate quantiles of each set cut it; what ties leave too large is dealt by hash to parts of half the size.
    """
    target = max(1, most // 2)
    cuts = F.percentile_approx(energy, F.lit([i / 1000 for i in range(1, 1000)]), 10_000)
    sizes = items.groupBy(group).agg(F.count("*").alias("__n"), cuts.alias("__cuts"))
    wanted = F.ceil(F.col("__n") / target)
    chosen = F.when(F.col("__n") <= most, F.array().cast("array<double>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(999), wanted.cast("int") - 1))), lambda k: F.get("__cuts", F.floor(k * 1000 / F.greatest(wanted, F.lit(2))).cast("int") - 1).cast("double")))
    )
    # A set of one library may need more than 1000 cuts; what they leave too large is split below as ties are.
    edges = sizes.select(F.col(group).alias("__g"), "__n", F.filter(chosen, lambda x: x.isNotNull()).alias("__edges"))
    cut = items.join(edges, F.col(group).eqNullSafe(F.col("__g"))).withColumn("block", F.when(F.col("__n") <= most, 0).otherwise(F.size(F.filter("__edges", lambda e: e < F.col(energy).cast("double")))).cast("int"))
    held = cut.groupBy("__g", "block").agg(F.count("*").alias("__in")).withColumnsRenamed({"__g": "__h", "block": "__b"})
    both = cut.join(held, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("block") == F.col("__b")))
    part = F.when(F.col("__in") <= most, 0).otherwise(F.pmod(F.xxhash64(item), F.ceil(F.col("__in") / target))).cast("int")
    return both.withColumn("part", part).drop("__n", "__g", "__edges", "__h", "__b", "__in")


Features = dict[str, np.ndarray]
#: (features of the items before, features of the items after) to costs, one row for each before, one column for each after.
Costs = Callable[[Features, Features], np.ndarray]


def features_of(rows: pd.DataFrame) -> Features:
    return {n: rows[n].to_numpy() for n in COST_COLUMNS}


#: Tables that all pairs share: the structural prior, places of its names.
BEAT_PRIORS, OUTRO_PLACES, INTRO_PLACES = np.array(PRIORS["beat"]), {k: i for i, k in enumerate(OUTROS)}, {k: i for i, k in enumerate(INTROS)}


@cache
def _key_scores(limit: int) -> np.ndarray:
    """The key score of every two of the 24 keys (twice the tonic, one more in minor), b shifted by up to `limit` where that helps."""
    number = lambda k: (CAMELOT_MINOR if k % 2 else CAMELOT_MAJOR)[k // 2]

    def distance(a: int, b: int) -> int:
        d = (number(a) - number(b)) % 12
        return min(d, 12 - d) + (a % 2 != b % 2)

    best = lambda a, b: d if (d := distance(a, b)) <= 1 else min(distance(a, (b + 2 * s) % 24) for s in range(-limit, limit + 1))
    return np.array([[KEY_BY_DISTANCE[min(4, best(a, b))] for b in range(24)] for a in range(24)])


def pair_costs(before: Features, after: Features, prefs: Prefs) -> np.ndarray:
    """J1 for all pairs of two lists of items: the same terms as the column pairs.pair_cost, as arrays; pairs with an unknown tempo or value cost UNKNOWN_COST."""
    a, b = (lambda n: before[n][:, None]), (lambda n: after[n][None, :])
    f = lambda v: np.asarray(v, float)
    known = lambda v: np.where(np.isnan(v), 0.0, v)
    share_of = lambda v: np.minimum(np.maximum(v, 0), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = f(b("bpm")) / f(a("bpm"))
        tries = np.stack([np.abs(np.log(r)), np.abs(np.log(r / 2)), np.abs(np.log(r * 2))])
        half, double = (tries[1] < tries[0]) & (tries[1] <= tries[2]), (tries[2] < tries[1]) & (tries[2] < tries[0])
        stretch = np.abs(np.where(half, r / 2, np.where(double, r * 2, r)) - 1) * 100
        octave = np.where(half | double, 0.85, 1.0)
        sigma = prefs.max_stretch / 1.5
        tempo = (np.exp(-((stretch / sigma) ** 2)) if sigma > 0 else (stretch <= 0).astype(float)) * octave
        code = lambda side: np.nan_to_num(f(side["tonic"])).astype(int) % 12 * 2 + side["minor"].astype(bool)
        base = _key_scores(max(0, min(6, prefs.max_shift)))[code(before)[:, None], code(after)[None, :]]
        weak = 1 - np.minimum(share_of(f(a("key_strength"))), share_of(f(b("key_strength"))))
        key = base + (0.6 - base) * weak
        audible = lambda v: np.isfinite(v) & (v > -100)
        la, lb = f(a("lufs")), f(b("lufs"))
        louder = np.where(audible(la) & audible(lb), lb - la, 0.0)
        rise = known(np.minimum(np.maximum(f(b("head_energy")) - f(a("tail_energy")), -1), 1))
        energy = np.exp(-((louder / 6) ** 2)) * (1 - 0.5 * np.abs(rise))
        vocal = 1 - known(share_of(f(a("tail_vocal")) * f(b("head_vocal"))))
        grid = np.minimum(share_of(f(a("grid_confidence"))), share_of(f(b("grid_confidence"))))
        place = lambda places, kinds: np.array([places.get(k, 5) for k in kinds], int)
        struct = BEAT_PRIORS[place(OUTRO_PLACES, before["outro"])[:, None], place(INTRO_PLACES, after["intro"])[None, :]]
        share = lambda v: np.minimum(1.0, np.maximum(f(v), 0) / prefs.needed_beats("beat"))
        room = share(a("outro_beats")) * share(b("intro_beats"))
        blocked = (grid < 0.5) | (stretch > prefs.max_stretch) | (room < 0.5)
        total = 0.30 * (1 - tempo) + 0.20 * (1 - key) + 0.15 * (1 - energy) + 0.10 * (1 - grid) + 0.10 * (1 - struct) + 0.05 * (1 - room) + 0.10 * (1 - vocal) + np.where(blocked, 0.25, 0.0)
    return np.where(np.isnan(total), UNKNOWN_COST, total)


def noise(seed: int, variety: float, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Variety * NOISE_SCALE * u for ordered pairs of item numbers (64-bit), u in [0, 1) from a 64-bit mix of the seed and both."""
    if variety <= 0:
        return np.zeros((len(before), len(after)))
    one = np.uint64
    z = one(seed & (2**64 - 1)) ^ (before.astype(np.uint64)[:, None] * one(0x9E3779B97F4A7C15)) ^ (after.astype(np.uint64)[None, :] * one(0xD6E8FEB86659FD93))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> one(shift))) * one(factor)
    return variety * NOISE_SCALE * ((z ^ (z >> one(31))) >> one(11)).astype(float) / 2**53


def target_of(arc: str, place: np.ndarray | int, n: int) -> np.ndarray:
    """H20 as numbers: the energy quantile that an arc wants at a place of n."""
    k = np.asarray(place, float)
    p = k / max(1, n - 1)
    if arc == "wave":
        return 0.5 - 0.5 * np.cos(2 * np.pi * k / 10)
    if arc == "peak":
        return np.where(p <= 0.7, 0.15 + 0.85 * p / 0.7, 1 - 0.6 * (p - 0.7) / 0.3)
    return {"flat": 0.5 + 0 * p, "rising": p}[arc]


def mid_quantile(known: list[float], value: float) -> float:
    """The mid-rank quantile of a value among sorted ones."""
    if len(known) <= 1:
        return 0.5
    lo, hi = bisect_left(known, value), bisect_right(known, value)
    return min(1.0, max(0.0, ((lo + hi - 1) / 2 if hi > lo else lo - 0.5) / (len(known) - 1)))


@dataclass(frozen=True)
class Online:
    """Settings of the online order."""

    arc: str = "flat"
    arc_weight: float = ARC_WEIGHT
    variety: float = 0.0
    seed: int = 0
    pool: int = 32
    horizon: int | None = None


def online(deck: Iterator[dict], n: int, costs: Costs, o: Online) -> Iterator[tuple[object, int, float]]:
    """(item, position, cost from the item before) of one set of n items, taken from its deck one by one.

    The next song is always the best of a pool: cost, artist, noise and distance to the arc, less for having waited. The
    pool is filled up from the deck; with an arc, songs that have waited a quarter of a pool and are off the arc go
    under the deck. Beyond the horizon the pool and the deck follow as they are. Held are the pool, the songs put back,
    and the energies seen so far, in order.
    """
    put_back: deque[dict] = deque()
    ahead: deque[dict] = deque()
    bent = o.arc != "flat" and o.arc_weight > 0
    seen: list[float] = []

    def drawn() -> dict | None:
        if ahead:
            return ahead.popleft()
        return next(deck, None) or (put_back.popleft() if put_back else None)

    def left() -> bool:
        if not ahead and (following := next(deck, None)) is not None:
            ahead.append(following)
        return bool(ahead or put_back)

    def known(x: float | None) -> bool:
        return x is not None and x == x

    def admit(row: dict) -> dict:
        if not row.get("admitted"):
            row["admitted"] = True
            if bent and known(row["energy"]):
                insort(seen, row["energy"])
        return row

    def listed(rows: list[dict]) -> Features:
        return {c: np.array([r[c] for r in rows], object if c in ("outro", "intro") else None) for c in COST_COLUMNS}

    last = drawn()
    if last is None:
        return
    admit(last)
    yield last["item"], 0, 0.0
    pool: list[dict] = []

    def refill(step: int) -> None:
        while len(pool) < o.pool and left():
            row = admit(drawn())
            row["entered"] = step
            pool.append(row)

    refill(0)
    step = 0
    for step in range(1, min(n - 1, o.horizon if o.horizon is not None else n) + 1):
        pair = costs(listed([last]), listed(pool))[0]
        score = pair + noise(o.seed, o.variety, np.array([last["number"]], np.int64), np.array([r["number"] for r in pool], np.int64))[0]
        target = float(target_of(o.arc, step, n))
        for i, row in enumerate(pool):
            if last["artist"] and row["artist"] == last["artist"]:
                score[i] += ARTIST_PENALTY
            if bent and known(row["energy"]):
                off = abs(mid_quantile(seen, row["energy"]) - target)
                score[i] += o.arc_weight * off + (OUT_OF_BAND if off > ARC_BAND else 0.0)
            score[i] -= AGE_WEIGHT * min(1.0, (step - row["entered"]) / o.pool)
        best = int(np.argmin(score))
        last = pool.pop(best)
        yield last["item"], step, float(pair[best])
        if bent and left():
            wanted = float(target_of(o.arc, step + 1, n))
            for row in [r for r in pool if step - r["entered"] >= max(1, o.pool // 4) and known(r["energy"]) and abs(mid_quantile(seen, r["energy"]) - wanted) > ARC_BAND]:
                pool.remove(row)
                put_back.append(row)
        refill(step)
    rest = itertools.chain(pool, iter(drawn, None))
    for row in rest:
        step += 1
        both = last.get("admitted") and row.get("admitted")
        yield row["item"], step, float(costs(listed([last]), listed([row]))[0, 0]) if both else UNKNOWN_COST
        last = row


def online_order(items: DataFrame, group: str, item: str, prefs: Prefs, options: Online = Online(), artist: str = "artist", energy: str = "energy", costs: Callable[[Features, Features, Prefs], np.ndarray] = pair_costs) -> DataFrame:
    """Every set in one pass over its deck, an order by hash of seed and item: (group, item, position, cost). Sets run in parallel, rows are streamed."""
    kinds = dict(items.dtypes)
    sizes = items.groupBy(group).agg(F.count("*").alias("__n")).withColumnRenamed(group, "__g")
    named = items.select(F.col(group).alias("set"), F.col(item).alias("item"), F.lower(F.trim(F.coalesce(artist, F.lit("")))).alias("artist"), F.col(energy).cast("double").alias("energy"), F.xxhash64(F.lit(options.seed), item).alias("number"), *COST_COLUMNS)
    dealt = spread(named.join(sizes, F.col("set").eqNullSafe(F.col("__g"))).drop("__g"), "set").sortWithinPartitions("set", "number", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, batch.num_rows, 256) for row in batch.slice(i, 256).to_pylist())
        for key, deck in itertools.groupby(rows, key=lambda r: r["set"]):
            first = next(deck)
            made = online(itertools.chain([first], deck), first["__n"], lambda a, b: costs(a, b, prefs), options)
            while part := list(itertools.islice(made, 4096)):
                columns = list(zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), *map(pa.array, columns)], names=[group, item, "position", "cost"])

    return dealt.mapInArrow(run, f"{group} {kinds[group]}, {item} {kinds[item]}, position long, cost double")


def greedy(obj: np.ndarray, arc: np.ndarray | None, start: int = 0) -> list[int]:
    """From the start item on, always the cheapest that is left (the first of equals); arc[t, k] is what item t costs at place k."""
    n = len(obj)
    order, free = [start], np.ones(n, bool)
    free[start] = False
    while len(order) < n:
        score = obj[order[-1]] + (arc[:, len(order)] if arc is not None else 0.0)
        best = int(np.argmin(np.where(free, score, np.inf)))
        order.append(best)
        free[best] = False
    return order


def improved(order: list[int], obj: np.ndarray, arc: np.ndarray | None = None, budget: int = BUDGET) -> list[int]:
    """Reversals and moves of one to three items, the first that helps each time, until none does; the first item stays."""
    o, n, work = np.array(order), len(order), 0
    places = np.arange(n)

    def bent_reversals() -> bool:
        nonlocal o, work
        any_ = False
        for i in range(1, n - 1):
            j = i + 1
            while j < n and work < budget:
                forward = np.concatenate([[0.0], np.cumsum(obj[o[i:-1], o[i + 1 :]])])
                backward = np.concatenate([[0.0], np.cumsum(obj[o[i + 1 :], o[i:-1]])])
                ends = np.arange(j, n)
                after = o[np.minimum(ends + 1, n - 1)]
                tail = np.where(ends < n - 1, obj[o[i], after] - obj[o[ends], after], 0.0)
                delta = backward[ends - i] - forward[ends - i] + obj[o[i - 1], o[ends]] - obj[o[i - 1], o[i]] + tail
                delta += np.array([arc[o[i : e + 1][::-1], places[i : e + 1]].sum() - arc[o[i : e + 1], places[i : e + 1]].sum() for e in ends])
                good = np.flatnonzero(delta < -ENOUGH)
                if not len(good):
                    work += len(ends)
                    break
                e = int(ends[good[0]])
                work += e - j + 1 + n
                o[i : e + 1] = o[i : e + 1][::-1].copy()
                any_, j = True, e + 1
        return any_

    def bent_moves() -> bool:
        nonlocal o, work
        any_ = False
        for size in (1, 2, 3):
            i = 1
            while i + size <= n and work < budget:
                rest = np.concatenate([o[:i], o[i + size :]])
                part = o[i : i + size]
                removal = -obj[o[i - 1], part[0]] + (obj[o[i - 1], o[i + size]] - obj[part[-1], o[i + size]] if i + size < n else 0.0)
                at = np.arange(1, len(rest) + 1)  # the part stands before rest[at]
                left = rest[at - 1]
                right = rest[np.minimum(at, len(rest) - 1)]
                inner = np.where(at < len(rest), obj[part[-1], right] - obj[left, right], 0.0)
                delta = removal + obj[left, part[0]] + inner
                base = arc[o, places].sum()
                delta += np.array([arc[np.concatenate([rest[:p], part, rest[p:]]), places].sum() - base for p in at])
                delta[at == i] = 0.0  # where it stands now
                good = np.flatnonzero(delta < -ENOUGH)
                work += int(good[0]) + 1 + n if len(good) else len(at)
                if len(good):
                    p = int(at[good[0]])
                    o = np.concatenate([rest[:p], part, rest[p:]])
                    any_ = True
                else:
                    i += 1
        return any_

    flat = np.ascontiguousarray(obj).ravel()

    def reversals() -> bool:
        """All ends of several starts at once, as many again while none helps; sums run on from each start."""
        nonlocal o, work
        any_, i, j, many = False, 1, 2, 1  # j: the first end to try from i
        ends = np.arange(n)[None, :]
        while i < n - 1 and work < budget:
            starts = np.arange(i, min(i + many, n - 1))
            lows = starts + 1
            lows[0] = j
            spent = np.cumsum(n - lows)
            rows = int(np.count_nonzero(work + spent - (n - lows) < budget))
            starts, lows, spent = starts[:rows, None], lows[:rows], spent[:rows]
            ahead, back = flat[o[:-1] * n + o[1:]], flat[o[1:] * n + o[:-1]]
            run = lambda steps: np.concatenate([np.zeros((rows, 1)), np.cumsum(np.where(ends[:, :-1] >= starts, steps[None, :], 0.0), axis=1)], axis=1)  # noqa: B023, E731
            before, first, after = o[starts - 1], o[starts], o[np.minimum(ends + 1, n - 1)]
            tail = np.where(ends < n - 1, flat[first * n + after] - flat[o[ends] * n + after], 0.0)
            delta = run(back) - run(ahead) + flat[before * n + o[ends]] - flat[before * n + first] + tail
            good = (delta < -ENOUGH) & (ends >= lows[:, None])
            helps = np.flatnonzero(good.any(axis=1))
            if not len(helps):
                work += int(spent[-1])
                i, many = i + rows, min(32, 2 * many)
                j = i + 1
                continue
            row = int(helps[0])
            e = int(np.argmax(good[row]))
            i, many, any_ = i + row, 1, True
            work += (int(spent[row - 1]) if row else 0) + e - int(lows[row]) + 1 + n
            o[i : e + 1] = o[i : e + 1][::-1].copy()
            j = e + 1
            if j >= n:
                i, j = i + 1, i + 2
        return any_

    def moves() -> bool:
        """All places of several parts at once, as many again while none helps; the first part and place that help count."""
        nonlocal o, work
        any_ = False
        for size in (1, 2, 3):
            i, many, m = 1, 1, n - size
            at = np.arange(1, m + 1)[None, :]  # the part stands before the at-th of the rest
            while i + size <= n and work < budget:
                starts = np.arange(i, min(i + many, m + 1, i + -(-(budget - work) // m)))[:, None]
                nxt = np.minimum(at, m - 1)
                left, right = o[at - 1 + size * (at - 1 >= starts)], o[nxt + size * (nxt >= starts)]
                first, last, before, after = o[starts], o[starts + size - 1], o[starts - 1], o[np.minimum(starts + size, n - 1)]
                removal = -flat[before * n + first] + np.where(starts + size < n, flat[before * n + after] - flat[last * n + after], 0.0)
                inner = np.where(at < m, flat[last * n + right] - flat[left * n + right], 0.0)
                delta = removal + flat[left * n + first] + inner
                delta[at == starts] = 0.0  # where it stands now
                good = delta < -ENOUGH
                helps = np.flatnonzero(good.any(axis=1))
                if not len(helps):
                    work += m * len(starts)
                    i, many = i + len(starts), min(32, 2 * many)
                    continue
                row = int(helps[0])
                place = int(np.argmax(good[row]))
                work += m * row + place + 1 + n
                i, many, any_ = i + row, 1, True
                part, rest = o[i : i + size], np.concatenate([o[:i], o[i + size :]])
                o = np.concatenate([rest[: place + 1], part, rest[place + 1 :]])
        return any_

    if n >= 3:
        while work < budget:
            if not ((reversals() | moves()) if arc is None else (bent_reversals() | bent_moves())):
                break
    return o.tolist()


def ordered(items: DataFrame, group: str, item: str, prefs: Prefs, artist: str = "artist", arc: str = "flat", energy: str = "energy", improve: bool = True, variety: float = 0.0, seed: int | None = None, costs: Callable[[Features, Features, Prefs], np.ndarray] = pair_costs, best: DataFrame | None = None) -> DataFrame:
    """Each block of each set by the whole objective: (group, block, part, item, position, cost).

    `cost` is the objective's pair part from the item before (0 for the first). With a seed the order starts at an item
    that it draws, else at the first by id; `variety` adds noise to the costs. `best` (group, a, b, score: the planner's
    best score of ordered pairs) refines the costs of sets of up to PLANNER_MOST items. A block has about MOST items, so
    its matrix is small.
    """
    kinds, refine = dict(items.dtypes), best is not None
    wanted = list(dict.fromkeys([group, "block", "part", item, artist, energy, *COST_COLUMNS]))
    rows = items.select(*wanted, F.xxhash64(F.lit(seed or 0), item).alias("__number"))
    if refine:
        known = best.groupBy(F.col(group).alias("__g"), F.col("a").alias("__a")).agg(F.collect_list(F.struct("b", "score")).alias("__best"))
        rows = rows.join(known, F.col(group).eqNullSafe(F.col("__g")) & (F.col(item) == F.col("__a")), "left").drop("__g", "__a")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item).reset_index(drop=True)
        n = len(rows)
        names = rows[artist].fillna("").str.strip().str.lower().to_numpy()
        x, number = features_of(rows), rows["__number"].to_numpy(np.int64)
        obj = costs(x, x, prefs)
        if refine and n <= PLANNER_MOST:
            place = {v: i for i, v in enumerate(rows[item])}
            for i, scores in enumerate(rows["__best"]):
                for pair in scores if scores is not None else ():
                    if pair["b"] in place and pair["score"] is not None and pair["score"] == pair["score"]:
                        j = place[pair["b"]]
                        obj[i, j] = PLANNER_BLEND * (1 - min(1.0, max(0.0, pair["score"]))) + (1 - PLANNER_BLEND) * obj[i, j]
        obj = obj + np.where((names[:, None] == names[None, :]) & (names[:, None] != ""), ARTIST_PENALTY, 0.0) + noise(seed or 0, variety, number, number)
        bend = None
        if arc != "flat":
            e = rows[energy].to_numpy(float)
            known = np.sort(e[~np.isnan(e)]).tolist()
            q = np.array([mid_quantile(known, v) for v in e])
            bend = np.where(np.isnan(e)[:, None], 0.0, ARC_WEIGHT * np.abs(q[:, None] - target_of(arc, np.arange(n), n)[None, :]))
        order = greedy(obj, bend, 0 if seed is None else int(np.argmin(number)))
        if improve:
            order = improved(order, obj, bend)
        cost = [0.0, *[obj[x, y] for x, y in zip(order, order[1:], strict=False)]]
        return pd.DataFrame({group: rows[group], "block": rows["block"], "part": rows["part"], item: rows[item].to_numpy()[order], "position": np.arange(n), "cost": cost})

    return spread(rows, group, "block", "part").groupBy(group, "block", "part").applyInPandas(solve, f"{group} {kinds[group]}, block int, part int, {item} {kinds[item]}, position long, cost double")


def stitched(parts: DataFrame, group: str, items: DataFrame | None = None) -> DataFrame:
    """Blocks one after another: positions shifted by the sizes of the blocks before, counted in `items`, what was ordered, where given: else all is ordered twice."""
    sizes = (parts if items is None else items).groupBy(group, "block", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.withColumn("before", before).drop("n")
    return parts.join(shift, [group, "block", "part"]).withColumn("position", F.col("position") + F.col("before")).drop("before", "block", "part")


def report(order: DataFrame, group: list[str], position: list[str], cost: Column, columns: list[str], name: str = "cost") -> DataFrame:
    """Total and mean cost of consecutive pairs; `cost` is a column over structs a and b."""
    b = F.lead(F.struct(*columns)).over(Window.partitionBy(*group).orderBy(*position))
    pairs = order.select(*group, F.struct(*columns).alias("a"), b.alias("b")).filter("b is not null").select(*group, cost.alias("__c"))
    return pairs.groupBy(*group).agg(F.sum("__c").alias(f"total_{name}"), F.avg("__c").alias(f"mean_{name}"), F.count("*").alias("pairs"))


def random_orders(items: DataFrame, group: str, item: str, seeds: int) -> DataFrame:
    """Seeded random orders of each set, to compare an order with: (group, seed, item, position)."""
    each = items.select(group, item, F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    w = Window.partitionBy(group, "seed").orderBy(_drawn("seed", item), item)
    return each.withColumn("position", F.row_number().over(w) - 1)


def _drawn(seed: str, item: str) -> Column:
    return F.md5(F.concat_ws(":", F.col(seed).cast("string"), F.col(item).cast("string")))


def order_gains(items: DataFrame, group: str, place: str, cost: Column, columns: list[str], seeds: int) -> DataFrame:
    """(group, mean_cost, gain) of each set's own order over its random_orders.

    The own order goes along as seed 0 and all columns are carried, so sets that are partitioned by group already need no shuffle and no join.
    """
    each = items.select(group, place, *columns, F.explode(F.sequence(F.lit(0), F.lit(seeds))).alias("__seed"))
    each = each.withColumn("__key", F.when(F.col("__seed") > 0, _drawn("__seed", place)).otherwise(""))
    means = report(each, [group, "__seed"], ["__key", place], cost, columns)
    of = lambda own: F.when((F.col("__seed") == 0) == F.lit(own), F.col("mean_cost"))
    both = means.groupBy(group).agg(F.max(of(True)).alias("__own"), F.collect_list(of(False)).alias("__random"))
    return both.select(group, F.col("__own").alias("mean_cost"), gain_over(F.col("__own"), F.col("__random")).alias("gain"))


def gain_over(mean_cost: Column, random_costs: Column) -> Column:
    """The share by which an order's mean cost lies below the median of random orders' (an array)."""
    sorted_ = F.sort_array(random_costs)
    n = F.size(sorted_)
    middle = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    return F.when(middle > 0, 1 - mean_cost / middle)


def horizon(queue: DataFrame, group: str, anchor: Column, length: int = 64, ahead: int = 16) -> DataFrame:
    """The slots after an anchor that a pass may arrange, for queues whose arranged part ends within `ahead` of it.

    queue: group, item, position, version, arranged_to (the last position arranged so far).
    """
    due = F.coalesce(F.col("arranged_to"), F.lit(-1)) - anchor < ahead
    return queue.filter(due & (F.col("position") > anchor) & (F.col("position") <= anchor + length))


def arranged(queue: DataFrame, made: DataFrame, group: str) -> DataFrame:
    """Queue (group, item, position, version) with the orders made for it (group, version, item, position) put in place.

    An order counts only while the queue's version is the one it was made for and its items are those in its slots.
    """
    slots = made.groupBy(group, "version").agg(F.min("position").alias("__from"), F.max("position").alias("__to"), F.sort_array(F.collect_list("item")).alias("__new"))
    inside = queue.join(slots, [group, "version"]).filter(F.col("position").between(F.col("__from"), F.col("__to")))
    good = inside.groupBy(group, "version").agg(F.sort_array(F.collect_list("item")).alias("__old"), F.first("__new").alias("__new"), F.first("__from").alias("__from"), F.first("__to").alias("__to")).filter("__old = __new")
    good = good.select(group, "version", "__from", "__to")
    kept = queue.join(good, [group, "version"], "left").filter(F.col("__from").isNull() | ~F.col("position").between(F.col("__from"), F.col("__to"))).drop("__from", "__to")
    return together(kept, made.join(good.select(group, "version"), [group, "version"], "left_semi").select(*queue.columns))
