"""From ranked plans to what is played: styles, gates, chains, explanations, rooms and programs (ids B10, E6, F12, H30, I9, I12, I14, I15, K10, N9)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.frames import by_runs, in_runs
from tonearm.functions.text import read_param
from tonearm.operators.pairs import COOLDOWN, NEEDED_BARS, STRATEGIES, Prefs, Strategy, first_plans

PREFER_BOOST = 1.3
#: Stretch up to which a pair counts as matched.
MATCHED_STRETCH = 3.0


@dataclass(frozen=True)
class Spec:
    """A knob: its kind (double, int, bool, choice), default and range, as functions.text.read_param takes them."""

    id: str
    kind: str
    default: object
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()

    def read(self, params: Column) -> Column:
        """The knob's value in a map of texts: clamped, or its default where it can't be read."""
        return read_param(params, self.id, self.kind, self.default, self.least, self.most, self.choices)

    def described(self) -> str:
        """One line for a list of knobs."""
        span = f" {self.least}..{self.most}" if self.least is not None or self.most is not None else ""
        return f"{self.id}: {self.kind}{span}{' ' + '|'.join(self.choices) if self.choices else ''} (default {self.default})"


@dataclass(frozen=True)
class Style:
    """A patch of settings; None leaves a setting as it is."""

    id: str
    energy: float | None = None
    max_stretch: float | None = None
    max_shift: int | None = None
    variety: float | None = None
    overlap_bars: int | None = None
    key_lock: bool | None = None
    weights: tuple[tuple[str, float], ...] = ()
    prefer: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    presets: tuple[tuple[str, str], ...] = ()

    def problem(self) -> str | None:
        """The first setting outside its range."""
        ranges = (("energy", self.energy, 1), ("max_stretch", self.max_stretch, 16), ("max_shift", self.max_shift, 6), ("variety", self.variety, 1))
        for name, x, most in ranges:
            if x is not None and not 0 <= x <= most:
                return f"{name} must be from 0 to {most}, not {x}"
        if self.overlap_bars is not None and not 1 <= self.overlap_bars <= 64:
            return f"overlap_bars must be from 1 to 64, not {self.overlap_bars}"
        bad = [f"{s} {w}" for s, w in self.weights if not 0 <= w < float("inf")]
        return f"weights out of range: {', '.join(bad)}" if bad else None

    def apply(self, prefs: Prefs) -> Prefs:
        """Weights multiply, preferred strategies gain PREFER_BOOST, disabled ones join those that are, the rest replaces."""
        weights = dict(prefs.weights)
        for s, w in (*self.weights, *((s, PREFER_BOOST) for s in self.prefer)):
            weights[s] = weights.get(s, 1.0) * w
        new = {n: v for n, v in (("energy", self.energy), ("max_stretch", self.max_stretch), ("max_shift", self.max_shift), ("variety", self.variety), ("overlap_bars", self.overlap_bars), ("key_lock", self.key_lock)) if v is not None}
        return replace(prefs, weights=weights, excluded=tuple(dict.fromkeys((*prefs.excluded, *self.disable))), **new)


#: The knobs of a plan's settings.
SPECS = (
    Spec("energy", "double", 0.5, 0, 1), Spec("max_stretch", "double", 8.0, 0, 16), Spec("max_shift", "int", 2, 0, 6),
    Spec("variety", "double", 0.3, 0, 1), Spec("overlap_bars", "int", 8, 1, 64), Spec("key_lock", "bool", True),
)
#: The styles that ship.
STYLES = {
    s.id: s
    for s in (
        Style("smooth", energy=0.3, overlap_bars=24, variety=0.2, prefer=("beatMatchedBlend", "bassSwap", "harmonicBlend"), weights=(("phraseCut", 0.8), ("brakeStop", 0.5), ("loopRollRiser", 0.5)), presets=(("bassSwap", "long-bass-swap"), ("crossfade", "long-crossfade"))),
        Style("club", energy=0.7, key_lock=True, prefer=("bassSwap", "stemSwap", "drumBreakBridge"), weights=(("crossfade", 0.7), ("ambientBridge", 0.7)), presets=(("bassSwap", "tight-bass-swap"),)),
        Style("radio", energy=0.4, overlap_bars=8, prefer=("phraseCut", "outroIntroMinimal", "echoOut"), weights=(("harmonicBlend", 0.7), ("stemSwap", 0.7), ("ambientBridge", 0.6)), presets=(("crossfade", "quick-crossfade"),)),
        Style("chill", energy=0.2, overlap_bars=32, max_stretch=4.0, prefer=("ambientBridge", "spectralFreezeBridge", "harmonicBlend", "outroIntroMinimal"), disable=("brakeStop", "loopRollRiser"), presets=(("crossfade", "long-crossfade"),)),
        Style("adventurous", energy=0.9, max_stretch=12.0, variety=0.7, prefer=("loopRollRiser", "brakeStop", "echoOut", "filterSweep", "drumBreakBridge", "stemSwap")),
        Style("purist", energy=0.1, overlap_bars=8, key_lock=True, max_stretch=3.0, max_shift=0, prefer=("outroIntroMinimal", "crossfade", "phraseCut"),
              disable=("echoOut", "filterSweep", "loopRollRiser", "brakeStop", "spectralFreezeBridge", "ambientBridge", "drumBreakBridge", "stemSwap", "textureCarry", "tempoGlide"),
              presets=(("phraseCut", "dry-cut"), ("bassSwap", "tight-bass-swap"), ("beatMatchedBlend", "short-blend"))),
    )
}


def gated(context: Column, same_album: Column, enabled: bool = True, in_albums: bool = False, keep_album_flow: bool = True) -> Column:
    """Does a pair get a transition at all? By the queue's context and whether both are of one album."""
    if not enabled:
        return F.lit(False)
    same = F.coalesce(same_album, F.lit(False))
    album = F.lit(True) if in_albums else ~same
    shuffle = ~same if keep_album_flow else F.lit(True)
    return F.when(context == "ALBUM", album).when(context == "SHUFFLE", shuffle).when(context == "SINGLE", False).otherwise(True)


def context_bucket() -> Column:
    """The key of a scored pair's context: matched, in key, rising."""
    matched = F.when(F.col("matchable") & (F.col("stretch") <= MATCHED_STRETCH), "matched").otherwise("unmatched")
    in_key = F.when(F.col("distance") <= 1, "inkey").otherwise("clash")
    return F.concat_ws(".", matched, in_key, F.when(F.col("energy_delta") >= 0, "rising").otherwise("falling"))


def explained(plans: DataFrame, prefs: Prefs) -> DataFrame:
    """Plans (pairs.plans_of) with the line that says how the score came about: its factors, whose product it is, a pin, and the modifiers.

    Fixed format: the words of the line and their order.
    """
    two = lambda c: F.format_string("%.2f", c)
    mods = F.array_join(F.transform("modifiers", lambda m: F.concat(m["modifier"], F.lit(" ("), two(m["score"]), F.lit(")"))), ", ")
    line = F.concat(
        F.lit("score "), F.format_string("%.3f", "score"), F.lit(" = fit "), two("fit"), F.lit(" × weight "), two("weight"), F.lit(" × energy "), two("energy"), F.lit(" × variety "), two("variety"),
        F.lit(" × modifiers "), two("bonus"), F.lit(" × jitter "), F.format_string("%.3f", "jitter"), F.when(F.col("learned") != 1, F.concat(F.lit(" × learned "), two("learned"))).otherwise(""),
        F.when(F.col("pinned"), " · pinned (ranked first)").otherwise(""), F.when(F.size("modifiers") > 0, F.concat(F.lit(", modifiers: "), mods)).otherwise(""),
    )
    return plans.withColumn("explanation", line)


def learned_line(multiplier: Column, ratings: Column, skips: Column, label: Column) -> Column:
    """What a learned weight came from, in words."""
    count = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    parts = F.array_compact(F.array(F.when((ratings > 0) | (skips == 0), count(ratings, "rating")), F.when(skips > 0, count(skips, "skip"))))
    return F.concat(F.lit("learned ×"), F.format_string("%.2f", multiplier), F.lit(" from "), F.array_join(parts, " and "), F.lit(" in '"), label, F.lit("'"))


def chained(plans: DataFrame, chain: list[str], place: list[str], variety: float) -> DataFrame:
    """Along each chain the best plan of every pair, what was used just before counting less.

    plans: chain, place, strategy, ordinal, score. A choice depends on the one before, so a chain is walked in order; chains run in parallel.
    """
    kinds = dict(plans.dtypes)
    keep = min(1.0, max(0.0, 1 - variety))

    def walk(rows: dict[str, list]) -> list[tuple]:
        out, last, at, n = [], None, 0, len(rows["strategy"])
        spot = list(zip(*[rows[c] for c in place], strict=True))
        head = tuple(rows[c][0] for c in chain)
        while at < n:
            best, score, end = at, -1.0, at
            while end < n and spot[end] == spot[at]:
                s = rows["strategy"][end]
                worth = rows["score"][end] * (1.0 if s != last else 0.0 if s in COOLDOWN else keep)
                if worth > score:
                    best, score = end, worth
                end += 1
            out.append((*head, *spot[at], rows["strategy"][best], score, last))
            last, at = rows["strategy"][best], end
        return out

    schema = ", ".join(f"{n} {kinds[n]}" for n in (*chain, *place)) + ", strategy string, score double, previous string"
    return by_runs(plans.select(*chain, *place, "strategy", "ordinal", "score"), chain, [*place, "ordinal"], walk, schema)


def bounds(start: Column, end: Column, entry: Column, leave: Column) -> Column:
    """(from, to) of what is played of a track between its transitions; null: no transition on that side."""
    begin = F.greatest(F.coalesce(entry, start), F.lit(0))
    return F.struct(begin.alias("from"), F.greatest(F.coalesce(leave, end), begin).alias("to"))


def least_body(start: Column, end: Column, bpm: Column, rate: int, beats_per_bar: int = 4) -> Column:
    """Frames that a track must play alone: a bar, a second without a tempo, half of the track at most."""
    playable = F.greatest(end - start, F.lit(0))
    bar = F.when(bpm > 0, F.floor(60.0 / bpm * beats_per_bar * rate + 0.5)).otherwise(F.lit(rate)).cast("long")
    return F.least(bar, F.floor(playable / 2).cast("long"))


def room(a_body: Column, a_least: Column, b_alone: Column, b_least: Column, b_with_next: Column | None = None) -> Column:
    """What a plan leaves its tracks: FITS, COSTS_NEXT, STARVES_B or STARVES_A.

    Bodies in frames; b_with_next: array of what b keeps with each plan of its next transition, null where it has none.
    """
    alone = b_alone >= b_least
    fits = alone if b_with_next is None else F.when(b_with_next.isNull(), alone).otherwise(F.exists(b_with_next, lambda x: x >= b_least))
    return F.when(a_body < a_least, "STARVES_A").when(fits, "FITS").when(alone, "COSTS_NEXT").otherwise("STARVES_B")


def room_order(plans: DataFrame, keys: list[str], place: str, verdict: str, pinned: Column | None = None) -> DataFrame:
    """plans that fit first, then those that cost the next transition, then those that starve a track; the pinned one first unless it starves.

    Where every plan starves a track the planner's order stays.
    """
    starves = F.col(verdict).isin("STARVES_A", "STARVES_B")
    rank = F.when(starves, 2).when(F.lit(False) if pinned is None else F.coalesce(pinned, F.lit(False)), -1).when(F.col(verdict) == "FITS", 0).otherwise(1)
    pair = Window.partitionBy(*keys)  # the plans of one pair: as many as there are strategies
    ranked = plans.withColumn("__rank", rank).withColumn("__rank", F.when(F.min("__rank").over(pair) == 2, 0).otherwise(F.col("__rank")))
    return ranked.withColumn("try", F.row_number().over(pair.orderBy("__rank", place))).drop("__rank")


def program(queue: DataFrame, group: str) -> DataFrame:
    """(group, position, kind, start, end): bodies, and after each the transition that stays, in play order.

    queue: group, position, start, end (of the track), least_body, leave (frame at which the transition into the next
    track leaves this one, null for none), enter (frame at which it enters the next one), length (of the transition).
    Transitions are dropped until every track keeps its least body, the one out of a track first; a queue is walked in order, queues run in parallel.
    """
    kind = dict(queue.dtypes)[group]

    def build(rows: dict[str, list]) -> list[tuple]:
        known = lambda x: x is not None and x == x
        start, end, least, leave, enter = (rows[c] for c in ("start", "end", "least_body", "leave", "enter"))
        n = len(start)
        stays = [known(x) for x in leave[:-1]] + [False]

        def body(i: int) -> tuple[int, int]:
            begin = max(int(enter[i - 1]) if i and stays[i - 1] else int(start[i]), 0)
            return begin, max(int(leave[i]) if stays[i] else int(end[i]), begin)

        repaired = True
        while repaired:
            repaired = False
            for i in range(n):
                into = i > 0 and stays[i - 1]
                if not (into or stays[i]):
                    continue
                begin, to = body(i)
                if to - begin < least[i]:
                    stays[i if stays[i] else i - 1] = False
                    repaired = True
        out = []
        for i, position in enumerate(rows["position"]):
            out.append((rows[group][0], position, "body", *body(i)))
            if stays[i]:
                out.append((rows[group][0], position, "transition", 0, int(rows["length"][i])))
        return out

    wanted = (group, "position", "start", "end", "least_body", "leave", "enter", "length")
    return by_runs(queue.select(*wanted), [group], ["position"], build, f"{group} {kind}, position long, kind string, start long, end long")


def plan_frames(plans: DataFrame, prefs: Prefs, a: str, b: str, rate: int, beats_per_bar: int = 4) -> DataFrame:
    """Plans with the frames at which each leaves its first track and enters its second, and its length.

    a, b: structs with start, end (frames of what is playable), bpm, outro_beats, intro_beats. A plan overlaps the beats
    that its family needs, as far as both tracks have room for them, and a bar at least; without a tempo a beat is half a second.
    """
    needs = F.lit(0)
    for family in NEEDED_BARS:
        needs = F.when(F.col("family") == family, prefs.needed_beats(family, beats_per_bar)).otherwise(needs)
    return plans.withColumns(overlap(needs, a, b, rate, beats_per_bar))


def overlap(needs: Column, a: str, b: str, rate: int, beats_per_bar: int = 4) -> dict[str, Column]:
    """Leave, enter and length of a plan that needs so many beats."""
    room_ = F.least(F.coalesce(F.col(f"{a}.outro_beats"), F.lit(0)), F.coalesce(F.col(f"{b}.intro_beats"), F.lit(0)))
    beats = F.greatest(F.least(needs, room_), F.lit(beats_per_bar))
    frames = lambda bpm: F.floor(beats * F.when(bpm > 0, 60.0 / bpm).otherwise(0.5) * rate + 0.5).cast("long")
    length = F.least(frames(F.col(f"{a}.bpm")), F.greatest(F.col(f"{a}.end") - F.col(f"{a}.start"), F.lit(0)))
    into = F.least(frames(F.col(f"{b}.bpm")), F.greatest(F.col(f"{b}.end") - F.col(f"{b}.start"), F.lit(0)))
    return {"leave": F.col(f"{a}.end") - length, "enter": F.col(f"{b}.start") + into, "length": length}


def offers(scored: DataFrame, prefs: Prefs, keys: list[str], a_id: str, b_id: str, a: str, b: str, rate: int, exact: Column | None = None, strategies: tuple[Strategy, ...] = STRATEGIES) -> DataFrame:
    """The keys and `plans`, what a queue can choose from, in each pair's row: (place, strategy, pinned, leave, enter, length) in ranked order.

    Plans that need as many beats leave and enter at the same frames and so suit a queue alike: the first of them is all that
    built() may choose, and stands for the others. exact: as in first_plans().
    """
    needs = [prefs.needed_beats(s.family) for s in strategies]
    groups = [[n for n, x in enumerate(needs) if x == beats] for beats in sorted(set(needs))]
    first = first_plans(scored, prefs, keys, a_id, b_id, groups, strategies, exact)
    name = lambda g: F.get(F.array(*[F.lit(s.id) for s in strategies]), F.col(f"ordinal_{g}"))
    plan = lambda g, o: F.struct(F.col(f"place_{g}").alias("place"), name(g).alias("strategy"), F.lit(False).alias("pinned"), *[o[c].alias(c) for c in ("leave", "enter", "length")])
    made = [F.when(F.col(f"ordinal_{g}").isNotNull(), plan(g, overlap(F.lit(needs[group[0]]), a, b, rate))) for g, group in enumerate(groups)]
    return first.select(*keys, F.array_compact(F.sort_array(F.array(*made))).alias("plans"))


def built(queue: DataFrame, plans: DataFrame, group: str) -> DataFrame:
    """Queues to segments: (group, position, kind, strategy, start, end).

    queue: group, position, start, end, least_body, enabled (whether a transition into the next track may be made).
    plans: group, position (of the track that is left), place, strategy, pinned, leave, enter, length. For each pair, in
    play order, the plans are put in the order of the room they leave (pinned first, then those that fit with some plan
    of the next pair, then those that cost it, ranked order within), given where the plan chosen before enters; the
    first that starves no track is taken, so the next ranked plan is tried before a transition is given up, and where
    all starve a track the two meet body to body. A queue is walked in order, queues run in parallel.
    """
    each = plans.groupBy(F.col(group).alias("__g"), F.col("position").alias("__p")).agg(F.array_sort(F.collect_list(F.struct("place", "strategy", "pinned", "leave", "enter", "length"))).alias("plans"))
    rows = queue.join(each, F.col(group).eqNullSafe(F.col("__g")) & (F.col("position") == F.col("__p")), "left").select(group, "position", "start", "end", "least_body", F.when(F.col("enabled"), F.col("plans")).alias("plans"))
    return walked(rows, group)


def walked(queue: DataFrame, group: str, dealt: bool = False) -> DataFrame:
    """What built() makes of queues whose rows hold their plans: group, position, start, end, least_body, plans (null or an array in ranked order).

    With a column `first`, a place has several rows: one for each entry of that place (first), and others that only bring
    further plans; all plans of the place are offered to each of its entries, by place and strategy. dealt: as in_runs() wants it.
    """
    kinds = dict(queue.dtypes)

    def gathered(rows: dict[str, list]) -> dict[str, list]:
        offered: dict[int, list[dict]] = {}
        for position, plans in zip(rows["position"], rows["plans"], strict=True):
            offered.setdefault(position, []).extend(plans if plans is not None else ())
        if len(offered) < len(rows["position"]):
            order = lambda x: [(v is not None, v) for v in x.values()]
            entries = [i for i, first in enumerate(rows["first"]) if first]
            rows = {n: [c[i] for i in entries] for n, c in rows.items()}
            offered = {p: sorted(plans, key=order) for p, plans in offered.items()}
        return rows | {"plans": [offered[p] for p in rows["position"]]}

    def build(rows: dict[str, list]) -> list[tuple]:
        if "first" in rows:
            rows = gathered(rows)
        start, end, least = (list(map(int, rows[c])) for c in ("start", "end", "least_body"))
        offered = [list(p) if p is not None else [] for p in rows["plans"][:-1]] + [[]]
        n = len(start)

        def keeps(i: int, entry: int | None, leave: int | None) -> bool:
            begin = max(start[i] if entry is None else entry, 0)
            return max(end[i] if leave is None else leave, begin) - begin >= least[i]

        chosen: list[dict | None] = []
        for i in range(n - 1):
            entry = chosen[-1]["enter"] if chosen and chosen[-1] else None

            def rank(plan: dict, i: int = i, entry: int | None = entry) -> int:
                if not keeps(i, entry, plan["leave"]) or not keeps(i + 1, plan["enter"], None):
                    return 3
                if plan["pinned"]:
                    return 0
                following = offered[i + 1]
                return 1 if not following or any(keeps(i + 1, plan["enter"], x["leave"]) for x in following) else 2

            best = min(offered[i], key=rank, default=None)  # the first of equals: the planner's order
            chosen.append(best if best is not None and rank(best) < 3 else None)
        out = []
        for i, position in enumerate(rows["position"]):
            before, after = chosen[i - 1] if i else None, chosen[i] if i < n - 1 else None
            begin = max(before["enter"] if before else start[i], 0)
            out.append((rows[group][0], position, "body", None, begin, max(after["leave"] if after else end[i], begin)))
            if after:
                out.append((rows[group][0], position, "transition", after["strategy"], 0, after["length"]))
        return out

    schema = f"{group} {kinds[group]}, position long, kind string, strategy string, start long, end long"
    return in_runs(queue, [group], build, schema) if dealt else by_runs(queue, [group], ["position"], build, schema)


def program_totals(segments: DataFrame, group: str) -> DataFrame:
    """Frames of each queue by kind of segment, and how many transitions stayed."""
    length = F.col("end") - F.col("start")
    by = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, length)), F.lit(0)).alias(f"{kind}_frames")
    return segments.groupBy(group).agg(by("body"), by("transition"), F.count_if(F.col("kind") == "transition").alias("transitions"))
