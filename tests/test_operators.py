"""Operators on literal rows: nulls, ties, empty tables, sequential rules."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.functions import music as M
from tonearm.operators import artifacts as A
from tonearm.operators import library as L
from tonearm.operators import pairs as P
from tonearm.operators import planning as G
from tonearm.operators import sequence as Q
from tonearm.operators import series as R
from tonearm.operators import stats as S
from tonearm.operators import structure as ST
from tonearm.plans import pairing
from tonearm.sources import files

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_normalise_and_scan(spark):
    media = spark.createDataFrame(
        [("  ", None, "", "/m/One Song.mp3", None, 2013, True, 90_000), ("T", "A", "B", "x", " g ", 7, False, 5_000)],
        "title string, artist string, album string, path string, genre string, raw_track int, is_music boolean, duration_ms long",
    )
    out = L.normalise(media).select("title", "artist", "album", "genre", "track", "disc")
    assert rows(out) == sorted([("One Song", "<unknown>", "<unknown>", None, 13, 2), ("T", "A", "B", "g", 7, 1)], key=repr)
    assert L.scan_library(media, 60).count() == 1
    assert L.scan_incremental(media, "raw_track", None).count() == 2
    assert L.scan_incremental(media, "raw_track", 7).count() == 1


def test_named_items_and_memberships(spark):
    built_in = spark.createDataFrame([("a", 1)], "id string, v int")
    own = spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int")
    assert rows(L.shadowed(built_in, own, "id")) == [("a", 1), ("b", 3)]
    assert rows(L.shadowed(built_in, own, "id", F.col("v") == 2)) == [("a", 2), ("b", 3)]
    members = spark.createDataFrame([(1, "rock", 1), (1, "jazz", 2), (2, "pop", 1)], "song int, genre string, at int")
    assert rows(L.last_membership(members, "song", "genre", "at")) == [(1, "jazz"), (2, "pop")]
    assert L.genres(spark.createDataFrame([("Rock ",), ("rock",), (" ",)], "g string"), "g").select("id").distinct().count() == 1


def test_folders_filters_queues(spark):
    f = spark.createDataFrame([("/a/x.mp3",), ("/a/b/y.mp3",), ("z.mp3",)], "path string")
    assert rows(L.in_folder(f, "path", "/a")) == [("/a/x.mp3",)]
    assert L.under_folder(f, "path", "/a").count() == 2
    assert L.outside(f, "path", spark.createDataFrame([("/a/b/",)], "d string"), "d").count() == 2
    low = spark.createDataFrame([(1, 0.4, 0.9, None), (2, 0.9, 0.9, 0.9)], "id int, grid_confidence double, key_confidence double, tempo_confidence double")
    assert [tuple(r) for r in L.low_confidence(low).select("id", "reasons").collect()] == [(1, ["grid", "tempo"])]
    queue = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a"), (2, 1, "b")], "q int, position int, item string")
    wanted = spark.createDataFrame([(1, 0, "c"), (1, 1, "b"), (2, 0, "z")], "q int, position int, item string")
    assert rows(L.replaced_tail(queue, "q", 0, wanted)) == [(1, 0, "a"), (1, 1, "c"), (1, 2, "b"), (2, 0, "a"), (2, 1, "b")]
    assert rows(L.shuffled(queue, "q", 5, F.col("item") == "b").filter("item = 'b'").select("position")) == [(0,), (0,)]


def test_series_rules(spark):
    x = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 5, 1, 6, 0, 0, 9, 0])], "k int, i long, x double")
    found = R.peaks(x, "k", "i", "x", 3, 0.0, 3)
    assert [r.i for r in found.orderBy("i").collect()] == [3, 6]
    clicks = spark.createDataFrame([(1, i) for i in (0, 2, 3, 5, 9)], "k int, i long")
    assert [r.i for r in R.spaced_first(clicks, "k", "i", 3).orderBy("i").collect()] == [0, 3, 9]
    truth = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "k int, t double")
    est = spark.createDataFrame([(1, 1.05), (1, 2.2), (1, 7.0)], "k int, t double")
    got = R.matched_within(truth, est, "k", "t", 0.1).first()
    assert (got.hits, round(got.f, 6)) == (1, round(1 / 3, 6))
    silent = spark.createDataFrame([(1, 0, 0.0), (1, 1, 9.0), (1, 2, 0.0), (1, 3, 0.0), (1, 4, 9.0), (1, 5, 0.0)], "k int, i long, x double")
    assert rows(R.silence_gap(silent, "k", "i", F.col("x") < 1)) == [(1, 2)]
    beats = spark.createDataFrame([(1, i, 1.0 if i % 4 == 0 else 0.0) for i in range(24)], "k int, i long, x double")
    assert [r.i for r in R.tracked_beats(beats, "k", "i", "x", 4.0).orderBy("i").collect()] == [0, 4, 8, 12, 16, 20]
    assert R.mid_rank(x.limit(0), "x").count() == 0


def test_level_on_the_gate_by_order_of_the_series(spark):
    levels = [28.62, 69.41, 46.08, 24.51, 53.58, 69.52]  # summed from the first on, 28.62 lies on the gate; from the last on, below it
    assert 28.62 >= sum(levels[1:], levels[0]) / 6 - 20
    backwards = 0.0
    for v in reversed(levels):
        backwards += v
    assert 28.62 < backwards / 6 - 20
    x = spark.createDataFrame([("a", i, v) for i, v in reversed(list(enumerate(levels)))], "k string, i long, x double").coalesce(1)
    assert [round(r.range, 9) for r in R.loudness_range(x, "k", "i", "x").collect()] == [40.9]


def test_mean_of_an_ending_by_order_of_the_series(spark):
    drums = [(i, 0.1) for i in range(3)] + [(3, 0.3), (4, 0.6), (5, 0.9), (6, 0.2)]
    x = spark.createDataFrame([("a", i, v, 6) for i, v in reversed(drums)], "k string, i long, x double, e long").coalesce(1)
    assert [r.m for r in x.groupBy("k").agg(ST.last_mean("i", "x", "e", 4).alias("m")).collect()] == [(0.3 + 0.6 + 0.9 + 0.2) / 4]
    assert (0.3 + 0.6 + 0.9 + 0.2) / 4 < 0.5 == (0.2 + 0.9 + 0.6 + 0.3) / 4


def test_equal_bins_of_tuning_by_place(spark):
    hertz = lambda b: 440 * 2 ** ((b - 49.5) / 1200)
    x = spark.createDataFrame([("a", hertz(5), 0.3), ("a", hertz(60), 0.1), ("a", hertz(60), 0.2)], "k string, f double, w double")  # .1 + .2 > .3
    assert [round(r.cents, 9) for r in ST.tuning(x, "k", "f", "w").collect()] == [-44.5]


def test_equal_neighbours_are_no_strict_peak(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 9.0, 9.0, 1.0, 8.0, 1.0])], "k string, i long, x double")
    places = lambda strict: sorted(r.i for r in R.peaks(x, "k", "i", "x", 1, -1e9, strict=strict).collect())
    assert places(False) == [2, 4]
    assert places(True) == [4]


def test_key_and_chroma(spark):
    hz = {0: 261.63, 4: 329.63, 7: 392.0}
    p = spark.createDataFrame([(1, f, w) for f, w in zip(hz.values(), (3.0, 2.0, 2.5), strict=True)], "k int, f double, p double")
    c = R.chroma(p, "k", "f", "p", 1)
    assert {r.pc for r in c.collect()} == {0, 4, 7}
    full = spark.createDataFrame([(1, pc, float(w)) for pc, w in enumerate(R.MINOR[-9:] + R.MINOR[:-9])], "k int, pc int, energy double")
    best = R.key_estimate(full, "k").first()
    assert (best.tonic, best.minor) == (9, True) and math.isclose(best.strength, 1.0)


def test_reports(spark):
    a = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("m", 9.0), ("o", 3.0)], "metric string, value double")
    assert rows(S.first_report_wins([a, b], ["metric"])) == [("m", 1.0), ("n", 2.0), ("o", 3.0)]
    out = spark.createDataFrame([(1, None, "WARN", 0, 1), (2, "boom", None, 0, 0), (3, None, "FAIL", 2, 0)], "index int, error string, verdict string, failures int, warnings int")
    assert [r["index"] for r in S.worst_first(out, 3).collect()] == [2, 3, 1]
    pairs = spark.createDataFrame([(i, float(i), float(-i)) for i in range(10)], "pair int, chain double, hard double")
    got = S.quota_sample(pairs, [("chain", F.col("chain"), 3), ("hard", F.col("hard"), 3), ("rest", F.col("pair"), 99)], 8)
    assert [(r.pair, r.source) for r in got.collect()] == [(0, "chain"), (1, "chain"), (2, "chain"), (7, "hard"), (8, "hard"), (9, "hard"), (3, "rest"), (4, "rest")]
    bad = spark.createDataFrame([("a", float("nan")), ("b", 1.5), ("c", None)], "k string, x double")
    assert sorted(r.json for r in files.json_rows(bad).collect()) == ['{"k":"a","x":null}', '{"k":"b","x":1.5}', '{"k":"c","x":null}']


def test_strategies_match_plain_python(spark):
    """Features and scores of every transition, recomputed row by row."""
    p = pairing.PREFS
    s = pairing.scored(spark, SF)
    found = P.candidates(s, p, ["l_orderkey", "position"]).filter("strategy = 'bassSwap'")
    got = {(r.l_orderkey, r.position): r for r in found.collect()}
    for r in s.collect():
        sigma = max(0.5, p.max_stretch / 1.5)
        tempo = math.exp(-((r.stretch / sigma) ** 2)) * (1.0 if r.relation == "SAME" else 0.85)
        w = 1 - min(r.key_a, r.key_b)
        key = (1.0, 0.85, 0.5, 0.35, 0.1)[min(r.distance, 4)] * (1 - w) + 0.6 * w
        energy = math.exp(-((r.loudness_delta / 6) ** 2)) * (1 - 0.5 * abs(r.energy_delta))
        room = min(1, r.outro_beats / 32) * min(1, r.intro_beats / 32)
        prior = P.OUTRO_FIT["blend"][r.outro] * P.INTRO_FIT["blend"][r.intro]
        low = min(1.0, min(r.low_a, r.low_b) / 0.3)
        want = 0.3 * tempo + 0.15 * low + 0.1 * (key + energy + 1 - r.vocal_clash + min(r.grid_a, r.grid_b) + room) + 0.05 * prior
        blocked = min(r.grid_a, r.grid_b) < 0.5 or r.stretch > p.max_stretch or room < 0.5
        mine = got[r.l_orderkey, r.position]
        assert math.isclose(mine.fit, want, abs_tol=1e-9) and mine.applicable == (not blocked)


def test_pins_layers_orders(spark):
    pairs = spark.createDataFrame([("1", "2"), ("1", "3"), ("4", "2"), ("5", "6")], "a string, b string")
    pins = spark.createDataFrame([("1", "2", "x"), ("1", "*", "y"), ("*", "2", "z")], "a string, b string, strategy string")
    assert rows(P.pinned(pairs, pins).select("a", "b", "pin")) == [("1", "2", "x"), ("1", "3", "y"), ("4", "2", "z"), ("5", "6", None)]
    lay = P.layered(F.create_map(F.lit("k"), F.lit("1"), F.lit("l"), F.lit("2")), F.create_map(F.lit("k"), F.lit("9")), F.lit(None).cast("map<string,string>"))
    assert spark.range(1).select(lay.alias("m")).first().m == {"k": "9", "l": "2"}
    pairs = P.all_pairs(spark.range(40).withColumnRenamed("id", "track_id"), 7).select("a.track_id", "b.track_id").collect()
    assert len(pairs) == len(set(map(tuple, pairs))) == 40 * 39


def test_candidate_pairs_lose_none(spark):
    t = pairing.tracks(spark, SF).select("track_id", "bpm")
    want = t.alias("x").join(t.alias("y"), (F.col("x.track_id") != F.col("y.track_id")) & (F.abs(F.col("x.bpm") - F.col("y.bpm")) <= 3.0)).count()
    assert P.candidate_pairs(t, "track_id", "bpm", 3.0).count() == want


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.WAV").write_bytes(b"12345")
    (tmp_path / "d" / "b.wav").write_bytes(b"12345" * 20_000)
    (tmp_path / "c.txt").write_text("no")
    assert files.listing(spark, str(tmp_path), ("wav",)).count() == 2
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert files.fingerprints(content).select("fingerprint").distinct().count() == 3
    samples = spark.createDataFrame([(1, i, math.sin(i)) for i in range(50)], "k int, i long, x double")
    assert files.content_hash(samples, "k", "i", "x", 4).first().hash == files.content_hash(samples.repartition(5), "k", "i", "x", 4).first().hash


def test_cached_analysis(spark):
    src = spark.createDataFrame([("a", 1), ("b", 2)], "fingerprint string, size int")
    cache = spark.createDataFrame([("a", 7.0)], "fingerprint string, bpm double")

    def analyse(batches):
        for b in batches:
            yield b.assign(bpm=b["size"] * 10.0)[["fingerprint", "bpm"]]

    assert rows(files.analysed(src, cache, ["fingerprint"], analyse)) == [("a", 7.0), ("b", 20.0)]


def plain_order(obj, n):
    """Nearest neighbour from item 0, then reversals and moves, the first that helps, written out loop by loop."""
    order = [0]
    while len(order) < n:
        order.append(min((j for j in range(n) if j not in order), key=lambda j: (obj[order[-1]][j], j)))
    cost = lambda o: sum(obj[x][y] for x, y in zip(o, o[1:], strict=False))
    better = True
    while better:
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                new = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if cost(new) < cost(order) - 1e-9:
                    order, better = new, True
        for size in (1, 2, 3):
            i = 1
            while i + size <= n:
                rest, part = order[:i] + order[i + size :], order[i : i + size]
                for p in range(1, len(rest) + 1):
                    new = rest[:p] + part + rest[p:]
                    if p != i and cost(new) < cost(order) - 1e-9:
                        order, better = new, True
                        break
                else:
                    i += 1
    return order


def test_orders_against_plain_loops(spark):
    """The arrays' costs are the columns' costs, and each block is ordered as plain loops order it."""
    t = pairing.tracks(spark, SF).withColumns({"energy": F.col("tail_energy"), "set": F.col("track_id") % 9})
    got = Q.ordered(Q.blocks(t, "set", "energy", "track_id"), "set", "track_id", pairing.PREFS).collect()
    pairs = t.select(F.struct("*").alias("a")).join(t.select(F.struct("*").alias("b")), (F.col("a.set") == F.col("b.set")) & (F.col("a.track_id") != F.col("b.track_id")))
    s = P.sub_scores(P.features(pairs, pairing.PREFS), pairing.PREFS)
    costs = {(r.a, r.b): r.c for r in s.select("a.track_id", "b.track_id", (P.pair_cost(s, pairing.PREFS) + F.when(F.col("a.artist") == F.col("b.artist"), Q.ARTIST_PENALTY).otherwise(0.0)).alias("c")).toDF("a", "b", "c").collect()}
    for g in range(9):
        mine = [r.track_id for r in sorted((r for r in got if r.set == g), key=lambda r: r.position)]
        ids = sorted(mine)
        obj = [[costs.get((x, y), 0.0) for y in ids] for x in ids]
        assert mine == [ids[k] for k in plain_order(obj, len(ids))]


def plain_online(deck, n, cost, o):
    """The online order in a plain loop over lists; deck: dicts in the order in which they are drawn."""

    def quantile(seen, v):
        below, same = sum(x < v for x in seen), sum(x == v for x in seen)
        if len(seen) <= 1:
            return 0.5
        return min(1.0, max(0.0, (below + (same - 1) / 2 if same else below - 0.5) / (len(seen) - 1)))

    def target(k):
        p = k / max(1, n - 1)
        return {"rising": p, "peak": 0.15 + 0.85 * p / 0.7 if p <= 0.7 else 1 - 0.6 * (p - 0.7) / 0.3, "flat": 0.5}[o.arc]

    deck, bent = list(deck), o.arc != "flat"
    order, entered, admitted = [deck.pop(0)], {}, set()
    seen, pool, costs = [], [], [0.0]

    def admit(r):
        if r["item"] not in admitted:
            admitted.add(r["item"])
            if r["energy"] is not None:
                seen.append(r["energy"])

    def refill(step):
        while len(pool) < o.pool and deck:
            r = deck.pop(0)
            admit(r)
            entered[r["item"]] = step
            pool.append(r)

    admit(order[0])
    refill(0)
    for step in range(1, min(n - 1, o.horizon if o.horizon is not None else n) + 1):
        last, best, least = order[-1], None, float("inf")
        for r in pool:
            x = cost(last, r) + float(Q.noise(o.seed, o.variety, np.array([last["number"]], np.int64), np.array([r["number"]], np.int64))[0, 0])
            x += 0.3 if last["artist"] and last["artist"] == r["artist"] else 0.0
            if bent and r["energy"] is not None:
                off = abs(quantile(seen, r["energy"]) - target(step))
                x += 0.5 * off + (1.0 if off > 0.2 else 0.0)
            x -= 0.15 * min(1.0, (step - entered[r["item"]]) / o.pool)
            if x < least:
                best, least = r, x
        pool.remove(best)
        order.append(best)
        costs.append(cost(last, best))
        if bent and deck:
            for r in list(pool):
                if step - entered[r["item"]] >= max(1, o.pool // 4) and r["energy"] is not None and abs(quantile(seen, r["energy"]) - target(step + 1)) > 0.2:
                    pool.remove(r)
                    deck.append(r)
        refill(step)
    for r in pool + deck:
        costs.append(cost(order[-1], r) if {order[-1]["item"], r["item"]} <= admitted else 0.5)
        order.append(r)
    return [r["item"] for r in order], costs


def songs(n, seed):
    rng = random.Random(seed)
    row = lambda i: {"item": i, "number": rng.getrandbits(63), "artist": rng.choice(["", "x", "y", f"a{i}"]), "energy": rng.choice([None, round(rng.random(), 2), rng.random()]), "bpm": 80 + 80 * rng.random()}
    return [row(i) | {c: 0.0 for c in Q.COST_COLUMNS if c != "bpm"} for i in range(n)]


def test_online_order_against_a_plain_loop():
    """Pool, aging, arc band, songs put back, horizon and noise; 10,000 songs in a stream."""
    costs = lambda a, b: np.abs(a["bpm"][:, None] - b["bpm"][None, :]) / 80
    one = lambda a, b: abs(a["bpm"] - b["bpm"]) / 80
    cases = [(n, Q.Online(arc=arc, variety=v, seed=n, pool=pool, horizon=h)) for n in (0, 1, 2, 150) for arc in ("flat", "rising", "peak") for v, pool, h in ((0.0, 32, None), (0.4, 8, 60), (0.4, 32, 0))]
    for n, o in [*cases, (10_000, Q.Online(arc="flat", variety=0.2)), (2000, Q.Online(arc="peak", variety=0.2))]:
        deck = songs(n, n)
        made = list(Q.online(iter([dict(r) for r in deck]), n, costs, o))
        if not n:
            assert made == []
            continue
        want, price = plain_online(deck, n, one, o)
        assert [m[0] for m in made] == want and [m[1] for m in made] == list(range(n))
        assert np.allclose([m[2] for m in made], price)


def test_online_sets_of_tracks(spark):
    """The registered order of tracks, with the costs of the column, against the plain loop; an arc bends it."""
    t = pairing.tracks(spark, SF).withColumn("energy", M.energy_proxy(F.col("lufs"), F.col("bpm"), F.col("tail_percussive"))).withColumn("set", F.col("track_id") % 7)
    pairs = t.select(F.struct("*").alias("a")).join(t.select(F.struct("*").alias("b")), F.col("a.set") == F.col("b.set"))
    s = P.sub_scores(P.features(pairs, pairing.PREFS), pairing.PREFS)
    cost = {(r.a, r.b): r.c for r in s.select(F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), P.pair_cost(s, pairing.PREFS).alias("c")).collect()}
    o = Q.Online(arc="peak", variety=0.2, seed=7)
    rows = [r.asDict() for r in t.select("set", F.col("track_id").alias("item"), F.lower(F.trim("artist")).alias("artist"), "energy", F.xxhash64(F.lit(7), "track_id").alias("number")).collect()]
    got = pairing.online_sets(spark, SF).collect()
    for g in range(7):
        deck = sorted((r for r in rows if r["set"] == g), key=lambda r: r["number"])
        want, price = plain_online(deck, len(deck), lambda a, b: cost[a["item"], b["item"]], o)
        mine = sorted((r for r in got if r.set == g), key=lambda r: r.position)
        assert [r.track_id for r in mine] == want and np.allclose([r.cost for r in mine], price, atol=1e-8)


def test_objective_is_what_the_solver_minimises(spark):
    """Sets of 20 with an arc and the planner's scores: the columns `objective` and `refined` on all pairs, put in a plain loop, give the solver's order."""
    t = pairing.tracks(spark, SF).withColumns({"energy": F.col("tail_energy"), "set": F.lit(1), "block": F.lit(0), "part": F.lit(0)}).filter("track_id <= 20")
    pairs = t.select(F.struct("*").alias("a")).join(t.select(F.struct("*").alias("b")), F.col("a.track_id") != F.col("b.track_id"))
    s = P.sub_scores(P.features(pairs, pairing.PREFS), pairing.PREFS)
    best = s.select(F.lit(1).alias("set"), F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), F.when((F.col("a.track_id") + F.col("b.track_id")) % 3 > 0, (F.col("a.track_id") * 7 % 10) / 8).alias("score"))
    both = s.select(F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), P.pair_cost(s, pairing.PREFS).alias("c"), F.coalesce(F.col("a.artist") == F.col("b.artist"), F.lit(False)).alias("same")).join(best, ["a", "b"])
    flat = both.select("a", "b", Q.objective(Q.refined(F.col("c"), F.col("score")), F.col("same"), "flat", F.lit(0.0), F.lit(0), F.lit(20)).alias("x"))
    cost = {(r.a, r.b): r.x for r in flat.collect()}
    got = [r.track_id for r in Q.ordered(t, "set", "track_id", pairing.PREFS, best=best).orderBy("position").collect()]
    ids = sorted(got)
    assert got == [ids[k] for k in plain_order([[cost.get((x, y), 0.0) for y in ids] for x in ids], len(ids))]
    rows = {r.track_id: r.energy for r in t.collect()}
    known = sorted(rows.values())
    places = spark.createDataFrame([(i, Q.mid_quantile(known, rows[i]), k) for i in ids for k in range(20)], "b long, q double, k int")
    want = {(r.b, r.k): r.x for r in places.select("b", "k", Q.objective(F.lit(0.0), F.lit(False), "rising", F.col("q"), F.col("k"), F.lit(20)).alias("x")).collect()}
    for (i, k), x in want.items():
        assert abs(Q.ARC_WEIGHT * abs(Q.mid_quantile(known, rows[i]) - float(Q.target_of("rising", k, 20))) - x) < 1e-12
    drawn = [r.track_id for r in Q.ordered(t, "set", "track_id", pairing.PREFS, seed=3, variety=0.5).orderBy("position").collect()]
    assert sorted(drawn) == ids and drawn != got


def test_factors_multiply_to_the_score(spark):
    """The factors' product is the score, also with weights, a pin, what came before and learned multipliers; the line names them."""
    some = pairing.candidates(spark, SF).limit(300)
    prefs = P.Prefs(energy=0.8, weights={"crossfade": 1.5, "echoOut": 0.4}, excluded=("phraseCut",))
    learned = F.create_map(F.lit("crossfade"), F.lit(1.2), F.lit("echoOut"), F.lit(0.75))
    plans = P.plans_of(some, prefs, pairing.KEYS, "a_id", "b_id", pin=F.lit("echoOut"), previous=F.lit("crossfade"), learned=learned)
    got = G.explained(plans, prefs).collect()
    assert len(got) > 300
    for r in got:
        assert abs(math.prod([r.fit, *(r[f] for f in P.FACTORS)]) - r.score) < 1e-12
        assert r.pinned == (r.strategy == "echoOut") and (not r.pinned or r.place == 1)
        assert (r.learned, r.weight) == ({"crossfade": 1.2, "echoOut": 0.75}.get(r.strategy, 1.0), {"crossfade": 1.5, "echoOut": 0.4}.get(r.strategy, 1.0))
        assert r.variety == (0.7 if r.strategy == "crossfade" else 1.0)
        assert (" · pinned (ranked first)" in r.explanation) == r.pinned and (" × learned " in r.explanation) == (r.learned != 1)
    plain = {(r.l_orderkey, r.position, r.strategy): r.score for r in P.plans_of(some, prefs, pairing.KEYS, "a_id", "b_id").collect()}
    assert all(abs(plain[r.l_orderkey, r.position, r.strategy] * r.variety * r.learned - r.score) < 1e-12 for r in got)


def test_built_queues(spark):
    """The next plan that leaves room is taken before a transition is given up; pins give way only where they starve a track."""
    queue = [(g, p, 0, 1000, 300, g != "off") for g in ("first", "second", "none", "pin", "costs", "off") for p in range(3)] + [("one", 0, 5, 90, 10, True), ("short", 0, 0, 1000, 300, True), ("short", 1, 0, 200, 100, True)]
    plan = lambda g, p, place, name, leave, enter, pinned=False: (g, p, place, name, pinned, leave, enter, 50)
    plans = [
        plan("first", 0, 1, "a", 800, 200), plan("first", 0, 2, "b", 900, 100), plan("first", 1, 1, "c", 600, 100),
        plan("second", 0, 1, "a", 200, 200), plan("second", 0, 2, "b", 900, 650), plan("second", 0, 3, "c", 800, 500), plan("second", 1, 1, "d", 700, 100), plan("second", 1, 2, "e", 900, 100),
        plan("none", 0, 1, "a", 200, 100), plan("none", 0, 2, "b", 900, 800), plan("none", 1, 1, "c", 900, 100),
        plan("pin", 0, 1, "p", 900, 690, True), plan("pin", 0, 2, "b", 900, 100), plan("pin", 1, 1, "c", 900, 100),
        plan("costs", 0, 1, "a", 900, 650), plan("costs", 0, 2, "b", 900, 640), plan("costs", 1, 1, "c", 900, 100), plan("off", 0, 1, "a", 900, 100), plan("short", 0, 1, "a", 900, 150),
    ]
    q = spark.createDataFrame(queue, "g string, position long, start long, end long, least_body long, enabled boolean")
    t = spark.createDataFrame(plans, "g string, position long, place int, strategy string, pinned boolean, leave long, enter long, length long")
    out = {}
    for r in sorted(G.built(q, t, "g").collect(), key=lambda r: (r.position, r.kind)):
        out.setdefault(r.g, []).append(r.strategy if r.kind == "transition" else (r.start, r.end))
    assert out == {
        "first": [(0, 800), "a", (200, 600), "c", (100, 1000)],
        "second": [(0, 800), "c", (500, 900), "e", (100, 1000)],
        "none": [(0, 1000), (0, 900), "c", (100, 1000)],
        "pin": [(0, 900), "p", (690, 1000), (0, 1000)],
        "costs": [(0, 900), "a", (650, 1000), (0, 1000)],
        "off": [(0, 1000), (0, 1000), (0, 1000)],
        "one": [(5, 90)],
        "short": [(0, 1000), (0, 200)],
    }
    assert G.built(q.limit(0), t, "g").count() == 0


def test_best_pairs_by_bounds(spark):
    """The ten best of all ordered pairs equal brute force, for tables of any size and ties; few of the pairs are scored."""
    t = pairing.tracks(spark, SF)
    every = t.select(F.struct("*").alias("a")).join(t.select(F.struct("*").alias("b")), F.col("a.track_id") != F.col("b.track_id"))
    s = P.sub_scores(P.features(every, pairing.PREFS), pairing.PREFS)
    want = s.select("a.track_id", "b.track_id", F.round(P.pair_cost(s, pairing.PREFS), 9).alias("cost")).toDF("a", "b", "cost").orderBy("cost", "a", "b").limit(40).collect()
    assert P.best_pairs(t, pairing.PREFS, 40).collect() == want
    assert P.bounded_pairs(t, pairing.PREFS, want[9].cost).count() < 0.05 * t.count() ** 2
    twins = t.filter("track_id < 12").withColumn("bpm", F.lit(120.0)).withColumn("track_id", F.col("track_id") + 1000)
    few = twins.unionByName(twins.limit(2).withColumns({"track_id": F.col("track_id") + 500, "bpm": F.lit(None).cast("double")}))
    pairs = few.filter("bpm > 0").select(F.struct("*").alias("a")).join(few.filter("bpm > 0").select(F.struct("*").alias("b")), F.col("a.track_id") != F.col("b.track_id"))
    s = P.sub_scores(P.features(pairs, pairing.PREFS), pairing.PREFS)
    want = s.select("a.track_id", "b.track_id", F.round(P.pair_cost(s, pairing.PREFS), 9).alias("cost")).toDF("a", "b", "cost").orderBy("cost", "a", "b").limit(200).collect()
    assert P.best_pairs(few, pairing.PREFS, 200).collect() == want
    assert P.best_pairs(few.limit(0), pairing.PREFS, 5).count() == 0


def test_suggested_names(spark):
    """Typos by edit distance, case apart, ties by name, nothing that is too far; against all distances."""
    rng = random.Random(3)
    known = ["level", "low", "mid", "lengthBars", "tempo", "Tempi", "b", "", "über"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    asked = ["levle", "Level", "lenghtBars", "zzz", "", "t", "uber", "tempx", None, None] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]

    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    want = {}
    for w in {a for a in asked if a is not None}:
        best = min((distance(w.lower(), k.lower()), k) for k in known)
        want[w] = best[::-1] if best[0] <= max(1, min(3, (len(w) + 2) // 3)) else (None, None)
    words = spark.createDataFrame([(a,) for a in asked], "word string")
    names = spark.createDataFrame([(k,) for k in [*known, *known, None]], "name string")
    assert {r.word: (r.suggestion, r.distance) for r in L.suggested(words, names, "word", "name").collect()} == want
    assert want["levle"] == ("level", 1) and want["lenghtBars"] == ("lengthBars", 1) and want["zzz"] == (None, None)


def test_nearest_vectors_block_by_block(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding")
    queries = v.filter("vec_id % 20 = 0")
    near = lambda: rows(P.nearest_vectors(queries, v, "vec_id", "embedding", 3).withColumn("cosine", F.round("cosine", 9)))
    one = near()
    monkeypatch.setattr(P, "QUERY_BLOCK", 7)
    assert near() == one


def plain_fit(beats, n_fits=4):
    """The robust fit of one series of (x, support) in plain loops: (kind, period, offset, share of the weight on the line)."""
    n, w = len(beats), [0.05 + s for _, s in beats]
    best, best_weight, start = None, 0.0, None
    for k in range(n + 1):
        if k < n and w[k] - 0.05 >= 0.25:
            start = k if start is None else start
        elif start is not None:
            if k - start >= 8 and sum(w[start:k]) > best_weight:
                best, best_weight = range(start, k), sum(w[start:k])
            start = None
    inside = [best is None or k in best for k in range(n)]
    period = offset = residual = share = None
    for turn in range(n_fits):
        rows_ = [(k, beats[k][0], w[k]) for k in range(n) if inside[k]]
        sw, sk, st = sum(r[2] for r in rows_), sum(r[0] * r[2] for r in rows_), sum(r[1] * r[2] for r in rows_)
        skk, skt = sum(r[0] ** 2 * r[2] for r in rows_), sum(r[0] * r[1] * r[2] for r in rows_)
        d = sw * skk - sk * sk
        if len(rows_) < 2 or d <= 1e-12:
            break
        period = (sw * skt - sk * st) / d
        offset = (st - period * sk) / sw
        res = [beats[k][0] - offset - period * k for k in range(n)]
        residual, share = math.sqrt(sum(w[k] * res[k] ** 2 for k in range(n) if inside[k]) / sw) * 1000, sw / sum(w)
        if turn < n_fits - 1:
            acc = 0.0
            for k in sorted(range(n), key=lambda k: abs(res[k])):
                acc += w[k]
                if acc >= sum(w) / 2:
                    break
            inside = [abs(r) <= max(3 * 1.4826 * abs(res[k]), 0.006) for r in res]
    rigid = period is not None and period > 0 and residual < 8 and share >= 0.7
    return ("RIGID" if rigid else "FLEX", period, offset, share)


def test_robust_grids_against_plain_loops(spark):
    """Outliers, weak openings, tempo changes, short and constant series."""
    rng = random.Random(12)
    series = {}
    for g in range(40):
        n = (1, 2, 5, 40, 120)[g % 5]
        x = lambda k: 0.3 + 0.5 * k + rng.gauss(0, 0.002) + (0.2 if rng.random() < 0.1 else 0) + (0.05 * (k - n // 2) if g % 7 == 0 and k > n // 2 else 0)  # noqa: B023, E731
        series[g] = [(round(x(k), 6), 0.02 if (g % 3 == 0 and k < 10) or rng.random() < 0.05 else round(0.3 + rng.random(), 6)) for k in range(n)]
    series[40] = [(1.0, 0.5)] * 20
    df = spark.createDataFrame([(g, k, x, s) for g, b in series.items() for k, (x, s) in enumerate(b)], "g int, i int, x double, s double").repartition(5)
    got = {r.g: r for r in R.robust_fit(df, "g", "i", "x", "s").collect()}
    assert got.keys() == series.keys()
    kinds = set()
    for g, beats in series.items():
        kind, period, offset, share = plain_fit(beats)
        kinds.add(kind)
        r = got[g]
        assert r.kind == kind, g
        assert (r.period is None) == (period is None)
        if period is not None:
            assert np.allclose([r.period, r.start, r.share], [period, offset, share], atol=1e-9)
    assert kinds == {"RIGID", "FLEX"} and R.robust_fit(df.limit(0), "g", "i", "x", "s").count() == 0


def test_blocks_are_bounded(spark):
    """Equal energies, null sets and large sets: no block is much larger than asked for, no item is lost, arcs bend orders."""
    rows = [(g, i, e) for g, e in ((1, 0.5), (None, None)) for i in range(1000)] + [(2, i, i / 1000) for i in range(1000)]
    cut = Q.blocks(spark.createDataFrame(rows, "g int, id long, e double"), "g", "e", "id", 100)
    sizes = [r["count"] for r in cut.groupBy("g", "block", "part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 100
    t = pairing.tracks(spark, SF).withColumns({"energy": F.col("tail_energy"), "set": F.lit(1), "block": F.lit(0), "part": F.lit(0)})
    rising = [r.energy for r in Q.ordered(t, "set", "track_id", pairing.PREFS, arc="rising").join(t.select("track_id", "energy"), "track_id").orderBy("position").collect()]
    assert sum(rising[:50]) < sum(rising[-50:])


def test_queue_passes(spark):
    queue = spark.createDataFrame([("q", x, i, 3, 4) for i, x in enumerate("abcdefgh")] + [("r", x, i, 3, 40) for i, x in enumerate("abc")], "g string, item string, position int, version int, arranged_to int")
    assert rows(Q.horizon(queue, "g", F.lit(1), 3, 16).select("g", "item")) == [("q", "c"), ("q", "d"), ("q", "e")]
    base = queue.select("g", "item", "position", "version")
    made = spark.createDataFrame([("q", 3, "e", 2), ("q", 3, "c", 3), ("q", 3, "d", 4)], "g string, version int, item string, position int")
    done = Q.arranged(base, made, "g").filter("g = 'q'").orderBy("position")
    assert "".join(r.item for r in done.collect()) == "abecdfgh"
    for stale in (made.withColumn("version", F.lit(2)), made.withColumn("item", F.lit("x"))):
        assert "".join(r.item for r in Q.arranged(base, stale, "g").filter("g = 'q'").orderBy("position").collect()) == "abcdefgh"


def test_styles():
    prefs = P.Prefs(weights={"bassSwap": 2.0}, excluded=("x",))
    club = G.STYLES["club"].apply(prefs)
    assert club.weights == {"bassSwap": 2.0 * 1.3, "stemSwap": 1.3, "drumBreakBridge": 1.3, "crossfade": 0.7, "ambientBridge": 0.7} and club.energy == 0.7 and club.max_stretch == prefs.max_stretch
    assert G.STYLES["chill"].apply(prefs).excluded == ("x", "brakeStop", "loopRollRiser")
    assert all(s.problem() is None for s in G.STYLES.values())
    assert G.Style("s", energy=1.5).problem() and G.Style("s", weights=(("a", -1.0),)).problem() and G.Style("s", max_stretch=17.0).problem()


def test_pair_pool(spark):
    t = spark.range(3000).withColumnRenamed("id", "k")
    few = S.pair_pool(t.limit(30), "k", 10_000, 1)
    assert few.count() == 30 * 29
    got = S.pair_pool(t, "k", 9000, 1).collect()
    assert len(got) == len({tuple(r) for r in got}) and 8000 <= len(got) <= 9200 and all(r.a != r.b for r in got)
    assert len({r.a for r in got}) == 3000 and len({r.b for r in got}) > 1500
    assert S.pair_pool(t, "k", 9000, 1).count() == len(got)


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [math.sin(i * k + 1) for k in range(1, 5)]) for i in range(60)] + [(60, [0.0] * 4)], "id long, e array<double>")
    want = rows(P.nearest_vectors(v.filter("id < 20"), v, "id", "e", 3).select("a", "place", "b"))
    vec = {r.id: r.e for r in v.collect()}
    cos = lambda p, q: round(sum(x * y for x, y in zip(p, q, strict=True)) / max(math.sqrt(sum(x * x for x in p)) * math.sqrt(sum(x * x for x in q)), 1e-300), 9)
    assert want == sorted(((a, n + 1, b) for a in range(20) for n, b in enumerate(sorted((b for b in vec if b != a), key=lambda b: (-cos(vec[a], vec[b]), b))[:3])), key=repr)
    monkeypatch.setattr(P, "QUERY_BLOCK", 6)
    assert rows(P.nearest_vectors(v.filter("id < 20"), v, "id", "e", 3).select("a", "place", "b")) == want


def test_signals_with_odd_values(spark):
    """Samples that are no number, constant series, single rows, null keys and empty tables."""
    bad = spark.createDataFrame([(1, 0.5, float("nan")), (1, float("inf"), -1.0), (2, 0.0, 0.0)], "k int, a double, b double")
    assert rows(A.health(bad, "k", ["a", "b"]).select("k", "clipped", "not_finite")) == [(1, 2, 2), (2, 0, 0)]
    s = spark.createDataFrame([(1, i, 0.0) for i in range(40)] + [(2, i, 0.5 if 10 <= i < 30 else 0.0) for i in range(40)] + [(3, 0, 1.0)], "k int, i long, x double")
    t = A.trimmed(s, "k", "i", "x", 2, 3)
    assert rows(t) == [(1, 0, 0, True), (2, 10, 30, False), (3, 0, 0, True)]
    assert A.hard_stops(s, t, "k", "i", "x", 4, 12).filter("hard_stop").count() == 1
    assert A.fade_outs(s, t, "k", "i", "x", 10, 20, 8, 2).filter("fade_out").count() == 0
    for f in (A.trimmed(s.limit(0), "k", "i", "x", 2), A.clicks(s.limit(0), "k", "i", "x", 2, 2, 2.0, 0.1), A.stereo_minimum(s.limit(0).withColumn("y", F.col("x")), "k", "i", "x", "y", 4)):
        assert f.count() == 0
    ranked = R.mid_rank(spark.createDataFrame([(1, 2.0), (1, None), (None, 3.0)], "g int, x double"), "x", ["g"])
    assert rows(ranked) == [(1, 2.0, 0.5), (1, None, None), (None, 3.0, 0.5)]
    kept = R.without_outliers(spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 9.0), (1, None)], "g int, x double"), "g", "x")
    assert rows(kept) == [(None, 1.0), (None, 1.0)]


def test_documents_by_file_name(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    for name, text in (("1.json", '{"id": "1",\n "v": 5}'), ("10.json", '{"id": "1", "v": 6}'), ("2.json", "{broken"), ("a b.json", '{"id": "a b", "v": 7}')):
        (tmp_path / name).write_text(text)
    for _ in range(2):  # the schema given stays as it is
        assert rows(files.read_documents(spark, str(tmp_path), schema, "id")) == [("1", 5), ("a b", 7)]


def test_documents_written_by_key(spark, tmp_path):
    """One gzip file a key, keys of any letters; a second batch replaces its keys alone; null keys and repeated rows."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    first = spark.createDataFrame([("1", 5), ("a b/c=d%20+é:x", 7), ("2", 1), ("2", 1), (None, 9)], schema)
    files.write_documents(first, str(tmp_path), "id")
    assert rows(files.read_documents(spark, str(tmp_path), schema, "id")) == [("1", 5), ("2", 1), ("a b/c=d%20+é:x", 7)]
    files.write_documents(spark.createDataFrame([("2", 8), ("3", 4)], schema), str(tmp_path), "id")
    assert rows(files.read_documents(spark, str(tmp_path), schema, "id")) == [("1", 5), ("2", 8), ("3", 4), ("a b/c=d%20+é:x", 7)]
    assert all(f.name.endswith(".gz") for f in tmp_path.glob("document=*/part-*"))


def test_specs_and_styles(spark):
    """Knobs read as specified; a style's overlap and key lock reach the scores' room."""
    params = spark.createDataFrame([({"energy": "3", "overlap_bars": "24.6", "key_lock": "off"},), ({"energy": "x", "max_shift": "-1"},)], "m map<string,string>")
    got = params.select(*[s.read(F.col("m")).alias(s.id) for s in G.SPECS]).collect()
    assert tuple(got[0]) == (1.0, 8.0, 2, 0.3, 25, False) and tuple(got[1]) == (0.5, 8.0, 0, 0.3, 8, True)
    assert G.SPECS[4].described() == "overlap_bars: int 1..64 (default 8)"
    smooth = G.STYLES["smooth"].apply(P.Prefs())
    assert (smooth.overlap_bars, smooth.key_lock, smooth.needed_beats("beat"), smooth.needed_beats("fade")) == (24, True, 96, 8)
    assert G.Style("odd", overlap_bars=0).problem() and not G.Style("fine", overlap_bars=64, key_lock=False).problem()
    t = pairing.tracks(spark, SF).limit(40)
    pairs = t.select(F.struct("*").alias("a")).join(t.select(F.struct("*").alias("b")), F.col("a.track_id") < F.col("b.track_id"))
    room = lambda p: P.sub_scores(P.features(pairs, p), p).agg(F.sum("room_beat")).first()[0]
    assert room(smooth) < room(P.Prefs(overlap_bars=16)) < room(P.Prefs())


def test_wide_unions_keep_their_rows(spark):
    """A window after a union of frames that are dealt by its key, in different ways."""
    e = pairing.entries(spark, SF).select("l_orderkey", F.col("l_partkey").alias("item"), "position")
    cur = e.groupBy("l_orderkey").agg(F.max("position").alias("current"))
    more = cur.select("l_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).withColumn("item", F.lit(1).cast("long"))
    q = L.removed(L.played_next(e.join(cur, "l_orderkey"), more, "l_orderkey", "current"), "l_orderkey", F.lit(False))
    assert q.groupBy("l_orderkey", "position").count().filter("count > 1").count() == 0
    assert q.count() == e.count() + 2 * cur.count()
    back = L.restored(L.shuffled(e.withColumn("was", F.col("position")), "l_orderkey", 3, F.lit(False)), "l_orderkey", "was")
    assert back.filter("position <> was").count() == 0


def test_ranked_plans_are_compiled_and_joined_narrow(spark):
    """No method that Java would interpret, no comparator in the ranking, and only what tracks are derived from in the joins."""
    from tonearm.plans import playing

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    plan = playing.PLANS.queries["room_ordered_plans"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert "array_sort" not in plan
    assert all("#" in line and line.count("#") < 40 for line in plan.splitlines() if "Join Inner" in line)
    pairs = pairing.transitions(spark, SF, True)
    joined = pairs._jdf.queryExecution().optimizedPlan()
    while "Join" not in joined.nodeName():
        joined = joined.children().apply(0)
    assert joined.output().size() <= 10


def test_nearest_vectors_across_slices(spark, monkeypatch):
    """The best few are carried from slice to slice, and a task gives no more than them for each query."""
    monkeypatch.setattr(P, "VECTOR_SLICE", 3)
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, size=(40, 3)).astype(float) + 0.5  # many ties
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "id long, v array<double>")
    got = {(x.a, x.place): x.b for x in P.nearest_vectors(df.filter("id % 10 = 0"), df, "id", "v", 4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for a in range(0, 40, 10):
        near = sorted((-round(float(unit[a] @ unit[b]), 9), b) for b in range(40) if b != a)[:4]
        assert [got[a, k] for k in range(1, 5)] == [b for _, b in near]


def test_best_pairs_of_copies(spark):
    """Many copies of each track: those alike are paired by id as far as the k best need them, and pairs of weak keys never meet."""
    t = pairing.tracks(spark, SF).filter("track_id < 60")
    copies = P.fenced(P.fenced(t).withColumn("track_id", F.explode(F.array(*[F.col("track_id") + 100_000 * n for n in range(5)]))))
    every = copies.select(F.struct("*").alias("a")).join(copies.select(F.struct("*").alias("b")), F.col("a.track_id") != F.col("b.track_id"))
    s = P.sub_scores(P.features(every, pairing.PREFS), pairing.PREFS)
    want = s.select("a.track_id", "b.track_id", F.round(P.pair_cost(s, pairing.PREFS), 9).alias("cost")).toDF("a", "b", "cost").orderBy("cost", "a", "b").limit(60).collect()
    assert P.best_pairs(copies, pairing.PREFS, 60).collect() == want
    most = want[9].cost
    met = P.bounded_pairs(copies, pairing.PREFS, most)
    rows = met.select("a.key_strength", "b.key_strength").toDF("x", "y").collect()
    assert rows and all(min(r.x, r.y) >= 1 - (most + 1e-6) / 0.08 for r in rows)
    assert met.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    near = P.near_keys(pairing.PREFS, 0.02)
    assert all(k in near[k] for k in range(24)) and max(map(len, near)) < 8


def test_candidate_pairs_are_dealt_out(spark):
    """Keys that must be equal are keys of the join, and a small table's pairs are made by more than one task."""
    t = pairing.tracks(spark, SF).select("track_id", "bpm", "tonic", "minor")
    want = t.alias("x").join(t.alias("y"), (F.col("x.track_id") != F.col("y.track_id")) & (F.abs(F.col("x.bpm") - F.col("y.bpm")) <= 3.0) & (F.col("x.tonic") == F.col("y.tonic")) & (F.col("x.minor") == F.col("y.minor"))).count()
    made = P.candidate_pairs(t, "track_id", "bpm", 3.0, same=("tonic", "minor"))
    assert made.select("a.track_id", "b.track_id").toDF("a", "b").distinct().count() == want
    assert made.select("a.track_id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_candidate_pairs_of_tracks_alike_are_one_row_of_the_join(spark, monkeypatch):
    """Tracks alike meet as blocks of keys, so the join's rows are few; blocks, null and repeated keys lose and add no pair."""
    monkeypatch.setattr(P, "ALIKE_BLOCK", 4)
    rng = random.Random(6)
    some = [(rng.choice([*range(60), None]), rng.choice([100.0, 100.5, 102.75, 104.0, None]), rng.choice([1, 2, None])) for _ in range(120)]
    t = spark.createDataFrame(some, "track_id long, bpm double, tonic int")
    want = [(a, b, abs(x - y)) for a, x, k in some for b, y, n in some if None not in (a, b, x, y, k, n) and a != b and k == n and abs(x - y) <= 2.25]
    made = P.candidate_pairs(t, "track_id", "bpm", 2.25, F.col("a.track_id") != 7, ("tonic",), {"gap": F.abs(F.col("a.bpm") - F.col("b.bpm"))})
    assert rows(made.select("a.track_id", "b.track_id", "gap")) == sorted((w for w in want if w[0] != 7), key=repr)
    assert made.schema["a"].dataType.names == t.columns
    plan = pairing.candidate_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner") :]
    assert "collect_list(track_id" in joined and "round(abs" in plan[plan.rindex("explode(__keys_a") : plan.index("Join Inner")]


def test_alignment_distance_of_short_names(spark):
    """Against a plain table, with common ends cut off and swaps at their edges; the registered query is dealt to all cores."""
    from tonearm.functions import text as X
    from tonearm.plans import browse

    def plain(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
    rows = [(word(), word()) for _ in range(500)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.alignment_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == plain(r.a, r.b) for r in got)
    assert browse.suggestions(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_order_gains_in_one_shuffle(spark):
    """Each order's mean against random_orders() joined back; playlists are shuffled once."""
    from tonearm.plans import playing
    from tonearm.plans.library import entries

    items = entries(spark, SF).select("l_orderkey", F.col("position").alias("place"), ((F.col("l_partkey") * 17) % 100 / 100).alias("x"))
    cost = F.abs(F.col("b.x") - F.col("a.x"))
    own = Q.report(items, ["l_orderkey"], ["place"], cost, ["x"]).select("l_orderkey", F.col("mean_cost").alias("m"))
    drawn = Q.random_orders(items, "l_orderkey", "place", 5).join(items, ["l_orderkey", "place"])
    random_ = Q.report(drawn, ["l_orderkey", "seed"], ["position"], cost, ["x"]).groupBy("l_orderkey").agg(F.collect_list("mean_cost").alias("r"))
    want = {r.l_orderkey: (round(r.m, 6), None if r.g is None else round(r.g, 6)) for r in own.join(random_, "l_orderkey").select("l_orderkey", "m", Q.gain_over(F.col("m"), F.col("r")).alias("g")).collect()}
    made = playing.order_gains(spark, SF)
    got = {r.l_orderkey: (r.mean_cost, r.gain) for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose([x or 0.0 for x in got[k]], [x or 0.0 for x in want[k]], atol=2e-6) for k in want)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_improved_in_blocks_of_starts():
    """Many starts tried at once give the order of one after another, also where the budget ends in between."""
    rng = np.random.default_rng(0)
    for n, budget in ((3, 10**6), (9, 10**6), (40, 10**6), (70, 10**6), (70, 4000), (70, 700)):
        obj = rng.random((n, n))
        start = Q.greedy(obj, None)
        assert Q.improved(list(start), obj, None, budget) == Q.improved(list(start), obj, np.zeros((n, n)), budget)


def test_stitched_orders_blocks_once(spark):
    t = spark.createDataFrame([(g, b, 0, 10 * b + i, i) for g in (1, 2) for b in (0, 1, 2) for i in range(3 + b)], "set long, block int, part int, item long, position long")
    got = {(r.set, r.item): r.position for r in Q.stitched(t, "set", t).collect()}
    assert got == {(r.set, r.item): r.position for r in Q.stitched(t, "set").collect()} and sorted(v for (g, _), v in got.items() if g == 1) == list(range(12))
    made = pairing.ordered_sets(spark, SF)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_online_sets_are_tasks_of_their_own(spark):
    """Small sets are not put into one task; the table of key scores is what the columns give."""
    assert pairing.online_sets(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    keys = spark.range(24).select((F.col("id") / 2).cast("int").alias("t"), (F.col("id") % 2 == 1).alias("m"))
    pairs = keys.alias("a").crossJoin(keys.alias("b"))
    direct = M.camelot_distance(M.camelot(F.col("a.t"), F.col("a.m")), F.col("a.m"), M.camelot(F.col("b.t"), F.col("b.m")), F.col("b.m"))
    best = F.when(direct <= 1, direct).otherwise(M.best_shift(F.col("a.t"), F.col("a.m"), F.col("b.t"), F.col("b.m"), 2)["distance"])
    for r in pairs.select(F.col("a.t").alias("ta"), F.col("a.m").alias("ma"), F.col("b.t").alias("tb"), F.col("b.m").alias("mb"), best.alias("d")).collect():
        assert Q._key_scores(2)[2 * r.ta + r.ma, 2 * r.tb + r.mb] == M.KEY_BY_DISTANCE[min(4, r.d)]


def test_transitions_shuffle_little_and_keep_odd_parts(spark, tmp_path):
    """Entries are shuffled twice, by track and by playlist, with no columns to break ties; null, missing and repeated parts count as in SQL."""
    import duckdb

    spark.createDataFrame([(1, 10, "x"), (2, None, "x"), (3, 30, "y"), (3, 31, "z"), (None, 5, "n")], "p_partkey long, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    lines = [(1, 1, 1), (1, 3, 2), (1, 3, 3), (1, 9, 4), (1, 1, 5), (2, 1, 1), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, None, 2), (3, 3, 3), (None, 1, 1), (None, 3, 2)]
    spark.createDataFrame([(o, p, n, at, 1.0, 2.0, None) for n, (o, p, at) in enumerate(lines)], kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"WITH {pairing.PAIRS} SELECT l_orderkey, position, a_track_id, b_track_id, a_bpm, b_bpm FROM p").fetchall()
    pairs = pairing.transitions(spark, str(tmp_path))
    assert rows(pairs.select("l_orderkey", "position", "a.track_id", "b.track_id", "a.bpm", "b.bpm")) == sorted(want, key=repr)
    assert len(want) == 11
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pairing.PLANS.queries["consecutive_pair_cost"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3
    assert "l_suppkey" not in plan and "p_brand" not in plan


def test_fade_outs_look_at_their_samples_twice(spark):
    """Each branch of a plan holds memory of its own in one task: one for the trims, one for the curve."""
    from tonearm.plans import audio

    plan = audio.PLANS.queries["fade_outs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2
    s = spark.createDataFrame([(k, i, 0.5 if 4 <= i < 12 or 14 <= i < 16 else 0.0) for k in (1, None) for i in range(20)], "k int, i long, x double")
    assert rows(A.trimmed(s, "k", "i", "x", 2, 2)) == sorted([(1, 4, 12, False), (None, 0, 0, True)], key=repr)


def test_best_plan_is_the_first_of_all_plans(spark):
    """The best plan alone needs no array of plans and no jitter of those that can't be the best; it is the first of the whole ranking."""
    found = pairing.candidates(spark, SF).filter("l_orderkey < 200")
    wanted = ("l_orderkey", "position", "place", "strategy", "fit", "score", "bonus", "jitter", "modifiers")
    best = P.plans_of(found, pairing.PREFS, pairing.KEYS, "a_id", "b_id", 1)
    every = P.plans_of(found, pairing.PREFS, pairing.KEYS, "a_id", "b_id")
    assert rows(best.select(*wanted)) == rows(every.filter("place = 1").select(*wanted))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(slice(__plans" in plan and "sort_array" not in plan


def test_built_programs_keep_plans_in_their_rows(spark, tmp_path):
    """Plans are not dealt out, joined or sorted on their way into the queues; null, missing and repeated parts give what joins of all plans give."""
    from tonearm.plans import playing

    sizes = [(1, 10), (2, None), (3, 30), (3, 140), (4, 7), (5, 44), (5, 44), (6, 21), (None, 5)]  # 30 and 140 are of one tempo
    spark.createDataFrame([(k, s, "b") for k, s in sizes], "p_partkey long, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    rng = random.Random(4)
    lines = [(o, rng.choice([1, 2, 3, 4, 5, 6, 9, None]), at) for o in [None, *range(30)] for at in range(rng.randrange(1, 9))]
    spark.createDataFrame([(o, p, n, at // 2, 1.0, 2.0, None) for n, (o, p, at) in enumerate(lines)], kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    sf = str(tmp_path)
    tracks = pairing.tracks(spark, sf).withColumn("body", playing.body("track_id", "CAST(NULL AS INT)")).withColumn("bars", F.when(F.col("bpm") > 0, F.floor(60.0 / F.col("bpm") * 4 * playing.RATE + 0.5)).otherwise(F.lit(playing.RATE)))
    bodies = tracks.select("track_id", "body.start", "body.end", "bpm", "outro_beats", "intro_beats", F.least("bars", F.floor(F.col("body.end") / 2)).cast("long").alias("least_body"))
    queue = playing.entries(spark, sf).select("l_orderkey", F.col("position").cast("long").alias("position"), "l_partkey").join(bodies, F.col("l_partkey") == F.col("track_id"))
    queue = queue.withColumn("enabled", G.gated(F.expr(playing.CONTEXT), F.lit(None).cast("boolean")))
    plans = P.plans_of(pairing.candidates(spark, sf), pairing.PREFS, pairing.KEYS, "a_id", "b_id")
    side = lambda id, name: bodies.select(F.col("track_id").alias(id), F.struct("start", "end", "bpm", "outro_beats", "intro_beats").alias(name))
    placed = G.plan_frames(plans.join(side("a_id", "a"), "a_id").join(side("b_id", "b"), "b_id"), pairing.PREFS, "a", "b", playing.RATE)
    want = rows(G.built(queue, placed, "l_orderkey"))
    assert rows(playing.built_programs(spark, sf)) == want
    assert len({r[3] for r in want}) > 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = playing.built_programs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("SortMergeJoin") == 1


def test_sections_are_summed_along_their_beats(spark):
    """Also where a task has more sections than an aggregate of arrays keeps before it sorts; nulls count for no mean."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = spark.range(300).select(F.col("id").alias("k"), F.posexplode(F.array(F.lit(1.0), F.lit(1e16), F.lit(-1e16), F.lit(None)))).select("k", F.col("pos").cast("long").alias("i"), F.col("col").alias("x"))
        b = b.select("k", "i", F.col("x").alias("e"), (F.col("x") / 2).alias("d"), F.lit(None).cast("double").alias("v"))
        found = ST.sections(b, b.filter("i = 0").select("k", F.col("i").alias("start")), "k", "i", "start", "e", "d", "v")
        assert found.groupBy("energy", "drums", "vocals", "label", "end").count().collect() == [(0.0, 0.0, None, "VERSE", 4, 300)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
