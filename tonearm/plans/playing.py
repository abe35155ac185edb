"""Queries from ranked plans to programs: playlists as queues, tracks derived from part as in pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.operators import pairs as P
from tonearm.operators import planning as G
from tonearm.plans.base import Plans, table
from tonearm.plans.library import ENTRIES, entries
from tonearm.plans.pairing import CANDIDATES, COST, FITS, KEYS, PREFS, TRACK, candidates, every_size, neighbours, scored, scored_pairs, tracks, with_tracks

PLANS = Plans()


def _styled(style: G.Style) -> str:
    """A style's factor on each strategy's score, over the plain one's."""
    prefs = style.apply(PREFS)
    by = {s: prefs.weights.get(s, 1.0) * P.energy_preference(s, prefs.energy) for s, _, _ in FITS if s not in prefs.excluded or s == "crossfade"}
    return "CASE strategy " + " ".join(f"WHEN '{s}' THEN {x}" for s, x in by.items()) + " END"


SMOOTH = G.STYLES["smooth"]


@PLANS.query(f"WITH {CANDIDATES}, y2 AS (SELECT l_orderkey, position, strategy, fit * bonus * jitter * {_styled(SMOOTH)} AS s, n FROM z WHERE ok) SELECT l_orderkey, position, first(strategy ORDER BY s DESC, n) AS strategy, round(max(s) + 1e-9, 6) AS score FROM y2 WHERE s IS NOT NULL GROUP BY 1, 2")
def styled_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The best plan of every transition under the smooth style."""
    best = P.plans_of(candidates(spark, sf), SMOOTH.apply(PREFS), KEYS, "a_id", "b_id", 1)
    return best.select("l_orderkey", "position", "strategy", F.round(F.col("score") + 1e-9, 6).alias("score"))


@PLANS.query(f"""WITH RECURSIVE {CANDIDATES}, l AS (SELECT l_orderkey, position, list({{'s': score, 'n': n, 'strategy': strategy}} ORDER BY n) AS c FROM ranked GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY position) AS k FROM l),
chain AS (SELECT l_orderkey, 0::BIGINT AS k, NULL::INT AS position, NULL::VARCHAR AS strategy, NULL::DOUBLE AS score, NULL::VARCHAR AS previous FROM o WHERE k = 1 UNION ALL
SELECT l_orderkey, k, position, b.strategy, -b.s, previous FROM (SELECT o.l_orderkey, o.k, o.position, chain.strategy AS previous,
list_sort(list_transform(o.c, lambda x: {{'s': -x.s * CASE WHEN chain.strategy IS NULL OR x.strategy <> chain.strategy THEN 1 WHEN x.strategy IN ('brakeStop', 'loopRollRiser') THEN 0 ELSE 0.7 END, 'n': x.n, 'strategy': x.strategy}}))[1] AS b FROM chain JOIN o ON o.l_orderkey = chain.l_orderkey AND o.k = chain.k + 1))
SELECT l_orderkey, position, strategy, round(score + 1e-9, 6) AS score, previous FROM chain WHERE k > 0""")
def chained_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Along every playlist the best plans, a repeated strategy counting less."""
    plans = P.plans_of(candidates(spark, sf), PREFS, KEYS, "a_id", "b_id")
    out = G.chained(plans, ["l_orderkey"], ["position"], PREFS.variety)
    return out.withColumn("score", F.round(F.col("score") + 1e-9, 6))


@PLANS.query(f"""WITH {CANDIDATES} SELECT l_orderkey, position, strategy, 'score ' || format('{{:.3f}}', score + 1e-9) || ' = fit ' || format('{{:.2f}}', fit + 1e-9) || ' × weight 1.00 × energy ' || format('{{:.2f}}', pref + 1e-9) || ' × variety 1.00 × modifiers ' || format('{{:.2f}}', bonus + 1e-9) || ' × jitter ' || format('{{:.3f}}', jitter + 1e-9) ||
CASE WHEN glide > 0.3 OR carry > 0.3 THEN ', modifiers: ' || array_to_string(list_filter([CASE WHEN glide > 0.3 THEN 'tempoGlide (' || format('{{:.2f}}', glide + 1e-9) || ')' END, CASE WHEN carry > 0.3 THEN 'textureCarry (' || format('{{:.2f}}', carry + 1e-9) || ')' END], lambda x: x IS NOT NULL), ', ') ELSE '' END AS explanation FROM ranked WHERE place = 1""")
def plan_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """How the best plan's score came about, factor by factor."""
    best = P.plans_of(candidates(spark, sf), PREFS, KEYS, "a_id", "b_id", 1)
    near = F.transform("modifiers", lambda m: F.struct(m["modifier"].alias("modifier"), (m["score"] + 1e-9).alias("score")))
    nudged = best.withColumns({n: F.col(n) + 1e-9 for n in ("score", "fit", "energy", "bonus", "jitter")} | {"modifiers": near})  # both engines round halves alike
    return G.explained(nudged, PREFS).select("l_orderkey", "position", "strategy", "explanation")


BUCKETED = f"""{COST[:COST.index("cost AS (")]}b AS (SELECT l_orderkey, position, CASE WHEN least(a_grid_confidence, b_grid_confidence) >= 0.5 AND stretch <= 3 THEN 'matched' ELSE 'unmatched' END || CASE WHEN distance <= 1 THEN '.inkey' ELSE '.clash' END || CASE WHEN ed >= 0 THEN '.rising' ELSE '.falling' END AS bucket FROM h)"""


@PLANS.query(f"WITH {BUCKETED} SELECT bucket, count(*) AS pairs FROM b GROUP BY 1")
def context_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """H30."""
    return scored(spark, sf).select(G.context_bucket().alias("bucket")).groupBy("bucket").agg(F.count("*").alias("pairs"))


@PLANS.query("""SELECT source, lang, count(*) FILTER (toxic = 0) AS n, 'learned ×' || format('{:.2f}', 1 + count(*) / 1000.0 + 1e-9) || ' from ' || array_to_string(list_filter([CASE WHEN count(*) FILTER (toxic = 0) > 0 OR count(*) FILTER (toxic = 1) = 0 THEN count(*) FILTER (toxic = 0) || ' rating' || CASE WHEN count(*) FILTER (toxic = 0) = 1 THEN '' ELSE 's' END END,
CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN count(*) FILTER (toxic = 1) || ' skip' || CASE WHEN count(*) FILTER (toxic = 1) = 1 THEN '' ELSE 's' END END], lambda x: x IS NOT NULL), ' and ') || ' in ''' || lang || '''' AS line FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1, 2""")
def learned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What each learned weight came from, by source and language."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").filter("lang is not null")
    sums = rows.groupBy("source", "lang").agg(F.count_if(F.col("toxic") == 0).alias("n"), F.count_if(F.col("toxic") == 1).alias("skips"), F.count("*").alias("all"))
    line = G.learned_line(1 + F.col("all") / 1000.0 + 1e-9, F.col("n"), F.col("skips"), F.col("lang"))
    return sums.select("source", "lang", "n", line.alias("line"))


CONTEXT = "CASE l_orderkey % 5 WHEN 0 THEN 'ALBUM' WHEN 1 THEN 'SHUFFLE' WHEN 2 THEN 'SINGLE' WHEN 3 THEN 'QUEUE' ELSE 'PLAYLIST' END"


@PLANS.query(f"""WITH e AS {ENTRIES}, q AS (SELECT l_orderkey, position, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY position) AS next FROM e), p AS (SELECT q.*, a.p_type = b.p_type AS same FROM q JOIN part a ON a.p_partkey = q.l_partkey JOIN part b ON b.p_partkey = q.next)
SELECT l_orderkey, position, CASE {CONTEXT} WHEN 'ALBUM' THEN NOT same WHEN 'SHUFFLE' THEN NOT same WHEN 'SINGLE' THEN false ELSE true END AS enabled FROM p""")
def gated_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Which neighbours get a transition, by context and album."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("position"))
    pairs = entries(spark, sf).select("l_orderkey", "position", "l_partkey", nxt.alias("next")).filter("next is not null")
    albums = table(spark, sf, "part").select("p_partkey", "p_type")
    a, b = albums.withColumnsRenamed({"p_partkey": "l_partkey", "p_type": "album_a"}), albums.withColumnsRenamed({"p_partkey": "next", "p_type": "album_b"})
    both = pairs.join(a, "l_partkey").join(b, "next")
    return both.select("l_orderkey", "position", G.gated(F.expr(CONTEXT), F.col("album_a") == F.col("album_b")).alias("enabled"))


RATE = 44_100
#: A track's frames, what it must keep for itself, and its tempo, from its seconds.
BODY = f"""0::BIGINT AS start, (seconds * {RATE})::BIGINT AS "end", least(CASE WHEN bpm > 0 THEN floor(60.0 / bpm * 4 * {RATE} + 0.5) ELSE {RATE} END, floor(seconds * {RATE} / 2))::BIGINT AS least_body"""
BARS_OF = "CASE strategy " + " ".join(f"WHEN '{s.id}' THEN {P.NEEDED_BARS[s.family]}" for s in P.STRATEGIES) + " END"
_KEEPS = lambda entry, leave, start, end, least: f"(greatest(coalesce({leave}, {end}), greatest(coalesce({entry}, {start}), 0)) - greatest(coalesce({entry}, {start}), 0) >= {least})"


@PLANS.query(f"""WITH RECURSIVE {CANDIDATES}, tb AS (SELECT track_id, bpm, outro_beats, intro_beats, {BODY} FROM tracks),
tg AS (SELECT ranked.l_orderkey, ranked.position, place, strategy, greatest(4, least({BARS_OF} * 4, outro, intro)) AS beats, a_bpm, b_bpm, a_end, b_end FROM ranked JOIN (SELECT x.track_id AS a_id, y.track_id AS b_id, x.outro_beats AS outro, y.intro_beats AS intro, x.bpm AS a_bpm, y.bpm AS b_bpm, x."end" AS a_end, y."end" AS b_end FROM (SELECT DISTINCT a_track_id, b_track_id FROM ranked) r JOIN tb x ON x.track_id = a_track_id JOIN tb y ON y.track_id = b_track_id) f ON f.a_id = a_track_id AND f.b_id = b_track_id),
tf AS (SELECT *, least(floor(beats * (60.0 / a_bpm) * {RATE} + 0.5)::BIGINT, a_end) AS length, least(floor(beats * (60.0 / b_bpm) * {RATE} + 0.5)::BIGINT, b_end) AS enter FROM tg),
tc AS (SELECT l_orderkey, position, list({{'place': place, 'strategy': strategy, 'leave': a_end - length, 'enter': enter, 'length': length}} ORDER BY place) AS c FROM tf GROUP BY 1, 2),
tw AS (SELECT e.l_orderkey, e.position, e.l_partkey, row_number() OVER (PARTITION BY e.l_orderkey ORDER BY e.position) AS k, count(*) OVER (PARTITION BY e.l_orderkey) AS n, CASE WHEN {CONTEXT.replace('l_orderkey', 'e.l_orderkey')} = 'SINGLE' THEN NULL ELSE tc.c END AS c FROM {ENTRIES} e LEFT JOIN tc ON tc.l_orderkey = e.l_orderkey AND tc.position = e.position),
tq AS (SELECT tw.*, tb.start AS s, tb."end" AS t, tb.least_body AS m, lead(tb.start) OVER o AS s2, lead(tb."end") OVER o AS t2, lead(tb.least_body) OVER o AS m2, lead(c) OVER o AS c2 FROM tw JOIN tb ON track_id = l_partkey WINDOW o AS (PARTITION BY tw.l_orderkey ORDER BY k)),
walk AS (SELECT l_orderkey, 0::BIGINT AS k, NULL::STRUCT("rank" INT, place BIGINT, strategy VARCHAR, "leave" BIGINT, enter BIGINT, length BIGINT) AS pick FROM tq WHERE k = 1 UNION ALL
SELECT l_orderkey, k, CASE WHEN best."rank" < 3 THEN best END FROM (SELECT tq.l_orderkey, tq.k, list_sort(list_transform(tq.c, lambda x: {{'rank': CASE WHEN NOT {_KEEPS('walk.pick.enter', "x['leave']", 'tq.s', 'tq.t', 'tq.m')} OR NOT {_KEEPS("x['enter']", 'NULL', 'tq.s2', 'tq.t2', 'tq.m2')} THEN 3
WHEN tq.c2 IS NULL OR len(list_filter(tq.c2, lambda y: {_KEEPS("x['enter']", "y['leave']", 'tq.s2', 'tq.t2', 'tq.m2')})) > 0 THEN 1 ELSE 2 END::INT, 'place': x['place'], 'strategy': x['strategy'], 'leave': x['leave'], 'enter': x['enter'], 'length': x['length']}}))[1] AS best FROM walk JOIN tq ON tq.l_orderkey = walk.l_orderkey AND tq.k = walk.k + 1 WHERE tq.k < tq.n)),
td AS (SELECT tq.*, i.pick AS i, u.pick AS u FROM tq LEFT JOIN walk i ON i.l_orderkey = tq.l_orderkey AND i.k = tq.k - 1 LEFT JOIN walk u ON u.l_orderkey = tq.l_orderkey AND u.k = tq.k)
SELECT l_orderkey, position::BIGINT AS position, 'body' AS kind, NULL AS strategy, coalesce(i.enter, s) AS start, greatest(coalesce(u."leave", t), coalesce(i.enter, s)) AS "end" FROM td UNION ALL SELECT l_orderkey, position, 'transition', u.strategy, 0, u.length FROM td WHERE u IS NOT NULL""")
def built_programs(spark: SparkSession, sf: str) -> DataFrame:
    """From tracks to segments: every playlist's plans ranked, put in order of the room they leave, the first that fits taken."""
    rows = queues(spark, sf)
    ids = scored_pairs(rows, *QUEUED).withColumns({"a_id": F.col("a.track_id"), "b_id": F.col("b.track_id")})
    offered = G.offers(ids, PREFS, [*QUEUED, "a_id", "b_id"], "a_id", "b_id", "own", "next", RATE, F.col("copies"))
    may = G.gated(F.expr(CONTEXT), F.lit(None).cast("boolean")) & F.col("b_id").isNotNull()
    held = offered.select("l_orderkey", "position", "first", "own.start", "own.end", "own.least_body", F.when(may, F.col("plans")).alias("plans"))
    return G.walked(held, "l_orderkey", dealt=True)


QUEUED = ("l_orderkey", "position", "first", "copies", "own", "next")


def queues(spark: SparkSession, sf: str) -> DataFrame:
    """Every playlist's entries that have a part, in order: both tracks a and b of the transition into the next entry (b of nulls where there is none), `own` and `next`: what is known of them in frames.

    A key with several parts (`copies`) gives an entry for each; its rows are all choices of the parts that a transition is
    ranked by and that its frames are taken from, and each entry's first row is marked.
    """
    rows = neighbours(spark, sf).filter("p_partkey is not null").select(
        "l_orderkey", (F.col("position") - 1).cast("long").alias("position"), F.col("p_partkey").alias("a_p_partkey"), "b_p_partkey",
        every_size(F.col("p_size"), F.col("others")).alias("a"), F.when(F.col("b_p_partkey").isNotNull(), every_size(F.col("b_p_size"), F.col("b_others"))).alias("b"),
    )
    rows = rows.withColumns({"copies": (F.size("a") > 1) | F.coalesce(F.size("b") > 1, F.lit(False)), "b_p_partkey": F.when(F.col("b").isNotNull(), F.col("b_p_partkey"))})
    for side, place, size in (("a", "own_place", "own_p_size"), ("a", "a_place", "a_p_size"), ("b", "b_place", "b_p_size"), ("b", "next_place", "next_p_size")):
        made = F.posexplode(side) if side == "a" else F.posexplode_outer(side)
        rows = rows.select("*", made.alias(place, size))
    first = F.greatest("a_place", F.coalesce("b_place", F.lit(0)), F.coalesce("next_place", F.lit(0))) == 0
    rows = rows.sortWithinPartitions("l_orderkey", "position", "own_place").withColumns({"first": first, "own": body("a_p_partkey", "own_p_size"), "next": body("b_p_partkey", "next_p_size")})
    return with_tracks(rows, True, *QUEUED)


def body(key: str, size: str) -> Column:
    """A track's frames, what it must keep for itself, its tempo and its rooms, from its part's key and size."""
    of = {n: F.expr(TRACK[n].replace("p_partkey", key).replace("p_size", size)) for n in ("bpm", "seconds", "outro_beats", "intro_beats")}
    end, bars = of["seconds"] * RATE, F.when(of["bpm"] > 0, F.floor(60.0 / of["bpm"] * 4 * RATE + 0.5)).otherwise(F.lit(RATE))
    frames = {"start": F.lit(0).cast("long"), "end": end.cast("long"), "least_body": F.least(bars, F.floor(end / 2)).cast("long")}
    return F.struct(*[c.alias(n) for n, c in (frames | {n: of[n] for n in ("bpm", "outro_beats", "intro_beats")}).items()])


#: A queue's tracks in frames, and where the transition into the next one leaves and enters.
FRAMES = """(l_partkey * 7) % 500 AS start, (l_partkey * 7) % 500 + 1000 + (l_partkey * 13) % 3000 AS "end", least(100 + l_partkey % 40 * 40, (1000 + (l_partkey * 13) % 3000) // 2) AS least_body,
CASE WHEN next IS NULL OR (l_partkey + next) % 6 = 0 THEN NULL ELSE (l_partkey * 7) % 500 + (1000 + (l_partkey * 13) % 3000) * ((l_partkey + next) % 10 + 2) // 12 END AS leave,
(next * 7) % 500 + (1000 + (next * 13) % 3000) * ((l_partkey * 3 + next) % 9) // 12 AS enter, 200 + (l_partkey + next) % 50 AS length"""
QUEUE = f"e AS {ENTRIES}, q AS (SELECT l_orderkey, position::BIGINT AS position, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY position) AS next FROM e), f AS (SELECT l_orderkey, position, {FRAMES} FROM q)"


def queue(spark: SparkSession, sf: str) -> DataFrame:
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("position"))
    rows = entries(spark, sf).select("l_orderkey", F.col("position").cast("long").alias("position"), "l_partkey", nxt.alias("next"))
    expr = FRAMES.replace('"end"', "`end`").replace("//", "div")
    return rows.selectExpr("l_orderkey", "position", *[x.strip() for x in _split(expr)])


def _split(text: str) -> list[str]:
    """Select items at top level."""
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


@PLANS.query(f"""WITH RECURSIVE {QUEUE}, l AS (SELECT l_orderkey, count(*) AS n, list(start ORDER BY position) AS s, list("end" ORDER BY position) AS t, list(least_body ORDER BY position) AS m, list(leave ORDER BY position) AS x, list(enter ORDER BY position) AS y, list(length ORDER BY position) AS z FROM f GROUP BY 1),
r AS (SELECT *, 0 AS k, list_transform(x, lambda v, i: v IS NOT NULL AND i < n) AS st FROM l UNION ALL
SELECT l_orderkey, n, s, t, m, x, y, z, k + 1, CASE WHEN (o OR i) AND greatest(CASE WHEN o THEN x[p] ELSE t[p] END, b) - b < m[p] THEN CASE WHEN o THEN list_transform(st, lambda v, j: v AND j <> p) ELSE list_transform(st, lambda v, j: v AND j <> p - 1) END ELSE st END
FROM (SELECT *, greatest(CASE WHEN i THEN y[p - 1] ELSE s[p] END, 0) AS b FROM (SELECT *, k % n + 1 AS p, st[k % n + 1] AS o, k % n > 0 AND coalesce(st[k % n], false) AS i FROM r WHERE k < 3 * n))),
d AS (SELECT *, unnest(range(1, n + 1)) AS p FROM r WHERE k = 3 * n), g AS (SELECT *, greatest(CASE WHEN p > 1 AND st[p - 1] THEN y[p - 1] ELSE s[p] END, 0) AS b FROM d)
SELECT l_orderkey, p - 1 AS position, 'body' AS kind, b AS start, greatest(CASE WHEN st[p] THEN x[p] ELSE t[p] END, b) AS "end" FROM g UNION ALL SELECT l_orderkey, p - 1, 'transition', 0, z[p] FROM g WHERE st[p]""")
def programs(spark: SparkSession, sf: str) -> DataFrame:
    """Every playlist as bodies and the transitions that leave each track its least body."""
    return G.program(queue(spark, sf), "l_orderkey")


@PLANS.query(f"""WITH {QUEUE}, g AS (SELECT *, coalesce(lag(CASE WHEN leave IS NOT NULL THEN enter END) OVER (PARTITION BY l_orderkey ORDER BY position), start) AS entry, lead(start) OVER w AS b_start, lead("end") OVER w AS b_end, lead(least_body) OVER w AS b_least, lead(leave) OVER w AS b_leave FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY position)),
h AS (SELECT *, greatest(leave, entry) - entry >= least_body AS a_ok, greatest(b_end, enter) - enter >= b_least AS b_alone, greatest(b_leave, enter) - enter >= b_least AS b_next FROM g WHERE leave IS NOT NULL AND b_start IS NOT NULL)
SELECT CASE WHEN NOT a_ok THEN 'STARVES_A' WHEN CASE WHEN b_leave IS NULL THEN b_alone ELSE b_next END THEN 'FITS' WHEN b_alone THEN 'COSTS_NEXT' ELSE 'STARVES_B' END AS room, count(*) AS pairs FROM h GROUP BY 1""")
def transition_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """What every transition leaves its tracks."""
    w = Window.partitionBy("l_orderkey").orderBy("position")
    into = F.coalesce(F.lag(F.when(F.col("leave").isNotNull(), F.col("enter"))).over(w), F.col("start"))
    q = queue(spark, sf).withColumns({"entry": into, **{f"b_{n}": F.lead(n).over(w) for n in ("start", "end", "least_body", "leave")}}).filter("leave is not null and b_start is not null")
    body = lambda s, e, i, o: (lambda x: x["to"] - x["from"])(G.bounds(s, e, i, o))
    a = body(F.col("start"), F.col("end"), F.col("entry"), F.col("leave"))
    alone = body(F.col("b_start"), F.col("b_end"), F.col("enter"), F.lit(None).cast("long"))
    nexts = F.when(F.col("b_leave").isNotNull(), F.array(body(F.col("b_start"), F.col("b_end"), F.col("enter"), F.col("b_leave"))))
    return q.select(G.room(a, F.col("least_body"), alone, F.col("b_least_body"), nexts).alias("room")).groupBy("room").agg(F.count("*").alias("pairs"))


@PLANS.query(f"""WITH {CANDIDATES}, v AS (SELECT l_orderkey, position, place, strategy, CASE (l_orderkey + n * 7 + position) % 4 WHEN 0 THEN 'FITS' WHEN 1 THEN 'COSTS_NEXT' WHEN 2 THEN 'STARVES_B' ELSE 'STARVES_A' END AS room FROM ranked WHERE place <= 4),
k AS (SELECT *, CASE WHEN room LIKE 'STARVES%' THEN 2 WHEN room = 'FITS' THEN 0 ELSE 1 END AS r FROM v), m AS (SELECT *, CASE WHEN min(r) OVER (PARTITION BY l_orderkey, position) = 2 THEN 0 ELSE r END AS r2 FROM k)
SELECT l_orderkey, position, strategy, room, row_number() OVER (PARTITION BY l_orderkey, position ORDER BY r2, place) AS try FROM m""")
def room_ordered_plans(spark: SparkSession, sf: str) -> DataFrame:
    """four plans of every transition in the order to try them."""
    best = P.plans_of(candidates(spark, sf), PREFS, KEYS, "a_id", "b_id", 4)
    kinds = F.array(*map(F.lit, ("FITS", "COSTS_NEXT", "STARVES_B", "STARVES_A")))
    rows = best.withColumn("room", F.get(kinds, ((F.col("l_orderkey") + F.col("ordinal") * 7 + F.col("position")) % 4).cast("int")))
    out = G.room_order(rows, ["l_orderkey", "position"], "place", "room")
    return out.select("l_orderkey", "position", "strategy", "room", F.col("try").cast("long").alias("try"))


@PLANS.query("WITH q AS (SELECT l_orderkey, sum(p_size * 100) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT l_orderkey, s::BIGINT AS seconds, floor(s / 60)::BIGINT AS minutes, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', (s // 3600)::BIGINT, (s % 3600 // 60)::BIGINT, (s % 60)::BIGINT) ELSE format('{}:{:02d}', (s // 60)::BIGINT, (s % 60)::BIGINT) END AS duration FROM q")
def playlist_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Total length of every playlist, in whole minutes and formatted."""
    from tonearm.functions.text import format_duration

    songs = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size").cast("long") * 100).alias("s"))
    sums = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(songs, "l_partkey").groupBy("l_orderkey").agg(F.sum("s").alias("seconds"))
    return sums.select("l_orderkey", "seconds", F.floor(F.col("seconds") / 60).alias("minutes"), format_duration(F.col("seconds") * 1000).alias("duration"))


@PLANS.query(f"""WITH e AS {ENTRIES}, c AS (SELECT l_orderkey, max(position) // 2 AS cur, max(position) AS last FROM e GROUP BY 1), n AS (SELECT e.l_orderkey, l_partkey AS item, CASE WHEN position > cur THEN position + 2 ELSE position END AS p FROM e JOIN c USING (l_orderkey) UNION ALL SELECT l_orderkey, l_orderkey % 100, cur + 1 FROM c UNION ALL SELECT l_orderkey, l_orderkey % 100 + 1, cur + 2 FROM c),
r AS (SELECT 'next' AS edit, l_orderkey, item, p::INT AS position FROM n UNION ALL SELECT 'removed', l_orderkey, item, (row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1)::INT FROM n WHERE item % 4 <> 1) SELECT * FROM r""")
def queue_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Two items played next in every queue, then some removed."""
    from tonearm.operators import library as L

    rows = entries(spark, sf).select("l_orderkey", F.col("l_partkey").alias("item"), "position")
    cur = rows.groupBy("l_orderkey").agg(F.floor(F.max("position") / 2).cast("int").alias("current"))
    more = cur.select("l_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).select("l_orderkey", (F.col("l_orderkey") % 100 + F.col("ordinal")).alias("item"), "ordinal")
    nxt = L.played_next(rows.join(cur, "l_orderkey"), more, "l_orderkey", "current").select("l_orderkey", "item", "position")
    gone = L.removed(nxt, "l_orderkey", F.col("item") % 4 == 1)
    return nxt.select(F.lit("next").alias("edit"), "l_orderkey", "item", "position").union(gone.select(F.lit("removed"), "l_orderkey", "item", "position"))


@PLANS.query(f"""WITH e AS {ENTRIES}, i AS (SELECT l_orderkey, position, l_partkey, CAST((l_partkey * 17) % 100 AS DOUBLE) / 100 AS x FROM e), o AS (SELECT l_orderkey, abs(lead(x) OVER (PARTITION BY l_orderkey ORDER BY position) - x) AS c FROM i), m AS (SELECT l_orderkey, avg(c) AS m FROM o WHERE c IS NOT NULL GROUP BY 1),
r AS (SELECT l_orderkey, s AS seed, abs(lead(x) OVER (PARTITION BY l_orderkey, s ORDER BY md5(s || ':' || position), position) - x) AS c FROM i, range(1, 6) t(s)), a AS (SELECT l_orderkey, seed, avg(c) AS c FROM r WHERE c IS NOT NULL GROUP BY 1, 2), g AS (SELECT l_orderkey, quantile_cont(c, 0.5) AS q FROM a GROUP BY 1)
SELECT l_orderkey, round(m, 6) AS mean_cost, round(CASE WHEN q > 0 THEN 1 - m / q END, 6) + 0.0 AS gain FROM m JOIN g USING (l_orderkey)""")
def order_gains(spark: SparkSession, sf: str) -> DataFrame:
    """What every playlist's order gains over five random ones."""
    from tonearm.operators import sequence as Q

    items = entries(spark, sf).select("l_orderkey", F.col("position").alias("place"), ((F.col("l_partkey") * 17) % 100 / 100).alias("x"))
    cost = F.abs(F.col("b.x") - F.col("a.x"))
    out = Q.order_gains(items, "l_orderkey", "place", cost, ["x"], 5)
    return out.select("l_orderkey", F.round("mean_cost", 6).alias("mean_cost"), (F.round("gain", 6) + 0.0).alias("gain"))


@PLANS.query("""WITH g AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, (embedding::DOUBLE[])[1:8] AS v, md5(label || ':' || vec_id) AS h FROM embeddings WHERE vec_id % 9 <> 4),
a AS (SELECT vec_id, label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x + 2) ELSE embedding::DOUBLE[] END AS e,
CASE WHEN vec_id % 13 = 0 THEN (embedding::DOUBLE[])[1:7] WHEN vec_id % 11 = 0 THEN list_transform((embedding::DOUBLE[])[1:8], lambda x: x - 0.75) WHEN vec_id % 11 = 1 THEN list_transform((embedding::DOUBLE[])[1:8], lambda x: x + 0.25) ELSE (embedding::DOUBLE[])[1:8] END AS v, CASE WHEN vec_id % 17 = 0 THEN 'other' ELSE md5(label || ':' || vec_id) END AS h FROM embeddings WHERE vec_id % 9 <> 5),
b AS (SELECT coalesce(g.vec_id, a.vec_id) AS vec_id, g.vec_id IS NULL AS ng, a.vec_id IS NULL AS na, g.label AS gl, a.label AS al, g.h AS gh, a.h AS ah, len(g.v) <> len(a.v) AS cut, sqrt(list_avg(list_transform(range(1, len(g.e) + 1), lambda i: (g.e[i] - a.e[i]) ^ 2))) AS r, sqrt(list_avg(list_transform(range(1, least(len(g.v), len(a.v)) + 1), lambda i: (g.v[i] - a.v[i]) ^ 2))) AS w FROM g FULL JOIN a USING (vec_id))
SELECT vec_id, round(w, 6) AS envelope_rmse, round(r, 6) AS spectrum_rmse, CASE WHEN na THEN ['not rendered'] WHEN ng THEN ['no golden'] ELSE list_filter([CASE WHEN gl <> al THEN 'plan' END, CASE WHEN w > 0.5 THEN 'envelope' END, CASE WHEN r > 1 THEN 'spectrum' END, CASE WHEN cut THEN 'length' END, CASE WHEN gh <> ah THEN 'hash' END], lambda x: x IS NOT NULL) END AS differs FROM b""")
def golden_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Plans, envelopes, spectra and hashes against golden ones."""
    from tonearm.operators import stats as S

    whole = F.col("embedding").cast("array<double>")
    v = table(spark, sf, "embeddings").select("vec_id", "label", whole.alias("e"), F.slice(whole, 1, 8).alias("v"), F.md5(F.concat_ws(":", "label", "vec_id")).alias("h"))
    cell = lambda df, plan, envelope, spectrum, hash: df.select("vec_id", plan.alias("plan"), envelope.alias("envelope"), spectrum.alias("spectrum"), hash.alias("hash"))
    golden = cell(v.filter("vec_id % 9 <> 4"), F.col("label"), F.col("v"), F.col("e"), F.col("h"))
    every = lambda n, rest=0: F.col("vec_id") % n == rest
    envelope = F.when(every(13), F.slice("v", 1, 7)).when(every(11), F.transform("v", lambda x: x - 0.75)).when(every(11, 1), F.transform("v", lambda x: x + 0.25)).otherwise(F.col("v"))
    actual = cell(v.filter("vec_id % 9 <> 5"), F.col("label") + every(7).cast("int"), envelope, F.when(every(5), F.transform("e", lambda x: x + 2)).otherwise(F.col("e")), F.when(every(17), "other").otherwise(F.col("h")))
    out = S.golden_cells(golden, actual, ["vec_id"], strict=True)
    return out.select("vec_id", F.round("envelope_rmse", 6).alias("envelope_rmse"), F.round("spectrum_rmse", 6).alias("spectrum_rmse"), "differs")


CASE_COLUMNS = {
    "true_bpm": "60.0 + p_partkey % 100", "bpm": "(60.0 + p_partkey % 100) * CASE p_partkey % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 1.02 ELSE 1.005 END", "f": "p_size / 60.0", "phase": "p_partkey % 4", "true_phase": "p_size % 4",
    "tonic": "p_partkey % 12", "minor": "p_partkey % 2 = 0", "true_tonic": "(p_partkey + CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 3 ELSE 9 END) % 12", "true_minor": "(p_partkey + CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END) % 2 = 0",
    "trim": "p_size / 500.0", "true_trim": "0.0", "cents": "p_partkey % 30 - 15", "true_cents": "0",
}


@PLANS.query("WITH c AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CASE_COLUMNS.items()) + """ FROM part), e AS (SELECT *, abs(bpm / true_bpm - 1) AS err, least(abs(bpm / (true_bpm / 2) - 1), abs(bpm / (true_bpm * 2) - 1)) <= 0.01 AS octave FROM c)
SELECT count(*) AS cases, count(*) FILTER (err <= 0.01) AS tempo_ok, count(*) FILTER (err > 0.01 AND octave) AS octave_errors, round(avg(f), 6)::DOUBLE AS mean_f, count(*) FILTER (phase = true_phase) AS phase_ok, count(*) FILTER (tonic = true_tonic AND minor = true_minor) AS key_ok,
count(*) FILTER (minor <> true_minor AND (true_tonic + CASE WHEN true_minor THEN 3 ELSE 9 END) % 12 = tonic) AS key_relative, count(*) FILTER (abs(trim - true_trim) <= 0.05) AS trim_ok, round(max(abs(trim - true_trim)), 6)::DOUBLE AS worst_trim, round(avg(abs(cents - true_cents)), 6)::DOUBLE AS mean_cents FROM e""")
def accuracy_bench(spark: SparkSession, sf: str) -> DataFrame:
    """K7: all measures of the accuracy bench."""
    from tonearm.operators import stats as S

    out = S.accuracy(table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in CASE_COLUMNS.items()]))
    return out.withColumns({n: F.round(n, 6).cast("double") for n in ("mean_f", "worst_trim", "mean_cents")})


@PLANS.query(f"""WITH {CANDIDATES}, tk AS (SELECT l_orderkey, position, strategy, ok, CASE WHEN ok THEN fit * pref * bonus * jitter END AS score, CASE WHEN ok THEN -20.0 - n % 5 - position % 3 END AS level FROM z)
SELECT strategy, count(*) AS rows, count(*) FILTER (ok) AS applicable, round(avg(score), 5) AS mean_score, round(avg(greatest(-12, low - level)) FILTER (ok), 5)::DOUBLE AS mean_gain FROM (SELECT *, min(level) OVER (PARTITION BY l_orderkey, position) AS low FROM tk) GROUP BY 1""")
def ab_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair's strategies, those that apply with score and level-matched gain, rolled up by strategy."""
    from tonearm.operators import stats as S

    scored_ = candidates(spark, sf)
    every = P.candidates(scored_, PREFS, KEYS).groupBy("strategy").agg(F.count("*").alias("rows"), F.count_if("applicable").alias("applicable"))
    plans = P.plans_of(scored_, PREFS, KEYS, "a_id", "b_id").withColumn("level", -20.0 - F.col("ordinal") % 5 - F.col("position") % 3)
    matched = S.level_matched(plans, ["l_orderkey", "position"], "level")
    means = matched.groupBy("strategy").agg(F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.avg("gain"), 5).alias("mean_gain"))
    return every.join(means, "strategy", "left").select("strategy", "rows", "applicable", "mean_score", "mean_gain")


#: Quotas of the evaluation's sample: half from chains, a quarter each of the hardest stretches and the steepest rises.
QUOTAS = (200, 100, 100)


@PLANS.query(f"""WITH {COST[:COST.index('cost AS (')]}tp AS (SELECT a_track_id || '-' || b_track_id AS pair, min(position) AS position, min(round(stretch, 9)) AS stretch, min(round(ed, 9)) AS rise FROM h GROUP BY 1),
s1 AS (SELECT pair, 'chain' AS source, 0 AS turn FROM tp ORDER BY position, pair LIMIT {QUOTAS[0]}), s2 AS (SELECT pair, 'hardest' AS source, 1 AS turn FROM tp ANTI JOIN s1 USING (pair) ORDER BY stretch DESC, pair LIMIT {QUOTAS[1]}),
s3 AS (SELECT pair, 'steepest' AS source, 2 AS turn FROM tp ANTI JOIN s1 USING (pair) ANTI JOIN s2 USING (pair) ORDER BY rise DESC, pair LIMIT {QUOTAS[2]}) SELECT pair, source FROM (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3) ORDER BY turn, pair LIMIT {sum(QUOTAS)}""")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that an evaluation renders: first chain pairs, then the hardest to stretch, then the steepest rises; the quotas are the feature."""
    from tonearm.operators import stats as S

    s = scored(spark, sf).select(F.concat_ws("-", "a.track_id", "b.track_id").alias("pair"), "position", F.round("stretch", 9).alias("stretch"), F.round("energy_delta", 9).alias("rise"))
    pairs = s.groupBy("pair").agg(F.min("position").alias("position"), F.min("stretch").alias("stretch"), F.min("rise").alias("rise"))
    sources = [("chain", F.asc("position"), QUOTAS[0]), ("hardest", F.desc("stretch"), QUOTAS[1]), ("steepest", F.desc("rise"), QUOTAS[2])]
    return S.quota_sample(pairs, sources, sum(QUOTAS)).select("pair", "source")


@PLANS.query("WITH v AS (SELECT p_partkey, greatest(1, least(8, floor(p_size / 4.0 + 0.5))) AS bars FROM part), w AS (SELECT *, greatest(0, least(60, bars * 4 - 2)) AS beats FROM v) SELECT p_partkey, bars::DOUBLE AS bars, beats::DOUBLE AS beats, greatest(0, least(1, beats / greatest(bars, 4)))::DOUBLE AS share FROM w")
def rule_variables(spark: SparkSession, sf: str) -> DataFrame:
    """A rule's variables, each over those before it, clamped to their ranges."""
    from tonearm.functions.exprs import resolved

    found = resolved({"bars": ("round(size / 4)", 1, 8), "beats": ("bars * 4 - 2", 0, 60), "share": ("beats / max(bars, 4)", 0, 1)}, {"size": F.col("p_size")})
    return table(spark, sf, "part").select("p_partkey", *[found[n].alias(n) for n in ("bars", "beats", "share")])


@PLANS.query()
def pair_pool(spark: SparkSession, sf: str) -> DataFrame:
    """About 20,000 ordered pairs of tracks, drawn at random; the pool's size is the feature, tests check its draw."""
    from tonearm.operators import stats as S

    return S.pair_pool(table(spark, sf, "part").select("p_partkey"), "p_partkey", 20_000, 1)
