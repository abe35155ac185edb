"""Queries on tempo, beats, sections and spectra: a user's events in order stand for a track's beats and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import music as M
from tonearm.operators import series as R
from tonearm.operators import structure as T
from tonearm.plans.base import Plans, table
from tonearm.plans.signals import S, series

PLANS = Plans()
#: A beat's energy, drums and voices, and its flux by band, from an event's value and place.
BEAT = {
    "energy": "CASE WHEN i // 9 % 3 = 0 THEN 0.4 ELSE 1 END * (x % 100) / 100",
    "drums": "CASE WHEN i < 9 OR i // 9 % 4 = 3 THEN 0.1 ELSE (i * 13 % 10) / 10.0 END",
    "vocals": "(i * 7 % 10) / 10.0",
    "low": "CASE WHEN i % 2 = user_id % 2 THEN x ELSE x / 8 END",
    "mid": "x * (i % 3) / 4",
    "broad": "x * 2",
}
B = f"{S}, b AS (SELECT user_id, i, x, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in BEAT.items())} FROM s)"


def beats(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).select("user_id", "i", "x", *[F.expr(e.replace("//", "div")).cast("double").alias(n) for n, e in BEAT.items()])


@PLANS.query("""WITH e AS (SELECT event_id, value AS b, user_id % 4 AS p FROM events), f AS (SELECT *, floor((b - p) / 4)::BIGINT AS bar, (floor((b - p) / 4) * 4 + p)::BIGINT AS previous, (ceil((b - p) / 4) * 4 + p)::BIGINT AS next FROM e)
SELECT event_id, bar, bar * 4 + p AS first_beat, previous, next, CASE WHEN b - previous <= next - b THEN previous ELSE next END AS nearest, (ceil((b - p) / 32) * 32 + p)::BIGINT AS next_phrase, ((floor(b) - p)::BIGINT % 4 + 4) % 4 = 0 AS downbeat FROM f""")
def beat_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """H14, H15."""
    b, p = F.col("value"), F.col("user_id") % 4
    bar = M.bar_of_beat(b, p)
    return table(spark, sf, "events").select(
        "event_id", bar.alias("bar"), M.beat_of_bar(bar, p).alias("first_beat"), M.previous_start(b, p).alias("previous"), M.next_start(b, p).alias("next"),
        M.nearest_start(b, p).alias("nearest"), M.next_start(b, p, 32).alias("next_phrase"), M.starts_at(F.floor(b).cast("long"), p).alias("downbeat"),
    )


@PLANS.query(f"WITH {B}, r AS (SELECT user_id, (i - 2) // 4 AS bar, avg(energy) AS energy FROM b WHERE i >= 6 AND i < 38 GROUP BY 1, 2), m AS (SELECT user_id, min(bar) AS lo, max(bar) AS hi FROM r GROUP BY 1) SELECT b.user_id, b.i, round(r.energy, 6) AS energy FROM b JOIN m USING (user_id) LEFT JOIN r ON r.user_id = b.user_id AND r.bar = greatest(lo, least(hi, floor((b.i - 2) / 4.0)))")
def bars_to_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Bar means spread to beats, those outside clamped."""
    b = beats(spark, sf)
    bars = b.filter("i >= 6 and i < 38").groupBy("user_id", M.bar_of_beat(F.col("i"), F.lit(2)).alias("bar")).agg(F.avg("energy").alias("energy"))
    return T.spread(b.select("user_id", "i"), bars, "user_id", "i", "bar", ["energy"], F.lit(2)).select("user_id", "i", F.round("energy", 6).alias("energy"))


EDGES = """n AS (SELECT user_id, max(i) + 1 AS n FROM b GROUP BY 1), t AS (SELECT user_id, n, greatest(0, least(n, CASE WHEN user_id % 5 = 0 THEN n WHEN user_id % 5 = 1 THEN 0 ELSE n - user_id % 7 END)) AS e, greatest(0, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 11 END) AS h FROM n),
u AS (SELECT user_id, CASE WHEN e <= 0 THEN 0 ELSE greatest(0, e - 8) END AS t0, CASE WHEN e <= 0 THEN least(n, 8) ELSE e END AS t1, CASE WHEN h > n - 8 THEN greatest(0, n - 8) ELSE h END AS h0, n FROM t)"""


@PLANS.query(f"WITH {B}, {EDGES} SELECT user_id, " + ", ".join(f"round(avg({v}) FILTER (i >= {a} AND i < {z}) + 1e-9, 6) AS {p}_{v}" for p, a, z in (("tail", "t0", "t1"), ("head", "h0", "least(n, h0 + 8)")) for v in ("energy", "vocals")) + " FROM b JOIN u USING (user_id) GROUP BY 1")
def edge_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the eight bars before a track's mix-out and from its mix-in on."""
    b = beats(spark, sf)
    cues = b.groupBy("user_id").agg((F.max("i") + 1).alias("n"))
    cues = cues.select("user_id", F.when(F.col("user_id") % 5 == 1, 0).when(F.col("user_id") % 5 > 1, F.col("n") - F.col("user_id") % 7).alias("out_bar"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 11).alias("in_bar"))
    out = T.edge_means(b, cues, "user_id", "i", ["energy", "vocals"])
    return out.select("user_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("tail_energy", "tail_vocals", "head_energy", "head_vocals")])


CUES = "(p_partkey * 13) % 600 AS beats, (p_partkey * 7) % 500 - 30 AS last, (p_partkey * 3) % 20 - 4 AS first, (p_partkey * 11) % 520 - 60 AS mix_out, (p_partkey * 5) % 90 - 30 AS mix_in, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS section_end"


@PLANS.query(f"""WITH c AS (SELECT p_partkey, {CUES} FROM part), d AS (SELECT *, CASE WHEN last >= 0 THEN last ELSE beats - 1 END AS l FROM c)
SELECT p_partkey, CASE WHEN beats <= 0 THEN 0 ELSE greatest(0, l - CASE WHEN mix_out >= 0 THEN mix_out ELSE greatest(0, l - 64) END) END::INT AS outro_beats,
CASE WHEN beats <= 0 THEN 0 ELSE least(beats, greatest(0, CASE WHEN mix_in >= 0 THEN mix_in ELSE coalesce(section_end, 32) END - greatest(0, first))) END::INT AS intro_beats FROM d""")
def track_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Beats that a track's outro and intro give, with what stands in for unknown cues."""
    c = table(spark, sf, "part").selectExpr("p_partkey", *[x.strip() for x in CUES.split(", ")])
    room = T.rooms(*[F.col(n) for n in ("beats", "last", "first", "mix_out", "mix_in", "section_end")])
    return c.select("p_partkey", room.alias("r")).select("p_partkey", "r.outro_beats", "r.intro_beats")


SECTIONS = f"""{B}, k AS (SELECT user_id, i, i // 9 * 9 AS start, energy AS e, drums AS d, vocals AS v FROM b), g AS (SELECT user_id, start, avg(e) AS energy, avg(d) AS drums, avg(v) AS vocals, max(i) + 1 AS "end", list(e ORDER BY i) AS es FROM k GROUP BY 1, 2),
j AS (SELECT *, row_number() OVER o - 1 AS section, count(*) OVER w AS n, max(energy) OVER w AS most, quantile_cont(energy, 0.75) OVER w AS q, len(es) >= 4 AND list_avg(es[len(es) - len(es) // 4 + 1:]) - list_avg(es[:len(es) // 4]) >= 0.15 AS rises FROM g WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY start)),
l AS (SELECT *, energy >= q AND most > 0 AS top, coalesce(lag(energy) OVER o, energy) AS pe, coalesce(lag(drums) OVER o, drums) AS pd FROM j WINDOW o AS (PARTITION BY user_id ORDER BY start)), m AS (SELECT *, coalesce(lead(top) OVER (PARTITION BY user_id ORDER BY start), false) AS nt FROM l),
sections AS (SELECT user_id, section::INT AS section, start, "end", CASE WHEN section = 0 AND n >= 2 AND (energy < 0.6 * most OR drums < 0.35) THEN 'INTRO' WHEN section = n - 1 AND n >= 2 AND (energy < 0.8 * pe OR energy < 0.6 * most OR (drums < 0.35 AND pd >= 0.35)) THEN 'OUTRO'
WHEN top AND drums >= 0.35 AND section > 0 AND energy - pe >= 0.2 THEN 'DROP' WHEN top THEN 'CHORUS' WHEN section > 0 AND section < n - 1 AND energy < 0.6 * most AND drums < 0.35 THEN 'BREAKDOWN' WHEN nt AND rises THEN 'BUILD' ELSE 'VERSE' END AS label, energy, drums, vocals FROM m)"""


def sections(spark: SparkSession, sf: str) -> DataFrame:
    b = beats(spark, sf)
    bounds = b.filter("i % 9 = 0").select("user_id", F.col("i").alias("start"))
    return T.sections(b, bounds, "user_id", "i", "start", "energy", "drums", "vocals")


@PLANS.query(f"WITH {SECTIONS} SELECT user_id, section, start, \"end\", label, round(energy, 6) AS energy FROM sections")
def section_labels(spark: SparkSession, sf: str) -> DataFrame:
    """L24, E17."""
    return sections(spark, sf).select("user_id", "section", "start", "end", "label", F.round("energy", 6).alias("energy"))


@PLANS.query(f"""WITH {SECTIONS}, f AS (SELECT user_id, first({{'e': energy, 'd': drums, 'v': vocals}} ORDER BY start) AS a, last({{'e': energy, 'd': drums, 'v': vocals}} ORDER BY start) AS z FROM sections GROUP BY 1),
h AS (SELECT user_id, quantile_cont(energy, 0.5) AS body, avg(energy) FILTER (i < 2) AS he, avg(drums) FILTER (i < 2) AS hd FROM b GROUP BY 1), o AS (SELECT user_id, avg(drums) AS td FROM (SELECT *, max(i) OVER (PARTITION BY user_id) AS e FROM b) WHERE i > e - 4 GROUP BY 1), x AS (SELECT *, user_id % 3 = 0 AS voices FROM f JOIN h USING (user_id) JOIN o USING (user_id))
SELECT user_id, CASE WHEN body <= 0 THEN 'UNKNOWN' WHEN user_id % 4 > 1 AND a.e < 0.1 THEN 'SILENCE' WHEN hd >= 0.5 AND he >= 0.7 * body THEN 'COLD_START' WHEN voices AND a.v >= 0.5 AND a.d < 0.35 THEN 'VOCAL_INTRO' WHEN a.d < 0.35 THEN 'AMBIENT_INTRO' WHEN a.e < 0.85 * body THEN 'BEAT_INTRO' ELSE 'UNKNOWN' END AS intro,
CASE WHEN user_id % 7 = 0 THEN 'FADE_OUT' WHEN user_id % 7 = 1 THEN 'HARD_STOP' WHEN body <= 0 THEN 'UNKNOWN' WHEN voices AND z.v >= 0.5 AND z.d < 0.35 THEN 'VOCAL_OUTRO' WHEN z.d < 0.35 OR td < 0.35 THEN 'AMBIENT_OUTRO' WHEN td >= 0.5 THEN 'BEAT_OUTRO' ELSE 'UNKNOWN' END AS outro FROM x""")
def edge_types(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of openings and endings."""
    b, all_ = beats(spark, sf), sections(spark, sf)
    kind = F.struct("energy", "drums", "vocals")
    ends = all_.groupBy("user_id").agg(F.min_by(kind, "start").alias("a"), F.max_by(kind, "start").alias("z"))
    last = b.groupBy("user_id").agg(F.max("i").alias("e"))
    means = b.join(last, "user_id").groupBy("user_id").agg(F.percentile("energy", 0.5).alias("body"), *[F.avg(F.when(F.col("i") < 2, F.col(c))).alias(n) for c, n in (("energy", "he"), ("drums", "hd"))], T.last_mean("i", "drums", "e", 4).alias("td"))
    x, u = ends.join(means, "user_id"), F.col("user_id")
    intro = T.intro_type(F.col("a"), F.col("body"), F.col("he"), F.col("hd"), (u % 4).cast("double"), u % 3 == 0)
    return x.select("user_id", intro.alias("intro"), T.outro_type(F.col("z"), F.col("body"), F.col("td"), u % 7 == 0, u % 7 == 1, u % 3 == 0).alias("outro"))


@PLANS.query(f"""WITH {B}, k AS (SELECT user_id, i // 8 AS k, {', '.join(f'sum({e}) FILTER (i % 2 = {o}) AS {n}{o}' for n, e in (('l', 'low'), ('m', 'mid'), ('w', 'broad'), ('h', 'greatest(0, broad - low - mid)')) for o in (0, 1))} FROM b GROUP BY 1, 2 HAVING count(*) = 8),
a AS (SELECT user_id, sum(CASE WHEN l0 + l1 > 0 THEN least(l0, l1) / greatest(l0, l1) * (l0 + l1) END) / sum(l0 + l1) AS low_balance, sum(CASE WHEN w0 + w1 > 0 THEN least(w0, w1) / greatest(w0, w1) * (w0 + w1) END) / sum(w0 + w1) AS broad_balance,
sum(CASE WHEN l0 >= l1 THEN m1 ELSE m0 END) / sum(CASE WHEN l0 >= l1 THEN m0 ELSE m1 END) AS mid_ratio, sum(CASE WHEN l0 >= l1 THEN h1 ELSE h0 END) / sum(CASE WHEN l0 >= l1 THEN h0 ELSE h1 END) AS high_ratio FROM k GROUP BY 1)
SELECT user_id, round(low_balance, 6) AS low_balance, round(broad_balance, 6) AS broad_balance, round(mid_ratio, 6) AS mid_ratio, round(high_ratio, 6) AS high_ratio, low_balance < 0.35 AND broad_balance < 0.65 AND mid_ratio < 0.5 AND high_ratio < 1 AS halve FROM a""")
def metrical_levels(spark: SparkSession, sf: str) -> DataFrame:
    """L18."""
    out = T.metrical_level(beats(spark, sf), "user_id", "i", "low", "mid", "broad", F.lit(124.0))
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("low_balance", "broad_balance", "mid_ratio", "high_ratio")], "halve")


WIN, HOP, LOW, MOST, SEC = 24, 8, 2, 12, 0.1
_LAGS = f"range(1, {MOST + 1})"


@PLANS.query(f"""WITH {S}, n AS (SELECT user_id, list(x ORDER BY i) AS x FROM s GROUP BY 1 HAVING count(*) >= {WIN}), w AS (SELECT user_id, x[s + 1:s + {WIN}] AS v FROM (SELECT user_id, x, unnest(range(0, len(x) - {WIN} + 1, {HOP})) AS s FROM n)),
c AS (SELECT user_id, list_sum(v) AS g, list_transform(v, lambda z: z - list_avg(v)) AS c FROM w), p AS (SELECT *, list_sum(list_transform(c, lambda z: z * z)) AS p FROM c),
a AS (SELECT user_id, g, k, list_dot_product(c[:{WIN} - k], c[k + 1:]) / ({WIN} - k) / (p / {WIN}) AS a FROM (SELECT *, unnest({_LAGS}) AS k FROM p WHERE p > 1e-12)),
m AS (SELECT user_id, k, greatest(0, sum(g * a) / sum(g)) * exp(-0.5 * (log2(60 / (k * {SEC}) / 120) / 0.9) ^ 2) AS w FROM a GROUP BY 1, 2), l AS (SELECT user_id, list(w ORDER BY k) AS w FROM m GROUP BY 1),
h AS (SELECT user_id, w, list_transform({_LAGS}, lambda k: CASE WHEN k < {LOW} THEN 0 ELSE w[k] + list_sum(list_transform([2, 3, 4], lambda j: CASE WHEN j * k <= {MOST} THEN greatest(0, list_max(w[greatest(1, j * k - 1):least({MOST}, j * k + 1)])) / j ELSE 0 END)) END) AS h FROM l),
q AS (SELECT user_id, w, h, list_sort(list_transform(list_filter(range({LOW}, {MOST + 1}), lambda k: h[k] > 0 AND h[k] >= coalesce(h[k - 1], 0) AND h[k] > coalesce(h[k + 1], 0)), lambda k: {{'n': -h[k], 'k': k}})) AS p FROM h),
o AS (SELECT *, CASE WHEN 60 / (p[1].k * {SEC}) < 70 THEN p[1].k / 2.0 WHEN 60 / (p[1].k * {SEC}) > 180 THEN p[1].k * 2.0 END AS o FROM q WHERE len(p) > 0),
y AS (SELECT *, list_filter(p, lambda z: abs(z.k - o) <= greatest(1.0, 0.04 * o))[1] AS alt FROM o), b AS (SELECT *, CASE WHEN o IS NOT NULL AND 60 / (o * {SEC}) BETWEEN 70 AND 180 AND alt.n <= 0.6 * p[1].n THEN alt ELSE p[1] END AS b FROM y),
r AS (SELECT *, b.k AS k, CASE WHEN b.k >= 2 AND b.k < {MOST} THEN w[b.k - 1] - 2 * w[b.k] + w[b.k + 1] ELSE 0 END AS curve FROM b), z AS (SELECT *, k + CASE WHEN curve < 0 THEN greatest(-0.5, least(0.5, 0.5 * (w[k - 1] - w[k + 1]) / curve)) ELSE 0 END AS lag,
list_filter(p, lambda z: len(list_filter([1.0, 2.0, 0.5, 3.0, 1 / 3, 1.5, 2 / 3], lambda f: abs(z.k - k * f) <= greatest(1.0, 0.05 * k * f))) = 0)[1] AS rival FROM r)
SELECT user_id, round(lag, 5) AS lag, round(60 / (lag * {SEC}), 4) AS bpm, round(greatest(0, least(1, 1 - coalesce(rival.n, 0) / b.n)), 5) AS confidence FROM z""")
def tempo_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Windows autocorrelated, averaged, weighted by the prior, summed over harmonics; half or double where they fit better."""
    out = T.tempo(series(spark, sf), "user_id", "i", "x", WIN, HOP, LOW, MOST, SEC)
    return out.select("user_id", F.round("lag", 5).alias("lag"), F.round("bpm", 4).alias("bpm"), F.round("confidence", 5).alias("confidence"))


TUNED = "t AS (SELECT user_id, 100 + x * 13 AS f, x + 1 AS w FROM s WHERE 100 + x * 13 BETWEEN 100 AND 4000), d AS (SELECT user_id, w, 1200 * log2(f / 440) AS c FROM t), e AS (SELECT user_id, w, c - 100 * round_even(c / 100, 0) AS o FROM d)"


@PLANS.query(f"""WITH {S}, {TUNED}, n AS (SELECT user_id, (floor(CASE WHEN o >= 50 THEN o - 100 ELSE o END + 50)::INT % 100 + 100) % 100 AS b, sum(w) AS w FROM e GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM n), g AS (SELECT u.user_id, r.b::INT AS b, coalesce(n.w, 0) AS w FROM u CROSS JOIN range(100) r(b) LEFT JOIN n ON n.user_id = u.user_id AND n.b = r.b),
h AS (SELECT user_id, list(w ORDER BY b) AS h FROM g GROUP BY 1), m AS (SELECT user_id, h, list_sort(list_transform(range(100), lambda b: {{'n': -round(list_sum(list_transform(range(-5, 6), lambda d: h[(b + d + 100) % 100 + 1] * (6 - abs(d)))), 9), 'b': b}}))[1].b AS best FROM h),
k AS (SELECT user_id, list_sum(list_transform(range(-10, 11), lambda d: h[(best + d + 100) % 100 + 1] * (best + d))) / list_sum(list_transform(range(-10, 11), lambda d: h[(best + d + 100) % 100 + 1])) - 49.5 AS c, list_sum(list_transform(range(-10, 11), lambda d: h[(best + d + 100) % 100 + 1])) / list_sum(h) AS share FROM m)
SELECT user_id, round(CASE WHEN c >= 50 THEN c - 100 WHEN c < -50 THEN c + 100 ELSE c END, 4) AS cents, round(greatest(0, least(1, (share - 0.21) / 0.79)), 5) AS confidence FROM k""")
def tunings(spark: SparkSession, sf: str) -> DataFrame:
    """The tuning of each track from its spectral peaks."""
    peaks = series(spark, sf).select("user_id", (100 + F.col("x") * 13).alias("f"), (F.col("x") + 1).alias("w"))
    return T.tuning(peaks, "user_id", "f", "w").select("user_id", F.round("cents", 4).alias("cents"), F.round("confidence", 5).alias("confidence"))


BINS = "p AS (SELECT user_id, i % 6 AS frame, i // 6 AS bin, 20 + (i * 7919 + user_id) % 19000 AS f, x + 1 AS p FROM s)"


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).selectExpr("user_id", "i % 6 AS frame", "i div 6 AS bin", "20 + (i * 7919 + user_id) % 19000 AS f", "x + 1 AS p")


@PLANS.query(f"WITH {S}, {BINS}, n AS (SELECT user_id, count(DISTINCT frame) AS n FROM p GROUP BY 1), b AS (SELECT user_id, least(30, greatest(0, floor(10 * log10(f / 1000) + 0.5) + 17))::INT AS band, sum(p) AS p FROM p GROUP BY 1, 2) SELECT user_id, band, round(10 * log10(p / n), 5) AS level FROM b JOIN n USING (user_id)")
def band_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels by third-octave band."""
    return T.band_levels(bins(spark, sf), "user_id", "frame", "f", "p").withColumn("level", F.round("level", 5))


@PLANS.query(f"WITH {S}, {BINS}, c AS (SELECT user_id, sum(f * p) / sum(p) AS centroid FROM p GROUP BY 1), t AS (SELECT user_id, bin, quantile_cont(p, 0.5) AS median FROM p GROUP BY 1, 2) SELECT user_id, bin, round(median, 6) AS median, round(centroid, 4) AS centroid FROM t JOIN c USING (user_id)")
def spectral_texture(spark: SparkSession, sf: str) -> DataFrame:
    """Centroid and the median of each bin."""
    b = bins(spark, sf)
    both = T.texture(b, "user_id", "bin", "p").join(T.centroid(b, "user_id", "f", "p"), "user_id")
    return both.select("user_id", "bin", F.round("median", 6).alias("median"), F.round("centroid", 4).alias("centroid"))


PROFILES = "k AS (SELECT t.t AS tonic, m.m AS minor, p.p AS pc, CASE WHEN m.m THEN {minor} ELSE {major} END[(p.p - t.t + 12) % 12 + 1] AS w FROM range(12) t(t), (VALUES (false), (true)) m(m), range(12) p(p))".format(minor=list(R.MINOR), major=list(R.MAJOR)).replace("THEN [", "THEN [").replace("CASE WHEN", "(CASE WHEN").replace("END[", "END)[")
CHROMA = "c AS (SELECT user_id, i % 12 AS pc, CASE WHEN i >= 24 THEN 'b' ELSE 'a' END AS part, x FROM s), w AS (SELECT user_id, pc, sum(x) AS e FROM c GROUP BY 1, 2), g AS (SELECT user_id, pc, sum(x) AS e FROM c WHERE part = 'b' GROUP BY 1, 2)"


@PLANS.query(f"""WITH {S}, {CHROMA}, {PROFILES}, rw AS (SELECT user_id, tonic, minor, corr(e, w.w) AS r FROM (SELECT * FROM w) x JOIN k w USING (pc) GROUP BY 1, 2, 3), rg AS (SELECT user_id, tonic, minor, corr(e, w.w) AS r FROM (SELECT * FROM g) x JOIN k w USING (pc) GROUP BY 1, 2, 3),
bw AS (SELECT user_id, first(tonic ORDER BY r DESC, tonic, minor) AS tonic, first(minor ORDER BY r DESC, tonic, minor) AS minor FROM rw GROUP BY 1), bg AS (SELECT user_id, first(tonic ORDER BY r DESC, tonic, minor) AS tonic, first(minor ORDER BY r DESC, tonic, minor) AS minor, max(r) AS r FROM rg GROUP BY 1)
SELECT user_id, bg.tonic::INT AS tonic, bg.minor AS minor FROM bg JOIN bw USING (user_id) JOIN rg ON rg.user_id = bg.user_id AND rg.tonic = bw.tonic AND rg.minor = bw.minor WHERE (bg.tonic <> bw.tonic OR bg.minor <> bw.minor) AND bg.r - rg.r > 0.1""")
def ending_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key of what follows the first two dozen rows, where it is clearly another."""
    s = series(spark, sf).select("user_id", (F.col("i") % 12).cast("int").alias("pc"), "i", "x")
    whole = s.groupBy("user_id", "pc").agg(F.sum("x").alias("energy"))
    end = s.filter("i >= 24").groupBy("user_id", "pc").agg(F.sum("x").alias("energy"))
    return T.edge_keys(R.key_correlations(whole, "user_id"), R.key_correlations(end, "user_id"), "user_id")


@PLANS.query(f"""WITH {S}, {CHROMA}, {PROFILES}, r AS (SELECT user_id, tonic, minor, corr(e, w.w) AS r FROM (SELECT * FROM w) x JOIN k w USING (pc) GROUP BY 1, 2, 3), l AS (SELECT user_id, list_sort(list({{'n': -r, 't': tonic, 'm': minor}})) AS l FROM r GROUP BY 1)
SELECT user_id, l[1].t::INT AS tonic, l[1].m AS minor, round((1 - l[1].n) / 2, 6) AS strength, round(l[2].n - l[1].n, 6) AS margin FROM l""")
def key_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """The key of each track from its chroma."""
    c = series(spark, sf).groupBy("user_id", (F.col("i") % 12).cast("int").alias("pc")).agg(F.sum("x").alias("energy"))
    return R.key_estimate(c, "user_id").withColumns({"strength": F.round("strength", 6), "margin": F.round("margin", 6)})


@PLANS.query(f"""WITH {S}, f AS (SELECT user_id, 50 + x * 9 AS f, x + 1 AS p FROM s), h AS (SELECT user_id, (floor(12 * log2(f / k / 440.0) + 9.5)::INT % 12 + 12) % 12 AS pc, p / k AS e FROM f, range(1, 5) r(k)), c AS (SELECT user_id, pc, sum(e) AS e FROM h GROUP BY 1, 2)
SELECT user_id, pc, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS energy FROM c""")
def chroma_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pitch classes of spectral peaks, folded over four harmonics."""
    peaks = series(spark, sf).select("user_id", (50 + F.col("x") * 9).alias("f"), (F.col("x") + 1).alias("p"))
    return R.chroma(peaks, "user_id", "f", "p").withColumn("energy", F.round("energy", 6))


@PLANS.query(f"""WITH {B}, p AS (SELECT user_id, i FROM (SELECT user_id, i, x, lag(x) OVER w AS a, lead(x) OVER w AS c FROM b WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE x > a AND x > c AND x > 80), n AS (SELECT user_id, count(*) AS n FROM b GROUP BY 1),
q AS (SELECT user_id, n, floor((i - 1) / 4.0) * 4 + 1 AS a, ceil((i - 1) / 4.0) * 4 + 1 AS z, i FROM p JOIN n USING (user_id)), r AS (SELECT user_id, n, CASE WHEN i - a <= z - i THEN a ELSE z END::BIGINT AS start FROM q) SELECT DISTINCT user_id, start FROM r WHERE start > 0 AND start < n UNION SELECT DISTINCT user_id, 0 FROM r""")
def section_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks snapped to their nearest downbeat."""
    b = beats(spark, sf)
    found = R.peaks(b.select("user_id", "i", "x"), "user_id", "i", "x", 1, -1e9, strict=True).filter("x > 80")
    rows = found.join(b.groupBy("user_id").agg(F.count("*").alias("n"), F.max("i").alias("last")), "user_id").filter("i > 0 and i < last")
    return T.boundaries(rows.select("user_id", "i", "n"), "user_id", "i", F.col("n"), F.lit(1))


@PLANS.query(f"""WITH {B}, l AS (SELECT user_id, sqrt(avg(x * x)) AS rms FROM b GROUP BY 1), d AS (SELECT user_id, count(*) AS beats, max(i) AS last FROM b GROUP BY 1), v AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT d.user_id, beats, last, round(rms, 6) AS rms, clicks FROM d LEFT JOIN l USING (user_id) LEFT JOIN v USING (user_id)""")
def track_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A track's features side by side."""
    b = beats(spark, sf)
    base = b.groupBy("user_id").agg(F.count("*").alias("beats"), F.max("i").alias("last"))
    rms = b.groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"))
    clicks = table(spark, sf, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"))
    return T.summary(base, [rms, clicks], "user_id")


@PLANS.query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, json_object('id', event_id, 'k', CAST(props->>'k' AS BIGINT))::VARCHAR AS json FROM events")
def analysis_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a nested document, read and written."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("json"))
