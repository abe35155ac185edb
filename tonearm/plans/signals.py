"""Series queries: a user's events in order are a series; days and orders stand for grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.operators import series as R
from tonearm.plans.base import Plans, table
from tonearm.streaming import live

PLANS = Plans()
W = "PARTITION BY user_id ORDER BY i"
S = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, ts, event_type, value AS x FROM events)"


def series(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return table(spark, sf, "events").select("user_id", place.alias("i"), "ts", "event_type", F.col("value").alias("x"))


@PLANS.query(f"WITH {S} SELECT user_id, i // 5 AS block, round(sqrt(avg(x * x)), 6) AS rms FROM s GROUP BY 1, 2 HAVING count(*) = 5")
def block_rms(spark: SparkSession, sf: str) -> DataFrame:
    """L1."""
    return R.block_rms(series(spark, sf), "user_id", "i", "x", 5).withColumn("rms", F.round("rms", 6))


@PLANS.query(f"WITH {S}, m AS (SELECT user_id, i, avg(x) OVER w AS mean, count(*) OVER w AS n FROM s WINDOW w AS ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT user_id, i, round(mean, 6) AS mean FROM m WHERE n = 4")
def moving_mean(spark: SparkSession, sf: str) -> DataFrame:
    """E10."""
    return R.moving_mean(series(spark, sf), "user_id", "i", "x", 4).select("user_id", "i", F.round("mean", 6).alias("mean"))


@PLANS.query(f"""WITH {S}, m AS (SELECT user_id, i, min(x) OVER a AS amin, max(x) OVER a AS amax, count(*) OVER a AS an, min(x) OVER b AS bmin, max(x) OVER b AS bmax, count(*) OVER b AS bn FROM s
WINDOW a AS ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT user_id, round(max(CASE WHEN an = 3 AND bn = 3 THEN greatest(0, amin - bmax, bmin - amax) END), 6) AS jump FROM m GROUP BY 1""")
def hold_level_jump(spark: SparkSession, sf: str) -> DataFrame:
    """L3, E11."""
    return R.hold_step(series(spark, sf), "user_id", "i", "x").groupBy("user_id").agg(F.round(F.max("step"), 6).alias("jump"))


@PLANS.query(f"""WITH {S}, h AS (SELECT *, x < 20 AS hit, count(*) OVER (PARTITION BY user_id) AS n FROM s), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM h WHERE hit),
r AS (SELECT user_id, island, count(*) AS length, min(i) AS a, max(i) AS b, max(n) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(length) AS gap FROM r WHERE a > 0 AND b < n - 1 GROUP BY 1""")
def silence_islands(spark: SparkSession, sf: str) -> DataFrame:
    """The longest interior run of low values."""
    return R.silence_gap(series(spark, sf), "user_id", "i", F.col("x") < 20)


@PLANS.query(f"""WITH {S}, m AS (SELECT user_id, i, x, max(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, max(x) OVER (PARTITION BY user_id) AS whole FROM s)
SELECT user_id, i, round(CASE WHEN greatest(near, 0.1 * whole) > 0 THEN x / greatest(near, 0.1 * whole) ELSE 0 END, 6) AS scaled FROM m""")
def running_max(spark: SparkSession, sf: str) -> DataFrame:
    """E9, L15."""
    return R.running_max(series(spark, sf), "user_id", "i", "x", 5).select("user_id", "i", F.round("scaled", 6).alias("scaled"))


@PLANS.query(f"WITH {S} SELECT user_id, i, round(x - lag(x) OVER w, 6) AS d1, round(lag(x, 5) OVER w - 2 * x + lead(x, 5) OVER w, 6) AS d2 FROM s WINDOW w AS ({W})")
def differences(spark: SparkSession, sf: str) -> DataFrame:
    """E13, L7."""
    return R.differences(series(spark, sf), "user_id", "i", "x").select("user_id", "i", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@PLANS.query(f"WITH {S} SELECT user_id, i, round(sum(x * x) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS energy FROM s")
def prefix_energy(spark: SparkSession, sf: str) -> DataFrame:
    """E14."""
    return R.prefix_energy(series(spark, sf), "user_id", "i", "x").select("user_id", "i", F.round("energy", 6).alias("energy"))


@PLANS.query(f"WITH {S}, a AS (SELECT user_id, x, avg(x) OVER (PARTITION BY user_id) AS m FROM s WHERE x > 10) SELECT user_id, round(avg(x) + 1e-9, 6) AS loudness, count(*) AS blocks FROM a WHERE x > m * 0.1 GROUP BY 1")
def loudness_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Two gates, two passes."""
    return R.gated_loudness(series(spark, sf), "user_id", "x", 10.0, 0.1).withColumn("loudness", F.round(F.col("loudness") + 1e-9, 6))


@PLANS.query(f"""WITH {S}, a AS (SELECT user_id, x, avg(x) OVER (PARTITION BY user_id) AS m FROM s), v AS (SELECT user_id, list(x ORDER BY x) AS v FROM a WHERE x >= m - 20 GROUP BY 1)
SELECT user_id, round(v[floor(0.95 * (len(v) - 1) + 0.5)::INT + 1] - v[floor(0.1 * (len(v) - 1) + 0.5)::INT + 1], 6) AS range FROM v""")
def loudness_range(spark: SparkSession, sf: str) -> DataFrame:
    """L10."""
    return R.loudness_range(series(spark, sf), "user_id", "i", "x").withColumn("range", F.round("range", 6))


@PLANS.query(f"WITH {S}, e AS (SELECT *, max(i) OVER (PARTITION BY user_id) AS e FROM s) SELECT user_id, round(regr_slope(x, i), 6) AS slope, round(max(x) - min(x), 6) AS range, count(*) AS n FROM e WHERE i > e - 12 GROUP BY 1")
def fade_slope(spark: SparkSession, sf: str) -> DataFrame:
    """L13."""
    return R.fade(series(spark, sf), "user_id", "i", "x", 12).withColumn("slope", F.round("slope", 6)).withColumn("range", F.round("range", 6))


@PLANS.query(f"WITH {S}, n AS (SELECT user_id, max(i) + 1 AS n FROM s GROUP BY 1) SELECT user_id, floor(i * 8 / n)::INT AS bin, min(x) AS low, max(x) AS high FROM s JOIN n USING (user_id) GROUP BY 1, 2")
def display_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """L14."""
    return R.min_max_bins(series(spark, sf), "user_id", "i", "x", 8)


@PLANS.query(f"""WITH {S}, m AS (SELECT user_id, (i % 4)::INT AS phase, avg(x) AS m FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, phase) AS p FROM m)
SELECT user_id, max(phase) FILTER (p = 1) AS phase, round(coalesce(max(m) FILTER (p = 1) - max(m) FILTER (p = 2), 0), 6) AS margin FROM r GROUP BY 1""")
def downbeat_phase(spark: SparkSession, sf: str) -> DataFrame:
    """L17."""
    return R.phase(series(spark, sf), "user_id", "i", "x", 4).withColumn("margin", F.round("margin", 6))


@PLANS.query(f"WITH {S} SELECT user_id, round(regr_slope(x, i), 6) AS slope, round(regr_intercept(x, i), 6) AS start FROM s GROUP BY 1")
def grid_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares from sums."""
    return R.line_fit(series(spark, sf), "user_id", "i", "x").select("user_id", F.round("slope", 6).alias("slope"), F.round("start", 6).alias("start"))


#: Beats of every user's series: half a second apart but for jitter, stray beats, and for some a slower second part; support by arithmetic.
BEATS = {
    "x": "0.3 + 0.5 * i + (i * 37 + user_id) % 11 / 4000.0 + CASE WHEN (i + user_id) % 13 = 3 THEN 0.17 ELSE 0 END + CASE WHEN user_id % 5 = 0 AND i > 20 THEN 0.04 * (i - 20) ELSE 0 END",
    "support": "CASE WHEN (i + user_id) % 13 = 3 OR (user_id % 4 = 1 AND i < 6) THEN 0.03 ELSE 0.3 + (i * 7 + user_id) % 10 / 16.0 END",
}


def _robust_sql() -> str:
    w = "0.05"
    sql = f"""WITH {S}, b AS (SELECT user_id, i, ({BEATS['x']})::DOUBLE AS x, ({BEATS['support']})::DOUBLE + {w} AS w FROM s), r0 AS (SELECT *, w - {w} >= 0.25 AS strong, i - sum((w - {w} >= 0.25)::INT) OVER ({W}) AS run FROM b),
r1 AS (SELECT user_id, run, min(i) AS lo, max(i) AS hi, round(sum(w), 9) AS sw FROM r0 WHERE strong GROUP BY 1, 2 HAVING count(*) >= 8), r2 AS (SELECT user_id, first(lo ORDER BY sw DESC, lo) AS lo, first(hi ORDER BY sw DESC, lo) AS hi FROM r1 GROUP BY 1),
f0 AS (SELECT b.user_id, i, x, w, sum(w) OVER (PARTITION BY b.user_id) AS total, lo IS NULL OR i BETWEEN lo AND hi AS inside, NULL::DOUBLE AS period, NULL::DOUBLE AS start, NULL::DOUBLE AS residual, NULL::DOUBLE AS onw FROM b LEFT JOIN r2 ON r2.user_id = b.user_id)"""
    p = "PARTITION BY user_id"
    for k in range(4):
        last = k == 3
        sql += f""",
a{k} AS (SELECT *, sum(w) FILTER (inside) OVER ({p}) AS sw, sum(w * i) FILTER (inside) OVER ({p}) AS sk, sum(w * x) FILTER (inside) OVER ({p}) AS st, sum(w * i * i) FILTER (inside) OVER ({p}) AS skk, sum(w * i * x) FILTER (inside) OVER ({p}) AS skt, count(*) FILTER (inside) OVER ({p}) AS n FROM f{k}),
c{k} AS (SELECT *, n >= 2 AND sw * skk - sk * sk > 1e-12 AS fits FROM a{k}), d{k} AS (SELECT * REPLACE (CASE WHEN fits THEN (sw * skt - sk * st) / (sw * skk - sk * sk) ELSE period END AS period) FROM c{k}),
e{k} AS (SELECT * REPLACE (CASE WHEN fits THEN (st - period * sk) / sw ELSE start END AS start) FROM d{k}), g{k} AS (SELECT *, abs(x - (start + period * i)) AS res FROM e{k}),
h{k} AS (SELECT * REPLACE (CASE WHEN fits THEN sqrt(sum(w * res * res) FILTER (inside) OVER ({p}) / sw) * 1000 ELSE residual END AS residual, CASE WHEN fits THEN sw ELSE onw END AS onw), sum(w) OVER ({p} ORDER BY res, i ROWS UNBOUNDED PRECEDING) AS acc FROM g{k}),
f{k + 1} AS (SELECT user_id, i, x, w, total, {'inside' if last else f"CASE WHEN fits THEN res <= greatest(3 * 1.4826 * min(res) FILTER (acc >= total / 2) OVER ({p}), 0.006) ELSE inside END AS inside"}, period, start, residual, onw FROM h{k})"""
    return sql + """, z AS (SELECT DISTINCT user_id, period, start, residual, coalesce(onw / total, 0) AS share FROM f4), y AS (SELECT user_id, period, start, residual, share, coalesce(period > 0 AND residual < 8 AND share >= 0.7, false) AS rigid FROM (SELECT user_id, min(period) AS period, min(start) AS start, min(residual) AS residual, min(share) AS share FROM z GROUP BY 1))
SELECT user_id, CASE WHEN rigid THEN 'RIGID' ELSE 'FLEX' END AS kind, round(period, 6) AS period, round(start, 6) AS start, round(residual, 4) AS residual_ms, round(share, 6) AS share, CASE WHEN rigid THEN round(60 / period, 4) END AS bpm FROM y"""


@PLANS.query(_robust_sql())
def robust_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Rigid or flexible grids of every user's beats, robust against stray beats and weak openings."""
    beats = series(spark, sf).select("user_id", "i", *[F.expr(e).cast("double").alias(n) for n, e in BEATS.items()])
    out = R.robust_fit(beats, "user_id", "i", "x", "support")
    return out.select("user_id", "kind", *[F.round(c, n).alias(c) for c, n in (("period", 6), ("start", 6), ("residual_ms", 4), ("share", 6), ("bpm", 4))])


@PLANS.query(f"WITH {S}, d AS (SELECT *, x - lag(x) OVER ({W}) AS jump FROM s) SELECT user_id, first(i ORDER BY jump DESC, i) AS at, round(max(jump), 6) AS jump FROM d WHERE jump > 0 GROUP BY 1")
def largest_jump(spark: SparkSession, sf: str) -> DataFrame:
    """E19, L25."""
    return R.largest_jump(series(spark, sf), "user_id", "i", "x").withColumn("jump", F.round("jump", 6))


@PLANS.query(f"WITH {S} SELECT user_id, min(i) FILTER (x > 50) AS first, max(i) FILTER (x > 50) AS last FROM s GROUP BY 1")
def mix_cues(spark: SparkSession, sf: str) -> DataFrame:
    """E18, L25."""
    return R.first_last(series(spark, sf), "user_id", "i", F.col("x") > 50)


@PLANS.query(f"WITH {S}, z AS (SELECT user_id, i, x, avg(x) OVER p AS m, stddev_pop(x) OVER p AS d FROM s WINDOW p AS (PARTITION BY user_id)) SELECT user_id, i, round(CASE WHEN d > 0 THEN (x - m) / d ELSE 0 END, 6) AS x_z FROM z")
def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    """L21."""
    return R.z_scored(series(spark, sf), "user_id", ["x"]).select("user_id", "i", F.round("x_z", 6).alias("x_z"))


@PLANS.query(f"WITH {S}, t AS (SELECT user_id, i, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM s WINDOW w AS ({W})) SELECT user_id, i, CASE WHEN a IS NULL OR b IS NULL THEN x ELSE list_sort([a, x, b])[2] END AS smooth FROM t")
def median_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """E20."""
    return R.smoothed(series(spark, sf), "user_id", "i", "x").select("user_id", "i", "smooth")


@PLANS.query(f"""WITH {S}, m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY user_id) AS m FROM s), d AS (SELECT *, quantile_cont(abs(x - m), 0.5) OVER (PARTITION BY user_id) AS d FROM m)
SELECT user_id, i, x FROM d WHERE abs(x - m) <= 1.5 * 1.4826 * d""")
def without_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """E21."""
    return R.without_outliers(series(spark, sf), "user_id", "x", 1.5).select("user_id", "i", "x")


@PLANS.query(f"WITH {S}, l AS (SELECT user_id, x, " + ", ".join(f"lead(x, {n}) OVER ({W}) AS l{n}" for n in (1, 2, 3, 4)) + " FROM s) " + " UNION ALL ".join(f"SELECT user_id, {n} AS lag, round(avg(x * l{n}), 5) AS r FROM l GROUP BY 1" for n in (1, 2, 3, 4)))
def tempogram(spark: SparkSession, sf: str) -> DataFrame:
    """The autocorrelation that tempo is read from."""
    return R.autocorrelation(series(spark, sf), "user_id", "i", "x", [1, 2, 3, 4]).withColumn("r", F.round("r", 5))


GRID = "g AS (SELECT DISTINCT user_id, epoch_us(date_trunc('day', ts)) AS t, extract(day FROM ts) AS b FROM events WHERE event_type = 'view')"


@PLANS.query(f"""WITH {GRID}, gg AS (SELECT *, lead(t) OVER w AS t1, lead(b) OVER w AS b1, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)),
p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'view'), s AS (SELECT *, CASE WHEN n = 1 THEN -1e30 ELSE t::DOUBLE END AS lo, CASE WHEN n = c - 1 THEN 1e30 ELSE t1::DOUBLE END AS hi FROM gg WHERE t1 IS NOT NULL)
SELECT p.event_id, round(CASE WHEN o.user_id IS NOT NULL THEN o.b WHEN s.user_id IS NOT NULL THEN s.b + (p.t - s.t) / (s.t1 - s.t)::DOUBLE * (s.b1 - s.b) END, 6)::DOUBLE AS beat
FROM p LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.lo AND p.t < s.hi LEFT JOIN (SELECT * FROM gg WHERE c = 1) o ON o.user_id = p.user_id""")
def asof_beat(spark: SparkSession, sf: str) -> DataFrame:
    """The day number at each event, between the days on which its user viewed something."""
    events = table(spark, sf, "events")
    grid = events.filter("event_type = 'view'").select("user_id", F.unix_micros(F.date_trunc("day", "ts").cast("timestamp_ltz")).alias("t"), F.dayofmonth("ts").alias("b")).distinct()
    points = events.filter("event_type <> 'view'").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("t"))
    return R.as_of(points, grid, "user_id", "t", "t", "b").select("event_id", F.round("beat", 6).alias("beat"))


@PLANS.query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), e AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'error')
SELECT event_id, round(first(e.t - c.t ORDER BY abs(e.t - c.t), e.t), 3)::DOUBLE AS off FROM c LEFT JOIN e ON c.user_id = e.user_id AND abs(e.t - c.t) <= 36000 GROUP BY 1""")
def nearest_error(spark: SparkSession, sf: str) -> DataFrame:
    """For each click the nearest error of its user within ten hours; buckets as wide as the tolerance."""
    events = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 1e6)
    errors = events.filter("event_type = 'error'").select("user_id", "t")
    near = R.nearest_within(events.filter("event_type = 'click'").select("event_id", "user_id", "t"), errors, "user_id", "t", "t", 36000.0)
    return near.select("event_id", F.round(F.col("nearest") - F.col("t"), 3).alias("off"))


@PLANS.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM n GROUP BY user_id, s""")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """M4: bursts ended by six hours of quiet; the stream runs the same function."""
    return live.sessions(table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", "6 hours")


T = "t AS (SELECT user_id AS u, ts AS s, ts + INTERVAL 10 MINUTES AS e, event_id AS a FROM events WHERE event_type = 'view'), k AS (SELECT user_id, ts AS skipped_at, event_id AS skip FROM events WHERE event_type = 'click')"


@PLANS.query(f"WITH {T} SELECT a, skip, CASE WHEN skipped_at <= e THEN 'DURING' ELSE 'JUST_AFTER' END AS kind FROM t JOIN k ON user_id = u AND skipped_at >= s AND skipped_at <= e + INTERVAL 2 HOURS")
def skip_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """M8, M6: clicks during a view's ten minutes, or up to two hours after; the stream runs the same join with watermarks."""
    events = table(spark, sf, "events")
    views = events.filter("event_type = 'view'").select(F.col("user_id").alias("user"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("end"), F.col("event_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit("view").alias("strategy"))
    clicks = events.filter("event_type = 'click'").select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("skip"))
    return live.attributed_skips(views, clicks, "2 HOURS").select("a", "skip", "kind")


@PLANS.query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def reports_once(spark: SparkSession, sf: str) -> DataFrame:
    """M9: one report for each key."""
    return live.once(table(spark, sf, "events"), ["user_id", "event_type"], "ts")


@PLANS.query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """M7, A19."""
    return live.pruned(table(spark, sf, "events").select("event_id", "ts"), "ts", "7 DAYS")


@PLANS.query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def live_counts(spark: SparkSession, sf: str) -> DataFrame:
    """M1: the batch twin of the running counts."""
    return live.live_counts(table(spark, sf, "events"), ["event_type"])


@PLANS.query("SELECT 'error' AS view, first(event_id::VARCHAR ORDER BY ts DESC, event_id::VARCHAR DESC) AS value, max(ts) AS ts FROM events WHERE event_type = 'error' UNION ALL SELECT 'user', first(user_id::VARCHAR ORDER BY ts DESC, user_id::VARCHAR DESC), max(ts) FROM events")
def combined_views(spark: SparkSession, sf: str) -> DataFrame:
    """M2: the latest of two live views; the stream runs the same function."""
    events = table(spark, sf, "events")
    return live.combined({"error": (events.filter("event_type = 'error'"), "event_id", "ts"), "user": (events, "user_id", "ts")})


@PLANS.query("""WITH r AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY 1), k AS (SELECT e.*, event_type = 'click' AS soft FROM events e LEFT JOIN r USING (user_id) WHERE event_type <> 'signup' AND (last IS NULL OR ts > last)),
t AS (SELECT user_id, count(*) FILTER (NOT soft) AS n, coalesce(sum(value / 200) FILTER (NOT soft), 0) AS s, count(*) FILTER (soft) AS m, coalesce(sum(value / 200) FILTER (soft), 0) AS q FROM k GROUP BY 1)
SELECT user_id, n, m AS implicit_n, round(greatest(0.5, least(1.5, 0.5 + (2 + s + CASE WHEN m = 0 THEN 0 ELSE q * least(0.25 * m, 2) / m END) / (4 + n + least(0.25 * m, 2)))), 6)::DOUBLE AS multiplier FROM t""")
def reset_multipliers(spark: SparkSession, sf: str) -> DataFrame:
    """Multipliers since each user's last reset; the stream keeps tallies that a reset clears."""
    rows = table(spark, sf, "events").select("user_id", "ts", (F.col("value") / 200).alias("rating"), (F.col("event_type") == "click").alias("implicit"), (F.col("event_type") == "signup").alias("reset"))
    out = live.running_multipliers(rows, ["user_id"], "rating", "implicit", F.col("reset"), "ts")
    return out.select("user_id", "n", "implicit_n", F.round("multiplier", 6).alias("multiplier"))


RUNS = "SELECT user_id, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE {}) GROUP BY user_id, g"


@PLANS.query(f"""WITH {S}, m AS (SELECT user_id, i, min(x) OVER a AS amin, max(x) OVER a AS amax, count(*) OVER a AS an, min(x) OVER b AS bmin, max(x) OVER b AS bmax, count(*) OVER b AS bn FROM s
WINDOW a AS ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), j AS (SELECT user_id, i, greatest(0, amin - bmax, bmin - amax) AS v FROM m WHERE an = 3 AND bn = 3),
e AS (SELECT user_id, max(i) AS e FROM s GROUP BY 1)
SELECT user_id, 'level_jump' AS kind, i AS start, 1::BIGINT AS length, v AS value FROM j WHERE v > 30 UNION ALL SELECT user_id, 'clip', a, n, 150.0::DOUBLE FROM ({RUNS.format('x >= 150')})
UNION ALL SELECT user_id, 'silence', a, n, 5.0::DOUBLE FROM ({RUNS.format('x <= 5')}) JOIN e USING (user_id) WHERE a > 0 AND b < e""")
def artifact_events(spark: SparkSession, sf: str) -> DataFrame:
    """Jumps, clipped runs and silent gaps with their places."""
    return R.artifact_events(series(spark, sf), "user_id", "i", "x", 30.0, 5.0, 150.0)


@PLANS.query(f"""WITH RECURSIVE {S}, t AS (SELECT user_id, i, x, coalesce(lag(x) OVER w, -1e300) AS a, coalesce(lead(x) OVER w, -1e300) AS b, avg(x) OVER n AS m, coalesce(stddev_pop(x) OVER n, 0) AS d FROM s
WINDOW w AS ({W}), n AS ({W} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)), c AS (SELECT user_id, i, x, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, i) AS n FROM t WHERE x >= a AND x > b AND x > m + d),
r AS (SELECT user_id, 1::BIGINT AS n, [i] AS taken FROM c WHERE n = 1 UNION ALL
SELECT c.user_id, c.n, CASE WHEN len(list_filter(taken, lambda t: abs(t - c.i) < 3)) = 0 THEN list_append(taken, c.i) ELSE taken END FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1),
l AS (SELECT user_id, unnest(last(taken ORDER BY n)) AS i FROM r GROUP BY user_id) SELECT s.user_id, s.i, s.x FROM l JOIN s ON s.user_id = l.user_id AND s.i = l.i""")
def onset_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks at least three places apart."""
    return R.peaks(series(spark, sf).select("user_id", "i", "x"), "user_id", "i", "x", 8, 1.0, 3)


@PLANS.query(f"""WITH RECURSIVE {S}, v AS (SELECT user_id, list(x ORDER BY i) AS x FROM s GROUP BY 1),
r AS (SELECT user_id, x, 0 AS t, [x[1]] AS score, [-1] AS back FROM v UNION ALL
SELECT user_id, x, t + 1, list_append(score, x[t + 2] + CASE WHEN b.v > 0 THEN b.v ELSE 0 END), list_append(back, CASE WHEN b.v > 0 THEN b.p ELSE -1 END)
FROM (SELECT *, list_sort(list_transform(range(greatest(0, t - 7), greatest(0, t)), lambda p: {{'n': -(score[p + 1] - 100 * ln((t + 1 - p) / 4.0) ^ 2), 'p': p}}))[1] AS f FROM r WHERE t + 1 < len(x)), LATERAL (SELECT coalesce(-f.n, 0) AS v, f.p::INT AS p) b),
d AS (SELECT user_id, score, back FROM r WHERE t + 1 = len(x)), e AS (SELECT user_id, back, list_position(score, list_max(score)) - 1 AS t, 0 AS k FROM d UNION ALL SELECT user_id, back, back[t + 1], k + 1 FROM e WHERE back[t + 1] >= 0)
SELECT user_id, max(k) OVER (PARTITION BY user_id) - k AS beat, t::BIGINT AS i FROM e""")
def tracked_beats(spark: SparkSession, sf: str) -> DataFrame:
    """L20."""
    return R.tracked_beats(series(spark, sf).select("user_id", "i", "x"), "user_id", "i", "x", 4.0)


@PLANS.query("""WITH RECURSIVE c AS (SELECT user_id, list(epoch_us(ts) / 1e6 ORDER BY ts) AS c FROM events WHERE event_type = 'click' GROUP BY 1), e AS (SELECT user_id, list(epoch_us(ts) / 1e6 ORDER BY ts) AS e FROM events WHERE event_type = 'error' GROUP BY 1),
b AS (SELECT user_id, coalesce(c, []) AS c, coalesce(e, []) AS e FROM c FULL JOIN e USING (user_id)), r AS (SELECT user_id, c, e, 0 AS k, e AS free FROM b UNION ALL
SELECT user_id, c, e, k + 1, CASE WHEN f IS NULL THEN free ELSE free[:f.p - 1] || free[f.p + 1:] END FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(free) + 1), lambda p: {'d': abs(free[p] - c[k + 1]), 'p': p}), lambda x: x.d <= 36000))[1] AS f FROM r WHERE k < len(c))),
h AS (SELECT user_id, len(e) - len(free) AS hits, len(c) AS n, len(e) AS m FROM r WHERE k = len(c)), q AS (SELECT user_id, hits, CASE WHEN m > 0 THEN hits / m ELSE 0 END AS p, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS r FROM h)
SELECT user_id, hits, p::DOUBLE AS precision, r::DOUBLE AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f FROM q""")
def matched_onsets(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks matched one-to-one with errors within ten hours, user by user."""
    events = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 1e6)
    return R.matched_within(events.filter("event_type = 'click'"), events.filter("event_type = 'error'"), "user_id", "t", 36000.0)


@PLANS.query(f"""WITH {S}, d AS (SELECT user_id, i, x, coalesce(x - lag(x) OVER ({W}), 0) AS d FROM s), z AS (SELECT user_id, i, (x - avg(x) OVER p) / stddev_pop(x) OVER p AS a, (d - avg(d) OVER p) / stddev_pop(d) OVER p AS b FROM d WINDOW p AS (PARTITION BY user_id)),
u AS (SELECT user_id, i, coalesce(a / nullif(sqrt(a * a + b * b), 0), 0) AS a, coalesce(b / nullif(sqrt(a * a + b * b), 0), 0) AS b FROM z),
k AS (SELECT c.user_id, c.i, CASE WHEN (p.i < c.i) = (q.i < c.i) THEN 1 ELSE -1 END * (p.a * q.a + p.b * q.b) AS v FROM u c JOIN u p ON p.user_id = c.user_id AND p.i >= c.i - 4 AND p.i < c.i + 4 JOIN u q ON q.user_id = c.user_id AND q.i >= c.i - 4 AND q.i < c.i + 4)
SELECT user_id, i, round(sum(v) / 64, 6) AS novelty FROM k GROUP BY 1, 2""")
def structure_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """From the sums on either side; the twin builds the kernel pair by pair."""
    wide = R.z_scored(R.differences(series(spark, sf), "user_id", "i", "x").na.fill(0.0, ["d1"]), "user_id", ["x", "d1"])
    return R.novelty(wide, "user_id", "i", ["x_z", "d1_z"], 4).withColumn("novelty", F.round("novelty", 6))
