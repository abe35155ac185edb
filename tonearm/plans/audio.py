"""Queries on the quality of signals: a user's events in order stand for a track's samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.operators import artifacts as A
from tonearm.operators.series import differences
from tonearm.plans.base import Plans
from tonearm.plans.signals import S, W, series

PLANS = Plans()
#: A second channel, and a signal with silence at both ends: the first and last tenth of a user's events, and gaps.
SIDE = "(i * 37 % 100) / 50.0 - 1"
QUIET = "CASE WHEN i < 4 OR i % 23 IN (20, 21) OR i >= n - 3 THEN 0.0004 WHEN i % 11 = 5 THEN 0.0015 ELSE x / 200 * (1 - i / (1.2 * n)) END"
Q = f"{S}, q AS (SELECT user_id, i, {QUIET} AS y FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s))"


def quiet(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf).filter("user_id is not null").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return s.select("user_id", "i", F.expr(QUIET).cast("double").alias("y"))


BLOCKS = "b AS (SELECT user_id, i // 2 AS block, avg(y * y) AS p, count(*) AS n FROM q GROUP BY 1, 2), l AS (SELECT user_id, block, n, CASE WHEN p > 0 THEN greatest(20 * log10(sqrt(p)), -120) ELSE -120 END AS l FROM b)"
TRIMS = f"""{BLOCKS}, f AS (SELECT *, min(block) FILTER (l >= -60) OVER (PARTITION BY user_id) AS first FROM l), g AS (SELECT *, min(block) FILTER (block > first AND l < -60) OVER (PARTITION BY user_id) AS fall FROM f),
o AS (SELECT *, coalesce(CASE WHEN fall IS NULL OR block < fall THEN block >= first ELSE last_value(CASE WHEN l >= -54 THEN true WHEN l < -60 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY block ROWS UNBOUNDED PRECEDING) END, false) AS sound FROM g),
u AS (SELECT user_id, block, block - row_number() OVER (PARTITION BY user_id ORDER BY block) AS island FROM o WHERE sound), r AS (SELECT user_id, min(block) AS a, max(block) AS b FROM u GROUP BY user_id, island HAVING count(*) >= 2),
e AS (SELECT user_id, min(a) AS a, max(b) AS b FROM r GROUP BY 1), t AS (SELECT user_id, coalesce(a * 2, 0) AS trim_start, CASE WHEN a IS NULL THEN 0 ELSE least((b + 1) * 2, n) END::BIGINT AS trim_end, a IS NULL AS silent FROM (SELECT user_id, sum(n) AS n FROM l GROUP BY 1) LEFT JOIN e USING (user_id))"""


def trims(spark: SparkSession, sf: str) -> DataFrame:
    return A.trimmed(quiet(spark, sf), "user_id", "i", "y", 2, 2)


@PLANS.query(f"WITH {Q}, {TRIMS} SELECT * FROM t")
def silence_trims(spark: SparkSession, sf: str) -> DataFrame:
    """L11."""
    return trims(spark, sf)


@PLANS.query(f"""WITH {Q}, {TRIMS}, h AS (SELECT user_id, (trim_end - 1 - i) // 4 AS b, avg(y * y) AS p, count(*) AS n FROM q JOIN t USING (user_id) WHERE NOT silent AND i >= greatest(trim_start, trim_end - 24) AND i < trim_end GROUP BY 1, 2),
k AS (SELECT user_id, max(p) FILTER (b = 0) AS e, list(p ORDER BY p) FILTER (b > 0 AND n = 4) AS r FROM h GROUP BY 1), d AS (SELECT user_id, CASE WHEN len(r) > 0 AND e > 0 AND r[len(r) // 2 + 1] > 0 THEN 10 * log10(e / r[len(r) // 2 + 1]) END AS d FROM k)
SELECT user_id, round(d, 6) AS end_delta_db, coalesce(d >= -8, false) AS hard_stop FROM d""")
def hard_stops(spark: SparkSession, sf: str) -> DataFrame:
    """L12."""
    out = A.hard_stops(quiet(spark, sf), trims(spark, sf), "user_id", "i", "y", 4, 20)
    return out.withColumn("end_delta_db", F.round("end_delta_db", 6))


@PLANS.query(f"""WITH {Q}, {TRIMS}, h AS (SELECT user_id, greatest(trim_start, trim_end - 48) AS a, trim_end AS z FROM t WHERE NOT silent), k AS (SELECT h.*, unnest(range(0, greatest(0, (z - a - 8) // 2 + 1))) AS k FROM h WHERE z - a >= 8),
c AS (SELECT k.user_id, a, k, greatest(CASE WHEN avg(y * y) > 0 THEN greatest(20 * log10(sqrt(avg(y * y))), -120) ELSE -120 END, -80) AS l FROM k JOIN q ON q.user_id = k.user_id AND q.i >= a + 2 * k AND q.i < a + 2 * k + 8 GROUP BY 1, 2, 3),
m AS (SELECT user_id, any_value(a) AS a, count(*) AS points, regr_slope(l, k * 0.2) AS slope, max(l) AS top, min(l) AS low, first(k ORDER BY l DESC, k) AS peak FROM c GROUP BY 1),
n AS (SELECT user_id, max(k) AS last FROM c JOIN m USING (user_id) WHERE k >= peak AND l >= top - 3 GROUP BY 1), faded AS (SELECT *, coalesce(points >= 5 AND slope < -1.5 AND top - low > 10, false) AS fade FROM m JOIN n USING (user_id))
SELECT user_id, round(CASE WHEN points >= 5 THEN coalesce(slope, 0) ELSE 0 END, 5) AS slope, round(CASE WHEN points >= 5 THEN top - low ELSE 0 END, 5) AS range, fade AS fade_out, CASE WHEN fade THEN a + 2 * last + 4 ELSE -1 END::BIGINT AS fade_start FROM faded""")
def fade_outs(spark: SparkSession, sf: str) -> DataFrame:
    """Slope, range and where the fade begins."""
    out = A.fade_outs(quiet(spark, sf), trims(spark, sf), "user_id", "i", "y", 10, 48, 8, 2)
    return out.withColumn("slope", F.round("slope", 5)).withColumn("range", F.round("range", 5))


@PLANS.query(f"""WITH RECURSIVE {S}, d AS (SELECT user_id, i, coalesce(x - lag(x) OVER ({W}), 0) AS d FROM s), b AS (SELECT user_id, i // 2 AS k, max(abs(d)) AS step, sqrt(avg(d * d)) AS rms, count(*) AS n FROM d GROUP BY 1, 2),
a AS (SELECT *, sum(rms * rms * n) OVER w - rms * rms * n AS e, sum(n) OVER w - n AS m FROM b WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
c AS (SELECT user_id, k, step FROM a WHERE n = 2 AND step >= 20 AND NOT (m > 0 AND greatest(e, 0) > 0 AND step < 1.5 * sqrt(greatest(e, 0) / m))),
r AS (SELECT user_id, min(k) AS k FROM c GROUP BY 1 UNION ALL SELECT c.user_id, min(c.k) FROM r JOIN c ON c.user_id = r.user_id AND c.k >= r.k + 3 GROUP BY 1) SELECT user_id, count(*) AS clicks, round(max(step), 6) AS worst FROM r JOIN c USING (user_id, k) GROUP BY 1""")
def click_counts(spark: SparkSession, sf: str) -> DataFrame:
    """L2, E12, E22."""
    d = differences(series(spark, sf), "user_id", "i", "x").na.fill(0.0, ["d1"])
    found = A.clicks(d, "user_id", "i", "d1", 2, 4, 1.5, 20.0)
    return found.groupBy("user_id").agg(F.count("*").alias("clicks"), F.round(F.max("step"), 6).alias("worst"))


@PLANS.query(f"""WITH {S}, c AS (SELECT user_id, x / 100 - 0.5 AS a, {SIDE} AS b FROM s), m AS (SELECT user_id, count(*) FILTER (abs(a) >= 1) + count(*) FILTER (abs(b) >= 1) AS clipped, 0::BIGINT AS not_finite, greatest(abs(avg(a)), abs(avg(b))) AS dc FROM c GROUP BY 1)
SELECT user_id, clipped, not_finite, round(CASE WHEN dc > 0 THEN greatest(20 * log10(dc), -120) ELSE -120 END, 5) AS dc_offset_db FROM m""")
def signal_health(spark: SparkSession, sf: str) -> DataFrame:
    """L4; samples that are no number are in the tests."""
    c = series(spark, sf).select("user_id", (F.col("x") / 100 - 0.5).alias("a"), F.expr(SIDE).cast("double").alias("b"))
    return A.health(c, "user_id", ["a", "b"]).withColumn("dc_offset_db", F.round("dc_offset_db", 5))


@PLANS.query(f"""WITH {S}, c AS (SELECT user_id, i, x / 100 - 0.5 AS a, {SIDE} AS b FROM s), k AS (SELECT c.*, unnest([i // 4, i // 4 - 1]) AS w FROM c), m AS (SELECT user_id, w, sum(a * b) AS xy, sum(a * a) AS xx, sum(b * b) AS yy FROM k WHERE w >= 0 GROUP BY 1, 2 HAVING count(*) = 8)
SELECT user_id, round(least(1, min(CASE WHEN xx <= 0 AND yy <= 0 THEN 1 WHEN xx <= 0 OR yy <= 0 THEN 0 ELSE xy / sqrt(xx * yy) END)), 6)::DOUBLE AS correlation FROM m WHERE sqrt((xx + yy) / 16) > 0.001 GROUP BY 1""")
def stereo_minimum(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of eight samples that overlap by half."""
    c = series(spark, sf).select("user_id", "i", (F.col("x") / 100 - 0.5).alias("a"), F.expr(SIDE).cast("double").alias("b"))
    return A.stereo_minimum(c, "user_id", "i", "a", "b", 8).withColumn("correlation", F.round("correlation", 6))


@PLANS.query(f"""WITH {S}, e AS (SELECT user_id, max(i) AS e FROM s GROUP BY 1), p AS (SELECT user_id, e - i AS back, x AS b, CASE WHEN user_id % 3 = 0 THEN x ELSE x + (i % 3 - 1) END AS a FROM s JOIN e USING (user_id)), m AS (SELECT user_id, sum((a - b) ^ 2) AS r, sum(b * b) AS s FROM p WHERE back < 12 GROUP BY 1),
n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1) SELECT user_id, CASE WHEN r <= 0 THEN '-inf'::DOUBLE ELSE round(10 * log10(r / s), 5) END AS residual_db, round(abs(n - 60) * 100.0 / 60, 6)::DOUBLE AS length_error FROM m JOIN n USING (user_id)""")
def tail_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """What a signal's end holds besides its source's, and by how much its length is off."""
    s = series(spark, sf).select("user_id", "i", "x")
    rendered = s.withColumn("x", F.when(F.col("user_id") % 3 == 0, F.col("x")).otherwise(F.col("x") + (F.col("i") % 3 - 1)))
    out = A.tail_residual(rendered, s, "user_id", "i", "x", 12)
    n = s.groupBy("user_id").agg(F.count("*").alias("n"))
    off = F.round(A.length_error(F.col("n"), F.lit(60)), 6)
    return out.join(n, "user_id").select("user_id", F.when(F.col("residual_db") == float("-inf"), F.col("residual_db")).otherwise(F.round("residual_db", 5)).alias("residual_db"), off.alias("length_error"))
