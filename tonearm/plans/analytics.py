"""Feedback and quality queries: labels stand for ratings, lineitem for reports of metrics, events for evaluated transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import stats as S
from tonearm.operators.series import mid_rank
from tonearm.plans.base import Plans, table

PLANS = Plans()
VALUES = "v AS (SELECT l_orderkey, 'discount' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem)"
JUDGED = VALUES + ", j AS (SELECT *, CASE metric WHEN 'discount' THEN CASE WHEN value > 0.09 THEN 'FAIL' WHEN value > 0.07 THEN 'WARN' ELSE 'PASS' END ELSE CASE WHEN value < 0.01 THEN 'FAIL' WHEN value < 0.03 THEN 'WARN' ELSE 'PASS' END END AS verdict FROM v)"


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("discount").alias("metric"), F.col("l_discount").alias("value")), F.struct(F.lit("tax").alias("metric"), F.col("l_tax").alias("value")))).alias("m")
    values = table(spark, sf, "lineitem").select("l_orderkey", each).select("l_orderkey", "m.*")
    limits = spark.createDataFrame([("discount", 0.07, 0.09, False), ("tax", 0.03, 0.01, True)], "metric string, warn_at double, fail_at double, lower_is_worse boolean")
    return S.judged(values, limits).select("l_orderkey", "metric", "value", "verdict")


@PLANS.query(f"""WITH {JUDGED}, s AS (SELECT l_orderkey, CASE verdict WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END AS s FROM j)
SELECT l_orderkey, ['PASS', 'WARN', 'FAIL'][max(s) + 1] AS worst, count(*) FILTER (s = 2) AS failures, count(*) FILTER (s = 1) AS warnings, max(s) < 2 AS installable FROM s GROUP BY 1""")
def verdict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K2, D15, H31."""
    return S.rolled_up(verdicts(spark, sf), ["l_orderkey"])


@PLANS.query(f"WITH {JUDGED} SELECT metric, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'WARN') AS warn, count(*) FILTER (verdict = 'FAIL') AS fail FROM j GROUP BY 1")
def metric_stats(spark: SparkSession, sf: str) -> DataFrame:
    """D10."""
    return S.metric_stats(verdicts(spark, sf), "metric", "verdict")


@PLANS.query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0), 4) AS low, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 1), 4) AS high, count(*) FILTER (l_extendedprice < 10000) AS below FROM lineitem GROUP BY 1""")
def distribution_stats(spark: SparkSession, sf: str) -> DataFrame:
    """D13, D12."""
    out = S.distribution(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 10000)
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("low", "p10", "median", "p90", "high")], "below")


@PLANS.query("SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (least(4, floor(l_discount * 10 * 5)) = {i}) AS b{i}" for i in range(5)) + " FROM lineitem GROUP BY 1")
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """D14."""
    return S.histogram(table(spark, sf, "lineitem").withColumn("x", F.col("l_discount") * 10), ["l_linestatus"], "x")


VERDICT = "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'WARN' ELSE 'PASS' END"


@PLANS.query(f"""SELECT user_id % 15 AS strategy, count(*) AS chosen, count(*) FILTER ({VERDICT} = 'FAIL') AS fail, count(*) FILTER ({VERDICT} = 'WARN') AS warn,
round(avg(CASE WHEN {VERDICT} = 'FAIL' THEN 1.0 ELSE 0.0 END), 6) AS fail_rate, round(quantile_cont(value, 0.5), 4) AS median_seconds FROM events GROUP BY 1""")
def strategy_stats(spark: SparkSession, sf: str) -> DataFrame:
    """D9, D11, D12."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 15).alias("strategy"), F.expr(VERDICT).alias("verdict"), "value")
    return S.strategy_stats(rows, "strategy", "verdict", "value").withColumn("fail_rate", F.round("fail_rate", 6)).withColumn("median_seconds", F.round("median_seconds", 4))


@PLANS.query("""WITH t AS (SELECT source, lang, count(*) FILTER (toxic = 0) AS n, coalesce(sum(quality) FILTER (toxic = 0), 0)::DOUBLE AS sum, count(*) FILTER (toxic = 1) AS implicit_n,
coalesce(sum(quality) FILTER (toxic = 1), 0)::DOUBLE AS implicit_sum FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), w AS (SELECT *, least(0.25 * implicit_n, 2.0)::DOUBLE AS w FROM t)
SELECT source, lang, n, sum, implicit_n, implicit_sum, round(greatest(0.5, least(1.5, 0.5 + (2 + sum + CASE WHEN implicit_n = 0 THEN 0 ELSE implicit_sum * w / implicit_n END) / (4 + n + w))), 6)::DOUBLE AS multiplier FROM w""")
def rating_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings by label; toxic ones count as implicit."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    rows = rows.select("source", "lang", F.col("quality").cast("double").alias("rating"), (F.col("toxic") == 1).alias("implicit"))
    return S.learned(S.tally(rows, ["source", "lang"], "rating", "implicit")).withColumn("multiplier", F.round("multiplier", 6))


@PLANS.query(f"""WITH {JUDGED}, o AS (SELECT l_orderkey, metric, max(CASE verdict WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS s FROM j GROUP BY 1, 2),
p AS (SELECT a.l_orderkey, a.metric, b.s AS b, a.s AS a FROM o a LEFT JOIN o b ON b.l_orderkey = a.l_orderkey - 1 AND a.metric = b.metric)
SELECT l_orderkey, metric, ['PASS', 'WARN', 'FAIL'][a + 1] AS after, ['PASS', 'WARN', 'FAIL'][b + 1] AS before FROM p WHERE a > b OR (b IS NULL AND a > 0)""")
def golden_regressions(spark: SparkSession, sf: str) -> DataFrame:
    """K4: each report against the one before as its golden."""
    now = verdicts(spark, sf).groupBy("l_orderkey", "metric").agg(S.verdict_of(F.max(S.severity(F.col("verdict")))).alias("verdict"))
    golden = now.withColumn("l_orderkey", F.col("l_orderkey") + 1)
    return S.regressions(golden, now, ["l_orderkey", "metric"])


DAY = "SELECT user_id, (extract(day FROM ts) - 1)::INT AS day, sum(value) AS x FROM events GROUP BY 1, 2"


@PLANS.query(f"""WITH d AS ({DAY}), g AS (SELECT user_id, day, x FROM d WHERE day < 15), a AS (SELECT user_id, day - 15 AS day, x FROM d WHERE day >= 15)
SELECT coalesce(g.user_id, a.user_id) AS user_id, round(sqrt(avg((g.x - a.x) ^ 2)), 4) AS rmse, count(g.x) AS n_golden, count(a.x) AS n_actual, coalesce(sqrt(avg((g.x - a.x) ^ 2)), 0) <= 50 AND count(g.x) = count(a.x) AS same
FROM g FULL JOIN a ON g.user_id = a.user_id AND g.day = a.day GROUP BY 1""")
def golden_series(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of each user's month as golden, the second as actual."""
    d = table(spark, sf, "events").groupBy("user_id", (F.dayofmonth("ts") - 1).alias("day")).agg(F.sum("value").alias("x"))
    out = S.series_gap(d.filter("day < 15"), d.filter("day >= 15").withColumn("day", F.col("day") - 15), ["user_id"], "day", "x", 50)
    return out.withColumn("rmse", F.round("rmse", 4))


CELLS = "SELECT l_suppkey AS strategy, l_linenumber AS pair, max(l_returnflag) AS state FROM lineitem WHERE l_linestatus = '{}' GROUP BY 1, 2"


@PLANS.query(f"""WITH g AS ({CELLS.format('F')}), a AS ({CELLS.format('O')}) SELECT coalesce(g.strategy, a.strategy) AS strategy, coalesce(g.pair, a.pair) AS pair, g.state AS before, a.state AS after,
CASE WHEN g.state IS NULL THEN 'added' WHEN a.state IS NULL THEN 'removed' WHEN g.state = a.state THEN 'same' ELSE 'changed' END AS change FROM g FULL JOIN a ON g.strategy = a.strategy AND g.pair = a.pair""")
def corpus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """K5."""
    cells = lambda status: table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status).groupBy(F.col("l_suppkey").alias("strategy"), F.col("l_linenumber").alias("pair")).agg(F.max("l_returnflag").alias("state"))
    return S.coverage(cells("F"), cells("O"), ["strategy", "pair"])


@PLANS.query("""WITH r AS (SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) - 1 AS lo, count(*) OVER (PARTITION BY p_retailprice) AS n, count(*) OVER () AS c FROM part)
SELECT p_partkey, round(CASE WHEN c <= 1 THEN 0.5 ELSE (lo + (n - 1) / 2.0) / (c - 1) END, 9) AS quantile FROM r""")
def mid_rank_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked range by range, no window over all rows."""
    return mid_rank(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("quantile", 9).alias("quantile"))


@PLANS.query("SELECT conv_id, count(*) FILTER (same) AS adjacent FROM (SELECT conv_id, lower(trim(role)) <> '' AND lower(trim(role)) = lead(lower(trim(role))) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS same FROM conversations) GROUP BY 1")
def same_artist_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    """D22."""
    return S.adjacent_same(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], "role")


@PLANS.query("""WITH v AS (SELECT l_orderkey, first(l_suppkey ORDER BY l_shipdate, l_suppkey) AS winner FROM lineitem GROUP BY 1)
SELECT DISTINCT l_orderkey AS session_id, l_suppkey AS strategy, CASE WHEN l_suppkey = winner THEN 1.0 ELSE 0.0 END::DOUBLE AS rating FROM lineitem JOIN v USING (l_orderkey)""")
def blind_votes(spark: SparkSession, sf: str) -> DataFrame:
    """K9: the first vote of a session counts; its candidates are the session's strategies."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("winner"), F.col("l_shipdate").alias("at"))
    sets = rows.groupBy("session_id").agg(F.collect_set("winner").alias("candidates"))
    return S.votes_to_ratings(rows.join(sets, "session_id"))


@PLANS.query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, greatest(-12.0, min(l_quantity) OVER (PARTITION BY l_orderkey) - l_quantity)::DOUBLE AS gain FROM lineitem")
def level_match(spark: SparkSession, sf: str) -> DataFrame:
    """D29, K11."""
    return S.level_matched(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], "l_quantity")


@PLANS.query("""WITH c AS (SELECT 60.0 + l_partkey % 100 AS t, (60.0 + l_partkey % 100) * CASE l_returnflag WHEN 'A' THEN 1.005 WHEN 'R' THEN 2.0 ELSE 1.03 END AS bpm, l_discount AS f FROM lineitem), e AS (SELECT *, abs(bpm / t - 1) AS e, least(abs(bpm / (t * 0.5) - 1), abs(bpm / (t * 2) - 1)) <= 0.01 AS o FROM c)
SELECT count(*) AS cases, count(*) FILTER (e <= 0.01) AS tempo_ok, count(*) FILTER (e > 0.01 AND o) AS octave_errors, round(avg(f), 6) AS mean_f, min(f) AS min_f, round(avg(e), 6)::DOUBLE AS mean_error, round(max(e), 6)::DOUBLE AS max_error FROM e""")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    """K7, D19."""
    true = F.lit(60.0) + F.col("l_partkey") % 100
    rows = table(spark, sf, "lineitem").select(true.alias("true_bpm"), (true * F.when(F.col("l_returnflag") == "A", 1.005).when(F.col("l_returnflag") == "R", 2.0).otherwise(1.03)).alias("bpm"), F.col("l_discount").alias("f"))
    out = S.bench_summary(rows)
    return out.select("cases", "tempo_ok", "octave_errors", F.round("mean_f", 6).alias("mean_f"), "min_f", F.round("mean_error", 6).alias("mean_error"), F.round("max_error", 6).alias("max_error"))


@PLANS.query(f"WITH {JUDGED} SELECT l_orderkey, max(value) FILTER (metric = 'discount') AS discount, max(value) FILTER (metric = 'tax') AS tax, max(verdict) FILTER (metric = 'discount') AS discount_verdict, max(verdict) FILTER (metric = 'tax') AS tax_verdict FROM j GROUP BY 1")
def report_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Value and verdict columns for each metric id; the ids are named, so pivoting needs no extra pass."""
    wide = verdicts(spark, sf).groupBy("l_orderkey").pivot("metric", ["discount", "tax"]).agg(F.max("value").alias("v"), F.max("verdict").alias("verdict"))
    return wide.select("l_orderkey", F.col("discount_v").alias("discount"), F.col("tax_v").alias("tax"), "discount_verdict", "tax_verdict")
