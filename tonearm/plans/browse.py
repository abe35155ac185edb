"""Everyday library and evaluation queries: part stands for songs (album: type, artist: brand), orders for logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import music as M
from tonearm.functions.frames import spread
from tonearm.functions import text as X
from tonearm.operators import library as L
from tonearm.operators import pairs as P
from tonearm.operators import planning as G
from tonearm.operators import stats as S
from tonearm.plans.base import Plans, table

PLANS = Plans()
SONG = {
    "id": "p_partkey", "title": "p_name", "artist": "p_brand", "artist_id": "CAST(substr(p_brand, 7) AS INT)", "album": "p_type", "album_id": "length(p_type) * 10 + p_partkey % 3", "genre": "p_type",
    "disc": "CAST(p_partkey % 2 + 1 AS INT)", "track": "p_size", "year": "CAST(1980 + p_size % 40 AS INT)", "duration_ms": "p_size * 10000", "date_added": "p_partkey * 7919 % 10007", "has_analysis": "p_partkey % 3 = 0",
}
SONGS = "songs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SONG.items()) + " FROM part)"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def songs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in SONG.items()])


@PLANS.query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 42 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13)")
def songs_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """B1, B2: the predicates reach the scan."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return L.by_id(part, "p_partkey", 42).union(L.by_id(part, "p_partkey", 3, 5, 8, 13))


@PLANS.query(f"WITH {SONGS} SELECT 'album' AS kind, id, disc, track FROM songs WHERE album_id = (SELECT min(album_id) FROM songs) UNION ALL SELECT 'artist', id, disc, track FROM songs WHERE artist_id = 12")
def songs_of(spark: SparkSession, sf: str) -> DataFrame:
    """An album's and an artist's songs in disc and track order."""
    s = songs(spark, sf)
    first = s.agg(F.min("album_id")).first()[0]  # one number
    return L.of_album(s, first).select(F.lit("album").alias("kind"), "id", "disc", "track").union(L.of_artist(s, 12).select(F.lit("artist"), "id", "disc", "track"))


@PLANS.query(f"WITH {SONGS} SELECT id, title FROM songs WHERE genre IN (SELECT DISTINCT trim(p_type) FROM part WHERE trim(p_type) LIKE '%A%')")
def songs_of_genre(spark: SparkSession, sf: str) -> DataFrame:
    """By genre, joined by its name."""
    return L.of_genre(songs(spark, sf), L.genres(table(spark, sf, "part"), "p_type"), F.col("name").contains("A")).select("id", "title")


@PLANS.query(f"""WITH {SONGS} SELECT * FROM (SELECT 'song' AS kind, id::BIGINT AS id, title AS name FROM songs WHERE contains(lower(title), 'an') OR contains(lower(artist), 'an') OR contains(lower(album), 'an') ORDER BY {FOLD.format('title')}, id LIMIT 200)
UNION ALL SELECT * FROM (SELECT 'customer', c_custkey, c_name FROM customer WHERE contains(lower(c_name), '07') ORDER BY {FOLD.format('c_name')}, c_custkey LIMIT 50)""")
def live_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two letters at least, pages of 200 and 50; the limits are the pages."""
    found = L.live_search(songs(spark, sf).select("title", "id", "artist", "album"), " AN ", ["title", "artist", "album"], 200).select(F.lit("song").alias("kind"), F.col("id").cast("long").alias("id"), F.col("title").alias("name"))
    people = L.live_search(table(spark, sf, "customer").select("c_name", "c_custkey"), "07", ["c_name"], 50).select(F.lit("customer"), F.col("c_custkey").cast("long"), "c_name")
    none = L.live_search(songs(spark, sf).select("title", "id"), " a", ["title"], 50).select(F.lit("song"), F.col("id").cast("long"), "title")
    return found.union(people).union(none)


@PLANS.query(f"WITH {SONGS} SELECT id, date_added FROM songs WHERE NOT has_analysis ORDER BY date_added DESC, id LIMIT 25")
def analysis_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """The next batch to analyse."""
    return L.backlog(songs(spark, sf), 25).select("id", "date_added")


@PLANS.query(f"WITH {SONGS} SELECT count(*) AS songs, count(*) FILTER (has_analysis) AS analysed, count(DISTINCT id) AS ids FROM songs")
def library_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Full reads that prune to the columns counted."""
    return songs(spark, sf).agg(F.count("*").alias("songs"), F.count_if("has_analysis").alias("analysed"), F.count_distinct("id").alias("ids"))


@PLANS.query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'renamed ' || o_orderkey ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 10 = 3 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Names and flags set in place."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return L.updated(orders, F.col("o_orderkey") % 10 == 3, o_orderpriority=F.concat(F.lit("renamed "), F.col("o_orderkey").cast("string")), o_totalprice=F.lit(0.0))


ORDERS = {
    "title": FOLD.format("title"), "artist": f"{FOLD.format('artist')}, {FOLD.format('album')}, disc, track", "album": f"{FOLD.format('album')}, disc, track",
    "date_added": f"date_added DESC, {FOLD.format('title')}", "duration": f"duration_ms DESC, {FOLD.format('title')}", "year": "year DESC, lower(album), track",
}


@PLANS.query(f"WITH {SONGS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS sort, id, row_number() OVER (ORDER BY {o}, id) AS place FROM songs ORDER BY place LIMIT 20)" for n, o in ORDERS.items()))
def sorted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """the first page of every order; a top-k each, no full sort."""
    out = None
    for n in ORDERS:
        rows = L.sorted_songs(songs(spark, sf), n).limit(20).select("id").coalesce(1)  # one page
        page = rows.select(F.lit(n).alias("sort"), "id", (F.monotonically_increasing_id() + 1).alias("place"))
        out = page if out is None else out.union(page)
    return out


@PLANS.query(f"""WITH {SONGS}, a AS (SELECT album || artist AS id, album AS title, artist, max(year) AS year FROM songs GROUP BY ALL) SELECT * FROM (SELECT 'title' AS sort, id, year FROM a ORDER BY {FOLD.format('title')}, id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'year', id, year FROM a ORDER BY year DESC, {FOLD.format('title')}, id LIMIT 15) UNION ALL SELECT * FROM (SELECT 'artist', id, year FROM a ORDER BY artist, year, {FOLD.format('title')}, id LIMIT 15)""")
def album_pages(spark: SparkSession, sf: str) -> DataFrame:
    """albums by title, year, and by artist."""
    albums = songs(spark, sf).groupBy("album", "artist").agg(F.max("year").alias("year")).select(F.concat("album", "artist").alias("id"), F.col("album").alias("title"), "artist", "year")
    pages = [L.sorted_albums(albums, n).limit(15).select(F.lit(n).alias("sort"), "id", "year") for n in ("title", "year", "artist")]
    return pages[0].union(pages[1]).union(pages[2])


@PLANS.query(f"SELECT * FROM (SELECT 'artist' AS kind, s_name AS name FROM supplier ORDER BY {FOLD.format('s_name')}, s_suppkey LIMIT 30) UNION ALL SELECT * FROM (SELECT 'genre', n_name FROM nation ORDER BY {FOLD.format('n_name')}, n_nationkey LIMIT 30)")
def names_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """artists and genres by name."""
    page = lambda t, n, k, kind: L.by_name(table(spark, sf, t), n, k).limit(30).select(F.lit(kind).alias("kind"), F.col(n).alias("name"))
    return page("supplier", "s_name", "s_suppkey", "artist").union(page("nation", "n_name", "n_nationkey", "genre"))


LOGS = "logs AS (SELECT l_orderkey AS id, l_partkey % 7 AS a, l_suppkey % 3 AS b, l_shipdate AS created_at, l_extendedprice AS x FROM lineitem)"


@PLANS.query(f"WITH {LOGS} SELECT 'all' AS kind, * FROM (SELECT id, created_at FROM logs ORDER BY created_at DESC, id DESC LIMIT 40) UNION ALL SELECT 'pair', * FROM (SELECT id, created_at FROM logs WHERE a = 2 AND b = 1 ORDER BY created_at DESC, id DESC LIMIT 40)")
def recent_logs(spark: SparkSession, sf: str) -> DataFrame:
    """F8: the newest logs, and those of one pair."""
    logs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 7).alias("a"), (F.col("l_suppkey") % 3).alias("b"), F.col("l_shipdate").alias("created_at"))
    page = lambda kind, *pair: L.recent_logs(logs, 40, *pair).select(F.lit(kind).alias("kind"), "id", "created_at")
    return page("all").union(page("pair", 2, 1))


@PLANS.query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '<unknown>' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN '<unknown>' ELSE p_brand END AS artist, p_type AS album, (p_partkey * 37 % 3500) % 1000 AS track, CASE WHEN p_partkey * 37 % 3500 >= 1000 THEN (p_partkey * 37 % 3500) // 1000 ELSE 1 END::INT AS disc FROM part")
def normalised_songs(spark: SparkSession, sf: str) -> DataFrame:
    """A4, H6: blanks, unknown names, track and disc."""
    raw = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 4 == 0, None).otherwise(F.col("p_brand")).alias("artist"), F.col("p_type").alias("album"), F.lit("").alias("path"), F.lit("").alias("genre"), (F.col("p_partkey") * 37 % 3500).alias("raw_track"))
    return L.normalise(raw).select("p_partkey", "title", "artist", "album", "track", "disc")


@PLANS.query("SELECT l_partkey, first(l_suppkey ORDER BY l_shipdate DESC, l_suppkey DESC) AS genre FROM lineitem GROUP BY 1")
def genre_membership(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the last membership wins."""
    return L.last_membership(table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("genre"), "l_shipdate"), "l_partkey", "genre", "l_shipdate")


@PLANS.query("""WITH b AS (SELECT s_suppkey AS k, 'built ' || s_suppkey AS name, 0 AS r FROM supplier), o AS (SELECT c_custkey AS k, 'own ' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS r FROM customer), u AS (SELECT *, 'styles' AS kind FROM b UNION ALL SELECT k, name, 1, 'styles' FROM o UNION ALL SELECT *, 'rules' FROM b UNION ALL SELECT *, 'rules' FROM o)
SELECT kind, k, first(name ORDER BY r) AS name FROM u GROUP BY 1, 2""")
def shadowed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Built-ins shadow the user's styles; valid rules of the user shadow built-in ones."""
    built = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("built "), F.col("s_suppkey").cast("string")).alias("name"))
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("own "), F.col("c_custkey").cast("string")).alias("name"))
    valid = F.col("k") % 2 == 0
    return L.shadowed(built, own, "k").select(F.lit("styles").alias("kind"), "k", "name").union(L.shadowed(built, own, "k", valid).select(F.lit("rules"), "k", "name"))


@PLANS.query("""WITH f AS (SELECT page_id, regexp_extract(url, '^https?:/(/[^?#]*)', 1) AS path FROM pages), d AS (SELECT min(regexp_extract(path, '^(.+)/[^/]*$', 1)) AS folder FROM f WHERE regexp_extract(path, '^(.+)/[^/]*$', 1) <> '')
SELECT 'in' AS kind, page_id FROM f, d WHERE regexp_extract(path, '^(.+)/[^/]*$', 1) = folder UNION ALL SELECT 'under', page_id FROM f, d WHERE path = folder OR starts_with(path, folder || '/')""")
def folder_items(spark: SparkSession, sf: str) -> DataFrame:
    """What is directly in a folder, and what is anywhere under it."""
    f = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?:/(/[^?#]*)", 1).alias("path"))
    folder = f.select(X.parent_dir(F.col("path")).alias("d")).filter("d <> ''").agg(F.min("d")).first()[0]  # one name
    return L.in_folder(f, "path", folder).select(F.lit("in").alias("kind"), "page_id").union(L.under_folder(f, "path", folder).select(F.lit("under"), "page_id"))


@PLANS.query("SELECT p_partkey, list_filter([CASE WHEN p_partkey % 100 < 50 THEN 'grid' END, CASE WHEN p_partkey * 3 % 100 < 60 THEN 'key' END, CASE WHEN p_partkey * 7 % 100 < 50 THEN 'tempo' END], lambda x: x IS NOT NULL) AS reasons FROM part WHERE p_partkey % 100 < 50 OR p_partkey * 3 % 100 < 60 OR p_partkey * 7 % 100 < 50")
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Weak analyses, and why."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", (k % 100 / 100).alias("grid_confidence"), (k * 3 % 100 / 100).alias("key_confidence"), (k * 7 % 100 / 100).alias("tempo_confidence"))
    return L.low_confidence(rows).select("p_partkey", "reasons")


@PLANS.query("""WITH p AS (SELECT l_orderkey AS k, l_partkey % 30 AS a, l_suppkey % 20 AS b FROM lineitem), n AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE (s_suppkey % 30)::VARCHAR END AS a, CASE WHEN s_suppkey % 5 = 1 THEN '*' ELSE (s_suppkey * 3 % 20)::VARCHAR END AS b FROM supplier),
u AS (SELECT a, b, min(s) AS s FROM n GROUP BY 1, 2) SELECT k, p.a, p.b, coalesce(x.s, y.s, z.s) AS pin FROM p LEFT JOIN u x ON x.a = p.a::VARCHAR AND x.b = p.b::VARCHAR LEFT JOIN u y ON y.a = p.a::VARCHAR AND y.b = '*' LEFT JOIN u z ON z.a = '*' AND z.b = p.b::VARCHAR""")
def pinned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pin of a pair: exact, else of a, else of b."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 30).cast("string").alias("a"), (F.col("l_suppkey") % 20).cast("string").alias("b"))
    s = F.col("s_suppkey")
    pins = table(spark, sf, "supplier").select(s.alias("strategy"), F.when(s % 5 == 0, "*").otherwise((s % 30).cast("string")).alias("a"), F.when(s % 5 == 1, "*").otherwise((s * 3 % 20).cast("string")).alias("b"))
    out = P.pinned(pairs, pins.groupBy("a", "b").agg(F.min("strategy").alias("strategy")))
    return out.select("k", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "pin")


@PLANS.query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '4' END AS bars, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'wide' END, CASE WHEN o_orderkey % 2 = 0 THEN 'narrow' END, 'none') AS mode, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 THEN 0 ELSE 0 END AS n FROM orders")
def layered_params(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults, presets and overrides laid over each other, the last one wins."""
    k = F.col("o_orderkey")
    base = F.create_map(F.lit("bars"), F.lit("4"))
    preset = F.when(k % 2 == 0, F.create_map(F.lit("bars"), F.col("o_orderstatus"), F.lit("mode"), F.lit("narrow")))
    own = F.when(k % 3 == 0, F.create_map(F.lit("mode"), F.lit("wide")))
    m = P.layered(base, preset, own)
    rows = table(spark, sf, "orders").select("o_orderkey", m.alias("m"))
    return rows.select("o_orderkey", F.try_element_at("m", F.lit("bars")).alias("bars"), F.coalesce(F.try_element_at("m", F.lit("mode")), F.lit("none")).alias("mode"), F.size("m").alias("n"))


@PLANS.query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN 'discount' WHEN l_tax > 0.04 THEN 'tax' ELSE 'quantity' END AS metric, l_linenumber, l_partkey, l_suppkey FROM lineitem), f AS (SELECT l_orderkey, metric, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS place FROM r GROUP BY 1, 2)
SELECT l_orderkey, list(metric ORDER BY place, metric) AS metrics, count(*)::INT AS n FROM f GROUP BY 1""")
def metric_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The metric ids of a report, as first seen."""
    metric = F.when(F.col("l_discount") > 0.05, "discount").when(F.col("l_tax") > 0.04, "tax").otherwise("quantity")
    rows = table(spark, sf, "lineitem").select("l_orderkey", metric.alias("metric"), "l_linenumber", "l_partkey", "l_suppkey")
    return S.metric_ids(rows, ["l_orderkey"], "metric", ["l_linenumber", "l_partkey", "l_suppkey"])


@PLANS.query("SELECT p_brand AS strategy, list_sort(list(DISTINCT p_type)) AS names FROM part GROUP BY 1")
def presets_by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Presets grouped for display."""
    return S.by_strategy(table(spark, sf, "part").select(F.col("p_brand").alias("strategy"), "p_type"), "strategy", "p_type")


@PLANS.query("""WITH r AS (SELECT l_linenumber::DOUBLE AS bars, (l_suppkey % 4)::DOUBLE AS gain, CASE WHEN l_returnflag = 'A' THEN 'click' ELSE 'jump' END AS metric, l_discount AS value, CASE WHEN l_discount > 0.09 THEN 2 WHEN l_discount > 0.07 THEN 1 ELSE 0 END AS s FROM lineitem)
SELECT bars, gain, max(value) FILTER (metric = 'click') AS value, ['PASS', 'WARN', 'FAIL'][max(s) + 1] AS worst, list_sort(list(DISTINCT metric)) AS metrics FROM r GROUP BY 1, 2 HAVING max(value) FILTER (metric = 'click') IS NOT NULL""")
def sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    """A metric's points over a grid of two axes."""
    verdict = F.when(F.col("l_discount") > 0.09, "FAIL").when(F.col("l_discount") > 0.07, "WARN").otherwise("PASS")
    runs = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("bars"), (F.col("l_suppkey") % 4).cast("double").alias("gain"), F.when(F.col("l_returnflag") == "A", "click").otherwise("jump").alias("metric"), F.col("l_discount").alias("value"), verdict.alias("verdict"))
    axes = S.grid(spark, {"bars": [float(i) for i in range(1, 8)], "gain": [0.0, 1.0, 2.0, 3.0]})  # 28 points
    return S.sweep(runs.join(F.broadcast(axes), ["bars", "gain"]), ["bars", "gain"], "click")


@PLANS.query("""WITH r AS (SELECT l_suppkey % 14 AS strategy, CASE WHEN l_discount > 0.09 THEN 'FAIL' WHEN l_discount > 0.07 THEN 'WARN' ELSE 'PASS' END AS verdict, CASE WHEN l_tax > 0.075 THEN 'x' END AS error FROM lineitem), b AS (SELECT *, error IS NOT NULL OR verdict = 'FAIL' AS bad FROM r)
SELECT count(*) AS pairs, count(error) AS errors, count(*) FILTER (bad) AS fails, count(*) FILTER (NOT bad AND verdict = 'WARN') AS warns, count(DISTINCT strategy) AS strategies, count(*) FILTER (bad) / count(*) AS fail_rate, count(*) FILTER (NOT bad AND verdict = 'WARN') / count(*) AS warn_rate, count(*) FILTER (bad) / count(*) <= 0.3 AS passes FROM b""")
def evaluation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation's counts, rates and gate."""
    verdict = F.when(F.col("l_discount") > 0.09, "FAIL").when(F.col("l_discount") > 0.07, "WARN").otherwise("PASS")
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 14).alias("strategy"), verdict.alias("verdict"), F.when(F.col("l_tax") > 0.075, "x").alias("error"))
    return S.evaluation(rows, "strategy", 0.3)


@PLANS.query("""WITH a AS (SELECT l_orderkey, l_linenumber AS metric, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber AS metric, max(l_discount) AS v FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.metric, b.metric) AS metric, CASE WHEN a.metric IS NOT NULL THEN a.v ELSE b.v END AS v FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.metric = b.metric""")
def merged_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports, the first one wins for each metric."""
    rows = table(spark, sf, "lineitem")
    one = rows.filter("l_returnflag = 'A'").groupBy("l_orderkey", F.col("l_linenumber").alias("metric")).agg(F.max("l_tax").alias("v"))
    two = rows.groupBy("l_orderkey", F.col("l_linenumber").alias("metric")).agg(F.max("l_discount").alias("v"))
    return S.first_report_wins([one, two], ["l_orderkey", "metric"])


@PLANS.query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS index, CASE WHEN l_tax > 0.079 THEN 'x' END AS error, CASE WHEN l_discount > 0.09 THEN 2 WHEN l_discount > 0.07 THEN 1 ELSE 0 END AS v, l_suppkey % 5 AS failures, l_partkey % 4 AS warnings FROM lineitem)
SELECT index, failures, warnings FROM r ORDER BY error IS NULL, v DESC, failures DESC, warnings DESC, index LIMIT 50""")
def worst_first(spark: SparkSession, sf: str) -> DataFrame:
    """The worst fifty."""
    verdict = F.when(F.col("l_discount") > 0.09, "FAIL").when(F.col("l_discount") > 0.07, "WARN").otherwise("PASS")
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"), F.when(F.col("l_tax") > 0.079, "x").alias("error"), verdict.alias("verdict"), (F.col("l_suppkey") % 5).alias("failures"), (F.col("l_partkey") % 4).alias("warnings"))
    return S.worst_first(rows, 50).select("index", "failures", "warnings")


@PLANS.query("SELECT p_brand AS strategy, (p_partkey % 8)::INT AS bucket_order, count(*) AS n FROM part GROUP BY 1, 2")
def learned_table(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies with their buckets in the buckets' fixed order."""
    names = [f"{m}.{k}.{r}" for m in ("matched", "unmatched") for k in ("inkey", "clash") for r in ("rising", "falling")]
    bucket = F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("strategy"), bucket.alias("bucket")).groupBy("strategy", "bucket").agg(F.count("*").alias("n"))
    return S.in_bucket_order(rows, "strategy", "bucket", names).select("strategy", (F.col("bucket_order") - 1).alias("bucket_order"), "n")


@PLANS.query("""WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'up' WHEN 1 THEN ' BAD ' WHEN 2 THEN (doc_id % 5 + 1)::VARCHAR WHEN 3 THEN doc_id % 120 || '%' WHEN 4 THEN '0.' || doc_id % 10 ELSE 'what' END AS t FROM documents)
SELECT doc_id, CASE WHEN lower(trim(t)) IN ('up', '+', 'good', 'like') THEN 1 WHEN lower(trim(t)) IN ('down', '-', 'bad', 'dislike') THEN 0 WHEN regexp_full_match(t, '[1-5]') THEN (t::INT - 1) / 4.0 END::DOUBLE AS rating,
CASE WHEN t LIKE '%\\%' ESCAPE '\\' THEN CASE WHEN replace(t, '%', '')::DOUBLE / 100 BETWEEN 0 AND 1 THEN replace(t, '%', '')::DOUBLE / 100 END WHEN try_cast(t AS DOUBLE) BETWEEN 0 AND 1 THEN try_cast(t AS DOUBLE) END AS rate FROM s""")
def parsed_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings and rates from text."""
    k = F.col("doc_id")
    t = F.when(k % 6 == 0, "up").when(k % 6 == 1, " BAD ").when(k % 6 == 2, (k % 5 + 1).cast("string")).when(k % 6 == 3, F.concat((k % 120).cast("string"), F.lit("%"))).when(k % 6 == 4, F.concat(F.lit("0."), (k % 10).cast("string"))).otherwise("what")
    return table(spark, sf, "documents").select("doc_id", X.parse_rating(t).alias("rating"), X.parse_rate(t).alias("rate"))


@PLANS.query("""WITH n AS (SELECT p_partkey, p_partkey % 12 AS k, p_partkey % 2 = 0 AS m FROM part) SELECT p_partkey, k::INT AS tonic, m AS minor, round(20 * log10((p_partkey + 1) / 100.0), 6) AS db, round(-0.691 + 10 * log10((p_partkey + 1) / 100.0), 6) AS lufs FROM n""")
def parsed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Key names read, levels and loudness."""
    names = ("C", "C#", "D", "Eb", "E", "F", "F♯", "G", "A♭", "a", "Bb", "B")
    k = F.col("p_partkey")
    name = F.concat(F.get(F.array(*map(F.lit, names)), (k % 12).cast("int")), F.when(k % 2 == 0, "m").otherwise(" major"))
    x = (k + 1) / 100.0
    return table(spark, sf, "part").select("p_partkey", M.parse_key(name).alias("key"), F.round(M.db(x), 6).alias("db"), F.round(M.lufs(x), 6).alias("lufs")).select("p_partkey", "key.tonic", "key.minor", "db", "lufs")


#: Misspelt names: letters swapped, dropped, doubled, changed, in other case, by the part's key.
MISSPELT = "CASE p_partkey % 5 WHEN 0 THEN reverse(substr(p_name, 1, 2)) || substr(p_name, 3) WHEN 1 THEN substr(p_name, 1, 3) || substr(p_name, 5) WHEN 2 THEN upper(p_name) || 'x' WHEN 3 THEN 'q' || substr(p_name, 2, 4) || 'zz' || substr(p_name, 6) ELSE substr(p_brand, 1, 9) END"


@PLANS.query(f"""WITH w AS (SELECT DISTINCT {MISSPELT} AS word FROM part), n AS (SELECT DISTINCT p_name AS name FROM part), d AS (SELECT word, name, damerau_levenshtein(lower(word), lower(name)) AS distance, greatest(1, least(3, (length(word) + 2) // 3)) AS most FROM w, n),
b AS (SELECT word, min({{'distance': distance, 'name': name}}) AS b FROM d WHERE distance <= most GROUP BY 1) SELECT word, b.name AS suggestion, b.distance AS distance FROM w LEFT JOIN b USING (word)""")
def name_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest known name for every misspelt one."""
    parts = table(spark, sf, "part")
    return L.suggested(parts.select(F.expr(MISSPELT).alias("word")), parts, "word", "p_name").withColumn("distance", F.col("distance").cast("long"))


@PLANS.query("SELECT p_partkey, damerau_levenshtein(p_name, reverse(p_name[:2]) || p_name[4:]) AS distance, greatest(1, least(3, (length(p_name) + 2) // 3))::INT AS most FROM part")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """How far a misspelt name is, a swap counting one edit, and how far it may be."""
    name = F.col("p_name")
    wrong = F.concat(F.reverse(F.substring(name, 1, 2)), F.substring(name, F.lit(4), F.length(name)))
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")  # a short file, and much work for each name
    return parts.select("p_partkey", X.alignment_distance(name, wrong).cast("long").alias("distance"), X.suggestion_limit(name).alias("most"))


@PLANS.query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 16 WHEN p_partkey % 3 = 1 THEN greatest(1, least(64, p_size + 1)) ELSE 16 END::BIGINT AS bars, p_partkey % 2 = 0 AS lock, CASE WHEN p_partkey % 4 < 2 THEN ['soft', 'hard'][p_partkey % 4 + 1] ELSE 'soft' END AS mode FROM part""")
def typed_params(spark: SparkSession, sf: str) -> DataFrame:
    """Typed reads of text parameters: clamped, defaulted, by choice."""
    k = F.col("p_partkey")
    bars = F.when(k % 3 == 0, "x").when(k % 3 == 1, F.concat((F.col("p_size") + 1).cast("string"), F.lit(".4"))).otherwise("")
    text = F.concat(F.lit("bars="), bars, F.lit(",lock="), F.when(k % 2 == 0, "YES").otherwise("0"), F.lit(",mode="), F.get(F.array(*map(F.lit, ("soft", "hard", "odd", ""))), (k % 4).cast("int")))
    m = X.params_of(text)
    specs = (G.Spec("bars", "int", 16, 1, 64), G.Spec("lock", "bool", False), G.Spec("mode", "choice", "soft", choices=("soft", "hard")))
    return table(spark, sf, "part").select("p_partkey", *[s.read(m).alias(s.id) for s in specs])


@PLANS.query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '—' ELSE regexp_replace(regexp_replace(format('{:.3f}', o_totalprice / 8 + 1e-7), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS shown, format('{:.1f}', o_orderkey % 1000 / 10.0 + 1e-9) || ' %' AS share, CASE WHEN o_orderkey % 3 = 0 THEN '"' || 'a ""' || o_orderkey || '"", b' || '"' ELSE 'plain ' || o_orderkey END AS field FROM orders""")
def formatted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, shares and CSV fields as text."""
    k = F.col("o_orderkey")
    x = F.when(k % 4 == 0, float("nan")).otherwise(F.col("o_totalprice") / 8 + 1e-7)
    field = F.when(k % 3 == 0, F.concat(F.lit('a "'), k.cast("string"), F.lit('", b'))).otherwise(F.concat(F.lit("plain "), k.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", X.number_text(x).alias("shown"), X.percent_text(k % 1000 / 1000 + 1e-11).alias("share"), X.csv_text(field).alias("field"))


@PLANS.query("SELECT l_orderkey, list_sort(list(l_partkey)) = list_sort(list(CASE WHEN l_orderkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END)) AS same FROM lineitem GROUP BY 1")
def same_items(spark: SparkSession, sf: str) -> DataFrame:
    """Is one list a permutation of the other?"""
    other = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("a"), F.reverse(F.collect_list(other)).alias("b"))
    return lists.select("l_orderkey", L.same_items(F.col("a"), F.col("b")).alias("same"))


@PLANS.query("SELECT event_id, to_json({'event_id': event_id, 'value': CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END})::VARCHAR AS json FROM events")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON, what is no number as null."""
    from tonearm.sources.files import json_rows as as_json

    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return as_json(rows).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "json")
