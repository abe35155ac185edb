"""Library queries: part stands for songs, orders for playlists, lineitem for their entries and for plays, pages for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.text import format_duration, nocase, parent_dir, path_prefixes, slug
from tonearm.operators import library as L
from tonearm.plans.base import Plans, table

PLANS = Plans()
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = "regexp_extract(url, '^https?:/(/[^?#]*)', 1)"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Playlist entries; (order, line) repeats, so every column breaks ties."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")]
    return L.numbered(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"), ["l_orderkey"], order)


ENTRIES = "(SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1)::INT AS position FROM lineitem)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?:/(/[^?#]*)", 1).alias("path"))


@PLANS.query("SELECT p_partkey, p_name, plays FROM part JOIN (SELECT l_partkey, count(*) AS plays FROM lineitem GROUP BY 1) ON p_partkey = l_partkey ORDER BY plays DESC, " + FOLD.format("p_name") + ", p_partkey LIMIT 100")
def most_played(spark: SparkSession, sf: str) -> DataFrame:
    """F6, C3, D6."""
    plays = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("plays"))
    return table(spark, sf, "part").select("p_partkey", "p_name").join(plays, "p_partkey").orderBy(F.desc("plays"), nocase(F.col("p_name")), "p_partkey").limit(100)


@PLANS.query("SELECT p_partkey, p_name, last_played, plays FROM part JOIN (SELECT l_partkey, max(l_shipdate) AS last_played, count(*) AS plays FROM lineitem GROUP BY 1) ON p_partkey = l_partkey ORDER BY last_played DESC, p_partkey LIMIT 100")
def recently_played(spark: SparkSession, sf: str) -> DataFrame:
    """One row per song."""
    last = L.play_counts(table(spark, sf, "lineitem"), "l_partkey", "l_shipdate").withColumnRenamed("l_partkey", "p_partkey")
    return table(spark, sf, "part").select("p_partkey", "p_name").join(last, "p_partkey").orderBy(F.desc("last_played"), "p_partkey").limit(100)


@PLANS.query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recently_added(spark: SparkSession, sf: str) -> DataFrame:
    """a top-k, no full sort."""
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)


@PLANS.query("SELECT p_partkey, p_name, p_brand, " + FOLD.format("p_brand") + " AS artist_key FROM part ORDER BY artist_key, " + FOLD.format("p_type") + ", p_size, p_partkey")
def songs_by_artist(spark: SparkSession, sf: str) -> DataFrame:
    """F1, H1."""
    return table(spark, sf, "part").withColumn("artist_key", nocase(F.col("p_brand"))).orderBy("artist_key", nocase(F.col("p_type")), "p_size", "p_partkey").select("p_partkey", "p_name", "p_brand", "artist_key")


@PLANS.query(f"SELECT l_orderkey, position, p_partkey, p_name FROM {ENTRIES} JOIN part ON p_partkey = l_partkey")
def playlist_songs(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates stay, positions close up."""
    songs = table(spark, sf, "part").select("p_partkey", "p_name")
    return entries(spark, sf).join(songs, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "position", "p_partkey", "p_name")


@PLANS.query("SELECT l_orderkey, count(*) AS songs, max(l_linenumber) AS last_position FROM lineitem GROUP BY 1")
def playlist_counts(spark: SparkSession, sf: str) -> DataFrame:
    """D4, D5."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("songs"), F.max("l_linenumber").alias("last_position"))


@PLANS.query(f"""WITH e AS {ENTRIES}, m AS (SELECT l_orderkey, max(position) AS last FROM e GROUP BY 1)
SELECT l_orderkey, l_partkey, position FROM e UNION ALL SELECT o_orderkey, o_custkey, (coalesce(last, -1) + 1)::INT FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def playlist_appended(spark: SparkSession, sf: str) -> DataFrame:
    """One more entry after each playlist's last."""
    have = entries(spark, sf).select("l_orderkey", "l_partkey", "position")
    more = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"))
    return L.appended(have, more, "l_orderkey", ["l_partkey"])


@PLANS.query(f"""WITH e AS {ENTRIES}, s AS (SELECT l_orderkey, l_partkey, CASE WHEN position = 0 THEN 2 WHEN position IN (1, 2) THEN position - 1 ELSE position END AS p FROM e)
SELECT l_orderkey, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY p) - 1)::INT AS position FROM s""")
def playlist_moved(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry of every playlist moved to the third place."""
    return L.moved(entries(spark, sf).select("l_orderkey", "l_partkey", "position"), "l_orderkey", 0, 2)


@PLANS.query("""WITH n AS (SELECT p_type, p_brand, count(*) AS c, min(p_partkey) AS f, max(p_size) AS y FROM part GROUP BY 1, 2)
SELECT p_type, first(p_brand ORDER BY c DESC, f) AS album_artist, max(y) AS year, sum(c)::BIGINT AS song_count FROM n GROUP BY 1""")
def album_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """D1, E3."""
    return L.album_aggregate(table(spark, sf, "part"), "p_type", "p_brand", "p_size", "p_partkey")


@PLANS.query("SELECT p_brand, count(DISTINCT p_type) AS album_count, count(*) AS song_count FROM part GROUP BY 1")
def artist_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """D2."""
    return L.artist_aggregate(table(spark, sf, "part"), "p_brand", "p_type")


@PLANS.query("""SELECT name, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower(name), ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (31 * h + c) % 9223372036854775808)::BIGINT AS id
FROM (SELECT DISTINCT trim(p_type) AS name FROM part WHERE trim(p_type) <> '')""")
def genre_names(spark: SparkSession, sf: str) -> DataFrame:
    """D3, G3, H21."""
    return L.genres(table(spark, sf, "part"), "p_type")


@PLANS.query("""SELECT * FROM (SELECT 'song' AS kind, p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'bo') ORDER BY lower(p_name), p_partkey LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'customer', c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') ORDER BY lower(c_name), c_custkey LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00') ORDER BY lower(s_name), s_suppkey LIMIT 50)""")
def search_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A page of hits for each kind."""
    page = lambda t, key, name, needle: L.search(table(spark, sf, t).select(F.col(key).alias("id"), F.col(name).alias("name")), needle, ["name"], ["name", "id"], 50).select(F.lit({"part": "song"}.get(t, t)).alias("kind"), "id", "name")
    return page("part", "p_partkey", "p_name", "BO").union(page("customer", "c_custkey", "c_name", "00")).union(page("supplier", "s_suppkey", "s_name", "00"))


SNAPSHOTS = "o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderdate < '1999-01-01'), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderdate >= '1995-01-01')"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    old = orders.filter("o_orderdate < '1999-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return old, orders.filter("o_orderdate >= '1995-01-01'").select(F.col("o_orderkey").alias("k"), price.alias("v"))


@PLANS.query(f"WITH {SNAPSHOTS} SELECT count(*) FILTER (o.k IS NULL) AS added, count(*) FILTER (o.v <> n.v) AS updated, count(*) FILTER (n.k IS NULL) AS removed, count(*) FILTER (o.v = n.v) AS unchanged FROM o FULL JOIN n ON o.k = n.k")
def reconcile_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A24, C6, G1, G2."""
    return L.reconcile(*snapshots(spark, sf), "k", ["v"])


@PLANS.query(f"WITH {SNAPSHOTS} SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)")
def merged_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Replace on key."""
    return L.merge_by_key(*snapshots(spark, sf), ["k"])


@PLANS.query(f"WITH {SNAPSHOTS} SELECT k FROM o WHERE k NOT IN (SELECT k FROM n)")
def removed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids only, by anti-join."""
    old, new = snapshots(spark, sf)
    return L.delete_by_ids(old.select("k"), new, "k")


@PLANS.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Entries follow their songs."""
    kept = table(spark, sf, "part").filter("p_size > 25")
    return L.cascade(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), kept, "l_partkey", "p_partkey")


@PLANS.query(f"WITH f AS (SELECT page_id, {PATH} AS path FROM pages), b AS (SELECT DISTINCT regexp_extract(path, '^(.+)/[^/]*$', 1) AS folder FROM f WHERE path LIKE '%/de/%') SELECT page_id, path FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE path = folder OR starts_with(path, folder || '/'))")
def blacklist_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Files under none of the banned folders."""
    all_files = files(spark, sf)
    banned = all_files.filter(F.col("path").like("%/de/%")).select(parent_dir(F.col("path")).alias("folder")).distinct()
    return L.outside(all_files, "path", banned, "folder")


FOLDERS = f"(SELECT array_to_string(p[1:n], '/') AS folder FROM (SELECT string_split(regexp_extract({PATH}, '^(.+)/[^/]*$', 1), '/') AS p FROM pages), range(2, 20) t(n) WHERE n <= len(p))"


@PLANS.query(f"SELECT folder, count(*) AS items FROM {FOLDERS} GROUP BY 1")
def folder_totals(spark: SparkSession, sf: str) -> DataFrame:
    """D8, H4, B15."""
    return L.folder_totals(files(spark, sf), "path")


@PLANS.query(f"""WITH d AS (SELECT regexp_extract({PATH}, '^(.+)/[^/]*$', 1) AS folder, count(*) AS own FROM pages GROUP BY 1), e AS (SELECT DISTINCT folder FROM {FOLDERS}),
c AS (SELECT regexp_extract(folder, '^(.+)/[^/]*$', 1) AS folder, count(*) AS children FROM e GROUP BY 1),
s AS (SELECT e.folder, coalesce(own, 0) AS own, coalesce(children, 0) AS children FROM e LEFT JOIN d USING (folder) LEFT JOIN c USING (folder) WHERE coalesce(own, 0) > 0 OR coalesce(children, 0) <> 1),
u AS (SELECT s.folder, first(a.folder ORDER BY length(a.folder) DESC) AS up FROM s JOIN s a ON starts_with(s.folder, a.folder || '/') GROUP BY 1)
SELECT s.folder, CASE WHEN up IS NULL THEN s.folder ELSE substr(s.folder, length(up) + 2) END AS label, own, children FROM s LEFT JOIN u USING (folder)""")
def folder_chains(spark: SparkSession, sf: str) -> DataFrame:
    """D30."""
    return L.folder_chains(files(spark, sf), "path")


@PLANS.query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id OR l.doc_id = d.n_chars)")
def stale_flags(spark: SparkSession, sf: str) -> DataFrame:
    """An OR of two keys as two anti-joins."""
    return L.stale(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id", "n_chars", "doc_id")


@PLANS.query("SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id OR l.doc_id = d.n_chars)")
def flagged_by_either(spark: SparkSession, sf: str) -> DataFrame:
    """A22."""
    return L.known_by_either(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id", "n_chars", "doc_id")


@PLANS.query("SELECT user_id, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id, first(event_type ORDER BY ts DESC, event_id DESC) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """By partial aggregation, no window."""
    return L.latest_per(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@PLANS.query("SELECT p_partkey, p_name, l_orderkey * 100 + l_linenumber AS position FROM lineitem JOIN part ON p_partkey = l_partkey")
def songs_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The caller's order, repeats kept."""
    ids = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"))
    return L.in_order_of(table(spark, sf, "part").select("p_partkey", "p_name"), ids, "p_partkey", "position")


@PLANS.query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
CASE WHEN p_size * 100 >= 3600 THEN format('{}:{:02d}:{:02d}', p_size * 100 // 3600, p_size * 100 % 3600 // 60, p_size * 100 % 60) ELSE format('{}:{:02d}', p_size * 100 // 60, p_size * 100 % 60) END AS duration FROM part""")
def formatted_songs(spark: SparkSession, sf: str) -> DataFrame:
    """H5, H33."""
    return table(spark, sf, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"), format_duration(F.col("p_size").cast("long") * 100_000).alias("duration"))


@PLANS.query("SELECT o_orderkey, sha256(o_orderkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority) AS key FROM orders")
def render_keys(spark: SparkSession, sf: str) -> DataFrame:
    """H24."""
    from tonearm.functions.text import render_key

    return table(spark, sf, "orders").select("o_orderkey", render_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


@PLANS.query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_shipdate > '1999-06-01' AND l_quantity >= 20")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A2: both predicates are pushed to the Parquet scan."""
    rows = L.scan_incremental(table(spark, sf, "lineitem"), "l_shipdate", "1999-06-01")
    return rows.filter("l_quantity >= 20").select("l_orderkey", "l_linenumber", "l_returnflag")


@PLANS.query(f"SELECT page_id, len(string_split({PATH}, '/')) - 2 AS depth FROM pages")
def folder_depths(spark: SparkSession, sf: str) -> DataFrame:
    """H3, H4, N8."""
    return files(spark, sf).select("page_id", F.size(path_prefixes(parent_dir(F.col("path")))).cast("long").alias("depth"))
