"""The library as DataFrame operators: scans, reconcile, merges, searches, playlists, aggregates (ids A, B, C, D1-D8, E1-E3, F, G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.text import alignment_distance, blank_to_null, deletions, disc_of, nocase, parent_dir, path_prefixes, stable_id, suggestion_limit, track_of
from tonearm.functions.frames import together

# -- scans and ingest


def scan_library(media: DataFrame, min_duration_s: int = 0) -> DataFrame:
    """A1: the music of a catalogue; both predicates reach the source."""
    return media.filter(F.col("is_music") & (F.col("duration_ms") >= min_duration_s * 1000))


def scan_incremental(df: DataFrame, column: str, high_water: object) -> DataFrame:
    """A2: rows changed since the stored mark; no mark is a full scan."""
    return df if high_water is None else df.filter(F.col(column) > F.lit(high_water))


def normalise(media: DataFrame) -> DataFrame:
    """A4: blanks to null, title from the file's stem, unknown artist and album, track and disc from the raw number."""
    stem = F.regexp_extract(F.col("path"), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return media.withColumns(
        {
            "title": F.coalesce(blank_to_null(F.col("title")), blank_to_null(stem), F.lit("<unknown>")),
            "artist": F.coalesce(blank_to_null(F.col("artist")), F.lit("<unknown>")),
            "album": F.coalesce(blank_to_null(F.col("album")), F.lit("<unknown>")),
            "genre": blank_to_null(F.col("genre")),
            "track": track_of(F.col("raw_track")),
            "disc": disc_of(F.col("raw_track")),
        }
    )


def last_membership(members: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """A5: one value for each key, the last one wins (ties: the greater value)."""
    return members.groupBy(key).agg(F.max_by(value, F.struct(ordinal, value)).alias(value))


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; one shuffle by key."""
    both = together(old.withColumn("__turn", F.lit(0)), new.withColumn("__turn", F.lit(1)))
    own = Window.partitionBy(*keys).orderBy(F.desc("__turn"))
    return both.withColumn("__place", F.row_number().over(own)).filter("__place = 1").drop("__turn", "__place")


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent is left."""
    return child.join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def known_by_either(df: DataFrame, found: DataFrame, uri: str, path: str, by: str) -> DataFrame:
    """Rows found by uri or by path: two equi-joins instead of a nested loop over an OR."""
    marks = found.select(F.col(by).alias("__mark")).filter("__mark is not null").distinct()
    by_uri = df.join(marks, F.col(uri) == F.col("__mark"), "left_semi")
    rest = df.join(marks, F.col(uri) == F.col("__mark"), "left_anti")
    return together(by_uri, rest.join(marks, F.col(path) == F.col("__mark"), "left_semi"))


def stale(df: DataFrame, found: DataFrame, uri: str, path: str, by: str) -> DataFrame:
    """Rows found neither by uri nor by path: two anti-joins."""
    marks = found.select(F.col(by).alias("__mark")).filter("__mark is not null").distinct()
    return df.join(marks, F.col(uri) == F.col("__mark"), "left_anti").join(marks, F.col(path) == F.col("__mark"), "left_anti")


def reconcile(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Counts of added, updated, removed and unchanged rows between two snapshots."""
    digest = F.xxhash64(*compare)
    a, b = old.select(F.col(key).alias("k"), digest.alias("a")), new.select(F.col(key).alias("k"), digest.alias("b"))
    both = a.join(b, "k", "full_outer")
    count = lambda c: F.count_if(c)
    return both.agg(
        count(F.col("a").isNull()).alias("added"),
        count(F.col("a") != F.col("b")).alias("updated"),
        count(F.col("b").isNull()).alias("removed"),
        count(F.col("a") == F.col("b")).alias("unchanged"),
    )


def in_order_of(df: DataFrame, ids: DataFrame, key: str, position: str) -> DataFrame:
    """Rows in the caller's order; missing ids are skipped, repeated ones repeated."""
    return ids.select(F.col(key).alias("__id"), F.col(position).alias("__at")).join(df, F.col("__id") == F.col(key)).orderBy("__at").drop("__id").withColumnRenamed("__at", position)


def shadowed(built_in: DataFrame, own: DataFrame, key: str, valid: Column | None = None) -> DataFrame:
    """Named items; a built-in shadows a user's item, or, where `valid` is given, a valid user's item shadows it."""
    rank = F.lit(1) if valid is None else F.when(valid, -1).otherwise(1)
    both = together(built_in.withColumn("__rank", F.lit(0)), own.withColumn("__rank", rank))
    return both.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy("__rank"))).filter("__place = 1").drop("__rank", "__place")


# -- filters and searches


def outside(df: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """Rows at or under none of the folders: an equi anti-join on the path's own prefixes, so the list may be long."""
    banned = folders.select(F.rtrim(F.regexp_replace(folder, "/+$", "")).alias("__folder")).filter("__folder <> ''").distinct()
    hit = df.select(path).distinct().select(F.col(path).alias("__path"), F.explode(path_prefixes(F.col(path))).alias("__folder")).join(banned, "__folder", "left_semi").select("__path").distinct()
    return df.join(hit, F.col(path) == F.col("__path"), "left_anti")


def in_folder(df: DataFrame, path: str, folder: str) -> DataFrame:
    """Directly in a folder."""
    return df.filter(parent_dir(F.col(path)) == folder)


def under_folder(df: DataFrame, path: str, folder: str) -> DataFrame:
    """At or under a folder."""
    return df.filter((F.col(path) == folder) | F.col(path).startswith(folder.rstrip("/") + "/"))


def search(df: DataFrame, needle: str, columns: list[str], order: list[str], limit: int, fold=nocase) -> DataFrame:
    """Rows that hold a needle in any column, ordered by folded columns, limited as a search page is."""
    wanted = fold(F.lit(needle))
    hit = reduce(Column.__or__, [F.coalesce(F.contains(fold(F.col(c)), wanted), F.lit(False)) for c in columns])
    return df.filter(hit).orderBy(*[fold(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c) for c in order]).limit(limit)


def low_confidence(df: DataFrame) -> DataFrame:
    """Tracks with a weak grid, key or tempo, and why."""
    gates = (("grid", 0.5), ("key", 0.6), ("tempo", 0.5))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"{n}_confidence"), F.lit(0.0)) < g, F.lit(n)) for n, g in gates]))
    return df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


# -- playlists


def numbered(entries: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Positions 0 to n - 1 within each group."""
    return entries.withColumn("position", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("int"))


def appended(entries: DataFrame, more: DataFrame, group: str, order: list[str]) -> DataFrame:
    """More entries after each group's last position."""
    last = entries.groupBy(group).agg(F.max("position").alias("__last"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    placed = more.join(last, group, "left").withColumn("position", (F.coalesce("__last", F.lit(-1)) + place).cast("int")).drop("__last")
    return together(entries, placed.select(entries.columns))


def moved(entries: DataFrame, group: str, old: int, new: int) -> DataFrame:
    """The entry at one position moved to another, the others closing up."""
    p = F.col("position")
    shift = F.when(p == old, F.lit(new)).when((p > old) & (p <= new), p - 1).when((p < old) & (p >= new), p + 1).otherwise(p)
    return numbered(entries.withColumn("position", shift), [group], [F.col("position")])


# -- aggregates


def album_aggregate(songs: DataFrame, album: str, artist: str, year: str, key: str) -> DataFrame:
    """Artist named most (ties: the first seen), latest year, songs."""
    named = songs.groupBy(album, artist).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(year).alias("y"))
    best = F.max_by(artist, F.struct("n", (-F.col("first")).alias("first")))
    return named.groupBy(album).agg(best.alias("album_artist"), F.max("y").alias("year"), F.sum("n").cast("long").alias("song_count"))


def artist_aggregate(songs: DataFrame, artist: str, album: str) -> DataFrame:
    """D2."""
    return songs.groupBy(artist).agg(F.count_distinct(album).alias("album_count"), F.count("*").alias("song_count"))


def genres(songs: DataFrame, genre: str) -> DataFrame:
    """D3: distinct genres with stable ids."""
    return songs.select(F.trim(genre).alias("name")).filter("name <> ''").distinct().withColumn("id", stable_id(F.col("name")))


def folder_totals(df: DataFrame, path: str) -> DataFrame:
    """Items under each folder, at any depth: prefixes exploded, then counted with partial sums."""
    return df.select(F.explode(path_prefixes(parent_dir(F.col(path)))).alias("folder")).groupBy("folder").agg(F.count("*").alias("items"))


def folder_chains(df: DataFrame, path: str) -> DataFrame:
    """The folders that a tree shows: those with items of their own or other than one child; label: path below the nearest shown ancestor."""
    direct = df.select(parent_dir(F.col(path)).alias("folder")).filter("folder <> ''").groupBy("folder").agg(F.count("*").alias("own"))
    every = direct.select(F.explode(path_prefixes(F.col("folder"))).alias("folder")).distinct()
    children = every.select(parent_dir(F.col("folder")).alias("folder")).filter("folder <> ''").groupBy("folder").agg(F.count("*").alias("children"))
    tree = every.join(direct, "folder", "left").join(children, "folder", "left").na.fill(0, ["own", "children"])
    shown = tree.filter("own > 0 or children <> 1")
    above = shown.select("folder", F.explode(path_prefixes(parent_dir(F.col("folder")))).alias("up")).join(shown.select(F.col("folder").alias("up")), "up", "left_semi")
    near = above.groupBy("folder").agg(F.max_by("up", F.length("up")).alias("up"))
    label = F.when(F.col("up").isNull(), F.col("folder")).otherwise(F.substring(F.col("folder"), F.length("up") + 2, F.length("folder")))
    return shown.join(near, "folder", "left").select("folder", label.alias("label"), "own", "children")


def play_counts(history: DataFrame, song: str, at: str) -> DataFrame:
    """D6."""
    return history.groupBy(song).agg(F.count("*").alias("plays"), F.max(at).alias("last_played"))


# -- queues


def same_items(a: Column, b: Column) -> Column:
    """Is one list a permutation of the other?"""
    return F.sort_array(a) == F.sort_array(b)


def shuffled(queue: DataFrame, group: str, seed: int, current: Column) -> DataFrame:
    """The current item first, the others by a seeded hash: the same seed gives the same order, anywhere."""
    return numbered(queue, [group], [F.when(current, 0).otherwise(1), F.xxhash64(F.lit(seed), F.col("item"), F.col("position")), F.col("position")])


def played_next(queue: DataFrame, more: DataFrame, group: str, current: str) -> DataFrame:
    """More (group, item, ordinal) right after each queue's current position; queue: group, item, position, with column `current`."""
    here = queue.groupBy(group).agg(F.max(current).alias("__at"))
    n = more.groupBy(group).agg(F.count("*").alias("__n"))
    shifted = queue.join(here.join(n, group), group, "left").withColumn("position", F.when(F.col("position") > F.col("__at"), F.col("position") + F.col("__n")).otherwise(F.col("position")).cast("int"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("ordinal"))
    added = more.join(here, group).withColumns({"position": (F.col("__at") + place).cast("int"), current: F.col("__at")})
    return together(shifted.select(queue.columns), added.select(queue.columns))


def removed(queue: DataFrame, group: str, gone: Column) -> DataFrame:
    """A queue without some entries, positions closed up."""
    return numbered(queue.filter(~F.coalesce(gone, F.lit(False))), [group], [F.col("position")])


def restored(queue: DataFrame, group: str, original: str) -> DataFrame:
    """A shuffled queue in the order it had before."""
    return numbered(queue, [group], [F.col(original)])


def replaced_tail(queue: DataFrame, group: str, anchor: int, wanted: DataFrame) -> DataFrame:
    """The items after an anchor in a new order, where it is a permutation of them; else the queue stays."""
    tail = queue.filter(F.col("position") > anchor).groupBy(group).agg(F.sort_array(F.collect_list("item")).alias("__have"))
    new = wanted.groupBy(group).agg(F.sort_array(F.collect_list("item")).alias("__want"))
    good = tail.join(new, group).filter("__have = __want").select(group)
    order = F.row_number().over(Window.partitionBy(group).orderBy("position"))
    moved_ = wanted.join(good, group, "left_semi").withColumn("position", (order + anchor).cast("int"))
    kept = together(queue.filter(F.col("position") <= anchor), queue.filter(F.col("position") > anchor).join(good, group, "left_anti"))
    return together(kept, moved_.select(queue.columns))


# -- everyday reads and edits


def by_id(df: DataFrame, key: str, *ids: object) -> DataFrame:
    """B1, B2: rows of one or a few ids; the predicate reaches the source. Long lists go through in_order_of(), a join."""
    return df.filter(F.col(key) == F.lit(ids[0]) if len(ids) == 1 else F.col(key).isin(*ids))


def of_album(songs: DataFrame, album: object) -> DataFrame:
    """An album's songs by disc, track, title."""
    return songs.filter(F.col("album_id") == F.lit(album)).orderBy("disc", "track", nocase(F.col("title")), "id")


def of_artist(songs: DataFrame, artist: object) -> DataFrame:
    """An artist's songs by album, disc, track."""
    return songs.filter(F.col("artist_id") == F.lit(artist)).orderBy(nocase(F.col("album")), "disc", "track", "id")


def of_genre(songs: DataFrame, genres_: DataFrame, genre_id: Column) -> DataFrame:
    """A genre's songs, found by the genre's id and joined by its name."""
    return songs.join(genres_.filter(genre_id).select(F.col("name").alias("genre")), "genre").orderBy(nocase(F.col("artist")), nocase(F.col("album")), "disc", "track", "id")


def live_search(df: DataFrame, needle: str, columns: list[str], limit: int) -> DataFrame:
    """Rows that hold the trimmed, lower-case needle in any column, in the table's own order by its first column; nothing for fewer than two letters."""
    wanted = needle.strip().lower()
    if len(wanted) < 2:
        return df.limit(0)
    hit = reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False)) for c in columns])
    return df.filter(hit).orderBy(nocase(F.col(columns[0])), *df.columns).limit(limit)


def backlog(songs: DataFrame, limit: int) -> DataFrame:
    """The newest songs without an analysis, a batch of them; the limit is the batch."""
    return songs.filter("not has_analysis").orderBy(F.desc("date_added"), "id").limit(limit)


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The table with some columns of the rows that match set anew."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


SORTS = {
    "title": lambda: [nocase(F.col("title"))],
    "artist": lambda: [nocase(F.col("artist")), nocase(F.col("album")), "disc", "track"],
    "album": lambda: [nocase(F.col("album")), "disc", "track"],
    "date_added": lambda: [F.desc("date_added"), nocase(F.col("title"))],
    "duration": lambda: [F.desc("duration_ms"), nocase(F.col("title"))],
    "year": lambda: [F.desc("year"), F.lower("album"), "track"],
}


def sorted_songs(songs: DataFrame, sort: str) -> DataFrame:
    """the songs in one of the library's orders; ids break ties."""
    return songs.orderBy(*SORTS[sort](), "id")


def by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    """artists, genres, playlists, presets by name."""
    return df.orderBy(nocase(F.col(name)), key)


def sorted_albums(albums: DataFrame, sort: str) -> DataFrame:
    """albums by title, by year (newest first), or an artist's by year (oldest first)."""
    order = {"title": [nocase(F.col("title"))], "year": [F.desc("year"), nocase(F.col("title"))], "artist": ["artist", "year", nocase(F.col("title"))]}
    return albums.orderBy(*order[sort], "id")


def recent_logs(logs: DataFrame, limit: int, a: object = None, b: object = None) -> DataFrame:
    """F8: the newest log rows, of one pair where it is given."""
    if a is not None:
        logs = logs.filter((F.col("a") == F.lit(a)) & (F.col("b") == F.lit(b)))
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def suggested(words: DataFrame, dictionary: DataFrame, word: str, name: str) -> DataFrame:
    """(word, suggestion, distance): for each distinct word the nearest name of a dictionary within its limit, else nulls.

    An index of deletion neighbourhoods: a word and a name within d edits (a swap of neighbours is one) have a common
    remainder after at most d deletions from each, so candidates come from one equi-join on remainders, and the distance
    is worked out for these alone. Case does not count; of equally near names the first by name is offered. Names are
    short: a name of n letters has about n^3 / 6 remainders where its limit is 3.
    """
    limit = suggestion_limit(F.col("word"))
    asked = words.select(F.col(word).alias("word")).filter("word is not null").distinct().withColumns({"low": F.lower("word"), "most": limit})
    left = asked.select("word", "low", "most", F.explode(F.when(F.col("most") == 1, deletions(F.col("low"), 1)).when(F.col("most") == 2, deletions(F.col("low"), 2)).otherwise(deletions(F.col("low"), 3))).alias("rest"))
    names = dictionary.select(F.col(name).alias("name")).filter("name is not null").distinct()
    index = names.select("name", F.explode(deletions(F.lower("name"), 3)).alias("rest"))
    near = left.join(index, "rest").select("word", "low", "most", "name").distinct()
    scored = near.withColumn("distance", alignment_distance(F.col("low"), F.lower("name"))).filter(F.col("distance") <= F.col("most"))
    best = scored.groupBy("word").agg(F.min(F.struct("distance", "name")).alias("b"))
    return asked.select("word").join(best, "word", "left").select("word", F.col("b.name").alias("suggestion"), F.col("b.distance").alias("distance"))
