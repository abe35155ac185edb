"""Streams drained from files give what their batch twins give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonearm.sources.versions import Versions
from tonearm.streaming import live
from tonearm.streaming.backlog import Backlog

SF = "/root/testdata/sf0.001"


def drain(stream, mode, tmp_path, name):
    got = []
    q = live.drained(stream, mode, str(tmp_path / f"cp-{name}"), lambda b, n: got.extend(b.collect()))
    q.awaitTermination(120)
    assert q.exception() is None
    return got


def source(spark, tmp_path, df, name="in"):
    path = str(tmp_path / name)
    df.coalesce(1).write.mode("append").parquet(path)
    return live.read_table(spark, path, df, 1)


def test_counts_and_multipliers(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = source(spark, tmp_path, events)
    got = {r.event_type: r.n for r in drain(live.live_counts(stream, ["event_type"]), "complete", tmp_path, "a")}
    assert got == {r.event_type: r.n for r in live.live_counts(events, ["event_type"]).collect()}
    rate = lambda df: df.select("user_id", (F.col("value") / 200).alias("rating"), (F.col("event_type") == "view").alias("implicit"))
    got = {r.user_id: round(r.multiplier, 9) for r in drain(live.running_multipliers(rate(stream), ["user_id"], "rating", "implicit"), "complete", tmp_path, "b")}
    assert got == {r.user_id: round(r.multiplier, 9) for r in live.running_multipliers(rate(events), ["user_id"], "rating", "implicit").collect()}


def test_changes_and_lru(spark, tmp_path):
    rows = [("u", i, v) for i, v in enumerate(["a", "a", "b", "b", "a"])] + [("w", 1, "x")]
    df = spark.createDataFrame(rows, "k string, at long, v string")
    got = drain(live.changes(source(spark, tmp_path, df, "c"), "k", "at", "v"), "append", tmp_path, "c")
    assert sorted((r.k, r.at, r.v) for r in got) == [("u", 2, "b"), ("u", 4, "a")]
    got = drain(live.once_lru(source(spark, tmp_path, df, "d"), "k", "v", "at", 1), "append", tmp_path, "d")
    assert sorted((r.k, r.at, r.v) for r in got) == [("u", 0, "a"), ("u", 2, "b"), ("u", 4, "a"), ("w", 1, "x")]


def test_sessions_and_skips(spark, tmp_path):
    ts = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    skips = spark.createDataFrame([("u", ts(5), 1), ("u", ts(25), 2), ("u", ts(60), 3), ("u", ts(9000), 4)], "user string, at timestamp, skip int")
    plays = spark.createDataFrame([("u", ts(0), ts(10), "a", "b", "s"), ("u", ts(9000), ts(9001), "c", "d", "s")], "user string, start timestamp, end timestamp, a string, b string, strategy string")
    want = {(1, "DURING"), (2, "JUST_AFTER"), (4, "DURING")}
    assert {(r.skip, r.kind) for r in live.attributed_skips(plays, skips).collect()} == want
    got = drain(live.attributed_skips(source(spark, tmp_path, plays, "p"), source(spark, tmp_path, skips, "s")), "append", tmp_path, "s")
    assert {(r.skip, r.kind) for r in got} == want
    assert sorted(r.n for r in live.sessions(skips, "user", "at", "30 seconds").collect()) == [1, 1, 2]
    got = drain(live.once(source(spark, tmp_path, skips.withColumn("skip", F.lit(1)), "o"), ["user", "skip"], "at"), "append", tmp_path, "o")
    assert len(got) == 1


def test_merge_batches(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    two = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    source(spark, tmp_path, one, "m")
    stream = source(spark, tmp_path, two, "m")
    sink = live.merging(str(tmp_path / "t"), ["id"], 4)
    live.drained(stream, "append", str(tmp_path / "cp-m"), sink).awaitTermination(120)
    table = Versions(spark, str(tmp_path / "t"), ["id"])
    held = lambda: sorted((r.id, r.v) for r in table.read().collect())
    assert held() == [(1, "a"), (2, "c"), (3, "d")]
    sink(two, 1)  # a batch that is run again
    assert held() == [(1, "a"), (2, "c"), (3, "d")]


def test_newest_row_wins_whole_batches_only(spark, tmp_path):
    """Rows of a key by sequence, within a batch and over batches; new columns stay; a stopped merge is not seen."""
    table = Versions(spark, str(tmp_path / "t"), ["id"], "n", 8)
    assert table.read() is None
    rows = [(i % 500, i, f"v{i}") for i in range(3000)]
    random.Random(1).shuffle(rows)
    table.merge(spark.createDataFrame(rows[:1500], "id int, n long, v string").repartition(7), 0)
    early = table.read()
    table.merge(spark.createDataFrame([(*r, True) for r in rows[1500:]], "id int, n long, v string, extra boolean").repartition(5), 1)
    want = {i: 2500 + i for i in range(500)}
    first = {r[1] for r in rows[:1500]}
    got = table.read().collect()
    assert {r.id: r.n for r in got} == want and all(r.v == f"v{r.n}" and r.extra == (None if r.n in first else True) for r in got)
    best = {}
    for i, n, _ in rows[:1500]:
        best[i] = max(best.get(i, -1), n)
    assert {r.id: r.n for r in early.collect()} == best  # a reader that began before goes on with what it has
    before = table.manifest()
    with pytest.raises(ZeroDivisionError):
        broken = Versions(spark, str(tmp_path / "t"), ["id"], "n", 8)
        broken.commit = lambda *a: 1 / 0  # stops after its files are written
        broken.merge(spark.createDataFrame([(1, 10**6, "lost")], "id int, n long, v string"), 2)
    assert table.manifest() == before and {r.id: r.n for r in table.read().collect()} == want
    table.merge(spark.createDataFrame([(1, 10**6, "new"), (2, 0, "old")], "id int, n long, v string"), 2)
    table.merge(spark.createDataFrame([(1, 10**7, "replay")], "id int, n long, v string"), 2)
    assert {r.id: r.n for r in table.read().collect()} == want | {1: 10**6}
    table.merge(spark.createDataFrame([], "id int, n long, v string"), 3)
    assert table.read().count() == 500


def hot_key(n):
    """Rows of one key with few values, shuffled over a day, and two rows of others that let time pass."""
    start = datetime(2024, 1, 1)
    rng = random.Random(n)
    rows = [("u", start + timedelta(seconds=i), f"v{rng.randrange(400)}" if rng.random() < 0.5 else "same") for i in range(n)]
    rng.shuffle(rows)
    return rows, [("z", start + timedelta(days=9), "end")]


@pytest.mark.parametrize("batch_rows", ["256", "10000"])
def test_event_order_over_triggers(spark, tmp_path, batch_rows):
    """50,000 shuffled rows of one key over several triggers give what the batch gives, whatever the Arrow batches."""
    rows, end = hot_key(50_000)
    schema = "k string, at timestamp, v string"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        every = spark.createDataFrame(rows, schema)
        for i in range(4):  # within the watermark: out of order by less than the first row's lead
            source(spark, tmp_path, spark.createDataFrame(rows[i::4], schema), "in")
        stream = source(spark, tmp_path, spark.createDataFrame(end, schema), "in")
        for name, f in (("changes", lambda df: live.changes(df, "k", "at", "v")), ("lru", lambda df: live.once_lru(df, "k", "v", "at", 8))):
            late = live.stepped
            live.stepped = lambda *a, **b: late(*a, **b, late="30 hours")  # noqa: B023
            try:
                got = drain(f(stream), "append", tmp_path, name)
            finally:
                live.stepped = late
            want = f(every).collect()
            assert sorted((r.at, r.v) for r in got if r.k == "u") == sorted((r.at, r.v) for r in want) and len(want) > 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last, plain = None, []
    for _, at, v in sorted(rows):
        if last is not None and v != last:
            plain.append((at, v))
        last = v
    assert sorted((r.at, r.v) for r in live.changes(every, "k", "at", "v").collect()) == plain


def test_resets_in_event_order(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(4)
    rows = [("u", start + timedelta(seconds=i), float(rng.randrange(5)), rng.random() < 0.3, rng.random() < 0.001) for i in range(20_000)]
    shuffled = rng.sample(rows, len(rows))
    schema = "k string, at timestamp, rating double, soft boolean, reset boolean"
    for i in range(3):
        source(spark, tmp_path, spark.createDataFrame(shuffled[i::3], schema), "in")
    stream = source(spark, tmp_path, spark.createDataFrame([("z", start + timedelta(days=9), 0.0, False, False)], schema), "in")
    late = live.stepped
    live.stepped = lambda *a, **b: late(*a, **b, late="30 hours")
    try:
        got = drain(live.running_multipliers(stream, ["k"], "rating", "soft", F.col("reset"), "at"), "update", tmp_path, "r")
    finally:
        live.stepped = late
    want = live.running_multipliers(spark.createDataFrame(rows, schema), ["k"], "rating", "soft", F.col("reset"), "at").first()
    mine = [r for r in got if r.k == "u"][-1]
    assert (mine.n, mine["sum"], mine.implicit_n, mine.implicit_sum) == (want.n, want["sum"], want.implicit_n, want.implicit_sum)


def test_trigger_order_without_timestamps(spark, tmp_path):
    """One change in 2,000 rows of one key, whatever the Arrow batches."""
    df = spark.createDataFrame([("u", i, "a" if i < 1200 else "b") for i in random.Random(2).sample(range(2000), 2000)], "k string, at long, v string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    try:
        got = drain(live.changes(source(spark, tmp_path, df, "c"), "k", "at", "v"), "append", tmp_path, "c")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.at, r.v) for r in got] == [(1200, "b")] == [(r.at, r.v) for r in live.changes(df, "k", "at", "v").collect()]


def test_resets_clear_what_was_learned(spark, tmp_path):
    rows = [("u", 1, 1.0, False, False), ("u", 2, 1.0, True, False), ("u", 3, 0.0, False, True), ("u", 4, 0.5, False, False), ("w", 1, 1.0, False, False)]
    df = spark.createDataFrame(rows, "k string, at long, rating double, soft boolean, reset boolean")
    want = {("u", 1, 0.5, 0), ("w", 1, 1.0, 0)}
    batch = live.running_multipliers(df, ["k"], "rating", "soft", F.col("reset"), "at")
    assert {(r.k, r.n, r["sum"], r.implicit_n) for r in batch.collect()} == want
    got = drain(live.running_multipliers(source(spark, tmp_path, df, "r"), ["k"], "rating", "soft", F.col("reset"), "at"), "update", tmp_path, "r")
    assert {(r.k, r.n, r["sum"], r.implicit_n) for r in got} == want


def worker():
    """A worker that always fails for some ids, gives nothing for some, and is good for the rest."""

    def analysed(batches):
        for b in batches:
            out = b.assign(bpm=b["id"] * 10.0, error=[None if i % 10 else "bad" for i in b["id"]])
            yield out[out["id"] % 7 != 1][["id", "bpm", "error"]]

    return analysed


def test_backlog_loses_nothing(spark, tmp_path):
    """A limit spreads the work over rounds; failed rows are tried again up to a limit; replays change nothing."""
    stream = source(spark, tmp_path, spark.range(2000), "b")
    queue = Backlog(spark, str(tmp_path / "q"), "id", worker(), "id long, bpm double, error string", 700, 2, 4)
    live.drained(stream, "append", str(tmp_path / "cp-b"), live.working(str(tmp_path / "q"), "id", worker(), "id long, bpm double, error string", 700, 2)).awaitTermination(300)
    bad = {i for i in range(2000) if i % 10 == 0 or i % 7 == 1}
    held = lambda: {r.id: (r.status, r.tries, r.bpm, r.error) for r in queue.table.read().collect()}
    want = {i: ("failed", 2, None if i % 7 == 1 else i * 10.0, "no result" if i % 7 == 1 else "bad") if i in bad else ("done", 1, i * 10.0, None) for i in range(2000)}
    assert held() == want
    assert {(r.status, r.n) for r in queue.progress().collect()} == {("done", 2000 - len(bad)), ("failed", len(bad))}
    queue.sink(spark.range(2000), 0)
    assert held() == want


def test_backlog_takes_up_what_died(spark, tmp_path):
    queue = Backlog(spark, str(tmp_path / "q"), "id", worker(), "id long, bpm double, error string", 10, 2, 2)
    queue.offer(spark.range(2, 6), 0)
    real = queue.table.merge

    def dies(batch, number):
        if queue.table.manifest()[1] == number - 1 and not batch.filter("status in ('done', 'waiting')").isEmpty():
            raise RuntimeError("killed")
        real(batch, number)

    queue.table.merge = dies
    with pytest.raises(RuntimeError):
        queue.work()
    queue.table.merge = real
    assert {(r.status, r.tries) for r in queue.table.read().collect()} == {("claimed", 1)}
    queue.offer(spark.range(4, 8), 1)
    while queue.work():
        pass
    assert {r.id: (r.status, r.tries) for r in queue.table.read().collect()} == {2: ("done", 2), 3: ("done", 2), 4: ("done", 2), 5: ("done", 2), 6: ("done", 1), 7: ("done", 1)}


def test_combined_views(spark, tmp_path):
    a = spark.createDataFrame([(1, 5), (3, 6)], "at long, n long")
    b = spark.createDataFrame([(2, "x")], "at long, v string")
    got = drain(live.combined({"a": (source(spark, tmp_path, a, "va"), "n", "at"), "b": (source(spark, tmp_path, b, "vb"), "v", "at")}), "complete", tmp_path, "v")
    assert {(r.view, r.value) for r in got} >= {("a", "6"), ("b", "x")}
