"""Prefix trie of conversations by the splitter-skeleton method.

A conversation is a path of turn keys (128-bit digests of role and text; lengths go along, texts do not). Equal paths
are counted once, then the paths are cut into ranges by splitters. A node, that is a distinct prefix, has its
conversations next to one another in the order of paths, so only a prefix of some splitter can be spread over ranges:
these prefixes form the skeleton, which every task gets. Each range is walked in order with one stack of open nodes.
All nodes beyond the skeleton are finished there, their rows given as soon as their parent is known; nodes of the
skeleton give partial sums, which one reduction adds up. Only the children of the skeleton's nodes need to be told their
parent's conversation afterwards, by a join with the skeleton.

The skeleton has at most SKELETON nodes: splitters are a sample of about SAMPLE_TURNS turns, drawn by digest so that a
task that runs again draws the same, and every second one goes until the skeleton fits. A task holds the open nodes of
one path and their finished children.

The ids that end at one node go through one digest in order: they are dealt by range of (path, id), joined to texts of
at most IDS ids where they lie, and these streamed; nothing holds the list.

Cases: null role or text is empty; null turns come first, turns of one number are ordered by role, then by key;
repeated rows count each; rows without a conv_id belong to no conversation; a conversation whose rebuilt path is empty
ends at the root; an empty table has no nodes; a negative id has its base by truncated division; a very long text is
digested where it is read; a conversation is gathered as its keys and lengths; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm.common import Tables, table

#: Nodes of the skeleton, at most; turns of the sample of splitters, about; turns of one splitter.
SKELETON, SAMPLE_TURNS, SPLITTER_TURNS = 1 << 16, 1 << 18, 1 << 15
#: Ids joined to one text.
IDS = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROWS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node int, parent int, size int"
NODE = ROWS.partition(", node")[0]


def turn_key(role: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def paths(convs: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes) of a table (conv_id, turn, role, text): each conversation's turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = convs.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.length(text).alias("size")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def with_heads(own: DataFrame, group: int, most: int) -> DataFrame:
    """Each conversation c with its first h turns (h from the id, under `most`) taken from conversation c - c % group."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = own.filter(c % group == 0).select(c.alias("base"), F.slice("keys", 1, most - 1).alias("head_keys"), F.slice("sizes", 1, most - 1).alias("head_sizes"))
    both = own.withColumns({"base": c - c % group, "h": h}).join(heads, "base", "left")
    rest = lambda x: F.slice(x, F.col("h") + 1, F.size(x))
    head = lambda x, kind: F.coalesce(F.slice(x, F.lit(1), F.col("h")), F.expr(f"cast(array() as array<{kind}>)"))
    return both.select("conv_id", F.concat(head("head_keys", "string"), rest("keys")).alias("keys"), F.concat(head("head_sizes", "int"), rest("sizes")).alias("sizes"))


def ends(members: DataFrame) -> DataFrame:
    """(path, conv_id) to (path, ends_sha256): the digest of a path's ids in order, joined by commas."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, ids = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))])], names=["path", "first", "ids"])

        for batch in batches:
            for p, i in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and (p != path or len(ids) == IDS):
                    yield out()
                    ids = []
                if not ids:
                    path, first = p, i
                ids.append(i)
        if ids:
            yield out()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for p, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if p != path:
                    if digest:
                        done.append((path, digest.hexdigest()))
                    path, digest = p, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["path", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "ends_sha256"])

    texts = members.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(joined, "path string, first long, ids string")
    return texts.repartition(parts, "path").sortWithinPartitions("path", "first").mapInArrow(digested, "path string, ends_sha256 string")


def shared_length(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Skeleton:
    """The trie of the splitters' prefixes; node 0 is the root."""

    def __init__(self, splitters: list[list[str]]):
        self.splitters = splitters
        self.children: list[dict[str, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path in splitters:
            node = 0
            for key in path:
                if key not in self.children[node]:
                    self.children[node][key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.children.append({})
                node = self.children[node][key]


def skeleton_of(sample: list[list[str]], ranges: int, most: int = SKELETON) -> Skeleton:
    """Splitters for about `ranges` ranges from a sample of paths, each cut after the turn that tells it from the one before."""
    ordered = sorted(set(map(tuple, sample)))
    every = max(1, len(ordered) // max(1, ranges))
    chosen = [list(p) for p in ordered[every // 2 :: every]]
    while True:
        cut = [p[: shared_length(chosen[i - 1], p) + 1 if i else 1] for i, p in enumerate(chosen)]
        skeleton = Skeleton([p for p in cut if p])
        if len(skeleton.parent) <= most or len(chosen) <= 1:
            return skeleton
        chosen = chosen[::2]


class Open:
    """A node on the stack: sums so far, and finished children that wait for its conversation."""

    __slots__ = ("size", "node", "least", "convs", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, size: int, node: int):
        self.size, self.node, self.least, self.convs, self.children, self.leaves, self.saved, self.ends, self.waiting = size, node, None, 0, 0, 0, 0, None, []


def walk(rows: Iterator[tuple], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows (range, keys, sizes, n, least, ends) in order to rows as in ROWS.

    Finished nodes have node -1 and their parent's conversation, or parent, a node of the skeleton. Nodes of the
    skeleton give partial sums under their number: n_children counts children beyond the skeleton, n_leaves and
    saved_tokens are of the node and of what is beyond the skeleton below it, saved_tokens as if one more conversation
    were there for each node (its own size is taken off once, where parts are added up).
    """
    stack: list[Open] = []
    keys: list[str] = []

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            top = stack.pop()
            at = len(stack)
            if not top.children and not (top.node >= 0 and skeleton.children[top.node]):
                top.leaves += 1
            beyond = top.node < 0
            top.saved += (top.convs - beyond) * top.size
            for w in top.waiting:
                yield (*w[:2], top.least, *w[3:])
            row = (top.least, at, None, top.convs, top.children, top.leaves, top.saved, top.ends or NO_ENDS, top.node, -1, top.size)
            if stack:
                above = stack[-1]
                above.convs += top.convs
                above.least = top.least if above.least is None else min(above.least, top.least)
                if beyond:
                    above.children += 1
                    above.leaves += top.leaves
                    above.saved += top.saved
                    if above.node >= 0:
                        yield (*row[:9], above.node, top.size)
                    else:
                        above.waiting.append(row)
                    continue
            yield (*row[:9], skeleton.parent[top.node], top.size)

    current = None
    for number, path, sizes, n, least, ended in rows:
        if number != current:
            yield from close(0)
            current, keys = number, []
            stack.append(Open(0, 0))
        else:
            yield from close(shared_length(keys, path) + 1)
        for i in range(len(stack) - 1, len(path)):
            above = stack[-1].node
            stack.append(Open(sizes[i], skeleton.children[above].get(path[i], -1) if above >= 0 else -1))
        top = stack[-1]
        top.convs += n
        top.least = least if top.least is None else min(top.least, least)
        top.ends = ended
        keys = path
    yield from close(0)


def trie(whole: DataFrame, ranges: int | None = None) -> DataFrame:
    """The nodes of the trie of paths (conv_id, keys, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, tables = whole.sparkSession, Tables(whole.sparkSession, "trie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = tables.write(whole.withColumn("path", F.sha2(F.array_join("keys", ""), 256)), "members")
    alike = members.groupBy("path", "keys", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = tables.write(alike.join(ends(members.select("path", "conv_id")), "path"), "distinct")
    turns = distinct.agg(F.sum(F.size("keys"))).first()[0] or 0
    drawn = distinct.filter(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < min(1 << 30, (SAMPLE_TURNS << 30) // max(turns, 1)))
    skeleton = skeleton_of([r.keys for r in drawn.select(F.slice("keys", 1, SPLITTER_TURNS).alias("keys")).collect()], ranges or parts)
    sent = spark.sparkContext.broadcast(skeleton)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = sent.value.splitters
        for batch in batches:
            numbers = [bisect_right(splitters, k) for k in batch.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *batch.columns], names=["number", *batch.schema.names])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, batch.num_rows, 256) for row in zip(*[c.to_pylist() for c in batch.slice(i, 256).columns], strict=True))
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32(), pa.int32()]
        held: list[tuple] = []
        to_batch: Callable = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kinds[i]) for i in range(11)], names=names)
        for row in walk(rows, sent.value):
            held.append(row)
            if len(held) == 4096:
                yield to_batch()
                held = []
        yield to_batch()

    columns = ["keys", "sizes", "n", "least", "ends_sha256"]
    dealt = distinct.select(*columns).mapInArrow(numbered, "number int, keys array<string>, sizes array<int>, n long, least long, ends_sha256 string")
    ordered = dealt.repartitionById(max(parts, len(skeleton.splitters) + 1), "number").sortWithinPartitions("number", "keys")
    rows = tables.write(ordered.mapInArrow(walked, ROWS), "rows")
    return finished(rows, skeleton)


def finished(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """All nodes: those of the skeleton added up (at most SKELETON rows, leaves before the root), the others with their parents."""
    spark = rows.sparkSession
    held = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends")
    sums = rows.filter("node >= 0").groupBy("node", "depth", "size").agg(F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], held)
    parts = {r.node: r for r in sums.collect()}
    leaves, saved = [0] * len(skeleton.parent), [0] * len(skeleton.parent)
    out = []
    for node in sorted(parts, reverse=True):  # children have higher numbers
        r, above = parts[node], skeleton.parent[node]
        leaves[node] += r.n_leaves
        saved[node] += r.saved_tokens - r.size
        if above >= 0:
            leaves[above] += leaves[node]
            saved[above] += saved[node]
        out.append((r.least, r.depth, parts[above].least if above >= 0 else None, r.n_convs, r.n_children + len(skeleton.children[node]), leaves[node], saved[node], r.ends or NO_ENDS))
    top = spark.createDataFrame(out, NODE)
    names = spark.createDataFrame([(n, r.least) for n, r in parts.items()], "parent int, parent_id long")
    columns = [x.split()[0] for x in NODE.split(", ")]
    others = rows.filter("node < 0").join(F.broadcast(names), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_id"))
    return together(others.select(columns), top)


def prefix_trie(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The nodes of the trie of whole conversations, as they are."""
    return trie(paths(convs), ranges)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie(with_heads(paths(table(spark, sf_dir, "conversations")), 100, 6))


#: CRC-32 bit by bit: the bytes of the id as text, each followed by eight shifts (-1).
CRC32 = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
ORACLE_SQL = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
heads AS (SELECT *, {CRC32} % 6 AS h FROM own),
built AS (SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS path FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefix AS (SELECT conv_id, len(path) AS size, unnest(range(len(path) + 1)) AS depth, path FROM built),
node AS (SELECT depth, path[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM prefix GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
sized AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.path[n.depth].text) ELSE 0 END AS own_saved FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
above AS (SELECT path, unnest(range(depth + 1)) AS depth, n_children, own_saved FROM sized),
sums AS (SELECT depth, path[1:depth] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM sized n JOIN sums s ON s.depth = n.depth AND s.path = n.path LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""
