"""Byte-level BPE: backtracking encoder over Aho-Corasick matches, decoder over an offset table.

A text is cut by the tokenizer's public pattern; each piece is encoded in linear time: Aho-Corasick gives the longest
vocabulary entry that starts at each byte, the encoder takes it if merging would never join it differently with the
token before it (the pair-compatibility table), else a shorter entry, else it goes one token back. The result is what
applying the merges by rank gives. Decoding gathers bytes from one blob by the tokens' offsets.

Cases: a null text is empty and has no token; an empty text too; repeated rows are encoded each; an empty table gives
an empty table; other columns stay as they are, but for the named outputs, which replace columns of those names; a
very long text costs its length, and so does a piece without a break.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.common import small_batches, table

#: Fixed value: the public pattern that cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Short pieces, and answers of the pair table, that a worker remembers; beyond either that memory starts anew. A worker stays small by them.
MEMORY, PAIRS = 150_000, 300_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class Offsets:
    """All tokens' bytes in one blob, with each one's offset and width: all that decoding needs."""

    def __init__(self, model: dict):
        vocab, special = model["model"]["vocab"], {x["content"]: x["id"] for x in model["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_chars())}
        parts = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for name, t in vocab.items():
            parts[t] = bytes(back[c] for c in name)
        for name, t in special.items():
            parts[t] = name.encode()
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.widths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.cumsum(self.widths) - self.widths

    def decode(self, ids: np.ndarray) -> str:
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        if not len(ids) or not ends[-1]:
            return ""
        places = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + widths, widths)
        return self.blob[places].tobytes().decode("utf-8", "replace")


class BytePairs:
    """Vocabulary, merges and the pair-compatibility table of one tokenizer file."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.chars = byte_chars()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.merged = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for (a, b), (rank, t) in self.merged.items():
            if t not in self.halves:
                self.halves[t], self.rank[t] = (a, b), rank
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.shorter: list[int] = [-1] * size
        self.length = [0] * size
        for name, t in self.vocab.items():
            self.length[t] = len(name)
        self.automaton = ahocorasick.Automaton()
        reachable = [name for name, t in self.vocab.items() if t in self.halves or len(name) == 1]
        known = set(reachable)
        for name in reachable:
            self.automaton.add_word(name, self.vocab[name])
            self.shorter[self.vocab[name]] = next((self.vocab[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in known), -1)
        self.automaton.make_automaton()
        self.cut = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.compatible_memory: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Would the merges, applied by rank, leave a border between these neighbours? Undoes their latest merges in turn."""
        known = self.compatible_memory.get((left, right))
        if known is not None:
            return known
        a, b, limit, ok = left, right, len(self.merged) + 1, True
        while True:
            joined = self.merged.get((a, b))
            if joined and joined[0] < limit:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # The later merge is undone first; a merge of the same rank on the right came second.
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
        if len(self.compatible_memory) >= PAIRS:
            self.compatible_memory.clear()
        self.compatible_memory[left, right] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        chars = self.chars
        mapped = "".join([chars[b] for b in piece.encode()])
        if mapped in self.vocab and len(mapped) == 1:
            return [self.vocab[mapped]]
        longest = [-1] * len(mapped)
        length = self.length
        for end, t in self.automaton.iter(mapped):
            longest[end + 1 - length[t]] = t  # later ends are longer
        ids: list[int] = []
        at, t, dead = 0, longest[0], set()
        while at < len(mapped):
            while t >= 0:
                end = at + length[t]
                if end not in dead and (not ids or self.compatible(ids[-1], t)):
                    break
                t = self.shorter[t]
            if t >= 0:
                ids.append(t)
                at = end
                t = longest[at] if at < len(mapped) else -1
            else:
                dead.add(at)
                last = ids.pop()
                at -= length[last]
                t = self.shorter[last]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memory = self.memory
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.cut.findall(part):
                known = memory.get(piece)
                if known is None:
                    known = self.encode_piece(piece)
                    if len(piece) < 64:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        memory[piece] = known
                ids += known
        return ids


@lru_cache(maxsize=2)
def byte_pairs(content: str) -> BytePairs:
    return BytePairs(json.loads(content))


@lru_cache(maxsize=2)
def offsets(content: str) -> Offsets:
    return Offsets(json.loads(content))


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content (1.5 MB for 50,000 entries), read by the driver and sent along: its size is fixed."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the token ids of a text column as array<int>; tokenizer is the file's content.

    With `decoded`, the text that the ids stand for as well, decoded by the same worker, so that no ids travel back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(tokenizer)
    docs = docs.drop(ids, *([decoded] if decoded else []))
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, back = byte_pairs(content.value), offsets(content.value) if decoded else None
        for batch in batches:
            out = [np.array(pairs.encode(x or ""), np.int32) for x in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            array = pa.ListArray.from_arrays(ends, np.concatenate(out) if out else np.array([], np.int32))
            texts = [pa.array([back.decode(x) for x in out], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([*batch.columns, array, *texts], names=[*batch.schema.names, ids, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the text that the ids stand for; null ids are empty, bytes that are no UTF-8 become U+FFFD."""
    spark = tokens.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(tokenizer)
    tokens = tokens.drop(text)
    schema = T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = offsets(content.value)
        for batch in batches:
            column = batch.column(ids)
            out = [table_.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return tokens.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text of documents encoded and decoded, as digests."""
    import public_tokenizers

    content = read_tokenizer(path or public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, content, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
