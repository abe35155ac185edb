"""A training-data pipeline over documents: quality rules, near-duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Quality rules and benchmark decontamination drop whole
documents, near-duplicate removal keeps one document of each group, the secret scan masks secrets inside texts (and
sets n_chars to the new length), encoding gives the token ids of every text that is left.

Cases: null and empty texts fail the quality base and go with the first stage, and pass the others unchanged; repeated
rows (equal in all columns) count once from the second stage on; of near-duplicates that tie, the least doc_id stays; an
empty table passes through all stages; other columns, whatever their names, are kept (but by the last stage, whose
columns are its own); very long texts are worked on as wholes, and cost their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm import bpe, decontaminate, minhash, quality, secret
from tonearm.llm.common import Tables, fresh, table

#: The rules below have no SQL form (a fitted model, a byte-pair vocabulary); tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject; rules are fitted on the labelled ones among docs."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    names, key = docs.columns, fresh("kept_id", docs.columns)
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).filter("kept and doc_id is not null").select(F.col("doc_id").alias(key))
    named = docs.join(kept, docs["doc_id"] == kept[key], "left_semi")
    # Repeated rows are told by a digest of the whole row, so that no text is a sort's key; the join has dealt rows by
    # doc_id already, so those of one id need no second shuffle.
    digest = fresh("digest", names)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"}), 256)
    once = lambda rows: rows.withColumn(digest, row).dropDuplicates(["doc_id", digest]).drop(digest)
    return together(once(named), once(docs.filter("doc_id is null")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; n_chars follows."""
    masked = secret.redact(docs, secret.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document, with the digest of the text that the ids decode to."""
    import public_tokenizers

    content = bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), content, decoded="decoded")
    return tokens.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scan", secrets),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written in the shared folder and read again."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"{number}")
    return docs
