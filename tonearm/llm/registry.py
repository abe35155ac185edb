"""Queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonearm.llm import bpe, chat, decontaminate, divergence, exact, language, licence, minhash, pii, quality, secret, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secret.op1_secrets,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality": quality.op3_quality,
    "op4_minhash": minhash.op4_minhash,
    "op5_warc": warc.op5_warc,
    "op6_chat": chat.op6_chat,
    "op7_bpe": bpe.op7_bpe,
    "op8_language": language.op8_language,
    "op9_licences": licence.op9_licences,
    "op10_pii": pii.op10_pii,
    "op11_trie": trie.op11_trie,
    "op12_exact": exact.op12_exact,
    "op13_divergence": divergence.op13_divergence,
}
#: The others fit models, follow links or use a vocabulary: tests compare them with brute force instead.
ORACLE_SQL: dict[str, str] = {"op5_warc": warc.ORACLE_SQL, "op11_trie": trie.ORACLE_SQL, "op12_exact": exact.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
