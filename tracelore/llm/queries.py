"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelore.llm import chat, html_text, langid, mixing, packing, phrases, pii, prefix_trie, quality, secrets, simhash, toxicity, vector_links
from tracelore.llm.base import read_table
from tracelore.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: run(read_table(spark, folder, table))


def _mixing(docs: DataFrame) -> DataFrame:
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    "op1_packing": _over("documents", packing.pack),
    "op2_chat": _over("conversations", chat.render),
    "op3_toxicity": _toxicity,
    "op4_html": _over("pages", html_text.extract_pages),
    "op5_vectors": _over("embeddings", vector_links.vector_links),
    "op6_mixing": _over("documents", _mixing),
    "op7_pii": _over("documents", pii.personal_report),
    "op8_secrets": _over("documents", secrets.secret_report),
    "op9_quality": _over("documents", quality.quality_verdicts),
    "op10_simhash": _over("documents", simhash.near_duplicates),
    "op11_langid": _over("documents", langid.languages),
    "op12_phrases": _over("documents", phrases.collocations),
    "op13_prefix_trie": _over("conversations", prefix_trie.trie),
}
