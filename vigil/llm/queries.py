"""The queries of the corpus operators: name -> (Spark query, DuckDB SQL).

Every query reads its whole table and binds an operator with its production
parameters; SQL is None where DuckDB cannot express the operator (those are
tested against brute force in tests/llm).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, hard_negatives, html_blocks, licences, mixing, near_dedup, pieces,
               prefix_trie, quality_rules, repeats, sharding, toxicity, url_lists)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.mark_copies(docs, carry=["doc_id"])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, carry=["doc_id"])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return near_dedup.mark_near(docs, carry=["doc_id"]).drop("first_row")


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_blocks.extract(pages, carry=["page_id", "url"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    out = mixing.sample(docs, carry=["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return url_lists.screen(url_lists.derived_captures(pages), url_lists.derived_changes(pages))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return licences.scan_texts(docs, carry=["doc_id"])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return repeats.remove_repeats(docs, carry=["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    return sharding.placement(docs, fallback=("source", "lang", "n_chars"), carry=["doc_id"])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.encode_texts(docs, carry=["doc_id"])


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scorer = toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_texts(docs, scorer, carry=["doc_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.trie(*prefix_trie.branched(prefix_trie.turn_marks(turns)))


REGISTRY: dict[str, tuple[Query, str | None]] = {
    "op1_exact_dedup": (op1_exact_dedup, exact_dedup.ORACLE),
    "op2_html_blocks": (op2_html_blocks, None),
    "op3_mixing": (op3_mixing, mixing.oracle()),
    "op4_quality_rules": (op4_quality_rules, None),
    "op5_near_dedup": (op5_near_dedup, near_dedup.ORACLE),
    "op6_url_lists": (op6_url_lists, url_lists.oracle()),
    "op7_licences": (op7_licences, None),
    "op8_repeats": (op8_repeats, None),
    "op9_sharding": (op9_sharding, sharding.oracle()),
    "op10_sentencepiece": (op10_sentencepiece, None),
    "op11_toxicity": (op11_toxicity, None),
    "op12_hard_negatives": (op12_hard_negatives, hard_negatives.ORACLE),
    "op13_prefix_trie": (op13_prefix_trie, prefix_trie.ORACLE),
}
