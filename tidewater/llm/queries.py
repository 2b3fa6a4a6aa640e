"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import pii, quality

from tidewater.llm.bloom_lm import score_texts
from tidewater.llm.decontaminate import contained_items
from tidewater.llm.jaccard_join import jaccard_components
from tidewater.llm.packing import pack
from tidewater.llm.span_dedup import LEAST, span_dedup
from tidewater.llm.sstable import shard_digests
from tidewater.llm.url_filter import Rule, url_filter
from tidewater.llm.voronoi_knn import top_k

RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans, and those that the trained span classifier adds."""
    return pii.find(table(spark, sf_dir, "documents"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the additive model with pairwise interactions."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences that a repeated span of sentences covers, the first occurrence excepted."""
    return span_dedup(table(spark, sf_dir, "documents"), least=LEAST)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences."""
    return pack(table(spark, sf_dir, "documents"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every whole text under the log-frequency Bloom filter model."""
    return score_texts(table(spark, sf_dir, "documents"))


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have Jaccard similarity 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds 80 % or more of the test item's 5-word shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url by the rules, else by the n-gram regression."""
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op10_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written and read back."""
    return shard_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_quality_gam": op2_quality_gam,
    "op3_sentence_span_dedup": op3_sentence_span_dedup,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_bloom_lm": op5_bloom_lm,
    "op6_voronoi_top_k": op6_voronoi_top_k,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_token_sstable": op10_token_sstable,
}
ORACLE_SQL: dict[str, str] = {}
