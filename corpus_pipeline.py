"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import pii, quality
from tidewater.llm.common import fresh_path, materialise
from tidewater.llm.decontaminate import contained_items
from tidewater.llm.jaccard_join import jaccard_components
from tidewater.llm.packing import pack

#: Shingle width and similarity of near duplicates.
WIDTH, NUM, DEN = 5, 80, 100


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("quality_kept").select(docs.columns)


def repeated_ids(docs: DataFrame) -> DataFrame:
    return materialise(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column row_number_, written once so that the numbers stay."""
    return materialise(docs.withColumn("row_number_", F.monotonically_increasing_id()), "numbered")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id.

    Rows that share a doc_id are documents of their own; of those in one group the one with the longest
    text stays.  Documents without words, and rows with a null doc_id, are in no group and stay, but
    of a repeated doc_id a row without words stays only if no row has words, and then the longest.
    """
    if not repeated_ids(docs).limit(1).count():
        found = jaccard_components(docs, WIDTH, NUM, DEN)
        gone = materialise(found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    rows = numbered(docs)
    own = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row_number_")).alias("doc_id"), "text")
    found = jaccard_components(own, WIDTH, NUM, DEN).where("doc_id is not null")
    found = found.select(F.col("doc_id").alias("row_number_"), "component_id", (F.col("n_shingles") > 0).alias("worded"))
    order = F.struct("doc_id", (-F.char_length("text")).alias("shorter"), F.xxhash64("text").alias("hash"), "row_number_")
    placed = materialise(rows.where("doc_id is not null").select("row_number_", "doc_id", order.alias("order")).join(found, "row_number_"), "placed")
    first = placed.where("worded").groupBy("component_id").agg(F.min("order").alias("o"))
    bare = placed.where("not worded").join(placed.where("worded").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("order").alias("o"))
    kept = materialise(first.select("o.row_number_").union(bare.select("o.row_number_")), "kept")
    return rows.where("doc_id is null").select(docs.columns).union(rows.where("doc_id is not null").join(kept, "row_number_", "left_semi").select(docs.columns))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item of the benchmark; rows with a null or repeated doc_id are judged one by one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    if not docs.where("doc_id is null").limit(1).count() and not repeated_ids(docs).limit(1).count():
        found = contained_items(docs, items)
        return docs.join(materialise(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(docs.columns)
    rows = numbered(docs)
    found = contained_items(rows.select(F.col("row_number_").alias("doc_id"), "text"), items)
    leaks = materialise(found.select(F.col("doc_id").alias("row_number_")).distinct(), "leaks")
    return rows.join(leaks, "row_number_", "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; ``n_chars`` follows the text where there is such a column."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences."""
    return pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_test_items),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL cannot express the trained stages; each stage is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to ``documents``; each writes Parquet that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
