"""The training-corpus pipeline over `documents`: each stage takes what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

What holds for every stage: a null text counts as empty; rows, not doc_ids, are kept or dropped, so rows that share a doc_id with other texts, or have
none, are documents of their own; an empty table gives an empty table; columns of any other names, also of those that the operators make, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domspark.llm import decontaminate, exact_dedup, near_dup, packing, quality
from domspark.llm._shared import written
from domspark.llm.queries import table, tokenizer_path


def _row_key(digest: Column) -> Column:
    """One value for each doc_id, null included, and text."""
    return F.concat(digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. Each row is judged by its text, so equal texts stay or go together, null and empty ones too."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: of equal texts one with the largest doc_id, and one without a doc_id only where no other has one.

    Of rows that repeat both doc_id and text one stays. A null text equals an empty one.
    """
    gone = exact_dedup.exact_dedup(docs).where(~F.col("kept")).select(_row_key(F.col("text_sha256")).alias("_key")).distinct()
    keyed = docs.withColumn("_key", _row_key(F.sha2(F.coalesce("text", F.lit("")), 256)))
    again = Window.partitionBy("_key").orderBy(F.xxhash64(*docs.columns))
    left = keyed.join(gone.hint("shuffle_hash"), "_key", "left_anti").withColumn("_again", F.row_number().over(again))
    return left.where("_again = 1").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id; one without a doc_id comes last.

    Rows are judged by numbers of their own in the order of doc_ids, so rows that share a doc_id, or have none, are documents of their own.
    Texts without words, null ones too, are near nothing and stay.
    """
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns))
    rows = written(ordered.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    gone = near_dup.near_dup(rows.select(F.col("_row").alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(gone.hint("shuffle_hash"), "_row", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its question and its answer. Null and empty texts hold none and stay; null and empty items are held by nothing."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: one row per piece. A null or empty text is one end token; a row with a null doc_id is packed like any other."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # SQL expresses neither the classifier nor the tokenizer; the tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
