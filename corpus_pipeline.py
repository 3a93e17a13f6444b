"""A training corpus in five stages, each by one operator of inkplane.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns and the next
one reads it. All but the last return the columns of documents.

1. quality: documents that the classifier scores below its threshold go.
2. near_duplicates: of each group of linked texts the one of smallest doc_id stays (null last), once. Texts that
   are not linked are of different groups, also under one doc_id. Documents without words link with nothing and stay.
3. pii: spans of personal data are masked by their kind.
4. mix: documents are taken as often as the mix takes them, each source up to its exact budget; the last one of
   a source is cut after the budget's word.
5. encode: doc_id, source, n_pieces, the ids of the pieces and the SHA-256 of the text they decode to.

Every stage takes nulls in any column, empty tables and columns of its own besides; see the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkplane.llm import common, jaccard_join, mixing, pieces, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words = jaccard_join.groups(docs).where("n_shingles > 0").select("group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("who")).distinct()
    stays = words.groupBy("group").agg(F.min("who").alias("stays"))
    away = words.join(stays, "group").where("who <> stays").select(F.struct(F.col("who.doc_id").alias("id"), F.col("who.digest").alias("digest")).alias("__who"))
    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = docs.withColumn("__who", F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("digest")))
    left = left.withColumn("__copy", F.when(~worded, F.monotonically_increasing_id()).otherwise(-1)).join(away, "__who", "left_anti")
    first = F.row_number().over(Window.partitionBy("__who", "__copy").orderBy(F.xxhash64(*docs.columns)))
    return left.withColumn("__first", first).where("__first = 1").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, keep=("source",))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("pii", pii_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: No SQL stands for a fitted classifier; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = common.scratch(spark, f"pipeline-{name}")
        out.write.parquet(f"{path}/rows")
        docs = spark.read.schema(out.schema).parquet(f"{path}/rows")
        if before:
            common.remove(spark, before)  # the stage that read it is written
        before = path
    return docs
