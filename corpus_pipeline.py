"""The corpus pipeline: five filtering and encoding stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it back as the next stage's input.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, decontamination, ngram_jaccard, quality_rules, toxicity
from docloom.llm.store import Workspace

#: Near duplicates: five words a shingle, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Ids up to which the dropped documents are broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: The rows' own number while near duplicates are removed.
ROW = "_near_row"
#: Rows of an Arrow batch: whole texts pass through Python, so batches are kept small.
BATCH_ROWS = "1000"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score of 0.3 or more) go."""
    _small_batches(spark)
    return toxicity.toxicity_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the count and compression limits go."""
    _small_batches(spark)
    return quality_rules.quality_filter(docs)


def stage_ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id.

    Rows are told apart by a number of their own, so rows without an id or with the same
    one are compared like others; an id goes before none, then the smaller number stays.
    """
    _small_batches(spark)
    ws = Workspace(spark, "near-duplicates")
    rows = ws.save(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    joined = ngram_jaccard.ngram_jaccard(rows, size=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1], id_col=ROW, links=False)
    groups = ws.save(joined.select(ROW, F.col("component_id").alias("_group")).join(rows.select(ROW, F.col("doc_id").alias("_id")), ROW), "groups")
    first = groups.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", ROW)).getField(ROW).alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    gone = ws.save(groups.join(first, "_group").filter(F.col(ROW) != F.col("_kept")).select(ROW), "gone")
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, ROW, "left_anti").select(*docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other slots, go."""
    _small_batches(spark)
    return decontamination.decontamination_filter(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    _small_batches(spark)
    return byte_bpe.digests(byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality_rules", stage_quality),
    ("ngram_jaccard", stage_ngram_jaccard),
    ("decontamination", stage_decontamination),
    ("byte_bpe", stage_byte_bpe),
]

#: Compression verdicts and learned weights have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
