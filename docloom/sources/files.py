"""Text files and ground truth in, tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.parsing import TEXT_SUFFIXES, file_suffix


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, filename, content_type, size_bytes, text) of the files below a path.

    Content that is no UTF-8 becomes an empty text. The id is a digest of path and size.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise("")
    kind = F.when(file_suffix(name) == ".md", "text/markdown").when(file_suffix(name).isin(*TEXT_SUFFIXES), "text/plain").when(file_suffix(name) == ".pdf", "application/pdf").otherwise("application/octet-stream")
    return raw.select(F.substring(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string")), 256), 1, 32).alias("document_id"), name.alias("filename"), kind.alias("content_type"), F.col("length").alias("size_bytes"), text.alias("text"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(fixture, field_name, expected_value, must_extract, normalized) of a ground-truth file."""
    field = "struct<value: string, must_extract: boolean, normalized: string>"
    raw = spark.read.schema(f"fixtures map<string, struct<expected_fields: map<string, {field}>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("fixtures").alias("fixture", "f")).select("fixture", F.explode("f.expected_fields").alias("field_name", "v"))
    return rows.select("fixture", "field_name", F.col("v.value").alias("expected_value"), F.coalesce("v.must_extract", F.lit(False)).alias("must_extract"), F.col("v.normalized").alias("normalized"))


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table as Parquet, partitioned by columns if any are named."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _path(spark: SparkSession, path: str):
    """(file system, path) by Spark's own readers, so any store that they reach will do."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file's content; many files are read as a table by ``read_text_files``."""
    found = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(found["content"])


def save_bytes(spark: SparkSession, folder: str, filename: str, content: bytes) -> str:
    """Save a file under a name with a prefix of its own, and return its path."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex[:8]}_{filename}"
    files, at = _path(spark, path)
    out = files.create(at)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path
