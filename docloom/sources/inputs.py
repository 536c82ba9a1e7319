"""Document inputs rendered from the star-schema and text tables.

Each input is given twice, as a DataFrame and as the SQL of a common table
expression of the same name, so queries and their SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 3


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores: a scan of fewer partitions than there are cores is dealt anew.

    A table of one small file is one task, and all that follows up to the next shuffle runs
    in it. Where the scan has a partition a core, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files: Spanish ones of an unsupported type, French ones in markdown."""
    d = table(spark, sf_dir, "documents")
    suffix = F.when(F.col("lang") == "fr", ".md").when(F.col("lang") == "es", ".docx").otherwise(".txt")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc_"), F.col("doc_id"), suffix).alias("filename"), F.octet_length("text").cast("long").alias("size_bytes"), "text")


FILES = """files AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 'doc_' || doc_id || CASE lang WHEN 'fr' THEN '.md' WHEN 'es' THEN '.docx' ELSE '.txt' END AS filename,
         CAST(strlen(text) AS BIGINT) AS size_bytes, text FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents paged by LINES_PER_PAGE lines."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.split("text", "\n").alias("l"))
    n = F.floor((F.size("l") - 1) / LINES_PER_PAGE).cast("int")
    return d.select("document_id", "l", F.explode(F.sequence(F.lit(0), n)).alias("i")).select(
        "document_id", (F.col("i") + 1).alias("page_number"), F.array_join(F.slice("l", F.col("i") * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n").alias("text")
    )


PAGES = f"""pages AS (
  SELECT document_id, CAST(i + 1 AS INTEGER) AS page_number, array_to_string(list_slice(l, i * {LINES_PER_PAGE} + 1, i * {LINES_PER_PAGE} + {LINES_PER_PAGE}), chr(10)) AS text
  FROM (SELECT document_id, l, unnest(range(0, (len(l) + {LINES_PER_PAGE - 1}) // {LINES_PER_PAGE})) AS i
        FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, string_split(text, chr(10)) AS l FROM documents)))"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text invoice an order; the wording depends on the order's priority."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    lines = F.concat_ws(
        "\n",
        F.lit("**INVOICE**"),
        F.concat(F.lit("Invoice Number: INV-"), F.col("o_orderkey"), F.lit("-A")),
        F.concat(F.lit("Invoice Date: "), F.date_format("o_orderdate", "MM/dd/yyyy")),
        F.concat(F.lit("Account Number: ACCT-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Claimant: Jane Doe")),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("Attending Physician: Dr. John Smith")),
        F.lit("BILLING SUMMARY"),
        F.concat(F.lit("| Total Due: | $"), F.format_string("%.2f", "o_totalprice"), F.lit(" |")),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("Payment due now. Please find the balance enclosed. Dear customer, sincerely yours.")),
        F.lit("CONCLUSIONS AND NOTES"),
        F.lit("1. Remit payment to the account above."),
    )
    return o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("invoice_"), F.col("o_orderkey"), F.lit(".txt")).alias("filename"), F.lit(1).alias("page_number"), lines.alias("text"), "o_orderkey", "o_totalprice", "o_orderdate", "o_custkey", "c_mktsegment", "o_orderstatus")


INVOICES = """invoices AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'invoice_' || o_orderkey || '.txt' AS filename, 1 AS page_number, concat_ws(chr(10),
    '**INVOICE**', 'Invoice Number: INV-' || o_orderkey || '-A', 'Invoice Date: ' || strftime(o_orderdate, '%m/%d/%Y'),
    'Account Number: ACCT-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0'),
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Claimant: Jane Doe' END,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Attending Physician: Dr. John Smith' END,
    'BILLING SUMMARY', '| Total Due: | $' || printf('%.2f', o_totalprice) || ' |',
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'Payment due now. Please find the balance enclosed. Dear customer, sincerely yours.' END,
    'CONCLUSIONS AND NOTES', '1. Remit payment to the account above.') AS text,
    o_orderkey, o_totalprice, o_orderdate, o_custkey, c_mktsegment, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
