"""Stage figures against separate counts, without a further job."""

from pyspark.sql import functions as F

from docloom.operators import ops
from docloom.operators.stages import Stages
from docloom.plans.evaluate import evaluate
from docloom.plans.ingest import ingest
from docloom.sources.settled import settle

FILES = [("a", "invoice_1.txt", 10, "Invoice Number: INV-1001\nTotal Due: $50.00\nAmount due, balance"), ("b", "x.pdf", 1, "y"), ("c", "blank.txt", 2, "  "), ("d", "gone.md", 0, None), ("e", "é.md", 9, "# Été\nBILLING SUMMARY\ntext")]
SCHEMA = "document_id string, filename string, size_bytes long, text string"


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_figures_come_from_the_action_that_writes(spark):
    df = spark.range(1000).repartition(4).select(F.when(F.col("id") % 10 == 0, "empty_extraction").when(F.col("id") % 10 == 1, "odd").alias("kind"), F.col("id"))
    stages = Stages(spark)
    plain = jobs(spark, "plain", lambda: settle(df, "plain"))
    noted = jobs(spark, "noted", lambda: stages.keep(df, "first", "kind", F.lit(3)))
    assert plain == noted
    stages.keep(df.limit(0), "second")
    got = {r.stage: r for r in stages.table().collect()}
    assert (got["first"].rows, got["first"].failed, got["first"].failures, got["first"].bytes) == (1000, 200, {"empty_extraction": 100, "other": 100}, 3000)
    assert (got["second"].rows, got["second"].failed, got["second"].bytes, got["second"].position) == (0, 0, None, 2)


def test_ingest_tells_its_stages(spark):
    files = spark.createDataFrame(FILES, SCHEMA)
    out = ingest(files, stages=Stages(spark))
    got = {r.stage: r for r in out["stages"].collect()}
    assert list(got) == ["parse", "clean", "chunk", "sections"]
    assert (got["parse"].rows, got["parse"].failed) == (5, 3) and got["parse"].failures == {"unsupported_file_type": 1, "empty_extraction": 1, "file_not_found": 1}
    assert got["clean"].rows == out["pages"].count() == 2 and got["clean"].bytes == out["pages"].agg(F.sum(F.octet_length("text"))).first()[0]
    assert got["chunk"].rows == out["chunks"].count() and got["sections"].rows == out["sections"].count()
    plain = ingest(files)
    assert "stages" not in plain and plain["chunks"].count() == out["chunks"].count()


def test_evaluation_tells_its_stages(spark):
    want = spark.createDataFrame([("invoice_1.txt", "invoice_number", "INV-1001", True, None)], "fixture string, field_name string, expected_value string, must_extract boolean, normalized string")
    kinds = spark.createDataFrame([("invoice_1.txt", "billing", ["billing"])], "fixture string, expected_type string, accept_types array<string>")
    out = evaluate(spark.createDataFrame(FILES, SCHEMA), want, kinds)
    got = {r.stage: r.rows for r in out["stages"].collect()}
    assert got["documents"] == 5 and got["matches"] == out["matches"].count() and set(got) == {"documents", "pages", "chunks", "routing", "fields", "matches"}


def test_newest_first_has_one_order(spark):
    rows = spark.createDataFrame([(k, k % 2, f"x{9 - k}") for k in range(8)], "position int, created_at int, row_id string")
    assert [r.position for r in ops.newest_first(rows).collect()] == [1, 3, 5, 7, 0, 2, 4, 6]
    assert [r.position for r in ops.newest_first(rows, "created_at", "row_id").collect()] == [7, 5, 3, 1, 6, 4, 2, 0]
