"""Lists, queues and review state: the read side of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_documents(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Documents, newest first, with their number of extractions.

    ``documents`` has document_id and created_at; ``extractions`` has document_id.
    """
    counts = extractions.groupBy("document_id").agg(F.count(F.lit(1)).alias("extraction_count"))
    return documents.join(counts, "document_id", "left").fillna({"extraction_count": 0}).orderBy(F.desc("created_at"), "document_id")


def chunk_previews(chunks: DataFrame, width: int = 120) -> DataFrame:
    """A compact view of chunks: sizes, spans, labels and the first characters on one line."""
    head = F.regexp_replace(F.substring("text", 1, width), "\n", " ")
    preview = F.concat(head, F.when(F.length("text") > width, "…").otherwise(""))
    return chunks.select("document_id", "chunk_index", "chunk_id", F.length("text").alias("chars"), "token_estimate", "page_numbers", "char_start", "char_end", "strategy", "is_truncated", "doc_type", "section_label", "parse_quality", preview.alias("preview"))


def queue_order(queue: DataFrame) -> DataFrame:
    """The review queue by priority; equal ones in order of arrival (``position``)."""
    return queue.orderBy(F.desc("priority_score"), "position")


def queue_page(queue: DataFrame, status: str | None = None) -> DataFrame:
    """The queue, or its part with one status, in queue order."""
    return queue_order(queue if status is None else queue.filter(F.col("status") == status))


def with_reviews(extractions: DataFrame, queue: DataFrame) -> DataFrame:
    """Extractions beside their review state; one that has none is pending without priority."""
    state = queue.select("document_id", "status", "priority_score", "trigger_reasons")
    return extractions.join(state, "document_id", "left").withColumns(
        {"status": F.coalesce("status", F.lit("pending_review")), "priority_score": F.coalesce("priority_score", F.lit(0.0)), "trigger_reasons": F.coalesce("trigger_reasons", F.expr("cast(array() as array<string>)"))}
    )


def base_extraction(requests: DataFrame, extractions: DataFrame) -> DataFrame:
    """The extraction that a request builds on: the one it names if it is of the same
    document, else the document's latest deterministic one.

    ``requests`` has request_id, document_id, extraction_id; ``extractions`` has
    extraction_id, document_id, output_type, created_at.
    """
    named = extractions.select(F.col("extraction_id"), F.col("document_id"), F.col("extraction_id").alias("named"))
    last = extractions.filter("output_type = 'deterministic'").groupBy("document_id").agg(F.max_by("extraction_id", "created_at").alias("latest"))
    out = requests.join(named, ["extraction_id", "document_id"], "left").join(last, "document_id", "left")
    return out.select("request_id", "document_id", F.coalesce("named", "latest").alias("base_extraction_id"))


def decide(decisions: DataFrame, document_id, decision: str, reviewer: str, at) -> DataFrame:
    """The decision log with one more row; nothing is ever changed in place."""
    row = decisions.sparkSession.createDataFrame([(document_id, decision, reviewer, at)], "document_id string, decision string, reviewer string, decided_at timestamp")
    return decisions.unionByName(row)


def corrected(queue: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with a correction have the status ``corrected``."""
    done = corrections.select("document_id").distinct().withColumn("_c", F.lit(True))
    return queue.join(done, "document_id", "left").withColumn("status", F.when(F.col("_c"), "corrected").otherwise(F.col("status"))).drop("_c")


#: Priorities from which the queue shows a row in red and in amber.
URGENT, NOTABLE = 0.7, 0.4


def queue_view(queue: DataFrame) -> DataFrame:
    """The queue with what its page shows: whether a row is open, and the colour of its priority."""
    p = F.col("priority_score")
    return queue.withColumns({"open": F.col("status") == "pending_review", "colour": F.when(p >= URGENT, "red").when(p >= NOTABLE, "amber").otherwise("green")})


def average_relevance(picks: DataFrame) -> DataFrame:
    """Mean relevance of what each strategy picked, by document; 0 where it picked nothing."""
    return picks.groupBy("document_id", "strategy").agg(F.round(F.coalesce(F.avg("relevance_score"), F.lit(0.0)), 4).alias("avg_relevance"), F.count(F.lit(1)).alias("picked"))


def one_document(documents: DataFrame, document_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """A document's row and its rows in other tables (extractions, corrections, feedback), each newest first where it says when."""
    own = lambda t: t.filter(F.col("document_id") == document_id)
    dated = lambda t: own(t).orderBy(F.desc("created_at")) if "created_at" in t.columns else own(t)
    return {"document": own(documents), **{name: dated(t) for name, t in tables.items()}}


def corrections_of(corrections: DataFrame, kind: str | None = None, failure_source: str | None = None) -> DataFrame:
    """Corrections, all or of one kind or source, newest first."""
    for column, wanted in (("kind", kind), ("failure_source", failure_source)):
        if wanted is not None:
            corrections = corrections.filter(F.col(column) == wanted)
    return corrections.orderBy(F.desc("created_at"))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, readable, rows): whether each table can be read, and how many rows it has."""
    spark = next(iter(tables.values())).sparkSession
    seen = []
    for name, table in tables.items():
        try:
            seen.append((name, True, table.count(), ""))
        except Exception as e:  # an unreadable table is the answer, not a failure of the check
            seen.append((name, False, 0, f"{type(e).__name__}: {e}"[:200]))
    return spark.createDataFrame(seen, "table string, readable boolean, rows long, error string")
