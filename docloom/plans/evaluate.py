"""Evaluation of a fixture corpus as one plan instead of a loop over fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import evaluation, extraction, searching, tasks
from docloom.operators.stages import Stages
from docloom.plans.ingest import ingest
from docloom.sources.settled import settle


def evaluate(
    files: DataFrame,
    expected_fields: DataFrame,
    expected_routing: DataFrame,
    slices: DataFrame | None = None,
    facts: DataFrame | None = None,
    model: tasks.Model | None = None,
    timings: DataFrame | None = None,
    budget: int = 5,
) -> dict[str, DataFrame]:
    """Ingest and extract all fixtures, then score fields, routing, evidence, summaries, retrieval and slices.

    ``files`` has document_id, filename, size_bytes, text; expectations are keyed by
    fixture, the file name. Fixtures that fail to parse are counted, not scored. ``facts``
    (fixture, key_facts, description) gives the summaries' key facts and, with them, each
    document's retrieval query; with a ``model`` as well, summaries are made and scored.
    ``timings`` (fixture, upload_time_ms, extraction_time_ms, summarisation_time_ms) are a
    run's measured stages. Tables that several parts read are written once; ``stages`` tells
    their rows, failures, bytes and times.
    """
    stages = Stages(files.sparkSession)
    told = {"documents": ("failure_reason", None), "pages": (None, F.octet_length("text")), "chunks": (None, F.octet_length("text")), "routing": (None, None)}
    tables = {name: stages.keep(table, name, *told[name]) for name, table in ingest(files).items() if name in told}
    documents = tables["documents"]
    names = documents.select("document_id", F.col("filename").alias("fixture"), "status")
    good = names.filter("status = 'parsed'").select("document_id", "fixture")
    fields = stages.keep(extraction.postprocess_fields(extraction.extract_fields(tables["pages"])).join(good, "document_id"), "fields")
    actual = fields.select("fixture", "field_name", F.col("original_value").alias("actual_value"))
    matches = stages.keep(evaluation.match_fields(expected_fields.join(good, "fixture", "left_semi"), actual), "matches")
    metrics = evaluation.field_metrics(matches)
    routed = tables["routing"].join(good, "document_id").select("fixture", "predicted_type")
    failures = names.filter("status <> 'parsed'")
    none = lambda *c: good.select("fixture", *[F.lit(None).cast("double").alias(x) for x in c]).filter(F.lit(False))
    summaries, retrieval, runs = none("factual_coverage", "grounding_score"), none("query_ranked_avg_relevance", "relevance_lift"), None
    if facts is not None:
        retrieval = settle(retrieval_scores(tables["chunks"], good, facts, budget), "retrieval")
        if model is not None:
            summaries, runs = summary_scores(tables, good, facts, model)
            summaries = settle(summaries, "summaries")
    parsed = documents.filter("status = 'parsed'").withColumn("document_id", F.col("filename"))
    runtime = evaluation.runtime_slices(parsed, runs)
    every = runtime.filter(F.col("slice_name").isin(*evaluation.SLICES)) if slices is None else evaluation.merge_slices(slices, runtime)
    if timings is None:
        timings = good.select("fixture", *[F.lit(0).alias(c) for c in ("upload_time_ms", "extraction_time_ms", "summarisation_time_ms")])
    timed = metrics.join(timings.select("fixture", "extraction_time_ms"), "fixture", "left")
    scored = summaries.join(timings.select("fixture", "summarisation_time_ms"), "fixture", "left")
    return {
        "matches": matches,
        "field_metrics": metrics,
        "micro_average": evaluation.field_metrics(matches, []),
        "routing": evaluation.routing_accuracy(routed, expected_routing),
        "evidence": evaluation.evidence_attachment(fields),
        "summaries": summaries,
        "retrieval": retrieval,
        "pipeline": evaluation.pipeline_metrics(timings, routed, expected_routing, fields, failures),
        "slices": evaluation.slice_breakdown(every, timed, scored, retrieval),
        "failures": failures,
        "stages": stages.table(),
    }


def summary_scores(tables: dict[str, DataFrame], good: DataFrame, facts: DataFrame, model: tasks.Model) -> tuple[DataFrame, DataFrame]:
    """(metrics, runs): every fixture with facts is summarised, and its whole text scored against them."""
    wanted = good.join(facts.select("fixture", "key_facts"), "fixture")
    chunks = tables["chunks"].join(wanted.select("document_id"), "document_id", "left_semi")
    documents = tables["documents"].join(wanted.select("document_id"), "document_id", "left_semi")
    out = tasks.summarise(chunks, documents.select("document_id", "page_count", "quality"), model)
    grounded = out["points"].filter("grounded").groupBy("document_id").agg(F.collect_list("text").alias("grounded_points"))
    text = evaluation.scored_text(out["summary"].join(grounded, "document_id", "left"))
    named = lambda table: table.join(good, "document_id").drop("document_id")
    metrics = evaluation.summary_dimensions(text.join(wanted, "document_id"), named(out["audit"]), named(out["usage"])).drop("summarisation_time_ms")
    return metrics, wanted.select("fixture", F.lit("hook").alias("model"), F.lit(tasks.get_prompt("summary_general").ref).alias("prompt"))


def retrieval_scores(chunks: DataFrame, good: DataFrame, facts: DataFrame, budget: int) -> DataFrame:
    """Retrieval metrics by fixture, every document against its own query, ranked as a search ranks."""
    queries = good.join(retrieval_queries(facts), "fixture").select(F.col("document_id").alias("query_id"), "document_id", "fixture", "query")
    ranked = searching.rank_queries(chunks, queries.drop("fixture"), 1 << 30, "salience").drop("query_id").withColumnRenamed("score", "relevance_score")
    ranked = ranked.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    picks = F.array_compact(F.array(F.when(F.col("chunk_index") < budget, "head"), F.when(F.col("rank") <= budget, "query_ranked")))
    taken = ranked.withColumn("strategy", F.explode(picks)).join(queries.select("document_id", "fixture"), "document_id")
    taken = taken.select(F.col("fixture").alias("document_id"), "chunk_id", "relevance_score", "total_chunks", "strategy")
    return evaluation.retrieval_metrics(taken, budget).withColumnRenamed("document_id", "fixture")


def retrieval_queries(facts: DataFrame) -> DataFrame:
    """(fixture, query): a fixture's first three facts, 300 characters, else its description."""
    text = F.substring(F.array_join(F.slice("key_facts", 1, 3), " "), 1, 300)
    return facts.select("fixture", F.when(F.size("key_facts") > 0, text).otherwise(F.coalesce("description", F.lit("document summary"))).alias("query"))
