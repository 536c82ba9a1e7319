"""Evaluation metrics: fields, summaries, retrieval, slices, pipeline, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import EVALUATION_DATES, alnum, amount, parse_date, strip

COVERED = 0.55
# Words that carry no fact.
STOPWORDS = """
a an the is was were are be been being have has had do does did will would shall should may might can could of in to for
with on at by from as into about and or but if then that this it its
""".split()
# Cues of an actionable text.
ACTION_CUES = ["recommend", "follow-up", "refer", "plan", "schedule", "continue", "request", "next step", "deadline", "within", "payment due", "action required", "pending", "should", "advised", "prescribe"]


def _date(c: Column) -> Column:
    return parse_date(F.regexp_replace(F.regexp_replace(strip(c), ",", ", "), "  ", " "), EVALUATION_DATES)


def match_fields(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected and actual fields side by side, with every kind of match.

    ``expected`` has fixture, field_name, expected_value, must_extract, normalized;
    ``actual`` has fixture, field_name, actual_value.
    """
    out = expected.join(actual, ["fixture", "field_name"], "full").withColumn("must_extract", F.coalesce("must_extract", F.lit(False)))
    e, a = F.col("expected_value"), F.col("actual_value")
    both = e.isNotNull() & a.isNotNull()
    no = F.lit(False)
    exact = F.when(e.isNull(), a.isNull()).otherwise(F.coalesce(e == a, no))
    normal = F.when(e.isNull(), a.isNull()).otherwise(F.coalesce(alnum(e) == alnum(a), no))
    numeric = F.when(both, F.coalesce(F.abs(amount(e) - amount(a)) < 0.01, no)).otherwise(no)
    dates = F.when(both, F.coalesce(F.coalesce(_date(e), _date(F.col("normalized"))) == _date(a), no)).otherwise(no)
    out = out.withColumns({"exact_match": exact, "normalized_match": normal, "numeric_close": numeric, "date_close": dates})
    return out.withColumn("best_match", F.col("exact_match") | F.col("normalized_match") | F.col("numeric_close") | F.col("date_close"))


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def field_metrics(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1; a wrong value is a false positive and a false negative.

    ``by`` defaults to the fixture; an empty list gives the micro average of all fixtures.
    """
    must = F.col("must_extract") & F.col("expected_value").isNotNull()
    free = ~F.col("must_extract") & F.col("expected_value").isNull()
    there = F.col("actual_value").isNotNull()
    grouped = matches.groupBy(*(["fixture"] if by is None else by))
    out = grouped.agg(
        F.count_if(must & F.col("best_match")).alias("true_positives"),
        F.count_if((must & ~F.col("best_match") & there) | (free & there)).alias("false_positives"),
        F.count_if(must & ~F.col("best_match")).alias("false_negatives"),
        F.count_if(free & ~there).alias("true_negatives"),
    )
    return out.withColumns(_prf(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")))


def fact_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOPWORDS)))


def summary_metrics(summaries: DataFrame) -> DataFrame:
    """Share of key facts that a summary covers, and how actionable it is.

    ``summaries`` has fixture, key_facts, summary_text. A fact is covered when 55 percent of
    its words occur; one without words is, and so is a summary without facts.
    """
    out = summaries.withColumn("_t", fact_tokens(F.coalesce("summary_text", F.lit(""))))
    covered = F.filter("key_facts", lambda f: (F.size(fact_tokens(f)) == 0) | (F.size(F.array_intersect(fact_tokens(f), "_t")) / F.size(fact_tokens(f)) >= COVERED))
    low = F.lower(F.coalesce("summary_text", F.lit("")))
    cues = sum((F.contains(low, F.lit(c)).cast("int") for c in ACTION_CUES), F.lit(0))
    return out.select(
        "fixture",
        F.when(F.size("key_facts") > 0, F.size(covered) / F.size("key_facts")).otherwise(1.0).alias("factual_coverage"),
        F.least(cues / F.lit(3.0), F.lit(1.0)).alias("actionability"),
    )


def fact_details(key_facts: Column, text: Column) -> Column:
    """Each key fact with whether the text covers it, in order."""
    found = fact_tokens(F.coalesce(text, F.lit("")))
    told = lambda f: (F.size(fact_tokens(f)) == 0) | (F.size(F.array_intersect(fact_tokens(f), found)) / F.size(fact_tokens(f)) >= COVERED)
    return F.transform(key_facts, lambda f: F.struct(f.alias("fact"), told(f).alias("covered")))


def summary_dimensions(summaries: DataFrame, audits: DataFrame | None = None, usage: DataFrame | None = None, timings: DataFrame | None = None) -> DataFrame:
    """Every dimension of a summary's evaluation, by fixture.

    ``summaries`` is that of ``summary_metrics``; ``audits`` (``audit_grounding``), ``usage``
    (``usage_meta``) and ``timings`` (summarisation_time_ms) are keyed by fixture. What no table
    tells is 0, or false.
    """
    out = summary_metrics(summaries).join(summaries.select("fixture", fact_details(F.col("key_facts"), F.col("summary_text")).alias("fact_details")), "fixture")
    parts = [
        (audits, {"grounding_score": F.col("grounding_score"), "contradiction_count": F.col("key_points_ungrounded"), "chunks_provided": F.col("chunks_provided"), "chunks_cited": F.col("chunks_cited_valid"), "key_points_total": F.col("key_points_total"), "key_points_grounded": F.col("key_points_grounded"), "needs_review": F.col("needs_review")}),
        (usage, {"evidence_support": F.col("evidence_usage_ratio")}),
        (timings, {"summarisation_time_ms": F.col("summarisation_time_ms").cast("long")}),
    ]
    types = {"grounding_score": "double", "evidence_support": "double", "needs_review": "boolean"}
    for table, columns in parts:
        if table is not None:
            out = out.join(table.select("fixture", *[c.alias(name) for name, c in columns.items()]), "fixture", "left")
        for name in columns:
            nothing = F.lit(False) if types.get(name) == "boolean" else F.lit(0).cast(types.get(name, "long"))
            out = out.withColumn(name, F.coalesce(F.col(name).cast(types.get(name, "long")), nothing) if table is not None else nothing)
    return out


def retrieval_dimensions(metrics: DataFrame, usage: DataFrame | None = None, audits: DataFrame | None = None, recommendations: DataFrame | None = None, latencies: DataFrame | None = None) -> DataFrame:
    """``retrieval_metrics`` with what the answer made of the chunks, the recommendation and notes, by document.

    ``usage`` (``usage_meta``), ``audits`` (``audit_grounding``), ``recommendations``
    (``selection.recommend``) and ``latencies`` (retrieval_latency_ms) are keyed by document_id;
    what no table tells is 0, or empty.
    """
    out = metrics
    parts = [
        (usage, "evidence_usefulness", lambda: F.round("evidence_usage_ratio", 4), F.lit(0.0)), (audits, "answer_grounding", lambda: F.round("grounding_score", 4), F.lit(0.0)),
        (recommendations, "recommendation", lambda: F.col("recommendation"), F.lit("")), (latencies, "retrieval_latency_ms", lambda: F.col("retrieval_latency_ms").cast("long"), F.lit(0).cast("long")),
    ]
    for table, name, value, nothing in parts:
        if table is None:
            out = out.withColumn(name, nothing)
        else:
            out = out.join(table.select("document_id", value().alias(name)), "document_id", "left").withColumn(name, F.coalesce(name, nothing))
    none = F.col("strategy_count") == 0
    gained = F.concat(F.lit("ranking by the query raised the mean relevance by "), F.format_string("%.3f", "relevance_lift"))
    said = F.when(none, "no strategy picked anything").when(F.col("relevance_lift") > 0, gained).otherwise("ranking by the query raised nothing")
    return out.withColumn("notes", F.array_compact(F.array(said, F.nullif(F.col("recommendation"), F.lit("")))))


def retrieval_metrics(picks: DataFrame, budget: int) -> DataFrame:
    """Relevance of head and query_ranked, their lift and overlap, by document."""
    # Scores have four decimals: averaged as whole ten-thousandths, half up, in any order of rows.
    whole = lambda s: F.when(F.col("strategy") == s, F.round(F.col("relevance_score") * 10000).cast("long"))
    mean = lambda s: F.coalesce(F.floor((2 * F.sum(whole(s)) + F.count(whole(s))) / (2 * F.count(whole(s)))) / 10000.0, F.lit(0.0))
    ids = lambda s: F.collect_set(F.when(F.col("strategy") == s, F.col("chunk_id")))
    out = picks.groupBy("document_id").agg(
        F.count_distinct("strategy").alias("strategy_count"), mean("head").alias("head_avg_relevance"), mean("query_ranked").alias("query_ranked_avg_relevance"), ids("head").alias("h"), ids("query_ranked").alias("q"), F.first("total_chunks").alias("total_chunks"),
    )
    union = F.size(F.array_union("h", "q"))
    return out.select(
        "document_id", "strategy_count", "head_avg_relevance", "query_ranked_avg_relevance",
        F.round(F.col("query_ranked_avg_relevance") - F.col("head_avg_relevance"), 4).alias("relevance_lift"),
        F.when(union > 0, F.round(F.size(F.array_intersect("h", "q")) / union, 4)).otherwise(0.0).alias("selected_overlap"),
        F.when(F.col("total_chunks") > 0, F.round(F.lit(budget) / F.col("total_chunks"), 4)).otherwise(0.0).alias("token_efficiency"),
    )


def slice_breakdown(slices: DataFrame, fields: DataFrame, summaries: DataFrame, retrieval: DataFrame) -> DataFrame:
    """Averages by slice; members without any metric are left out, and slices without members.

    ``slices`` has slice_name, slice_value, fixture; the metrics are keyed by fixture.
    """
    tagged = [d.withColumn(f"_{k}", F.lit(True)) for k, d in (("f", fields), ("s", summaries), ("r", retrieval))]
    out = slices
    for d in tagged:
        out = out.join(d, "fixture", "left")
    out = out.filter(F.coalesce("_f", "_s", "_r").isNotNull())
    for c in ("grounding_score", "extraction_time_ms", "summarisation_time_ms"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return out.groupBy("slice_name", "slice_value").agg(
        F.count(F.lit(1)).alias("fixture_count"), mean("precision").alias("avg_precision"), mean("recall").alias("avg_recall"), mean("f1").alias("avg_f1"),
        mean("factual_coverage").alias("avg_factual_coverage"), mean("grounding_score").alias("avg_grounding_score"),
        mean("extraction_time_ms").alias("avg_extraction_time_ms"), mean("summarisation_time_ms").alias("avg_summarisation_time_ms"),
        mean("query_ranked_avg_relevance").alias("avg_retrieval_relevance"), mean("relevance_lift").alias("avg_retrieval_lift"),
        F.coalesce(F.sum("true_positives"), F.lit(0)).alias("total_true_positives"), F.coalesce(F.sum("false_positives"), F.lit(0)).alias("total_false_positives"), F.coalesce(F.sum("false_negatives"), F.lit(0)).alias("total_false_negatives"),
    )


#: The slices that a breakdown may have; others are left out.
SLICES = (
    "by_document_type", "by_size_category", "by_file_format", "by_extraction_density", "by_section_richness", "by_content_style",
    "by_parse_quality", "by_page_count_bucket", "by_text_cleanliness", "by_task_type", "by_model_prompt",
)


def bucket_slices(documents: DataFrame) -> DataFrame:
    """Run-time slices by page count: up to 1, 5, 20, more."""
    pages = F.col("page_count")
    bucket = F.when(pages <= 1, "single_page").when(pages <= 5, "short_multi_page").when(pages <= 20, "medium_multi_page").otherwise("long_document")
    return documents.select(F.lit("by_page_count_bucket").alias("slice_name"), bucket.alias("slice_value"), F.col("document_id").alias("fixture"))


def runtime_slices(documents: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Slices that a run gives by itself: parse quality, page count, cleanliness of the text, task, model and prompt.

    ``documents`` has document_id, page_count and may have quality, likely_needs_ocr,
    likely_scanned; ``runs`` (fixture, model, prompt) are the summaries that were made.
    """
    has = lambda c, empty: F.coalesce(F.col(c), F.lit(empty)) if c in documents.columns else F.lit(empty)
    quality = has("quality", "unknown")
    clean = F.when((quality == "degraded") | has("likely_needs_ocr", False) | has("likely_scanned", False), "low_text_or_degraded").otherwise("clean_text")
    fixture = F.col("document_id").alias("fixture")
    row = lambda name, value: F.struct(F.lit(name).alias("slice_name"), value.alias("slice_value"))
    three = F.array(row("by_parse_quality", quality), row("by_text_cleanliness", clean), row("by_task_type", F.lit("deterministic_extraction")))
    out = documents.select(F.explode(three).alias("s"), fixture).select("s.*", "fixture").unionByName(bucket_slices(documents))
    if runs is None:
        return out
    two = F.array(row("by_task_type", F.lit("ai_summary")), row("by_model_prompt", F.concat_ws(":", "model", "prompt")))
    return out.unionByName(runs.select(F.explode(two).alias("s"), "fixture").select("s.*", "fixture"))


def merge_slices(given: DataFrame, runtime: DataFrame) -> DataFrame:
    """Both tables' slices; a slice that the run gives replaces the given one of that name. Unknown names go."""
    rest = given.join(runtime.select("slice_name").distinct(), "slice_name", "left_anti")
    return rest.unionByName(runtime).filter(F.col("slice_name").isin(*SLICES))


def routing_accuracy(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Routing hits among the fixtures with an expectation; any accepted type is right."""
    both = actual.join(expected, "fixture")
    right = (F.col("predicted_type") == F.col("expected_type")) | F.coalesce(F.array_contains("accept_types", F.col("predicted_type")), F.lit(False))
    return both.agg(F.count_if(right).alias("routing_correct"), F.count_if(~right).alias("routing_incorrect"), F.coalesce(F.avg(right.cast("int")), F.lit(0.0)).alias("routing_accuracy"))


def timing_metrics(timings: DataFrame) -> DataFrame:
    """Average and largest stage times; summarisation averages positive times only."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    ran = F.when(F.col("summarisation_time_ms") > 0, F.col("summarisation_time_ms"))
    return timings.agg(
        F.count(F.lit(1)).alias("fixtures_processed"), mean("upload_time_ms").alias("avg_upload_ms"), F.max("upload_time_ms").alias("max_upload_ms"),
        mean("extraction_time_ms").alias("avg_extraction_ms"), F.max("extraction_time_ms").alias("max_extraction_ms"), mean(ran).alias("avg_summarisation_ms"), F.coalesce(F.max(ran), F.lit(0)).alias("max_summarisation_ms"),
    )


def evidence_attachment(fields: DataFrame) -> DataFrame:
    return fields.agg(F.count(F.lit(1)).alias("total_fields_extracted"), F.count_if(F.col("evidence_id").isNotNull()).alias("total_fields_with_evidence"))


def pipeline_metrics(timings: DataFrame, routed: DataFrame, expected: DataFrame, fields: DataFrame, failures: DataFrame) -> DataFrame:
    """One row over a whole run: counts, stage times, routing, failures, attached evidence.

    ``failures`` has the fixtures that could not be processed.
    """
    failed = failures.agg(F.count(F.lit(1)).alias("fixtures_failed"), F.sort_array(F.collect_list("fixture")).alias("failures"))
    parts = [timing_metrics(timings), routing_accuracy(routed, expected), evidence_attachment(fields), failed]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:  # single rows side by side
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    total = F.col("fixtures_processed") + F.col("fixtures_failed")
    return out.drop("_one").withColumns(
        {"total_fixtures": total, "extraction_failure_rate": rate(F.col("fixtures_failed"), total), "evidence_attachment_rate": rate(F.col("total_fields_with_evidence"), F.col("total_fields_extracted"))}
    )


def scored_text(summaries: DataFrame) -> DataFrame:
    """(document_id, summary_text): narrative, key points and grounded points in lines; empty parts go.

    ``summaries`` has document_id, summary_text, key_points, and may have grounded_points.
    """
    none = F.expr("cast(array() as array<string>)")
    lists = [F.coalesce(F.col(c), none) for c in ("key_points", "grounded_points") if c in summaries.columns]
    parts = F.filter(F.concat(F.array("summary_text"), *lists), lambda x: F.coalesce(x, F.lit("")) != "")
    return summaries.select("document_id", F.array_join(parts, "\n").alias("summary_text"))


def compare_experiments(rows: DataFrame) -> DataFrame:
    """Best variant by coverage, by grounding, by speed, and overall; first of equals.

    ``rows`` has experiment, position, label, factual_coverage, grounding_score, processing_time_ms.
    """
    first = -F.col("position")
    return rows.groupBy("experiment").agg(
        F.max_by("label", F.struct("factual_coverage", first)).alias("best_factual_coverage"),
        F.max_by("label", F.struct("grounding_score", first)).alias("best_grounding"),
        F.min_by("label", F.struct("processing_time_ms", "position")).alias("fastest_variant"),
        F.max_by("label", F.struct("factual_coverage", "grounding_score", -F.col("processing_time_ms"), first)).alias("recommended"),
    )


def recommendation(rows: DataFrame) -> DataFrame:
    """(experiment, recommendation): the best variant over all, with its figures in words."""
    best = F.max_by(F.struct("label", "factual_coverage", "grounding_score", "processing_time_ms"), F.struct("factual_coverage", "grounding_score", -F.col("processing_time_ms"), -F.col("position")))
    out = rows.groupBy("experiment").agg(best.alias("b"))
    figures = F.format_string("%s: coverage %.2f, grounding %.2f, %d ms", "b.label", F.col("b.factual_coverage").cast("double"), F.col("b.grounding_score").cast("double"), F.col("b.processing_time_ms").cast("long"))
    return out.select("experiment", figures.alias("recommendation"))
