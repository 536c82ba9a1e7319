"""Operational metrics over event tables, and pipeline traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.parsing import HARD_FAILURES

RECENT_ERRORS = 12


def ops_snapshot(calls: DataFrame, tasks: DataFrame, retrievals: DataFrame) -> DataFrame:
    """One row of counters, latencies and rates.

    ``calls``: latency_ms, success, retryable. ``tasks``: processing_time_ms,
    validation_status, needs_review, grounding_score, unsupported_claims, review_recommended
    (null where a stage did not run). ``retrievals``: latency_ms. Without tasks the valid
    rate is 1, every other empty rate 0.
    """
    no = F.lit(False)
    lat = lambda c, name: [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2).alias(f"avg_{name}_ms"), F.coalesce(F.max(c), F.lit(0)).alias(f"max_{name}_ms")]
    rate = lambda test, empty=0.0: F.round(F.coalesce(F.avg(test.cast("int")), F.lit(empty)), 4)
    a = calls.agg(
        F.count(F.lit(1)).alias("provider_calls_total"), F.count_if(~F.col("success")).alias("provider_errors_total"), F.count_if(~F.col("success") & F.col("retryable")).alias("retryable_provider_errors"),
        rate(~F.col("success")).alias("provider_error_rate"), *lat("latency_ms", "model_latency"),
    )
    invalid = F.col("validation_status") != "valid"
    b = tasks.agg(
        F.count(F.lit(1)).alias("task_runs_total"), *lat("processing_time_ms", "generation_latency"), rate(~invalid, 1.0).alias("output_valid_rate"),
        rate(F.coalesce(F.col("needs_review") | (F.col("grounding_score") < 0.7), no)).alias("grounding_failure_rate"),
        rate(F.coalesce(F.col("unsupported_claims") > 0, no)).alias("unsupported_claim_rate"),
        rate(invalid | F.coalesce("review_recommended", no) | F.coalesce("needs_review", no)).alias("review_needed_rate"),
    )
    c = retrievals.agg(F.count(F.lit(1)).alias("retrieval_requests_total"), *lat("latency_ms", "retrieval_latency"))
    # Three single rows side by side, matched on a constant.
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").join(one(c), "_one").drop("_one")


def recent_errors(calls: DataFrame, keep: int = RECENT_ERRORS) -> DataFrame:
    """The newest failed calls, messages cut to 200 characters."""
    return calls.filter("not success").orderBy(F.desc("occurred_at"), F.desc("call_id")).limit(keep).withColumn("message", F.substring("message", 1, 200))


# Substrings of errors that are worth another try.
RETRYABLE = ("timeout", "timed out", "temporarily unavailable", "connection", "rate limit", "429", "500", "502", "503")


def is_retryable(message):
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, RETRYABLE)), lambda m: F.contains(low, m))


def fold_trace(outcomes: DataFrame) -> DataFrame:
    """Stage outcomes to one trace a document: durations summed, flags or-ed, failures listed in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("position", "stage"))))
    return outcomes.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("duration_ms").alias("total_duration_ms"), F.bool_or("used_fallback").alias("used_fallback"), F.bool_or("review_needed").alias("review_needed"),
        F.bool_and("success").alias("success"), F.transform(failed, lambda x: x["stage"]).alias("failed_stages"),
    )


#: Kinds of outcome: nothing amiss, a document is lost, worse than it could be, worth another try, for a person.
KINDS = ("none", "hard", "soft", "retryable", "review_needed")
LOW_CONFIDENCE, STRONG_GROUNDING = 0.5, 0.7


def _outcomes(rows: DataFrame, position: int, stage: str, cases: list[tuple], success, duration) -> DataFrame:
    """(document_id, position, stage, success, failure_kind, message, used_fallback, review_needed, duration_ms).

    ``cases`` are (test, kind, message); the first that holds decides.
    """
    kind = message = None
    for test, name, text in cases:
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        message = F.when(test, text) if message is None else message.when(test, text)
    took = F.coalesce(F.col(duration), F.lit(0)) if duration in rows.columns else F.lit(0)
    out = rows.select("document_id", F.lit(position).alias("position"), F.lit(stage).alias("stage"), success.alias("success"), kind.otherwise("none").alias("failure_kind"), message.otherwise("").alias("message"), *_fallback(rows), took.cast("long").alias("duration_ms"))
    return out.withColumn("review_needed", F.col("failure_kind") == "review_needed")


def _fallback(rows: DataFrame) -> list:
    return [(F.col("ocr_applied") if "ocr_applied" in rows.columns else F.lit(False)).alias("used_fallback")]


def parse_outcomes(meta: DataFrame) -> DataFrame:
    """The parse stage's outcome: a failed parse is a failed stage, and only OCR may save a text-less one."""
    reason, quality = F.coalesce("failure_reason", F.lit("none")), F.coalesce("quality", F.lit("good"))
    hard, bare, poor = reason.isin(*HARD_FAILURES), reason == "zero_text_pdf", quality == "unusable"
    cases = [
        (hard, "hard", F.concat(F.lit("not parsed: "), reason)),
        (bare, "soft", F.lit("no text layer; OCR may find one")),
        (poor, "hard", F.lit("parsed, but of no use")),
        (quality == "degraded", "soft", F.lit("parsed with losses")),
    ]
    return _outcomes(meta, 1, "parse", cases, ~(hard | bare | poor), "parse_ms")


def extraction_outcomes(stats: DataFrame) -> DataFrame:
    """``stats`` has document_id, field_count, min_confidence: no or doubtful fields need a person, but are no failure."""
    none = F.coalesce("field_count", F.lit(0)) == 0
    cases = [(none, "review_needed", F.lit("no field was found")), (F.col("min_confidence") < LOW_CONFIDENCE, "review_needed", F.concat(F.lit("least confidence "), F.format_string("%.2f", "min_confidence")))]
    return _outcomes(stats, 2, "extract", cases, F.lit(True), "extraction_ms")


def summary_outcomes(audits: DataFrame) -> DataFrame:
    """``audits`` has document_id, grounding_score, needs_review."""
    score = F.format_string("%.2f", "grounding_score")
    cases = [(F.coalesce("needs_review", F.lit(False)), "review_needed", F.concat(F.lit("grounding too weak: "), score)), (F.col("grounding_score") < STRONG_GROUNDING, "soft", F.concat(F.lit("grounding could be stronger: "), score))]
    return _outcomes(audits, 3, "summarise", cases, F.lit(True), "summarisation_ms")


def trace_flags(outcomes: DataFrame) -> DataFrame:
    """Per document which kinds of outcome its stages had, and the messages of the failed ones in order."""
    flags = [F.bool_or(F.col("failure_kind") == k).alias(f"has_{k}") for k in KINDS[1:]]
    said = F.when(~F.col("success") & (F.col("message") != ""), F.struct("position", F.concat(F.col("stage"), F.lit(": "), F.col("message")).alias("said")))
    return outcomes.groupBy("document_id").agg(F.sum("duration_ms").alias("total_ms"), *flags, F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]).alias("warnings"))


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest row of each key; ``position`` breaks ties, the first of equals wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(time), -F.col("position"))).alias("r")).select(*keys, "r.*")


def newest_first(rows: DataFrame, time: str = "created_at", *ties: str) -> DataFrame:
    """Rows by time, newest first; equal times by ``ties``, by default the ids and the position that the table has."""
    ties = ties or tuple(c for c in rows.columns if c.endswith("_id") or c == "position")
    return rows.orderBy(F.desc(time), *ties)
