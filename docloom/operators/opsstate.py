"""Operational metrics as states that can be added up: one row a batch, merged when they are read.

A state holds counts, sums and maxima and the newest errors (RECENT_ERRORS of them), so
states of any split of the calls merge to the state of the whole, in any order. A batch's
state is a file under its id: a batch that comes again replaces its own and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ops import RECENT_ERRORS

_ERROR = ("occurred_at", "call_id", "message")
#: What is summed, and what the largest is kept of.
SUMS = (
    "calls", "call_errors", "retryable_errors", "call_ms", "tasks", "task_ms", "valid", "ungrounded", "unsupported", "to_review", "retrievals", "retrieval_ms",
)
MAXIMA = ("call_ms_max", "task_ms_max", "retrieval_ms_max")


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def batch_state(calls: DataFrame, tasks: DataFrame, retrievals: DataFrame) -> DataFrame:
    """One row: the state of a batch of ``ops_snapshot``'s tables; calls may have occurred_at, call_id, message."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    most = lambda c: F.coalesce(F.max(F.col(c).cast("long")), F.lit(0))
    told = all(c in calls.columns for c in _ERROR)
    at = F.struct(F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.col("call_id").cast("string").alias("call_id"), F.substring("message", 1, 200).alias("message")) if told else F.lit(None).cast("struct<occurred_at: timestamp, call_id: string, message: string>")
    a = calls.agg(
        F.count(F.lit(1)).alias("calls"), _count(~F.col("success")).alias("call_errors"), _count(~F.col("success") & F.col("retryable")).alias("retryable_errors"), total("latency_ms").alias("call_ms"), most("latency_ms").alias("call_ms_max"),
    )
    # The newest errors by a bounded top-k, not by a list of all.
    newest = calls.filter(~F.col("success")).select(at.alias("e")).filter("e is not null").orderBy(F.desc("e.occurred_at"), F.desc("e.call_id")).limit(RECENT_ERRORS)
    errors = newest.agg(F.sort_array(F.collect_list("e"), asc=False).alias("errors"))
    no, invalid = F.lit(False), F.col("validation_status") != "valid"
    b = tasks.agg(
        F.count(F.lit(1)).alias("tasks"), total("processing_time_ms").alias("task_ms"), most("processing_time_ms").alias("task_ms_max"), F.count_if(~invalid).alias("valid"),
        _count(F.col("needs_review") | (F.col("grounding_score") < 0.7)).alias("ungrounded"), _count(F.col("unsupported_claims") > 0).alias("unsupported"),
        _count(invalid | F.coalesce("review_recommended", no) | F.coalesce("needs_review", no)).alias("to_review"),
    )
    c = retrievals.agg(F.count(F.lit(1)).alias("retrievals"), total("latency_ms").alias("retrieval_ms"), most("latency_ms").alias("retrieval_ms_max"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(a).join(one(errors), "_one").join(one(b), "_one").join(one(c), "_one").drop("_one").select(*SUMS, *MAXIMA, "errors")


def merged(states: DataFrame) -> DataFrame:
    """One row: the state of all batches together. Merging merged states gives the same."""
    rest = states.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in MAXIMA]).withColumn("_one", F.lit(1))
    newest = states.select(F.explode("errors").alias("e")).orderBy(F.desc("e.occurred_at"), F.desc("e.call_id")).limit(RECENT_ERRORS)
    return rest.join(newest.agg(F.sort_array(F.collect_list("e"), asc=False).alias("errors")).withColumn("_one", F.lit(1)), "_one").drop("_one").select(*SUMS, *MAXIMA, "errors")


def snapshot(state: DataFrame) -> DataFrame:
    """The row that ``ops.ops_snapshot`` gives of the batches' tables."""
    mean = lambda total, n: F.round(F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0), 2)
    rate = lambda hits, n, empty=0.0: F.round(F.when(F.col(n) > 0, F.col(hits) / F.col(n)).otherwise(empty), 4)
    return state.select(
        F.col("calls").alias("provider_calls_total"), F.col("call_errors").alias("provider_errors_total"), F.col("retryable_errors").alias("retryable_provider_errors"), rate("call_errors", "calls").alias("provider_error_rate"),
        mean("call_ms", "calls").alias("avg_model_latency_ms"), F.col("call_ms_max").alias("max_model_latency_ms"),
        F.col("tasks").alias("task_runs_total"), mean("task_ms", "tasks").alias("avg_generation_latency_ms"), F.col("task_ms_max").alias("max_generation_latency_ms"),
        rate("valid", "tasks", 1.0).alias("output_valid_rate"), rate("ungrounded", "tasks").alias("grounding_failure_rate"), rate("unsupported", "tasks").alias("unsupported_claim_rate"), rate("to_review", "tasks").alias("review_needed_rate"),
        F.col("retrievals").alias("retrieval_requests_total"), mean("retrieval_ms", "retrievals").alias("avg_retrieval_latency_ms"), F.col("retrieval_ms_max").alias("max_retrieval_latency_ms"),
    )


class OpsRegistry:
    """The states of all batches in a folder, one below ``batch=<id>`` each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch_id: str, calls: DataFrame, tasks: DataFrame, retrievals: DataFrame) -> None:
        """Note a batch; one of the same id is replaced."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        batch_state(calls, tasks, retrievals).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def state(self) -> DataFrame:
        return merged(self.spark.read.parquet(self.path).drop("batch"))

    def snapshot(self) -> DataFrame:
        return snapshot(self.state())

    def recent_errors(self) -> DataFrame:
        """(occurred_at, call_id, message), newest first."""
        return self.state().select(F.inline("errors"))
