"""The summarisation, chronology and hierarchy composites, and prompt experiments.

The model call itself is a hook: a function from (document_id, system_prompt,
user_prompt) rows to (document_id, response) rows, or a table of recorded responses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import evaluation as E
from docloom.operators import grounding as G
from docloom.operators import selection as S
from docloom.operators.hierarchy import hierarchy
from docloom.operators.models import CallPolicy, Model, ResponseStore, degraded_responses, model_hook, prompt_digest, provider_calls, recorded
from docloom.operators.prompts import PromptTemplate, build_prompts, get_prompt, list_prompts, register_prompt, with_templates
from docloom.settings import load_settings
from docloom.sources.settled import settle

__all__ = [
    "CallPolicy", "Model", "PromptTemplate", "ResponseStore", "Variant", "build_prompts", "chronology", "degraded_responses", "get_prompt", "hierarchy", "list_prompts", "model_hook", "prompt_digest",
    "provider_calls", "recorded", "register_prompt", "register_task", "run_experiment", "run_task", "summarise", "with_templates",
]


def summarise(
    chunks: DataFrame,
    documents: DataFrame,
    model: Model,
    budget: int | None = None,
    strategy: str = "head",
    query: str | None = None,
    fields: DataFrame | None = None,
    template: PromptTemplate | None = None,
) -> dict[str, DataFrame]:
    """Selection, coverage, prompt, response, validation, grounding, uncertainty, degradation.

    ``documents`` has document_id, page_count, quality. Returns the tables of all steps.
    The steps that others read are written, so the model is called once a prompt. Without a
    ``budget`` the session's setting holds.
    """
    budget = budget or load_settings(chunks.sparkSession).max_llm_chunks
    selected = settle(S.select_chunks(chunks, budget, strategy, query), "selected")
    coverage = settle(S.coverage_report(chunks, selected, documents), "coverage")
    return _summarised(selected, coverage, documents, model, fields, template)


def _summarised(selected: DataFrame, coverage: DataFrame, documents: DataFrame, model: Model, fields: DataFrame | None, template: PromptTemplate | DataFrame | None) -> dict[str, DataFrame]:
    """What follows the selection; a document_id may be a run's."""
    responses = settle(model(build_prompts(selected, coverage, fields, template)), "responses")
    validated = settle(G.validate_summaries(responses), "validated")
    points = settle(G.ground_points(validated, selected), "points")
    audit = G.audit_grounding(validated, points, selected)
    llm_fields = validated.select("document_id", F.inline("structured_fields"))
    conflicts = G.field_contradictions(llm_fields, fields).groupBy("document_id").agg(F.count(F.lit(1)).alias("contradictions")) if fields is not None else None
    inputs = (
        audit.join(validated.select("document_id", F.col("status").alias("validation_status")), "document_id")
        .join(coverage.select("document_id", "coverage_level"), "document_id", "left")
        .join(documents.select("document_id", F.col("quality").alias("parse_quality")), "document_id", "left")
        .join(G.inferred_claims(points), "document_id", "left")
    )
    inputs = inputs.join(conflicts, "document_id", "left") if conflicts is not None else inputs.withColumn("contradictions", F.lit(0))
    inputs = inputs.fillna({"contradictions": 0, "inferred_claims": 0}).select(
        "document_id", "parse_quality", F.lit(False).alias("likely_low_quality_source"), "coverage_level", "grounding_score", F.col("key_points_ungrounded").alias("unsupported_claims"), "contradictions", "validation_status", "inferred_claims",
    )
    assessed = G.uncertainty(inputs)
    return {"selected": selected, "coverage": coverage, "responses": responses, "validated": validated, "points": points, "audit": audit, "gaps": G.evidence_gaps(points, audit), "uncertainty": assessed, "summary": G.degrade_summaries(validated, assessed, points), "usage": G.usage_meta(validated, selected)}


def chronology(chunks: DataFrame, model: Model, budget: int = 10, strategy: str = "head", query: str | None = None, template: PromptTemplate | None = None) -> dict[str, DataFrame]:
    """Selection, prompt, response, validation and audit of dated events."""
    selected = settle(S.select_chunks(chunks, budget, strategy, query), "selected")
    prompts = build_prompts(selected, template=template or get_prompt("chronology_general"))
    validated = settle(G.validate_chronologies(model(prompts)), "validated")
    return {"selected": selected, "validated": validated, "audit": G.audit_chronology(validated, selected)}


_TASKS: dict[str, Callable[..., dict[str, DataFrame]]] = {"summarisation": summarise, "chronology": chronology, "hierarchical": hierarchy}


def register_task(name: str, task: Callable[..., dict[str, DataFrame]]) -> None:
    _TASKS[name] = task


def run_task(name: str, *args, **kwargs) -> dict[str, DataFrame]:
    return _TASKS[name](*args, **kwargs)


@dataclass(frozen=True)
class Variant:
    """One arm of a prompt experiment: the prompt it sends, the model it asks, the chunks it shows."""

    label: str
    model: Model
    prompt: str = "summary_general@1.0"
    strategy: str = "head"
    budget: int = 10
    query: str | None = None
    use_fields: bool = False
    #: The model's name in the rows; empty: the template's.
    model_name: str = ""


def _runs(documents: DataFrame, variants: list[Variant]) -> DataFrame:
    """One row for each document and variant, with the variant's settings and its template.

    ``document_id`` is the run's, ``source_id`` the document's. A prompt that is not registered is an error.
    """
    rows = []
    for position, v in enumerate(variants):
        name, _, version = v.prompt.partition("@")
        get_prompt(name, version or "1.0")
        rows.append((str(position), position, v.label, name, version or "1.0", v.model_name, v.strategy, v.budget, v.use_fields))
    schema = "arm string, position int, label string, prompt_name string, prompt_version string, model string, chunk_selection string, max_chunks int, use_fields boolean"
    table = with_templates(documents.sparkSession.createDataFrame(rows, schema))
    every = documents.withColumnRenamed("document_id", "source_id").withColumn("arm", F.explode(F.array(*[F.lit(r[0]) for r in rows])))
    return every.join(F.broadcast(table), "arm").withColumn("document_id", F.concat_ws(":", "arm", "source_id"))


def run_experiment(name: str, chunks: DataFrame, documents: DataFrame, facts: DataFrame, variants: list[Variant], fields: DataFrame | None = None) -> dict[str, DataFrame]:
    """The same documents summarised by every variant, scored alike and compared.

    One plan over (document, variant) rows: every step runs once for all variants, under run
    ids. ``facts`` has document_id and key_facts. ``runs`` holds a row a document and variant
    with its status, scores and notes, ``rows`` a variant's averages over the documents; times
    are those that the hooks report, 0 where they report none.
    """
    runs = settle(_runs(documents, variants), "runs")
    keys = runs.select("document_id", "source_id", "arm")
    arms = [S.Arm(str(i), v.strategy, v.budget, v.query) for i, v in enumerate(variants)]
    taken = S.select_arms(chunks, arms).withColumnRenamed("document_id", "source_id")
    selected = settle(taken.withColumn("document_id", F.concat_ws(":", "arm", "source_id")).drop("arm", "source_id"), "selected")
    totals = keys.join(S.chunk_totals(chunks).withColumnRenamed("document_id", "source_id"), "source_id").drop("source_id", "arm")
    coverage = settle(S.coverage_report(chunks, selected, runs, totals), "coverage")
    known = None
    if fields is not None:
        known = runs.filter("use_fields").select("document_id", "source_id").join(fields.withColumnRenamed("document_id", "source_id"), "source_id").drop("source_id")

    def asked(prompts: DataFrame) -> DataFrame:
        """Every arm's prompts by its own hook; arms that share one are asked together."""
        hooks = list(dict.fromkeys(v.model for v in variants))
        arm = F.substring_index("document_id", ":", 1)
        parts = [hook(prompts.filter(arm.isin(*[str(i) for i, v in enumerate(variants) if v.model == hook]))) for hook in hooks]
        parts = [p.select("document_id", "response", (F.col("latency_ms") if "latency_ms" in p.columns else F.lit(0)).cast("long").alias("latency_ms")) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    out = _summarised(selected, coverage, runs.select("document_id", "page_count", "quality"), asked, known, runs)
    grounded = out["points"].filter("grounded").groupBy("document_id").agg(F.collect_list("text").alias("grounded_points"))
    text = E.scored_text(out["summary"].join(grounded, "document_id", "left"))
    wanted = keys.join(facts.withColumnRenamed("document_id", "source_id"), "source_id").select("document_id", "key_facts")
    metrics = E.summary_metrics(text.join(wanted, "document_id").withColumn("fixture", F.col("document_id"))).withColumnRenamed("fixture", "document_id")
    each = (
        runs.select("document_id", "source_id", "position", "label", "prompt_ref", "model", "chunk_selection", "max_chunks")
        .join(metrics.select("document_id", "factual_coverage", "actionability"), "document_id")
        .join(out["audit"].select("document_id", "grounding_score", "needs_review"), "document_id")
        .join(out["usage"].select("document_id", F.col("evidence_usage_ratio").alias("evidence_support")), "document_id")
        .join(out["validated"].select("document_id", "status", F.size("issues").alias("issues")), "document_id")
        .join(out["coverage"].select("document_id", "coverage_level", "selected_chunks", "total_chunks"), "document_id")
        .join(out["uncertainty"].select("document_id", "review_recommended", "abstained", "risk_flags"), "document_id")
        .join(out["responses"].select("document_id", F.coalesce("latency_ms", F.lit(0)).alias("processing_time_ms")), "document_id")
    )
    notes = F.array_compact(
        F.array(
            F.concat_ws(" ", F.lit("shown"), F.concat_ws("/", "selected_chunks", "total_chunks"), F.lit("chunks,"), "coverage_level"),
            F.when(F.col("issues") > 0, F.concat(F.lit("repaired: "), F.col("issues"))),
            F.when(F.size("risk_flags") > 0, F.concat(F.lit("risks: "), F.array_join("risk_flags", ", "))),
            F.when(F.col("abstained"), "no summary was given").when(F.col("review_recommended"), "to be reviewed"),
        )
    )
    detail = ["position", "label", "prompt_ref", "model", "chunk_selection", "max_chunks", "status", "processing_time_ms", "factual_coverage", "grounding_score", "evidence_support", "actionability"]
    scored = settle(each.select(F.col("source_id").alias("document_id"), *detail, notes.alias("notes")), "scored")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c)
    arm = ["position", "label", "prompt_ref", "model", "chunk_selection", "max_chunks"]
    by_status = scored.groupBy(*arm, "status").agg(F.count(F.lit(1)).alias("n")).groupBy(*arm).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "status", "n"))), ", ").alias("statuses"))
    rows = scored.groupBy(*arm).agg(
        *map(mean, ("factual_coverage", "grounding_score", "evidence_support", "actionability")),
        F.sum("processing_time_ms").alias("processing_time_ms"), F.count_if(F.col("status") == "valid").alias("valid"), F.count(F.lit(1)).alias("documents"),
    )
    rows = rows.join(by_status, arm).withColumn("experiment", F.lit(name))
    return {"rows": rows, "runs": scored, "comparison": E.compare_experiments(rows).join(E.recommendation(rows), "experiment")}
