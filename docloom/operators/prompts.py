"""Prompt templates, and prompts as rows: one for each document, or run, and template.

A row is all that a model is told: (document_id, prompt_ref, model, system_prompt,
user_prompt). The registry is a small table, joined to the rows by name and version, so
the arms of an experiment differ in what they send and not in a label beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PromptTemplate:
    """A system prompt by name and version, the model it suits, the keys its answer must have."""

    name: str
    version: str
    task: str
    system: str
    model: str = ""
    keys: tuple[str, ...] = ()
    notes: str = ""

    @property
    def ref(self) -> str:
        return f"{self.name}@{self.version}"


_JSON = "Answer with one JSON object and cite the chunk ids that support every statement."
_SUMMARY_KEYS = ("summary_text", "key_points", "structured_fields", "chunk_ids_used")
_REGISTRY: dict[tuple[str, str], PromptTemplate] = {}


def register_prompt(template: PromptTemplate) -> None:
    _REGISTRY[template.name, template.version] = template


for _name, _task, _text, _keys in (
    ("summary_general", "summarisation", "Summarise the document from the given chunks.", _SUMMARY_KEYS),
    ("summary_billing", "summarisation", "Summarise charges, payments and balances from the given chunks.", _SUMMARY_KEYS),
    ("summary_medical", "summarisation", "Summarise findings, treatment and follow-up from the given chunks.", _SUMMARY_KEYS),
    ("chronology_general", "chronology", "List the dated events that the given chunks report.", ("events", "chunk_ids_used")),
    ("hierarchy_general", "hierarchical", "Combine the given section summaries into one summary of the document.", ("summary_text", "key_points", "coverage_notes")),
):
    register_prompt(PromptTemplate(_name, "1.0", _task, f"{_text} {_JSON}", keys=_keys))


def get_prompt(name: str, version: str = "1.0") -> PromptTemplate:
    return _REGISTRY[name, version]


def list_prompts(spark: SparkSession) -> DataFrame:
    """The registry as a table, by task, name and version."""
    rows = [(p.task, p.name, p.version, p.system, p.model, list(p.keys), p.notes) for p in _REGISTRY.values()]
    return spark.createDataFrame(rows, "task string, name string, version string, system string, model string, keys array<string>, notes string").orderBy("task", "name", "version")


def with_template(rows: DataFrame, template: PromptTemplate) -> DataFrame:
    """``rows`` under one template: prompt_ref, model, system_prompt."""
    return rows.withColumns({"prompt_ref": F.lit(template.ref), "model": F.lit(template.model), "system_prompt": F.lit(template.system)})


def with_templates(rows: DataFrame) -> DataFrame:
    """``rows`` beside the registered template that each names by prompt_name and prompt_version.

    Their own ``model``, where they have one that is not empty, goes before the template's.
    """
    known = list_prompts(rows.sparkSession).select(F.col("name").alias("prompt_name"), F.col("version").alias("prompt_version"), F.col("system").alias("system_prompt"), F.col("model").alias("_model"))
    own = F.nullif(F.col("model"), F.lit("")) if "model" in rows.columns else F.lit(None).cast("string")
    met = rows.join(F.broadcast(known), ["prompt_name", "prompt_version"]).withColumn("_m", F.coalesce(own, "_model"))
    return met.drop("model", "_model").withColumnRenamed("_m", "model").withColumn("prompt_ref", F.concat_ws("@", "prompt_name", "prompt_version"))


def _listed(place: str, text: Column, glue: str) -> Column:
    """The texts of a group joined in the order of ``place``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place), text.alias("t")))), lambda x: x["t"]), glue)


def user_prompts(selected: DataFrame, coverage: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(document_id, user_prompt): what is left out, what is known, the chunks in order.

    The disclosure stands first, and only where the coverage is not comprehensive. Known
    fields carry the confidence they were found with, where the table has one.
    """
    block = F.concat(F.lit("[chunk_id: "), F.col("chunk_id"), F.lit("]\n"), F.col("text"))
    out = selected.groupBy("document_id").agg(_listed("position", block, "\n\n").alias("chunks"))
    parts = ["chunks"]
    if fields is not None:
        sure = F.col("confidence").cast("double") if "confidence" in fields.columns else F.lit(None).cast("double")
        told = F.when(sure.isNotNull(), F.format_string(" [confidence %.2f]", sure)).otherwise("")
        line = F.concat(F.lit("- "), F.col("field_name"), F.lit(": "), F.col("field_value"), told)
        known = fields.groupBy("document_id").agg(F.concat(F.lit("Known fields:\n"), _listed("field_index", line, "\n")).alias("known"))
        out, parts = out.join(known, "document_id", "left"), ["known", *parts]
    if coverage is not None:
        told = coverage.select("document_id", F.when(F.col("coverage_level") != "comprehensive", F.col("disclosure_text")).alias("told"))
        out, parts = out.join(told, "document_id", "left"), ["told", *parts]
    return out.select("document_id", F.concat_ws("\n\n", *parts).alias("user_prompt"))


def build_prompts(selected: DataFrame, coverage: DataFrame | None = None, fields: DataFrame | None = None, template: PromptTemplate | DataFrame | None = None) -> DataFrame:
    """(document_id, prompt_ref, model, system_prompt, user_prompt).

    ``template`` is one for all documents (by default the general summary), or a table
    (document_id, prompt_ref, model, system_prompt) with each row's own.
    """
    out = user_prompts(selected, coverage, fields)
    if isinstance(template, DataFrame):
        out = out.join(template.select("document_id", "prompt_ref", "model", "system_prompt"), "document_id")
    else:
        out = with_template(out, template or get_prompt("summary_general"))
    return out.select("document_id", "prompt_ref", "model", "system_prompt", "user_prompt")
