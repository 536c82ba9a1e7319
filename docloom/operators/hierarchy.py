"""Hierarchical summaries: facts of chunks, by section, then prompts level by level until one answer is left.

The facts of every chunk and their sections are expressions (``semantic``). Sections are
packed, in the order of their pages, into prompts of at most ``limit`` tokens by running
sums of their sizes; the answers of a document that needed several prompts are the next
level's sections. A document whose sections fit one prompt takes one call. Levels are
steps of the whole collection, so their number is that of the largest document: each
prompt holds two blocks at least, so at most log2 of its sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import strip
from docloom.operators import semantic
from docloom.operators.grounding import _is_object, _issue, _list, _text
from docloom.operators.models import Model
from docloom.operators.prompts import PromptTemplate, get_prompt, with_template
from docloom.sources.settled import settle

#: Tokens of a prompt, and the characters that count as one.
LIMIT, TOKEN_CHARS = 6000, 4
_NONE = "cast(array() as array<string>)"


def validate_syntheses(responses: DataFrame) -> DataFrame:
    """Coerced synthesis responses: summary_text, key_points, coverage_notes, with status and issues.

    Key points may be plain strings or objects with a ``point``; blank ones go. Without a
    summary text the required part is missing.
    """
    raw = F.when(F.trim(F.coalesce("response", F.lit(""))) == "", "{}").otherwise(F.col("response"))
    out = responses.select("document_id", raw.alias("raw"))
    point = lambda x: F.when(F.substring(F.ltrim(x), 1, 1) == "{", _text(x, "$.point")).otherwise(x)
    out = out.select(
        "document_id", _is_object(F.col("raw")).alias("ok"), _text(F.col("raw"), "$.summary_text").alias("summary_text"),
        F.transform(_list(F.col("raw"), "$.key_points"), point).alias("all_points"), _text(F.col("raw"), "$.coverage_notes").alias("coverage_notes"),
    )
    out = out.withColumn("key_points", F.filter("all_points", lambda p: strip(p) != ""))
    blank = strip(F.col("summary_text")) == ""
    issues = F.array_compact(
        F.array(
            F.when(blank, _issue("summary_text", "empty", "error")), F.when(F.size("all_points") == 0, _issue("key_points", "none", "warning", True)),
            F.when(F.size("all_points") > F.size("key_points"), _issue("key_points", "blank removed", "warning", True)),
        )
    )
    issues = F.when(F.col("ok"), issues).otherwise(F.array(_issue("<root>", "no object", "error")))
    status = F.when(~F.col("ok"), "wrong_structure").when(blank, "missing_required").when(F.size(issues) > 0, "partial_recovery").otherwise("valid")
    return out.select("document_id", status.alias("status"), "summary_text", "key_points", "coverage_notes", issues.alias("issues"))


def _first_page() -> Column:
    return F.coalesce(F.get("page_range", F.lit(0)), F.lit(0))


def pack(sections: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``sections`` with ``part``, the prompt of their document that they go to, from 0.

    Sections that are longer than a third of a prompt are cut to that. The parts that the running
    sum of sizes falls in are two thirds long: so none overfills a prompt, and but for a
    document's last one all hold two sections at least.
    """
    third = max(limit // 3, 40)
    text = F.substring("condensed_text", 1, (third - 30) * TOKEN_CHARS)
    cut = sections.withColumn("condensed_text", text)
    size = F.ceil((F.length("condensed_text") + F.length(F.substring("section_label", 1, 60)) + 40) / F.lit(TOKEN_CHARS))
    order = Window.partitionBy("document_id").orderBy(_first_page(), "first_chunk", "section_label").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(size).over(order), F.lit(0))
    whole = F.sum(size).over(Window.partitionBy("document_id"))
    part = F.when(whole <= limit, F.lit(0).cast("long")).otherwise(F.floor(place / (2 * third)).cast("long"))
    return cut.withColumn("section_label", F.substring("section_label", 1, 60)).withColumn("part", part)


def hierarchy(chunks: DataFrame, model: Model | None = None, limit: int = LIMIT, template: PromptTemplate | None = None) -> dict[str, DataFrame]:
    """Facts, sections, the first level's prompts, and with a model the responses and ``summary``.

    ``summary`` has document_id, status, summary_text, key_points, coverage_notes, levels,
    calls, sections_found, chunks_processed, chunk_ids, pages, notes. A document one of whose
    calls gave no text goes on with the others'; its status is that of the last call.
    """
    sections = semantic.section_summaries(semantic.chunk_facts(chunks))
    if model is None:
        prompts = semantic.synthesis_prompts(sections).withColumnRenamed("prompt", "user_prompt")
        return {"sections": sections, "prompts": prompts, "responses": None}
    sections = settle(sections, "sections")
    template = template or get_prompt("hierarchy_general")
    now, level, done, first, calls, responses = sections, 0, [], None, None, None
    while True:
        level += 1
        packed = settle(pack(now, limit), f"level-{level}")
        keyed = packed.withColumn("document_id", F.concat_ws("\x1f", "document_id", "part"))
        prompts = settle(with_template(semantic.synthesis_prompts(keyed).withColumnRenamed("prompt", "user_prompt"), template), f"prompts-{level}")
        answered = settle(model(prompts), f"responses-{level}")
        split = F.split("document_id", "\x1f")
        checked = settle(validate_syntheses(answered).withColumns({"part": F.element_at(split, -1).cast("long"), "document_id": F.element_at(split, 1)}), f"checked-{level}")
        own = checked.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        calls = own if calls is None else calls.unionByName(own)
        first, responses = first or prompts, responses or answered
        alone = checked.join(own.filter("n = 1"), "document_id").drop("n", "part").withColumn("levels", F.lit(level))
        done.append(alone)
        rest = checked.join(own.filter("n > 1"), "document_id")
        if rest.isEmpty():
            break
        spans = packed.groupBy("document_id", "part").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("page_range")))).alias("page_range"), F.sum("chunk_count").cast("int").alias("chunk_count"), F.min("first_chunk").alias("first_chunk")
        )
        told = F.concat_ws(" ", "summary_text", F.array_join("key_points", " "))
        now = rest.join(spans, ["document_id", "part"]).select(
            "document_id", F.concat(F.lit("part "), F.col("part") + 1).alias("section_label"), "chunk_count", "page_range", told.alias("condensed_text"), "first_chunk"
        )
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    facts = sections.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("sections_found"), F.sum("chunk_count").alias("chunks_processed"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(_first_page().alias("p"), "first_chunk", "chunk_ids"))), lambda x: x["chunk_ids"])).alias("chunk_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("page_range")))).alias("pages"),
    )
    out = out.join(calls.groupBy("document_id").agg(F.sum("n").alias("calls")), "document_id").join(facts, "document_id")
    notes = F.array_compact(
        F.array(
            F.format_string("%d chunks, %d sections, %d calls in %d levels", "chunks_processed", "sections_found", "calls", "levels"),
            F.when(strip(F.col("coverage_notes")) != "", F.concat(F.lit("the model on coverage: "), F.col("coverage_notes"))),
        )
    )
    return {"sections": sections, "prompts": first, "responses": responses, "summary": out.withColumn("notes", notes)}
