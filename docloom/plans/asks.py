"""Queries that ask: prompt experiments, recorded calls, many searches in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import evaluation, grounding, searching, selection, tasks
from docloom.plans.queries import _CHUNKS, _PICKS, _RESPONSES, BUDGET, _picks, _plain_chunks, _responses, query
from docloom.sources import inputs as I


def _answer(prompts: DataFrame) -> DataFrame:
    """A model as an expression: it cites a chunk only where the system prompt asks for charges."""
    first = F.regexp_extract("user_prompt", r"\[chunk_id: (\w+)\]", 1)
    shown = F.size(F.regexp_extract_all("user_prompt", F.lit(r"(\[chunk_id: \w+\])"), 1))
    cited = F.array(F.when(F.contains("system_prompt", F.lit("charges")), first).otherwise("nowhere"))
    points = F.array(F.struct(F.lit("the first part").alias("point"), cited.alias("chunk_ids")))
    said = F.struct(F.concat(shown.cast("string"), F.lit(" shown")).alias("summary_text"), points.alias("key_points"), cited.alias("chunk_ids_used"))
    return prompts.select("document_id", F.to_json(said).alias("response"))


VARIANTS = [
    tasks.Variant("general", _answer, "summary_general@1.0", "head", 4),
    tasks.Variant("billing", _answer, "summary_billing@1.0", "head", 4),
    tasks.Variant("ends", _answer, "summary_billing@1.0", "head_tail", 6),
]


@query(
    f"""WITH {_CHUNKS}, t AS (SELECT DISTINCT document_id, total FROM ch),
v AS (SELECT * FROM (VALUES ('general', 'summary_general@1.0', 4, false), ('billing', 'summary_billing@1.0', 4, true), ('ends', 'summary_billing@1.0', 6, true)) AS x(label, prompt_ref, budget, cites))
SELECT document_id, label, prompt_ref, 'valid' AS status, CASE WHEN cites AND least(total, budget) = least(total, 4) THEN 1.0 ELSE 0.0 END AS factual_coverage,
  CASE WHEN cites THEN 1.0 ELSE 0.0 END AS grounding_score, CASE WHEN cites THEN round(1 / least(total, budget), 4) ELSE 0.0 END AS evidence_support FROM t, v"""
)
def prompt_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Three arms over all documents in one plan: two templates, two selections."""
    chunks = _plain_chunks(spark, sf)
    documents = I.pages(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count")).withColumn("quality", F.lit("good"))
    fact = F.concat(F.least(F.count(F.lit(1)), F.lit(4)).cast("string"), F.lit(" shown"))
    facts = chunks.groupBy("document_id").agg(F.array(fact).alias("key_facts"))
    out = tasks.run_experiment("prompts", chunks, documents, facts, VARIANTS)["runs"]
    return out.select("document_id", "label", "prompt_ref", "status", "factual_coverage", "grounding_score", "evidence_support")


_TERMS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x <> ''))"


@query(
    rf"""WITH {_CHUNKS}, q AS (
  SELECT 'item ' || item_id AS query_id, CAST(NULL AS VARCHAR) AS d, {_TERMS.format('text')} AS terms FROM benchmark
  UNION ALL SELECT 'own ' || document_id, document_id, {_TERMS.format('text[1:60]')} FROM pages WHERE page_number = 1),
s AS (SELECT q.query_id, c.document_id, c.chunk_id, c.chunk_index, len(list_filter(terms, lambda t: contains(lower(c.text), t))) AS hits, greatest(len(terms), 1) AS n FROM q JOIN ch c ON q.d IS NULL OR q.d = c.document_id),
r AS (SELECT *, round(hits / n, 4) AS score, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(hits / n, 4) DESC, chunk_index) AS rank FROM s WHERE hits > 0)
SELECT query_id, document_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 1"""
)
def query_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark items asked of all documents, and each document's opening asked of itself."""
    everywhere = I.table(spark, sf, "benchmark").select(F.concat(F.lit("item "), F.col("item_id")).alias("query_id"), F.lit(None).cast("string").alias("document_id"), F.col("text").alias("query"))
    own = I.pages(spark, sf).filter("page_number = 1").select(F.concat(F.lit("own "), F.col("document_id")).alias("query_id"), "document_id", F.substring("text", 1, 60).alias("query"))
    out = searching.rank_queries(_plain_chunks(spark, sf), everywhere.unionByName(own), 1, found_only=True)
    return out.select("query_id", "document_id", "chunk_id", "score", "rank")


@query(
    """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.chunk_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def vector_batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth embedding against all, through a stored index that is filled in two parts."""
    from docloom.sources.settled import fresh_path

    entries = I.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")
    middle = entries.agg(F.percentile_approx("vec_id", 0.5)).first()[0]
    index = searching.VectorIndex(spark, fresh_path(spark, "index"))
    index.add_batch(entries.filter(F.col("vec_id") <= middle), "vec_id")
    index.add_batch(entries, "vec_id")  # the first half is there already
    asked = entries.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return index.search(asked, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_RESPONSES}, k AS (SELECT document_id, provided, CASE WHEN total > 3 THEN 3 ELSE 2 END AS n FROM f0 JOIN np USING (document_id))
SELECT document_id AS fixture, round(2 / 3, 6) AS factual_coverage, 0.0 AS actionability, 'The order and the balance: true; made up: true; nothing of it: false' AS fact_details, round(1 / n, 4) AS grounding_score, CAST(n - 1 AS BIGINT) AS contradiction_count,
  CAST(provided AS BIGINT) AS chunks_provided, CAST(1 AS BIGINT) AS chunks_cited, CAST(n AS BIGINT) AS key_points_total, CAST(1 AS BIGINT) AS key_points_grounded, true AS needs_review, round(1 / provided, 4) AS evidence_support FROM k"""
)
def summary_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Every dimension of the recorded responses' evaluation."""
    chunks = _plain_chunks(spark, sf)
    selected = selection.select_chunks(chunks, BUDGET, "head")
    validated = grounding.validate_summaries(_responses(chunks))
    audit = grounding.audit_grounding(validated, grounding.ground_points(validated, selected), selected)
    facts = F.array(*map(F.lit, ("The order and the balance", "made up", "nothing of it")))
    text = evaluation.scored_text(validated.select("document_id", "summary_text", F.transform("key_points", lambda p: p["point"]).alias("key_points"))).withColumn("key_facts", facts)
    named = lambda table: table.withColumnRenamed("document_id", "fixture")
    out = evaluation.summary_dimensions(named(text), named(audit), named(grounding.usage_meta(validated, selected)))
    told = F.array_join(F.transform("fact_details", lambda f: F.concat_ws(": ", f["fact"], f["covered"].cast("string"))), "; ")
    return out.drop("summarisation_time_ms").withColumns({"fact_details": told, "factual_coverage": F.round("factual_coverage", 6)})


@query(
    f"""WITH {_PICKS}, m AS (SELECT document_id, round(coalesce(avg(score) FILTER (strategy = 'query_ranked'), 0.0) - coalesce(avg(score) FILTER (strategy = 'head'), 0.0), 9) AS lift FROM picks GROUP BY document_id),
pr AS (SELECT document_id, count(*) AS provided FROM (SELECT document_id, chunk_id FROM ch WHERE total <= {BUDGET} OR chunk_index < {BUDGET}) GROUP BY document_id), z AS (SELECT DISTINCT document_id, total FROM ch)
SELECT document_id, CASE WHEN lift > 0.1 THEN 'query_ranked' WHEN lift > 0 THEN 'query_ranked_slightly' ELSE 'similar' END AS recommendation, round(1 / provided, 4) AS evidence_usefulness, CAST(CASE WHEN total > 3 THEN 0.3333 ELSE 0.5 END AS DOUBLE) AS answer_grounding FROM m JOIN pr USING (document_id) JOIN z USING (document_id)"""
)
def retrieval_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """What retrieval was good for: the answer's use of the chunks, its grounding, the recommendation."""
    chunks = _plain_chunks(spark, sf)
    picks = _picks(spark, sf)
    totals = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    selected = selection.select_chunks(chunks, BUDGET, "head")
    validated = grounding.validate_summaries(_responses(chunks))
    audit = grounding.audit_grounding(validated, grounding.ground_points(validated, selected), selected)
    out = evaluation.retrieval_dimensions(evaluation.retrieval_metrics(picks.join(totals, "document_id"), BUDGET), grounding.usage_meta(validated, selected), audit, selection.recommend(picks))
    return out.select("document_id", "recommendation", "evidence_usefulness", "answer_grounding")
