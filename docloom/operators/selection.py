"""Chunk selection strategies, their comparison and coverage reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import percent
from docloom.operators.ranking import rank_vector, retrieve_hybrid, salience_score

STRATEGIES = ("head", "head_tail", "sampled", "routing_aware", "query_ranked", "diversified")
# The positional strategy of each document type.
ROUTING = {"legal": "head_tail", "billing": "head", "medical": "sampled", "treatment": "sampled", "correspondence": "head"}
PREVIEW = 120


def _with_totals(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("document_id")))


def _positional(strategy: Column | str, budget: int) -> Column:
    """Whether a chunk's place is selected by a positional strategy."""
    i, t = F.col("chunk_index"), F.col("total")
    tests = {
        "head": i < budget,
        "tail": i >= t - budget,
        "head_tail": (i < budget // 2) | (i >= t - (budget - budget // 2)),
        # floor(k * total / budget) for some k: the step down of k is where the floor changes.
        "sampled": F.exists(F.sequence(F.lit(0), F.lit(budget - 1)), lambda k: F.floor(k * (t / F.lit(budget))) == i),
    }
    if isinstance(strategy, str):
        return tests[strategy]
    out = F.when(strategy == "tail", tests["tail"])
    for name in ("head_tail", "sampled"):
        out = out.when(strategy == name, tests[name])
    return out.otherwise(tests["head"])


def _group() -> Column:
    """Section, else page, of a chunk; a chunk without pages is grouped by its place, label or not."""
    on_page = F.when(F.col("section_label") != "", F.col("section_label")).otherwise(F.concat(F.lit("page-"), F.get("page_numbers", F.lit(0))))
    return F.when(F.size("page_numbers") > 0, on_page).otherwise(F.concat(F.lit("idx-"), F.floor(F.col("chunk_index") / 5)))


@dataclass(frozen=True)
class Arm:
    """One selection among several over the same chunks."""

    label: str
    strategy: str = "head"
    budget: int = 10
    query: str | None = None


def flag_arms(chunks: DataFrame, arms: list[Arm]) -> DataFrame:
    """The chunks that any arm takes, with ``picks``: (strategy, place in its selection's order) by the arm's label.

    All arms are decided on the same rows: salience is scored once a query, and the windows of
    a document share one partitioning. A document whose chunks fit an arm's budget keeps all of
    them in order, whatever the strategy. ``relevance`` is the first query's salience score, 0 without one.
    """
    out = _with_totals(chunks)
    whole = Window.partitionBy("document_id")
    queries = list(dict.fromkeys(a.query or "" for a in arms))
    scores = [f"_score{k}" for k in range(len(queries))]
    for name, query in zip(scores, queries):
        out = out.withColumn(name, salience_score(query, F.col("total")) if query else F.lit(0.0))
    place = F.col("chunk_index").cast("double")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in ROUTING.items() for x in kv])[F.col("doc_type")], F.lit("head_tail"))
    made: list[str] = list(scores)
    taken = []
    for arm in arms:
        k = queries.index(arm.query or "")
        fits = F.col("total") <= arm.budget
        if arm.strategy == "query_ranked" and arm.query:
            if f"_ranked{k}" not in made:
                out = out.withColumn(f"_ranked{k}", F.row_number().over(whole.orderBy(F.desc(scores[k]), "chunk_index")))
                made.append(f"_ranked{k}")
            test, order = F.col(f"_ranked{k}") <= arm.budget, F.col(f"_ranked{k}").cast("double")
        elif arm.strategy == "diversified":
            if f"_pick{k}" not in made:
                own = {c: f"_{c}{k}" for c in ("s", "g", "turn", "best", "first", "pick")}
                out = out.withColumn(own["s"], F.col(scores[k]) if arm.query else 1.0 / (F.col("chunk_index") + 1)).withColumn(own["g"], _group())
                inside = Window.partitionBy("document_id", own["g"])
                turns = {own["turn"]: F.row_number().over(inside.orderBy(F.desc(own["s"]), "chunk_index")), own["best"]: F.max(own["s"]).over(inside), own["first"]: F.min("chunk_index").over(inside)}
                # Round-robin: each round takes every group's next best chunk, the best groups first.
                out = out.withColumns(turns).withColumn(own["pick"], F.row_number().over(whole.orderBy(own["turn"], F.desc(own["best"]), own["first"])))
                made += own.values()
            test, order = F.col(f"_pick{k}") <= arm.budget, place
        else:
            rule = kind if arm.strategy == "routing_aware" else "head_tail" if arm.strategy == "query_ranked" else arm.strategy
            test, order = _positional(rule, arm.budget), place
        taken.append(F.when(fits | test, F.struct(F.lit(arm.label).alias("strategy"), F.when(fits, place).otherwise(order).alias("place"))))
    out = out.withColumns({"relevance": F.col(scores[0]), "picks": F.array_compact(F.array(*taken))}).filter(F.size("picks") > 0)
    return out.drop(*made)


def flag_strategies(chunks: DataFrame, budget: int, strategies: tuple[str, ...], query: str | None = None) -> DataFrame:
    """``flag_arms`` of several strategies with one budget and query."""
    return flag_arms(chunks, [Arm(name, name, budget, query) for name in strategies])


def select_arms(chunks: DataFrame, arms: list[Arm]) -> DataFrame:
    """The chunks of every arm's selection, with ``arm`` and their position in it."""
    taken = flag_arms(chunks, arms).withColumn("_pick", F.explode("picks"))
    order = Window.partitionBy("document_id", "_pick.strategy").orderBy("_pick.place")
    return taken.withColumns({"arm": F.col("_pick.strategy"), "position": F.row_number().over(order)}).drop("_pick", "picks", "relevance")


def select_chunks(chunks: DataFrame, budget: int = 10, strategy: str = "head", query: str | None = None) -> DataFrame:
    """Selected chunks with their position in the selection.

    A document whose chunks fit the budget keeps all of them in order, whatever the strategy.
    """
    taken = flag_strategies(chunks, budget, (strategy,), query)
    order = Window.partitionBy("document_id").orderBy(F.get("picks", F.lit(0))["place"])
    return taken.withColumn("position", F.row_number().over(order)).drop("picks", "relevance").withColumn("strategy_used", F.lit(strategy))


def selection_meta(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """What a selection leaves out: ratios and pages by document."""
    totals = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks_available"))
    sent = selected.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks_sent_to_llm"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages_covered_by_selection")
    )
    out = totals.join(sent, "document_id", "left").fillna(0, ["chunks_sent_to_llm"])
    ratio = F.when(F.col("total_chunks_available") == 0, 1.0).otherwise(F.col("chunks_sent_to_llm") / F.col("total_chunks_available"))
    return out.withColumns({"coverage_ratio": F.round(ratio, 4), "is_partial": F.col("chunks_sent_to_llm") < F.col("total_chunks_available")})


def summarise_range(pages: Column) -> Column:
    """Up to five numbers plainly, more as runs ``a-b``; ``(none)`` for no numbers."""
    starts = F.filter(pages, lambda p: ~F.array_contains(pages, p - 1))
    ends = F.filter(pages, lambda p: ~F.array_contains(pages, p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))
    return F.when(F.size(pages) == 0, "(none)").when(F.size(pages) <= 5, F.array_join(pages.cast("array<string>"), ", ")).otherwise(F.array_join(runs, ", "))


_ADVICE = {
    "minimal": "Little of the document is shown here. Say so first, and claim nothing about the rest.",
    "partial": "Much of the document is not shown here. Name the statements that the missing parts could change.",
    "good": "Most of the document is shown here. Point out where a missing part would be needed to be sure.",
}


def _labels() -> Column:
    return F.sort_array(F.collect_set(F.when(F.col("section_label") != "", F.col("section_label"))))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """(document_id, total_chunks, all_sections)."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"), _labels().alias("all_sections"))


def coverage_report(chunks: DataFrame, selected: DataFrame, documents: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Chunk, page and section coverage of a selection, with its disclosure text.

    ``documents`` has document_id and page_count. Sections are the labels of the chunks.
    ``totals`` replaces ``chunk_totals`` where ids are not those of the chunks (runs).
    """
    labels = _labels
    every = chunk_totals(chunks) if totals is None else totals
    seen = selected.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("selected_chunks"), labels().alias("sections_covered"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages_covered")
    )
    out = documents.select("document_id", F.col("page_count").cast("int").alias("total_pages")).join(every, "document_id").join(seen, "document_id", "left")
    none_s, none_i = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<int>)")
    out = out.withColumns(
        {
            "selected_chunks": F.coalesce("selected_chunks", F.lit(0)),
            "sections_covered": F.coalesce("sections_covered", none_s),
            "pages_covered": F.coalesce("pages_covered", none_i),
        }
    )
    all_pages = F.when(F.col("total_pages") > 0, F.sequence(F.lit(1), F.col("total_pages"))).otherwise(none_i)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    out = out.withColumns(
        {
            "pages_missing": F.array_except(all_pages, F.col("pages_covered")),
            "sections_missing": F.array_except("all_sections", "sections_covered"),
            "c": ratio(F.col("selected_chunks"), F.col("total_chunks")),
            "p": ratio(F.size("pages_covered"), F.col("total_pages")),
            "s": ratio(F.size("sections_covered"), F.size("all_sections")),
        }
    )
    mean = (F.col("c") + F.col("p") + F.col("s")) / 3.0
    level = F.when(mean >= 0.8, "comprehensive").when(mean >= 0.5, "good").when(mean >= 0.25, "partial").otherwise("minimal")
    out = out.withColumn("coverage_level", level)
    missing = F.size("pages_missing")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("[What is shown] "), F.col("selected_chunks"), F.lit("/"), F.col("total_chunks"), F.lit(" chunks, "), percent(F.col("c"))),
        F.when(F.col("total_pages") > 0, F.concat(F.lit("Pages covered: "), summarise_range(F.col("pages_covered")), F.lit(" ("), F.size("pages_covered"), F.lit("/"), F.col("total_pages"), F.lit(" pages)."))),
        F.when((F.col("total_pages") > 0) & missing.between(1, 10), F.concat(F.lit("Left out are pages "), summarise_range(F.col("pages_missing")))).when(
            (F.col("total_pages") > 0) & (missing > 10), F.concat(F.lit("Left out are "), missing, F.lit(" pages"))
        ),
        F.when(F.size("sections_covered") > 0, F.concat(F.lit("Sections here: "), F.array_join("sections_covered", "; "))),
        F.when(F.size("sections_missing") > 0, F.concat(F.lit("Sections NOT covered: "), F.array_join("sections_missing", ", "), F.lit("."))),
        F.create_map(*[F.lit(x) for kv in _ADVICE.items() for x in kv])[F.col("coverage_level")],
        F.lit("[End of what is shown]"),
    )
    return out.select(
        "document_id", "total_chunks", "selected_chunks", F.round("c", 4).alias("chunk_coverage_ratio"), "total_pages", "pages_covered", "pages_missing",
        F.round("p", 4).alias("page_coverage_ratio"), F.size("all_sections").alias("total_sections"), "sections_covered", "sections_missing",
        F.round("s", 4).alias("section_coverage_ratio"), (F.col("coverage_level") == "comprehensive").alias("is_comprehensive"), "coverage_level", text.alias("disclosure_text"),
    )


def compare_strategies(chunks: DataFrame, query: str, budget: int = 5, strategies: tuple[str, ...] = STRATEGIES, hybrid: bool = False) -> DataFrame:
    """Long form: what each strategy selects, scored alike by salience (0 without a query).

    With ``hybrid`` the vector and the fused ranking are two further strategies.
    """
    preview = F.regexp_replace(F.substring("text", 1, PREVIEW), "\n", " ").alias("text_preview")
    facts = ["document_id", "chunk_id", "chunk_index", "page_numbers", "section_label"]
    taken = flag_strategies(chunks, budget, strategies, query).select(*facts, F.col("relevance").alias("relevance_score"), preview, F.explode("picks").alias("p"))
    order = Window.partitionBy("document_id", "p.strategy").orderBy("p.place")
    rest = [*facts[2:], "relevance_score", "text_preview"]
    out = taken.select("document_id", "chunk_id", F.col("p.strategy").alias("strategy"), F.row_number().over(order).alias("position"), *rest)
    if not hybrid:
        return out
    fused = retrieve_hybrid(chunks, query, budget).filter("signal = 'fused'").select("document_id", F.lit("hybrid").alias("strategy"), "chunk_id", F.col("rank").alias("position"))
    near = rank_vector(chunks, query, budget).select("document_id", F.lit("vector").alias("strategy"), "chunk_id", F.col("rank").alias("position"))
    scored = _with_totals(chunks).withColumn("relevance_score", salience_score(query, F.col("total")) if query else F.lit(0.0)).select(*facts, "relevance_score", preview)
    return out.unionByName(near.unionByName(fused).join(scored, ["document_id", "chunk_id"]))


def overlap_matrix(picks: DataFrame, strategies: tuple[str, ...] | None = None) -> DataFrame:
    """(document_id, a, b, shared): chunks that two strategies share, zeros included.

    The grid holds all ``strategies``, by default those that picked something. The pairs
    come from the set of strategies that took a chunk, so no chunk meets another.
    """
    took = picks.groupBy("document_id", "chunk_id").agg(F.collect_set("strategy").alias("s"))
    shared = took.select("document_id", F.explode("s").alias("a"), "s").select("document_id", "a", F.explode("s").alias("b")).groupBy("document_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    names = F.collect_set("strategy") if strategies is None else F.array(*map(F.lit, strategies))
    docs = picks.groupBy("document_id").agg(names.alias("s")) if strategies is None else picks.select("document_id").distinct().withColumn("s", names)
    grid = docs.select("document_id", F.explode("s").alias("a"), "s").select("document_id", "a", F.explode("s").alias("b"))
    return grid.join(shared, ["document_id", "a", "b"], "left").select("document_id", "a", "b", F.coalesce("n", F.lit(0)).alias("shared"))


def unique_chunks(picks: DataFrame) -> DataFrame:
    """(document_id, strategy, chunk_ids) that no other strategy selected."""
    alone = picks.groupBy("document_id", "chunk_id").agg(F.min("strategy").alias("strategy"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return alone.groupBy("document_id", "strategy").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def recommend(picks: DataFrame) -> DataFrame:
    """Average relevance of head and query_ranked, the lift, and what follows from it."""
    mean = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("relevance_score")))
    out = picks.groupBy("document_id").agg(F.coalesce(mean("head"), F.lit(0.0)).alias("head_avg"), F.coalesce(mean("query_ranked"), F.lit(0.0)).alias("ranked_avg"))
    lift = F.round(F.col("ranked_avg") - F.col("head_avg"), 9)  # sums of the same scores in another order are equal
    return out.select("document_id", "head_avg", "ranked_avg", lift.alias("lift"), F.when(lift > 0.1, "query_ranked").when(lift > 0, "query_ranked_slightly").otherwise("similar").alias("recommendation"))
