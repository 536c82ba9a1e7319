"""Items that other tests only pass through, and two composites against plain readings."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom import registry
from docloom.operators import cleaning, evaluation, extraction, grounding, listing, ranking, review, selection, semantic, tasks
from docloom.sources import files

CHUNK = "document_id string, chunk_id string, chunk_index int, text string, page_numbers array<int>, section_label string, source_filename string, doc_type string, parse_quality string, char_start long, char_end long"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d", f"c{i}", i, f"payment {i} " * (30 if i == 2 else 1) if i % 2 == 0 else f"text {i}", [i // 2 + 1] if i < 5 else [], "Intro" if i < 2 else "", "d.txt", "legal", "good", i * 10, i * 10 + 9) for i in range(6)]
    return spark.createDataFrame(rows, CHUNK)


def test_evidence_is_cut_and_scored(spark, chunks):
    scores = spark.createDataFrame([("c0", 0.25), ("c2", 0.5)], "chunk_id string, score double")
    got = {r.chunk_id: r for r in extraction.package_evidence(chunks, scores).collect()}
    assert got["c0"].relevance_score == 0.25 and got["c1"].relevance_score == 1.0 and len(got["c2"].chunk_text) == 300 and got["c1"].chunk_text == "text 1"
    assert {r.relevance_score for r in extraction.package_evidence(chunks).collect()} == {1.0} and got["c3"].source_filename == "d.txt"


def test_contradictions_compare_letters_and_digits(spark):
    told = spark.createDataFrame([("d", "total", "$5,00"), ("d", "name", "Anna S."), ("d", "other", "x"), ("e", "total", "9")], "document_id string, field_name string, field_value string")
    found = spark.createDataFrame([("d", 0, "total", "500"), ("d", 1, "name", "Bob"), ("d", 2, "name", "Otto"), ("e", 0, "total", "8")], "document_id string, field_index int, field_name string, field_value string")
    got = {(r.document_id, r.field_name): (r.expected, r.got) for r in grounding.field_contradictions(told, found).collect()}
    assert got == {("d", "name"): ("Otto", "Anna S."), ("e", "total"): ("8", "9")}


def test_gaps_and_usage_of_evidence(spark):
    points = spark.createDataFrame([("d", True, ["a", "b"], [1, 2]), ("d", True, ["a"], [2]), ("d", False, [], []), ("e", True, ["x", "y"], [3])], "document_id string, grounded boolean, chunk_ids array<string>, page_numbers array<int>")
    audits = spark.createDataFrame([("d", 5, 2), ("e", 2, 2), ("f", 4, 0)], "document_id string, chunks_provided int, chunks_cited_valid int")
    got = {r.document_id: r for r in grounding.evidence_gaps(points, audits).collect()}
    assert (got["d"].total_claims, got["d"].strong, got["d"].weak, got["d"].unsupported, got["d"].overall_strength, got["d"].chunks_unused, got["d"].pages_with_evidence) == (3, 1, 1, 1, "moderate", 3, [1, 2])
    assert got["e"].overall_strength == "strong" and got["f"].overall_strength == "none" and got["f"].total_claims == 0
    used = spark.createDataFrame([("d", ["a", "a", "zz"]), ("e", [])], "document_id string, chunk_ids_used array<string>")
    given = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c")], "document_id string, chunk_id string")
    assert {r.document_id: (r.chunks_cited_by_llm, r.evidence_usage_ratio) for r in grounding.usage_meta(used, given).collect()} == {"d": (2, 0.6667), "e": (0, 0.0)}


def test_queue_and_corrections(spark):
    queue = spark.createDataFrame([("a", "pending_review", 0.9, ["weak_grounding"]), ("b", "auto_accepted", 0.0, []), ("c", "accepted", 0.1, [])], "document_id string, status string, priority_score double, trigger_reasons array<string>")
    assert review.queue_counts(queue).first() == (1, 1, 3) and review.queue_counts(queue.limit(0)).first() == (0, 0, 0)
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3)], "document_id string, n int")
    got = {(r.document_id, r.n): (r.status, r.priority_score, r.trigger_reasons) for r in listing.with_reviews(runs, queue).collect()}
    assert got == {("a", 1): ("pending_review", 0.9, ["weak_grounding"]), ("a", 2): ("pending_review", 0.9, ["weak_grounding"]), ("z", 3): ("pending_review", 0.0, [])}
    fixes = spark.createDataFrame([("a", "total", "6"), ("a", "new", "x"), ("b", "total", "7")], "document_id string, field_name string, corrected_value string")
    fields = spark.createDataFrame([("a", "total", "5", 0.9)], "document_id string, field_name string, field_value string, confidence double")
    old = {(r.document_id, r.field_name): (r.original_value, r.original_confidence) for r in review.correction_originals(fixes, fields).collect()}
    assert old == {("a", "total"): ("5", 0.9), ("a", "new"): ("", 0.0), ("b", "total"): ("", 0.0)}
    assert {r.document_id: r.total_corrections for r in review.total_corrections(fixes).collect()} == {"a": 2, "b": 1}


def test_what_a_selection_leaves_out(spark, chunks):
    got = selection.selection_meta(chunks, selection.select_chunks(chunks, 3)).first()
    assert (got.total_chunks_available, got.chunks_sent_to_llm, got.coverage_ratio, got.is_partial, got.pages_covered_by_selection) == (6, 3, 0.5, True, [1, 2])
    none = selection.selection_meta(chunks, selection.select_chunks(chunks, 3).limit(0)).first()
    assert (none.chunks_sent_to_llm, none.coverage_ratio) == (0, 0.0)


def test_recommendations_by_lift(spark):
    rows = [("a", "head", 0.1), ("a", "query_ranked", 0.9), ("b", "head", 0.5), ("b", "query_ranked", 0.55), ("c", "head", 0.1), ("c", "head", 0.2), ("c", "query_ranked", 0.2), ("c", "query_ranked", 0.1), ("d", "tail", 1.0)]
    got = {r.document_id: (r.recommendation, round(r.lift, 6)) for r in selection.recommend(spark.createDataFrame(rows, "document_id string, strategy string, relevance_score double")).collect()}
    assert got == {"a": ("query_ranked", 0.8), "b": ("query_ranked_slightly", 0.05), "c": ("similar", 0.0), "d": ("similar", 0.0)}


def test_topics_of_matched_chunks(spark, chunks):
    aligned = spark.createDataFrame([("d", True, "c0"), ("d", True, "c1"), ("d", True, "c1"), ("d", True, "c4"), ("d", True, "c5"), ("d", False, "c3")], "document_id string, grounded boolean, matched_chunk_id string")
    got = [(r.cluster_label, r.chunk_ids, r.member_count) for r in semantic.topic_clusters(aligned, chunks).orderBy("cluster_rank").collect()]
    assert got == [("Intro", ["c0", "c1"], 2), ("page_3", ["c4"], 1), ("unlabelled", ["c5"], 1)]


def test_search_entry(spark, chunks):
    assert [r.chunk_id for r in ranking.search(chunks, "payment", "lexical", 2).orderBy("rank").collect()] == ["c0", "c2"]
    assert ranking.search(chunks, "payment").count() == 6
    for ranker, k in (("vector", 5), ("lexical", 0), ("salience", 51)):
        with pytest.raises(ValueError):
            ranking.search(chunks, "x", ranker, k)


def test_ground_truth_file(spark, tmp_path):
    told = {"fixtures": {"a.txt": {"expected_fields": {"total": {"value": "5", "must_extract": True, "normalized": "5.00"}, "none": {"value": None}}}, "b.txt": {"expected_fields": {}}}}
    (tmp_path / "truth.json").write_text(json.dumps(told, indent=1))
    got = {(r.fixture, r.field_name): (r.expected_value, r.must_extract, r.normalized) for r in files.read_ground_truth(spark, str(tmp_path / "truth.json")).collect()}
    assert got == {("a.txt", "total"): ("5", True, "5.00"), ("a.txt", "none"): (None, False, None)}


def test_tasks_run_by_name(spark, chunks):
    answer = tasks.model_hook(lambda system, user: json.dumps({"events": [{"date": "May", "description": system[:4], "chunk_ids": re.findall(r"chunk_id: (\w+)", user)[:1]}]}))
    out = tasks.run_task("chronology", chunks, answer, 2, query="payment", strategy="query_ranked")
    assert out["validated"].first().events[0].description == "List" and out["audit"].first().events_grounded == 1
    assert {r.chunk_id for r in out["selected"].collect()} < {"c0", "c2", "c4"}
    tasks.register_task("own", lambda n: {"n": n})
    assert tasks.run_task("own", 3) == {"n": 3}
    with pytest.raises(KeyError):
        tasks.run_task("nothing")


def test_every_dimension_of_a_summary(spark):
    rows = spark.createDataFrame([("a", ["paid in May", "the of"], "It was paid in May; schedule a visit"), ("b", [], None)], "fixture string, key_facts array<string>, summary_text string")
    bare = {r.fixture: r for r in evaluation.summary_dimensions(rows).collect()}
    assert [(f.fact, f.covered) for f in bare["a"].fact_details] == [("paid in May", True), ("the of", True)] and bare["a"].factual_coverage == 1.0 and not bare["a"].needs_review and bare["b"].fact_details == []
    audits = spark.createDataFrame([("a", 0.5, 1, 4, 2, 2, 1, True)], "fixture string, grounding_score double, key_points_ungrounded int, chunks_provided int, chunks_cited_valid int, key_points_total int, key_points_grounded int, needs_review boolean")
    usage = spark.createDataFrame([("a", 0.25)], "fixture string, evidence_usage_ratio double")
    times = spark.createDataFrame([("b", 7)], "fixture string, summarisation_time_ms int")
    got = {r.fixture: r for r in evaluation.summary_dimensions(rows, audits, usage, times).collect()}
    assert (got["a"].contradiction_count, got["a"].chunks_cited, got["a"].evidence_support, got["a"].summarisation_time_ms) == (1, 2, 0.25, 0) and (got["b"].grounding_score, got["b"].summarisation_time_ms) == (0.0, 7)
    metrics = spark.createDataFrame([("a", 2, 0.25), ("b", 0, 0.0), ("c", 1, -0.1)], "document_id string, strategy_count int, relevance_lift double")
    told = spark.createDataFrame([("a", "query_ranked")], "document_id string, recommendation string")
    notes = {r.document_id: r.notes for r in evaluation.retrieval_dimensions(metrics, recommendations=told).collect()}
    assert notes == {"a": ["ranking by the query raised the mean relevance by 0.250", "query_ranked"], "b": ["no strategy picked anything"], "c": ["ranking by the query raised nothing"]}


BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"


def cleaned(texts):
    """The steps of cleaning, page by page, as plain loops."""
    solid = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    often = lambda edges: {x for e in edges for x in e if len(texts) >= cleaning.MIN_PAGES and len(x) < cleaning.MAX_LINE and sum(e.count(x) for e in edges) >= cleaning.FREQUENCY * len(texts)}
    heads, feet = often([s[: cleaning.EDGE_LINES] for s in solid]), often([s[-cleaning.EDGE_LINES :] for s in solid])
    total = dict.fromkeys(("chars_before", "chars_after", "unicode_normalizations", "control_chars_removed", "whitespace_reductions", "headers_removed", "footers_removed", "duplicate_lines_suppressed"), 0)
    for t in texts:
        total["chars_before"] += len(t)
        u = unicodedata.normalize("NFC", t)
        total["unicode_normalizations"] += sum(a != b for a, b in zip(t, u))
        c = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", u)
        total["control_chars_removed"] += len(u) - len(c)
        w = re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+(?=\n|$)(?![^\n])", "", c)))
        total["whitespace_reductions"] += len(w) < len(c)
        lines = w.split("\n")
        ends = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        for name, targets, at in (("headers_removed", heads, 0), ("footers_removed", feet, -1)):
            while targets and ends and ends[at].strip() in targets:
                ends.pop(at)
                total[name] += 1
        kept = [x for i, x in enumerate(ends) if i == 0 or not x.strip() or x.strip() != ends[i - 1].strip()]
        total["duplicate_lines_suppressed"] += len(ends) - len(kept)
        total["chars_after"] += len("".join(kept))
    return total


def test_clean_audit_equals_plain_loops(spark):
    docs = {
        "a": [f"ACME Corp\nPage {i}\nbody  text {i} \nsame\nsame\n\n\n\n\n\nend {i}\nConfidential" for i in range(4)], "b": ["été \x07bell\n\n", "x\n x\nx", ""], "c": ["one page only\nACME"], "d": ["T\nT\nT", "T\nT\nT", "T\nmiddle\nT"], "e": ["   \n", "\t"],
    }
    table = spark.createDataFrame([(d, i + 1, t) for d, ts in docs.items() for i, t in enumerate(ts)], "document_id string, page_number int, text string")
    got = {r.document_id: r.asDict() for r in cleaning.clean_audit(cleaning.clean_pages(table)).collect()}
    for d, texts in docs.items():
        want = cleaned(texts)
        assert {k: got[d][k] for k in want} == want, d
        assert got[d]["chars_removed"] == want["chars_before"] - want["chars_after"]


def test_enriched_chunks_carry_what_their_parts_say(spark):
    """The labels, types and files of the composite against intervals and routes looked up one by one."""
    from docloom.operators import routing, sections
    from docloom.sources import inputs as I

    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["enriched_chunks"](spark, sf).collect()
    pages = I.invoices(spark, sf)
    found = {}
    for s in sections.detect_sections(pages.select("document_id", "page_number", "text")).collect():
        found.setdefault(s.document_id, []).append(s)
    texts = {r.document_id: (r.text, r.filename) for r in pages.collect()}
    kinds = {r.document_id: r.predicted_type for r in routing.route(pages.select("document_id", "filename", F.col("text").alias("sample"))).collect()}
    assert {r.document_id for r in rows} == set(texts)
    for r in rows:
        text, name = texts[r.document_id]
        assert text[r.char_start : r.char_end] == r.text and (r.source_filename, r.doc_type, r.page_numbers) == (name, kinds[r.document_id], [1])
        own = sorted(found.get(r.document_id, []), key=lambda s: s.section_index)
        at = [s.label for s in own if s.char_start <= r.char_start < s.char_end] or [s.label for s in own if s.page_start <= 1 <= s.page_end]
        assert r.section_label == (at[-1] if at else "")


def test_settings_reach_the_operators(spark, chunks):
    from docloom import settings
    from docloom.plans.ingest import ingest

    said = {"chunk_size": "40", "chunk_overlap": "5", "max_llm_chunks": "2", "llm_max_retries": "0", "llm_model": "big", "llm_provider": "own"}
    for k, v in said.items():
        spark.conf.set(f"spark.docloom.{k}", v)
    try:
        assert settings.chunk_config(spark).chunk_size == 40 and settings.call_policy(spark).retries == 0
        made = ingest(spark.createDataFrame([("a", "a.txt", 90, "word " * 18)], "document_id string, filename string, size_bytes long, text string"))["chunks"]
        assert made.agg(F.max(F.length("text"))).first()[0] == 40
        documents = spark.createDataFrame([("d", 3, "good")], "document_id string, page_count int, quality string")

        def broken(system, user):
            raise ValueError("no")

        out = tasks.summarise(chunks, documents, tasks.model_hook(broken))
        row = out["responses"].first()
        assert out["selected"].count() == 2 and (row.attempts, row.model, row.provider) == (1, "big", "own")
    finally:
        for k in said:
            spark.conf.unset(f"spark.docloom.{k}")


@pytest.mark.parametrize("wide", [2, 30])
def test_fused_signals_equal_the_fusion_of_their_lists(spark, chunks, wide):
    more = chunks.unionByName(chunks.withColumns({"document_id": F.lit("e"), "chunk_id": F.concat(F.lit("e"), "chunk_id")}).filter("chunk_index < 4"))
    lists = [("lexical", ranking.rank_lexical(more, "payment text", wide)), ("vector", ranking.rank_vector(more, "payment text", wide)), ("salience", ranking.rank_salience(more, "payment text", wide))]
    want = sorted(map(tuple, ranking.fuse(lists, 5).select("document_id", "chunk_id", "rank", "score").collect()))
    got = ranking.fuse_signals(more, "payment text", wide=wide).filter("rank <= 5")
    assert sorted(map(tuple, got.select("document_id", "chunk_id", "rank", "score").collect())) == want
