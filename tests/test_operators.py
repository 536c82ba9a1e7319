"""Cases that the tables cannot supply, with expected values worked out by hand."""

import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from docloom.functions import scalars
from docloom.operators import chunking, cleaning, evaluation, extraction, grounding, ops, parsing, ranking, review, sections, selection, semantic, tasks
from docloom.plans.ingest import ingest


def pages(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, text string")


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_hash_embedding_chains_digests(spark):
    digest = hashlib.sha256("héllo".encode()).digest()
    while len(digest) < 64 * 4:
        digest += hashlib.sha256(digest).digest()
    raw = [x / 2147483648.0 - 1.0 for x in struct.unpack(">64I", digest[:256])]
    norm = math.sqrt(sum(x * x for x in raw))
    assert one(spark, scalars.hash_embedding(F.col("t")), t="héllo") == pytest.approx([x / norm for x in raw])


def test_title_case_and_snippet(spark):
    assert one(spark, scalars.title_case(F.col("t")), t="BILLING/NOTES AND-MORE") == "Billing/Notes And-More"
    text = "x" * 100 + "NEEDLE" + "y" * 100
    assert one(spark, scalars.needle_snippet(F.col("t"), F.col("n")), t=text, n="needle") == "…" + "x" * 40 + "NEEDLE" + "y" * 60 + "…"


def test_cosine_of_unequal_lengths_is_zero(spark):
    assert one(spark, scalars.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_lines_keep_their_ends(spark):
    text = "a\nb\r\n\nc"
    assert one(spark, scalars.lines_with_ends(F.col("t")), t=text) == ["a\n", "b\r\n", "\n", "c"]


def test_headers_and_footers_go_and_the_rest_stays(spark):
    rows = [("d", i, f"HEAD\nbody {i}\nbody {i}\n\n\n\n\n\nmore  text {i} \nFOOT") for i in range(1, 6)]
    out = {r.page_number: r for r in cleaning.clean_pages(pages(spark, *rows)).collect()}
    assert out[2].text == "body 2\n\n\nmore text 2\n" and out[2].headers_removed == 1 and out[2].footers_removed == 1 and out[2].duplicate_lines_suppressed == 1


def test_cleaning_counts_unicode_and_control(spark):
    out = cleaning.clean_pages(pages(spark, ("d", 1, "éa\x07b"))).first()
    assert out.text == "éab" and out.control_chars_removed == 1 and out.unicode_normalizations > 0


def test_parse_failures(spark):
    files = spark.createDataFrame([("a", "a.txt", "hi"), ("b", "b.docx", "hi"), ("c", "c.md", "  "), ("e", "e.txt", None)], "document_id string, filename string, text string")
    assert {r.document_id: r.failure_reason for r in parsing.parse_text_files(files).collect()} == {"a": "none", "b": "unsupported_file_type", "c": "empty_extraction", "e": "file_not_found"}


def test_ocr_recovers_only_failed_documents(spark):
    raw = pages(spark, ("blank", 1, " "), ("thin", 1, "few words"))
    meta = parsing.assess_pages(raw)
    found, kept = parsing.ocr_fallback(meta, raw, lambda d: d.select("document_id", F.lit(1).alias("page_number"), F.lit("recovered").alias("text")))
    assert {r.document_id: (r.quality, r.ocr_applied) for r in found.collect()} == {"blank": ("degraded", True), "thin": ("degraded", False)}
    assert {r.document_id: r.text for r in kept.collect()} == {"blank": "recovered", "thin": "few words"}


def test_fixed_chunks_keep_the_tail_inside_the_overlap(spark):
    out = chunking.chunk(pages(spark, ("d", 1, "a" * 10), ("d", 2, "b" * 8), ("e", 1, " ")), chunking.ChunkConfig(chunk_size=8, overlap=4)).orderBy("chunk_index").collect()
    assert [(r.char_start, r.char_end, r.page_numbers) for r in out] == [(0, 8, [1]), (4, 12, [1]), (8, 16, [1, 2]), (12, 20, [2]), (16, 20, [2])]


def test_paragraphs_merge_and_drift(spark):
    text = "aa\n\nbb\n\n\n\ncc\n\n" + "d" * 30
    out = chunking.chunk(pages(spark, ("d", 1, text)), chunking.ChunkConfig("paragraph", chunk_size=10)).orderBy("chunk_index").collect()
    assert [r.text for r in out] == ["aa\n\nbb\n\ncc", "d" * 30] and (out[0].char_start, out[0].char_end) == (0, 10)


def test_truncation_marks_the_last_chunk(spark):
    out = chunking.chunk(pages(spark, ("d", 1, "a" * 100)), chunking.ChunkConfig(chunk_size=10, overlap=0, max_chunks=3)).orderBy("chunk_index").collect()
    assert [r.is_truncated for r in out] == [False, False, True]


def test_sections_merge_equal_neighbours(spark):
    found = sections.detect_sections(pages(spark, ("d", 1, "Diagnosis\ntext\nDiagnosis notes"), ("d", 2, "IV. Plan\nMY LONG HEADING"))).orderBy("section_index").collect()
    assert [(r.label, r.page_start, r.page_end, r.char_start) for r in found] == [("Diagnosis", 1, 2, 0), ("IV. Plan", 2, 2, 32), ("My Long Heading", 2, 2, 41)]


def test_first_match_is_page_major(spark):
    out = extraction.extract_fields(pages(spark, ("d", 1, "total: $5"), ("d", 2, "Total Due: 7.50\nPolicy #: AB-12_34"))).collect()
    assert {r.field_name: (r.field_value, r.evidence_id) for r in out} == {"total_amount": ("5", "page:1"), "policy_number": ("AB-1234", "page:2")}


def test_dates_and_amounts_normalise(spark):
    rows = spark.createDataFrame([("d", 0, "service_date", " March 5, 2024 ", 1.4), ("d", 1, "total_amount", "$1,234.5", 0.9), ("d", 2, "service_date", "someday", 0.5)], "document_id string, field_index int, field_name string, field_value string, confidence double")
    out = {r.field_index: r for r in extraction.postprocess_fields(rows).collect()}
    assert [out[i].field_value for i in range(3)] == ["2024-03-05", "1234.50", "someday"] and out[0].confidence == 1.0 and out[0].whitespace_cleaned


def chunk_table(spark, *rows):
    return spark.createDataFrame([("d", f"c{i}", i, t, p, s, "", "", "", 0, 0) for i, (t, p, s) in enumerate(rows)], "document_id string, chunk_id string, chunk_index int, text string, page_numbers array<int>, section_label string, parse_quality string, doc_type string, source_filename string, char_start long, char_end long")


def test_diversified_takes_turns(spark):
    c = chunk_table(spark, ("x", [1], "A"), ("x", [1], "A"), ("x", [2], "B"), ("x", [], "A"), ("x", [3], "C"))
    assert [r.chunk_id for r in selection.select_chunks(c, 3, "diversified").orderBy("position").collect()] == ["c0", "c2", "c3"]


def test_budget_above_total_keeps_document_order(spark):
    c = chunk_table(spark, ("b", [1], ""), ("a query", [1], ""))
    assert [r.chunk_id for r in selection.select_chunks(c, 5, "query_ranked", "query").orderBy("position").collect()] == ["c0", "c1"]


def test_disclosure_names_what_is_missing(spark):
    c = chunk_table(spark, *[("x", [i], f"S{i}") for i in range(1, 9)])
    docs = spark.createDataFrame([("d", 8)], "document_id string, page_count int")
    r = selection.coverage_report(c, c.filter("chunk_index < 6"), docs).first()
    assert "Pages covered: 1-6 (6/8 pages)." in r.disclosure_text and "Sections NOT covered: S7, S8." in r.disclosure_text and r.coverage_level == "good"


def test_fusion_prefers_the_first_list_on_ties(spark):
    a = spark.createDataFrame([("d", "x", 1), ("d", "y", 2)], "document_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("d", "y", 1), ("d", "x", 2)], "document_id string, chunk_id string, rank int")
    assert [r.chunk_id for r in ranking.fuse([("a", a), ("b", b)]).orderBy("rank").collect()] == ["x", "y"]


def test_vector_index_keeps_the_first_of_an_id(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 2, [0.0, 1.0])], "chunk_id string, position int, vector array<double>")
    assert [r.chunk_id for r in ranking.vector_search(ranking.vector_index(rows), [1.0, 0.1], 2).collect()] == ["a", "b"]


RESPONSES = [
    ("valid", '{"summary_text": "s", "key_points": [{"point": "p", "chunk_ids": ["c0"]}], "chunk_ids_used": ["c0"]}', "valid"),
    ("string", '{"summary_text": "s", "key_points": ["p"], "chunk_ids_used": ["c0"]}', "partial_recovery"),
    ("blank", '{"summary_text": " ", "key_points": []}', "missing_required"),
    ("list", "[1]", "wrong_structure"),
    ("broken", "{oops", "wrong_structure"),
    ("empty", "", "missing_required"),
    ("range", '{"summary_text": "s", "key_points": [{"point": "p", "chunk_ids": ["c0"]}], "chunk_ids_used": ["c0"], "structured_fields": [{"field_name": "f", "confidence": 7}]}', "partial_recovery"),
]


def test_response_status_ladder(spark):
    out = grounding.validate_summaries(spark.createDataFrame([r[:2] for r in RESPONSES], "document_id string, response string"))
    got = {r.document_id: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {k: s for k, _, s in RESPONSES}
    assert got["range"].structured_fields[0].confidence == 1.0


def test_chronology_drops_blank_events(spark):
    raw = '{"events": [{"date": "", "description": "d", "chunk_ids": ["c0", "zz"]}, {"description": " "}, "x"]}'
    v = grounding.validate_chronologies(spark.createDataFrame([("d", raw)], "document_id string, response string"))
    r = v.first()
    assert r.status == "partial_recovery" and len(r.events) == 1 and r.chunk_ids_used == ["c0", "zz"]
    a = grounding.audit_chronology(v, chunk_table(spark, ("t", [1], ""))).first()
    assert (a.events_grounded, a.chunks_cited_invalid) == (1, 1)


def test_best_snippet_centres_on_keywords(spark):
    text = ("filler " * 40) + "payment balance due " + ("filler " * 40)
    got = one(spark, grounding.best_snippet(F.col("t"), F.col("c")), t=text, c="the payment balance")
    assert "payment balance" in got and got.startswith("...") and got.endswith("...")


def test_hierarchy_facts_and_prompt(spark):
    c = chunk_table(spark, ("Short. On 5 May Anna paid the whole amount to Bob in cash. tiny one.", [1], "Intro"), ("short.", [2], "Intro"))
    facts = semantic.chunk_facts(c).orderBy("chunk_index").collect()
    assert facts[0].key_sentences[0].startswith("On 5 May") and facts[0].word_count == 15
    s = semantic.section_summaries(semantic.chunk_facts(c)).first()
    assert s.chunk_count == 2 and len(s.key_facts) == 3
    assert "--- Section 1: Intro (pp. 1-2, 2 chunks) ---" in semantic.synthesis_prompts(semantic.section_summaries(semantic.chunk_facts(c))).first().prompt


def test_names_are_never_auto_accepted(spark):
    fields = spark.createDataFrame([("d", 0, "claim_number", "A-1234", 0.9), ("d", 1, "patient_name", "Jane Doe", 0.8), ("e", 0, "claim_number", "A-1234", 0.9), ("e", 1, "mrn", "M-1234", 0.9)], "document_id string, field_index int, field_name string, field_value string, confidence double")
    results = spark.createDataFrame([("d", "good"), ("e", "good"), ("f", "good")], "document_id string, parse_quality string")
    out = {r.document_id: r for r in review.reviewables(results, fields, "2024-01-01").collect()}
    assert (out["d"].status, out["d"].priority_score, out["e"].status) == ("pending_review", 0.0, "auto_accepted")
    assert out["f"].trigger_reasons == ["no_fields_extracted"] and out["f"].priority_score == 0.9


def test_negative_amounts_read_as_positive_in_review(spark):
    assert one(spark, scalars.review_amount(F.col("v")), v="-$1,200.50") == 1200.5


def test_wrong_values_count_twice(spark):
    e = spark.createDataFrame([("f", "a", "1", True, None), ("f", "b", "Jan 5, 2024", True, None), ("f", "c", None, False, None)], "fixture string, field_name string, expected_value string, must_extract boolean, normalized string")
    a = spark.createDataFrame([("f", "a", "2"), ("f", "b", "01/05/2024"), ("f", "x", "9")], "fixture string, field_name string, actual_value string")
    m = evaluation.field_metrics(evaluation.match_fields(e, a)).first()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.true_negatives) == (1, 2, 1, 1)


def test_model_hook_retries_and_keeps_errors(spark):
    def flaky(prompt):
        if "bad" in prompt:
            raise TimeoutError("timed out")
        return '{"summary_text": "ok"}'

    rows = spark.createDataFrame([("a", "good"), ("b", "bad")], "document_id string, user_prompt string")
    out = {r.document_id: r for r in tasks.model_hook(flaky, retries=2)(rows).collect()}
    assert out["a"].response and out["a"].attempts == 1 and out["b"].attempts == 3 and "timed out" in out["b"].error
    assert one(spark, ops.is_retryable(F.col("m")), m=out["b"].error) is True


def test_prompts_are_versioned(spark):
    assert tasks.list_prompts(spark).count() == 5 and tasks.get_prompt("summary_general").ref == "summary_general@1.0"


def test_ingest_and_stream(spark, tmp_path):
    files = spark.createDataFrame([("a", "invoice.txt", 10, "Invoice Number: INV-1\nAmount due: $5\nDIAGNOSIS"), ("b", "b.pdf", 3, "x")], "document_id string, filename string, size_bytes long, text string")
    out = ingest(files)
    assert {r.document_id: (r.status, r.predicted_type) for r in out["documents"].collect()} == {"a": ("parsed", "billing"), "b": ("failed", None)}
    assert out["chunks"].filter("section_label = ''").count() <= 1
    from docloom.streaming import live

    files.write.parquet(str(tmp_path / "in"))
    stream = live.route_stream(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.predicted_type for r in spark.sql("SELECT * FROM routed").collect()] == ["billing"]


def test_text_files_source(spark, tmp_path):
    from docloom.sources import files

    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    assert {r.filename: (r.text, r.content_type) for r in files.read_text_files(spark, str(tmp_path)).collect()} == {"a.txt": ("hello", "text/plain"), "b.md": ("", "text/markdown")}


def test_evaluate_reports_and_trace(spark):
    from docloom.operators import reports
    from docloom.plans.evaluate import evaluate, retrieval_queries

    files = spark.createDataFrame([("a", "invoice_1.txt", 10, "Invoice Number: INV-1001\nTotal Due: $50.00\nAmount due, balance"), ("b", "x.pdf", 1, "y")], "document_id string, filename string, size_bytes long, text string")
    want = spark.createDataFrame([("invoice_1.txt", "invoice_number", "INV-1001", True, None), ("invoice_1.txt", "total_amount", "60", True, None)], "fixture string, field_name string, expected_value string, must_extract boolean, normalized string")
    kinds = spark.createDataFrame([("invoice_1.txt", "billing", ["billing"])], "fixture string, expected_type string, accept_types array<string>")
    out = evaluate(files, want, kinds)
    m = out["field_metrics"].first()
    assert (m.true_positives, m.false_positives, m.false_negatives) == (1, 1, 1) and out["routing"].first().routing_correct == 1 and out["failures"].count() == 1
    text = reports.deterministic_report(out["field_metrics"], out["matches"], out["micro_average"])
    assert "Precision=0.500" in text and "✓ invoice_number" in text and "✗ total_amount" in text and "mismatch" in text
    assert "n=1" in reports.slice_report(out["slices"])
    assert retrieval_queries(spark.createDataFrame([("f", ["a", "b", "c", "d"], None)], "fixture string, key_facts array<string>, description string")).first().query == "a b c"
    trace = reports.Trace()
    with reports.trace_stage(trace, "parse"):
        pass
    with pytest.raises(ValueError), reports.trace_stage(trace, "route"):
        raise ValueError("bad")
    assert trace.hard_failure and [s.success for s in trace.stages] == [True, False] and '"route"' in trace.line("d")


def test_lists_and_review_state(spark):
    from docloom.operators import listing

    docs = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, created_at int")
    found = listing.list_documents(docs, spark.createDataFrame([("a",), ("a",)], "document_id string")).collect()
    assert [(r.document_id, r.extraction_count) for r in found] == [("b", 0), ("a", 2)]
    queue = spark.createDataFrame([("a", "pending_review", 0.5, 1, ["x"]), ("b", "pending_review", 0.9, 2, ["y"]), ("c", "auto_accepted", 0.5, 0, [])], "document_id string, status string, priority_score double, position int, trigger_reasons array<string>")
    assert [r.document_id for r in listing.queue_page(queue).collect()] == ["b", "c", "a"]
    assert [r.document_id for r in listing.queue_page(queue, "auto_accepted").collect()] == ["c"]
    fixed = listing.corrected(queue, spark.createDataFrame([("a",)], "document_id string"))
    assert {r.document_id: r.status for r in fixed.collect()}["a"] == "corrected"
    made = spark.createDataFrame([("e1", "a", "deterministic", 1), ("e2", "a", "deterministic", 2), ("e3", "b", "summary", 3)], "extraction_id string, document_id string, output_type string, created_at int")
    asked = spark.createDataFrame([("r1", "a", "e1"), ("r2", "a", "e3"), ("r3", "a", None)], "request_id string, document_id string, extraction_id string")
    assert {r.request_id: r.base_extraction_id for r in listing.base_extraction(asked, made).collect()} == {"r1": "e1", "r2": "e2", "r3": "e2"}
