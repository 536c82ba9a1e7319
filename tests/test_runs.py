"""Chunk folds, outcomes, model hooks, evaluation runs, read views and settings."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, evaluation, listing, ops, parsing, ranking, reports, review, selection, tasks
from docloom.plans.evaluate import evaluate
from docloom.settings import Settings, load_settings
from docloom.sources import files as S


def paragraphs(text, size):
    """Runs of paragraphs by plain reading: (text, start, end)."""
    spans, at = [], 0
    for gap in [*re.finditer(r"\n\s*\n", text), None]:
        spans.append((at, gap.start() if gap else len(text)))
        at = gap.end() if gap else at
    out, run, weight, read = [], [], 0, 0
    for start, end in spans:
        part = text[start:end]
        start = start if part else read  # an empty paragraph stands where the one before ends
        read = start + len(part)
        if run and weight + len(part) > size:
            out.append(run)
            run, weight = [], 0
        run.append((start, part))
        weight += len(part) + 2
    out.append(run)
    return [(t := "\n\n".join(x for _, x in r), r[0][0], r[0][0] + len(t)) for r in out]


TEXTS = [
    "one\n\ntwo\n\n\n three \n  \nfour",
    "a" * 50 + "\n\n" + "b" * 20 + "\n\n" + "c" * 5,
    "single",
    "x\n\n" * 30 + "end",
    "\n\nlead",
    "tail\n\n",
    "é😀 y\n\nsmall\n\n" + "word " * 30,
]


def test_paragraph_fold_equals_plain_reading(spark):
    pages = spark.createDataFrame([(f"d{i}", 1, t) for i, t in enumerate(TEXTS)], "document_id string, page_number int, text string")
    got = {}
    for r in chunking.chunk(pages, chunking.ChunkConfig("paragraph", chunk_size=40)).collect():
        got.setdefault(r.document_id, []).append((r.text, r.char_start, r.char_end))
    for i, text in enumerate(TEXTS):
        assert sorted(got[f"d{i}"], key=lambda x: x[1:]) == sorted(paragraphs(text, 40), key=lambda x: x[1:])


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 6), (5, 9), (12, 0)])
def test_windows_and_pages_of_many_pages(spark, size, overlap):
    texts = [("ab😀 " * (k % 5))[: k % 17] + "x" * (k % 3) for k in range(90)]
    pages = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(texts)] + [("e", 1, " ")], "document_id string, page_number int, text string")
    config = chunking.ChunkConfig("fixed_size", size, overlap)
    rows = sorted(chunking.chunk(pages, config).collect(), key=lambda r: r.chunk_index)
    whole, spans, at = "\n\n".join(texts), [], 0
    for k, t in enumerate(texts):
        spans.append((k + 1, at, at + len(t)))
        at += len(t) + 2
    assert {r.document_id for r in rows} == {"d"} and len(rows) == len(range(0, len(whole), config.step))
    for r, o in zip(rows, range(0, len(whole), config.step)):
        end = min(o + size, len(whole))
        assert (r.text, r.char_start, r.char_end) == (whole[o:end], o, end)
        assert r.page_numbers == [p for p, s, e in spans if s < end and e > o]


def test_size_warnings(spark):
    rows = [("s", 1, 10, 10, 3), ("l", 300, 2_000_000, 10, 40), ("o", 5000, 1, 1, 100)]
    got = {r.document_id: r for r in chunking.classify_size(spark.createDataFrame(rows, "document_id string, page_count long, total_chars long, file_size_bytes long, chunk_count long")).collect()}
    assert got["s"].warnings == [] and not got["s"].partial_view
    assert len(got["l"].warnings) == 2 and "2,000,000" in got["l"].warnings[0] and "50%" in got["l"].warnings[1]
    assert got["o"].category == "oversized" and "25 of 100" in got["o"].warnings[1]


@pytest.fixture
def chunks(spark):
    rows = [("d", f"c{i}", i, f"text {i} payment" if i % 3 == 0 else f"text {i}", [i // 2 + 1], "Intro" if i < 4 else "", "", "legal") for i in range(12)]
    return spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, text string, page_numbers array<int>, section_label string, parse_quality string, doc_type string")


def test_strategies_agree_with_single_selections(chunks):
    together = selection.compare_strategies(chunks, "payment", 4)
    by = {}
    for r in together.collect():
        by.setdefault(r.strategy, []).append((r.position, r.chunk_id))
    for name in selection.STRATEGIES:
        alone = selection.select_chunks(chunks, 4, name, "payment").select("position", "chunk_id").collect()
        assert sorted(by[name]) == sorted(map(tuple, alone)) and len(alone) == 4
    assert [c for _, c in sorted(by["head_tail"])] == ["c0", "c1", "c10", "c11"]
    hybrid = selection.compare_strategies(chunks, "payment", 4, ("head",), hybrid=True)
    assert {r.strategy for r in hybrid.collect()} == {"head", "vector", "hybrid"}


def test_overlap_grid_has_all_strategies(chunks):
    picks = selection.compare_strategies(chunks, "payment", 4, ("head", "tail"))
    grid = {(r.a, r.b): r.shared for r in selection.overlap_matrix(picks, ("head", "tail", "sampled")).collect()}
    assert len(grid) == 9 and grid["head", "head"] == 4 and grid["head", "tail"] == 0 and grid["sampled", "sampled"] == 0


def test_embedders_rerankers_and_index_hits(spark, chunks):
    embed = ranking.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert ranking.embed_chunks(chunks, embed=embed).first().vector == [14.0, 1.0]
    assert ranking.rank_embedded(chunks, "text 0 payment", 1, embed).first().score == 1.0
    with pytest.raises(ValueError):
        ranking.rank_embedded(chunks, "x")
    with pytest.raises(NotImplementedError):
        ranking.rerank(chunks, "x", name="cross_encoder")
    best = ranking.rank_lexical(chunks, "payment", None)
    assert ranking.rerank(best, "x", 2).count() == 2
    hits = spark.createDataFrame([("c3", 0.5), ("zz", 0.9), ("c0", 0.1)], "chunk_id string, score double")
    assert [(r.chunk_id, r.rank) for r in ranking.index_hits(hits, chunks).orderBy("rank").collect()] == [("c3", 2), ("c0", 3)]


def test_outcomes_by_kind(spark):
    meta = spark.createDataFrame([("a", "none", "good", False), ("b", "unreadable_pdf", "unusable", False), ("c", "zero_text_pdf", "unusable", False), ("d", "none", "degraded", True), ("e", "none", "unusable", False)], "document_id string, failure_reason string, quality string, ocr_applied boolean")
    parse = {r.document_id: r for r in ops.parse_outcomes(meta).collect()}
    assert {k: (r.success, r.failure_kind) for k, r in parse.items()} == {"a": (True, "none"), "b": (False, "hard"), "c": (False, "soft"), "d": (True, "soft"), "e": (False, "hard")}
    stats = spark.createDataFrame([("a", 3, 0.9), ("b", 0, None), ("d", 2, 0.4)], "document_id string, field_count long, min_confidence double")
    found = {r.document_id: r for r in ops.extraction_outcomes(stats).collect()}
    assert {k: r.failure_kind for k, r in found.items()} == {"a": "none", "b": "review_needed", "d": "review_needed"} and all(r.success for r in found.values())
    audits = spark.createDataFrame([("a", 0.9, False), ("b", 0.6, False), ("d", 0.2, True)], "document_id string, grounding_score double, needs_review boolean")
    assert {r.document_id: r.failure_kind for r in ops.summary_outcomes(audits).collect()} == {"a": "none", "b": "soft", "d": "review_needed"}
    every = ops.parse_outcomes(meta).unionByName(ops.extraction_outcomes(stats)).unionByName(ops.summary_outcomes(audits))
    flags = {r.document_id: r for r in ops.trace_flags(every).collect()}
    assert flags["b"].has_hard and flags["b"].has_review_needed and flags["b"].warnings == ["parse: not parsed: unreadable_pdf"]
    assert not flags["a"].has_hard and flags["d"].has_soft and not flags["d"].has_retryable
    assert ops.fold_trace(every).count() == 5


def test_feedback_signals_carry_their_evidence(spark):
    rows = [("d", "mismatch", "f", "", "", 0.5, "prompt", "", "c9", "the claim", [3, 4]), ("e", "field", "f", "1", "2", 0.9, "retrieval", "typo", None, None, None)]
    table = spark.createDataFrame(rows, "document_id string, kind string, field_name string, original_value string, corrected_value string, original_confidence double, failure_source string, reason string, suggested_chunk_id string, claim_text string, page_numbers array<int>")
    got = {(r.document_id, r.category): r for r in review.feedback_signals(table).collect()}
    assert set(got) == {("d", "retrieval_ranking"), ("d", "summary_prompt"), ("e", "extraction_heuristic"), ("e", "retrieval_ranking"), ("e", "evaluation_fixture")}
    assert got["d", "retrieval_ranking"].details == "claim=the claim; suggested chunk=c9; pages=3,4" and got["d", "summary_prompt"].priority == "medium"
    assert got["e", "extraction_heuristic"].priority == "high" and "1 -> 2" in got["e", "extraction_heuristic"].description


def test_calls_time_out_retry_and_degrade(spark):
    def call(prompt):
        import time

        if prompt == "slow":
            time.sleep(3)
        if prompt == "bad":
            raise ValueError("no such model")
        return "{}"

    policy = tasks.CallPolicy(retries=1, timeout_s=0.3, backoff_ms=1, provider="p", model="m", retry_all=False)
    rows = spark.createDataFrame([("a", "ok"), ("b", "slow"), ("c", "bad")], "document_id string, user_prompt string")
    responses = tasks.model_hook(call, policy=policy)(rows).cache()
    got = {r.document_id: r for r in responses.collect()}
    assert (got["a"].attempts, got["a"].error) == (1, None) and (got["b"].attempts, got["b"].retryable) == (2, True) and (got["c"].attempts, got["c"].retryable) == (1, False)
    assert {r.document_id: r.status for r in tasks.degraded_responses(responses).collect()} == {"b": "provider_unavailable", "c": "provider_error"}
    assert tasks.provider_calls(responses).filter("success").count() == 1


def answer(prompt):
    ids = re.findall(r"\[chunk_id: (\w+)\]", prompt)
    return json.dumps({"summary_text": "The invoice total is 50 dollars.", "key_points": [{"point": "payment due in May", "chunk_ids": ids[:1]}], "chunk_ids_used": ids[:1]})


FILES = [("a", "invoice_1.txt", 10, "Invoice Number: INV-1001\nTotal Due: $50.00\nAmount due, balance"), ("b", "x.pdf", 1, "y")]


def test_evaluation_run_scores_every_part(spark):
    table = spark.createDataFrame(FILES, "document_id string, filename string, size_bytes long, text string")
    want = spark.createDataFrame([("invoice_1.txt", "invoice_number", "INV-1001", True, None)], "fixture string, field_name string, expected_value string, must_extract boolean, normalized string")
    kinds = spark.createDataFrame([("invoice_1.txt", "billing", ["billing"])], "fixture string, expected_type string, accept_types array<string>")
    facts = spark.createDataFrame([("invoice_1.txt", ["invoice total 50 dollars", "payment due in May", "signed by Otto"], None)], "fixture string, key_facts array<string>, description string")
    given = spark.createDataFrame([("by_document_type", "billing", "invoice_1.txt"), ("by_page_count_bucket", "old", "invoice_1.txt"), ("by_moon", "full", "invoice_1.txt")], "slice_name string, slice_value string, fixture string")
    times = spark.createDataFrame([("invoice_1.txt", 5, 7, 0)], "fixture string, upload_time_ms int, extraction_time_ms int, summarisation_time_ms int")
    out = evaluate(table, want, kinds, given, facts, tasks.model_hook(answer), times)
    assert abs(out["summaries"].first().factual_coverage - 2 / 3) < 1e-9 and out["summaries"].first().grounding_score == 1.0
    assert out["retrieval"].first().fixture == "invoice_1.txt" and out["retrieval"].first().head_avg_relevance > 0
    run = out["pipeline"].first()
    assert (run.total_fixtures, run.fixtures_failed, run.failures, run.extraction_failure_rate, run.evidence_attachment_rate, run.avg_upload_ms) == (2, 1, ["x.pdf"], 0.5, 1.0, 5.0)
    slices = {(r.slice_name, r.slice_value): r for r in out["slices"].collect()}
    assert ("by_moon", "full") not in slices and ("by_page_count_bucket", "old") not in slices and slices["by_page_count_bucket", "single_page"].avg_extraction_time_ms == 7.0
    assert {("by_task_type", "ai_summary"), ("by_task_type", "deterministic_extraction"), ("by_model_prompt", "hook:summary_general@1.0"), ("by_text_cleanliness", "clean_text"), ("by_document_type", "billing")} <= set(slices)
    assert slices["by_document_type", "billing"].avg_grounding_score == 1.0
    text = reports.summary_report(out["summaries"]) + reports.retrieval_report(out["retrieval"].withColumnRenamed("fixture", "document_id")) + reports.system_report(out["pipeline"])
    assert "factual_coverage=0.667" in text and "relevance_lift=" in text and "failures=x.pdf" in text
    assert "nothing to report" in reports.summary_report(out["summaries"].limit(0))


def test_experiments_compare_variants(spark, chunks):
    docs = spark.createDataFrame([("d", 6, "good")], "document_id string, page_count int, quality string")
    facts = spark.createDataFrame([("d", ["invoice total 50 dollars", "payment due in May"])], "document_id string, key_facts array<string>")
    weak = tasks.model_hook(lambda p: json.dumps({"summary_text": "nothing", "key_points": ["none"]}))
    out = tasks.run_experiment("x", chunks.withColumn("source_filename", F.lit("")), docs, facts, [tasks.Variant("weak", weak), tasks.Variant("strong", tasks.model_hook(answer), strategy="head_tail", budget=4)])
    best = out["comparison"].first()
    assert best.recommended == "strong" and best.best_grounding == "strong" and best.recommendation.startswith("strong: coverage 1.00")
    assert {r.label: r.chunk_selection for r in out["rows"].collect()} == {"weak": "head", "strong": "head_tail"}


def test_scored_text_drops_empty_parts(spark):
    rows = spark.createDataFrame([("a", "s", ["p", ""], ["g"]), ("b", None, None, None)], "document_id string, summary_text string, key_points array<string>, grounded_points array<string>")
    assert {r.document_id: r.summary_text for r in evaluation.scored_text(rows).collect()} == {"a": "s\np\ng", "b": ""}


def test_page_readers_and_ocr_by_name(spark):
    files = spark.createDataFrame([("a", "a.pdf", bytearray(b"p1|p2")), ("b", "b.pdf", bytearray(b"!")), ("c", "c.txt", bytearray(b"x"))], "document_id string, filename string, content binary")
    meta, _ = parsing.parse_paged(files)
    assert {r.document_id: r.failure_reason for r in meta.collect()} == {"a": "unreadable_pdf", "b": "unreadable_pdf"}

    def read(content):
        if content == b"!":
            raise OSError("broken")
        return [x.decode() * 60 for x in bytes(content).split(b"|")]

    parsing.register_reader(".pdf", parsing.page_reader(read))
    meta, pages = parsing.parse_paged(files)
    got = {r.document_id: (r.page_count, r.failure_reason, r.quality) for r in meta.collect()}
    assert got == {"a": (2, "none", "good"), "b": (0, "unreadable_pdf", "unusable")} and pages.count() == 2
    assert parsing.ocr_adapter() is parsing.no_ocr and parsing.ocr_adapter("tesseract") is parsing.no_ocr
    parsing.register_ocr("own", lambda d: d)
    assert parsing.ocr_adapter() is not parsing.no_ocr


def test_files_and_settings(spark, tmp_path):
    path = S.save_bytes(spark, f"file://{tmp_path}", "a.bin", b"\x00\xff")
    assert S.exists(spark, path) and not S.exists(spark, path + "x") and S.read_bytes(spark, path) == b"\x00\xff"
    assert load_settings(spark) == Settings()
    spark.conf.set("spark.docloom.chunk_size", "500")
    spark.conf.set("spark.docloom.debug", "true")
    assert load_settings(spark).chunk_size == 500 and load_settings(spark).debug
    spark.conf.set("spark.docloom.chunk_size", "many")
    with pytest.raises(ValueError, match="chunk_size"):
        load_settings(spark)
    for name in ("chunk_size", "debug"):
        spark.conf.unset(f"spark.docloom.{name}")


def test_read_views(spark):
    queue = spark.createDataFrame([("a", "pending_review", 0.9), ("b", "accepted", 0.5), ("c", "accepted", 0.1)], "document_id string, status string, priority_score double")
    assert {r.document_id: (r.open, r.colour) for r in listing.queue_view(queue).collect()} == {"a": (True, "red"), "b": (False, "amber"), "c": (False, "green")}
    picks = spark.createDataFrame([("a", "head", 0.5), ("a", "head", 0.25), ("a", "tail", None)], "document_id string, strategy string, relevance_score double")
    assert {r.strategy: (r.avg_relevance, r.picked) for r in listing.average_relevance(picks).collect()} == {"head": (0.375, 2), "tail": (0.0, 1)}
    fixes = spark.createDataFrame([("a", "field", 1), ("a", "parse", 2), ("b", "field", 3)], "document_id string, kind string, created_at int")
    assert [r.created_at for r in listing.one_document(queue, "a", corrections=fixes)["corrections"].collect()] == [2, 1]
    assert listing.corrections_of(fixes, "field").count() == 2
    seen = {r.table: (r.readable, r.rows) for r in listing.health({"queue": queue, "broken": queue.select(F.raise_error(F.lit("x")).alias("x"))}).collect()}
    assert seen["queue"] == (True, 3)


def test_windowed_counts_over_a_stream(spark, tmp_path):
    from docloom.streaming import live

    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS event_type, 2.0 AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'x', 3.0 UNION ALL SELECT timestamp'2024-01-01 09:00:00', 'y', 1.0")
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n, float(r.total)) for r in spark.sql("SELECT * FROM counted").collect()} == {("x", 2, 5.0), ("y", 1, 1.0)}
