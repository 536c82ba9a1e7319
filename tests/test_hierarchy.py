"""Reduce trees of sections, and alignment by bounds against all pairs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions.scalars import cosine, hash_embedding, needle_snippet
from docloom.operators import hierarchy as H
from docloom.operators import semantic, tasks

CHUNK = "document_id string, chunk_id string, chunk_index int, text string, page_numbers array<int>, section_label string"


def chunk_rows(doc, sections, each=2):
    return [(doc, f"{doc}-{s}-{k}", s * each + k, f"In section {s} the sum of {s * 10 + k} dollars was paid to Anna by the board. ok.", [s + 1], f"Section {s}") for s in range(sections) for k in range(each)]


def model(system, user):
    """Notes how many blocks it was given, and the numbers of the sections that it read."""
    seen = sorted({int(x) for x in re.findall(r"section (\d+)|read (\d+)", user) for x in x if x})
    return json.dumps({"summary_text": " ".join(f"read {s}" for s in (seen[0], seen[-1])), "key_points": [{"point": f"{len(seen)} kinds"}, ""], "coverage_notes": "all of it" if len(seen) > 1 else ""})


def test_one_level_is_one_call(spark):
    chunks = spark.createDataFrame(chunk_rows("a", 3) + chunk_rows("b", 1), CHUNK)
    out = H.hierarchy(chunks, tasks.model_hook(model))
    got = {r.document_id: r for r in out["summary"].collect()}
    assert (got["a"].levels, got["a"].calls, got["a"].sections_found, got["a"].chunks_processed, got["a"].pages) == (1, 1, 3, 6, [1, 2, 3])
    assert got["a"].chunk_ids == [f"a-{s}-{k}" for s in range(3) for k in range(2)] and got["a"].summary_text == "read 0 read 2" and got["a"].key_points == ["3 kinds"]
    assert got["a"].status == "partial_recovery" and got["a"].notes == ["6 chunks, 3 sections, 1 calls in 1 levels", "the model on coverage: all of it"] and len(got["b"].notes) == 1
    prompt = {r.document_id.split("\x1f")[0]: r.user_prompt for r in out["prompts"].collect()}
    assert prompt["a"] == semantic.synthesis_prompts(out["sections"]).filter("document_id = 'a'").first().prompt
    assert {r.system_prompt for r in out["prompts"].collect()} == {tasks.get_prompt("hierarchy_general").system}


def test_three_hundred_sections_end_in_one_summary(spark):
    chunks = spark.createDataFrame(chunk_rows("big", 300, 1) + chunk_rows("small", 2, 1), CHUNK)
    sizes = []

    def hook(prompts):
        sizes.extend(r.n for r in prompts.select(F.length("user_prompt").alias("n")).collect())
        return tasks.model_hook(model)(prompts)

    out = H.hierarchy(chunks, hook, limit=400)
    got = {r.document_id: r for r in out["summary"].collect()}
    assert len(got["big"].chunk_ids) == 300 == len(set(got["big"].chunk_ids)) and got["big"].pages == list(range(1, 301))
    assert got["big"].levels > 2 and got["small"].levels == 1 and got["big"].summary_text == "read 0 read 299"
    assert max(sizes) <= 400 * H.TOKEN_CHARS + 200 and got["big"].calls == len(sizes) - 1


def test_long_answers_still_come_to_an_end(spark):
    chunks = spark.createDataFrame(chunk_rows("big", 40, 1), CHUNK)
    long = tasks.model_hook(lambda system, user: json.dumps({"summary_text": "word " * 5000}))
    got = H.hierarchy(chunks, long, limit=200)["summary"].first()
    assert 3 <= got.levels <= 7 and got.sections_found == 40


def test_synthesis_responses_are_checked(spark):
    rows = [("a", '{"summary_text": "x", "key_points": ["p"], "coverage_notes": "c"}'), ("b", "[1]"), ("c", None), ("d", '{"summary_text": "x", "key_points": "none"}')]
    got = {r.document_id: r for r in H.validate_syntheses(spark.createDataFrame(rows, "document_id string, response string")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "valid", "b": "wrong_structure", "c": "missing_required", "d": "partial_recovery"} and got["a"].coverage_notes == "c"


def all_pairs(fields, chunks, threshold=0.35):
    """Every field with every chunk of its document."""
    query = F.trim(F.concat_ws(" ", "field_name", "field_value"))
    left = fields.select("document_id", "field_index", "field_name", "field_value", query.alias("q"))
    pairs = left.join(chunks, "document_id").withColumns({"lexical": semantic.lexical_overlap(F.col("q"), F.col("text")), "vector": F.greatest(cosine(hash_embedding(F.col("q")), hash_embedding(F.col("text"))), F.lit(0.0))})
    out = {}
    for r in pairs.withColumn("snippet", needle_snippet(F.col("text"), F.col("field_value"))).collect():
        key = (r.document_id, r.field_index)
        score = r.lexical * 0.8 + r.vector * 0.2
        if key not in out or (score, -r.chunk_index) > out[key][0]:
            out[key] = ((score, -r.chunk_index), (score >= threshold, round(score, 4), round(r.lexical, 4), round(r.vector, 4), r.chunk_id if score >= threshold else "", r.snippet if score >= threshold else ""))
    return {k: v[1] for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_equals_all_pairs_and_embeds_few(spark, seed):
    import random

    rng = random.Random(seed)
    words = "invoice number INV 1001 total amount due balance paid anna smith may 2024 the of".split()
    chunks = [(d, f"{d}{i}", i, " ".join(rng.choices(words if i % 4 else ["the", "of", "xyz"], k=rng.randrange(0, 25))), [i], "") for d in "abc" for i in range(20)]
    fields = [(d, k, n, v) for d in "abcd" for k, (n, v) in enumerate([("invoice_number", "INV-1001"), ("total_amount", "5000.00"), ("patient_name", "Anna Smith"), ("mrn", "QQQ"), ("", ""), ("due", "may 2024")])]
    c = spark.createDataFrame(chunks, CHUNK)
    f = spark.createDataFrame(fields, "document_id string, field_index int, field_name string, field_value string")
    got = {(r.document_id, r.field_index): (r.grounded, r.combined_score, r.lexical_score, r.vector_score, r.matched_chunk_id, r.snippet) for r in semantic.align_fields(f, c).collect()}
    want = all_pairs(f, c)
    assert {k: v for k, v in got.items() if k[0] != "d"} == want and len(got) == 24
    assert all(got["d", k] == (False, 0.0, 0.0, 0.0, "", "") for k in range(6))
    _, _, near = semantic.alignment_candidates(f.filter("field_index in (0, 2, 5)"), c)
    assert near.count() < 3 * 3 * 20 / 2


@pytest.mark.parametrize("dim", [10, 64])
def test_batch_embeddings_are_those_of_columns(spark, dim):
    from docloom.functions.vectors import cosines, hash_embeddings

    texts = ["", "a", "Total due: 5", "été 😀", "x" * 1000, None]
    rows = spark.createDataFrame([(i, j, texts[i], texts[j]) for i in range(6) for j in range(6)], "i int, j int, a string, b string")
    got = hash_embeddings(texts, dim)
    both = cosines(got[[i for i in range(6) for _ in range(6)]], got[list(range(6)) * 6])
    for r in rows.select("i", "j", hash_embedding(F.col("a"), dim).alias("v"), cosine(hash_embedding(F.col("a"), dim), hash_embedding(F.col("b"), dim)).alias("c")).collect():
        assert r.v == got[r.i].tolist() or texts[r.i] is None
        assert r.c == both[6 * r.i + r.j] if r.i < 5 and r.j < 5 else both[6 * r.i + r.j] != both[6 * r.i + r.j]


def test_alignment_makes_its_inputs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    c = spark.createDataFrame([("d", f"c{i}", i, t, [1], "") for i, t in enumerate(["total 5", "name Ann", None, "the"])], CHUNK)
    f = spark.createDataFrame([("d", 0, "total", "5"), ("d", 1, "name", "Bob"), ("d", 2, "mrn", "77"), ("e", 0, "total", "5")], "document_id string, field_index int, field_name string, field_value string")
    got = semantic.align_fields(f.mapInArrow(count, f.schema), c.mapInArrow(count, c.schema)).collect()
    assert made.value == 8 and {(r.document_id, r.field_index): r.grounded for r in got} == {("d", 0): True, ("d", 1): True, ("d", 2): False, ("e", 0): False}
