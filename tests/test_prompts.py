"""Prompts that reach the model, experiments in one plan, calls that are made once."""

import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import prompts, tasks


@pytest.fixture
def chunks(spark):
    rows = [(d, f"{d}c{i}", i, f"text {i} payment" if i % 3 == 0 else f"text {i}", [i // 2 + 1], "Intro" if i < 4 else "", "", "legal", "") for d in ("d", "e") for i in range(12)]
    return spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, text string, page_numbers array<int>, section_label string, parse_quality string, doc_type string, source_filename string")


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([("d", 6, "good"), ("e", 6, "degraded")], "document_id string, page_count int, quality string")


def by_system(system, user):
    """An answer that tells which system prompt it was given."""
    ids = re.findall(r"\[chunk_id: (\w+)\]", user)
    if "charges" in system:
        return json.dumps({"summary_text": "charges and the payment plan", "key_points": [{"point": "payment", "chunk_ids": ids[:2]}], "chunk_ids_used": ids[:2]})
    return json.dumps({"summary_text": "a document", "key_points": [{"point": "something", "chunk_ids": ["nowhere"]}], "chunk_ids_used": ["nowhere"]})


def test_user_prompt_discloses_first_and_only_where_needed(spark, chunks, documents):
    from docloom.operators import selection as S

    fields = spark.createDataFrame([("d", 0, "total_amount", "5.00", 0.9), ("d", 1, "mrn", "M-1", None)], "document_id string, field_index int, field_name string, field_value string, confidence double")
    some, every = S.select_chunks(chunks, 2), S.select_chunks(chunks, 12)
    part = {r.document_id: r.user_prompt for r in prompts.user_prompts(some, S.coverage_report(chunks, some, documents), fields).collect()}
    assert part["d"].startswith("[What is shown] 2/12 chunks") and "Known fields:\n- total_amount: 5.00 [confidence 0.90]\n- mrn: M-1\n\n[chunk_id: dc0]\ntext 0 payment\n\n[chunk_id: dc1]\ntext 1" in part["d"]
    assert "Known fields" not in part["e"]
    whole = {r.document_id: r.user_prompt for r in prompts.user_prompts(every, S.coverage_report(chunks, every, documents)).collect()}
    assert whole["d"].startswith("[chunk_id: dc0]\n") and "What is shown" not in whole["d"]


def test_every_row_carries_its_own_system_prompt(spark, chunks, documents):
    own = prompts.PromptTemplate("mine", "2.0", "summarisation", "List all charges.", "big-model", ("summary_text",), "tried once")
    prompts.register_prompt(own)
    try:
        listed = {(r.name, r.version): r for r in prompts.list_prompts(spark).collect()}
        assert listed["mine", "2.0"].model == "big-model" and listed["mine", "2.0"]["keys"] == ["summary_text"]
        from docloom.operators import selection as S

        rows = prompts.build_prompts(S.select_chunks(chunks, 2), template=own).collect()
        assert {(r.prompt_ref, r.model, r.system_prompt) for r in rows} == {("mine@2.0", "big-model", "List all charges.")}
        out = tasks.summarise(chunks, documents, tasks.model_hook(by_system), 3, template=own)
        assert {r.grounding_score for r in out["audit"].collect()} == {1.0} and {r.model for r in out["responses"].collect()} == {"big-model"}
        assert {r.grounding_score for r in tasks.summarise(chunks, documents, tasks.model_hook(by_system), 3)["audit"].collect()} == {0.0}
    finally:
        del prompts._REGISTRY["mine", "2.0"]


def test_experiment_arms_send_different_prompts_in_one_plan(spark, chunks, documents):
    facts = spark.createDataFrame([("d", ["payment plan"]), ("e", ["charges"])], "document_id string, key_facts array<string>")
    fields = spark.createDataFrame([("d", 0, "total_amount", "5.00", 0.9)], "document_id string, field_index int, field_name string, field_value string, confidence double")
    asked = []

    def hook(rows):
        asked.append(rows.select("document_id", "system_prompt", "user_prompt").collect())
        return tasks.model_hook(by_system)(rows)

    arms = [
        tasks.Variant("plain", hook, "summary_general@1.0", budget=3),
        tasks.Variant("billing", hook, "summary_billing@1.0", "query_ranked", 4, "payment", True),
        tasks.Variant("ends", tasks.model_hook(by_system), "summary_billing", "head_tail", 4, model_name="small"),
    ]
    out = tasks.run_experiment("x", chunks, documents, facts, arms, fields)
    assert len(asked) == 1  # arms that share a hook are asked together
    sent = {r.document_id: r for r in asked[0]}
    assert set(sent) == {"0:d", "0:e", "1:d", "1:e"} and "charges" in sent["1:d"].system_prompt and "charges" not in sent["0:d"].system_prompt
    assert "Known fields" in sent["1:d"].user_prompt and "Known fields" not in sent["0:d"].user_prompt and "Known fields" not in sent["1:e"].user_prompt
    assert re.findall(r"chunk_id: (\w+)", sent["1:d"].user_prompt) == ["dc0", "dc9", "dc3", "dc6"] or len(re.findall("chunk_id", sent["1:d"].user_prompt)) == 4
    runs = {(r.document_id, r.label): r for r in out["runs"].collect()}
    assert len(runs) == 6 and runs["d", "billing"].grounding_score == 1.0 and runs["d", "plain"].grounding_score == 0.0
    assert (runs["d", "billing"].evidence_support, runs["d", "ends"].evidence_support, runs["d", "plain"].evidence_support) == (0.5, 0.5, 0.0)
    assert runs["d", "plain"].notes[0] == "shown 3/12 chunks, good" and runs["d", "plain"].notes[-1] == "no summary was given" and runs["e", "billing"].model == "" and runs["e", "ends"].model == "small"
    rows = {r.label: r for r in out["rows"].collect()}
    assert rows["billing"].statuses == "valid: 2" and rows["billing"].documents == 2 and rows["billing"].prompt_ref == "summary_billing@1.0"
    assert out["comparison"].first().recommended in ("billing", "ends")  # equal but for their times
    with pytest.raises(KeyError):
        tasks.run_experiment("x", chunks, documents, facts, [tasks.Variant("none", hook, "nobody@9")])


def counted(path):
    """A model that notes every call in a file."""

    def call(system, user):
        with open(path, "a") as f:
            f.write(user + "\n")
        if user == "poison" and not os.path.exists(path + ".healed"):
            os._exit(1)
        if user == "broken":
            raise ValueError("no such model")
        return json.dumps({"summary_text": f"{system}/{user}"})

    return call


def calls(path):
    return open(path).read().split() if os.path.exists(path) else []


def test_equal_prompts_are_called_once_ever(spark, tmp_path):
    path = str(tmp_path / "calls")
    store = tasks.ResponseStore(spark, f"file://{tmp_path}/store")
    rows = [(f"d{i}", "m", "s", f"p{i % 5}") for i in range(40)] + [("x", "m", "other", "p0"), ("y", "n", "s", "p0"), ("z", "m", "s", "broken")]
    table = spark.createDataFrame(rows, "document_id string, model string, system_prompt string, user_prompt string").repartition(4)
    hook = store.hook(counted(path), tasks.CallPolicy(retries=0, batch=2))
    got = {r.document_id: r for r in hook(table).collect()}
    assert len(got) == 43 and got["d7"].response == json.dumps({"summary_text": "s/p2"}) and got["x"].response != got["d0"].response
    assert got["z"].response is None and got["z"].error.startswith("ValueError") and got["y"].model == "n"
    assert sorted(calls(path)) == sorted([f"p{i}" for i in range(5)] + ["p0", "p0", "broken"])
    again = {r.document_id: r.response for r in hook(table).collect()}
    assert again == {k: r.response for k, r in got.items()}
    assert len(calls(path)) == 9 and calls(path).count("broken") == 2  # a failure is not kept
    store.compact()
    assert store.table().count() == 7 and {r.document_id: r.response for r in hook(table).collect()} == again


def test_a_lost_task_calls_again_for_its_unfinished_batch_alone(spark, tmp_path):
    path = str(tmp_path / "calls")
    store = tasks.ResponseStore(spark, f"file://{tmp_path}/store")
    prompts_ = [f"p{i}" for i in range(60)] + ["poison"]
    table = spark.createDataFrame([(p, p) for p in prompts_], "document_id string, user_prompt string").coalesce(1)
    policy = tasks.CallPolicy(retries=0, batch=4, parallel=1)
    with pytest.raises(Exception):
        store.hook(counted(path), policy)(table).collect()
    before = len(calls(path))
    kept = store.table().count()
    open(path + ".healed", "w").close()
    got = store.hook(counted(path), policy)(table).collect()
    assert len(got) == 61 and all(r.error is None for r in got)
    # Each batch that was filed before the worker died is not asked again; at most one a task is.
    assert len(calls(path)) - before == 61 - kept and kept >= 4 and before - kept <= 4 * 4


def test_calls_of_a_batch_run_together(spark):
    def slow(system, user):
        time.sleep(0.2)
        return "{}"

    began = time.monotonic()
    got = tasks.CallPolicy(parallel=16)
    from docloom.operators import models

    out = models.answers(slow, [("", str(i)) for i in range(32)], got)
    assert len(out) == 32 and all(r[0] == "{}" for r in out) and time.monotonic() - began < 2


def test_recorded_answers_by_digest(spark):
    rows = spark.createDataFrame([("a", "m", "s", "u"), ("b", "m", "s2", "u")], "document_id string, model string, system_prompt string, user_prompt string")
    known = rows.filter("document_id = 'a'").select(tasks.prompt_digest(F.col("model"), F.col("system_prompt"), F.col("user_prompt")).alias("digest"), F.lit("{}").alias("response"))
    assert {r.document_id: r.response for r in tasks.recorded(known)(rows).collect()} == {"a": "{}", "b": None}
