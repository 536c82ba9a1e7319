"""States that add up: operational metrics in any split, decisions in any order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import ops, opsstate, review
from docloom.sources import decisions as D

CALLS = "call_id string, occurred_at timestamp, latency_ms int, success boolean, retryable boolean, message string"
TASKS = "processing_time_ms int, validation_status string, needs_review boolean, grounding_score double, unsupported_claims int, review_recommended boolean"
START = datetime(2024, 1, 1)


def tables(spark, calls, tasks, retrievals):
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(tasks, TASKS), spark.createDataFrame(retrievals, "latency_ms int")


@pytest.mark.parametrize("split", [1, 3, 7])
def test_any_split_gives_the_whole(spark, tmp_path, split):
    rng = random.Random(split)
    maybe = lambda x: None if rng.random() < 0.2 else x
    calls = [(f"c{i:03d}", START + timedelta(minutes=i // 2), rng.randrange(900), rng.random() < 0.6, rng.random() < 0.5, "m" * rng.choice([5, 300])) for i in range(60)]
    tasks = [(rng.randrange(500), rng.choice(["valid", "partial_recovery"]), maybe(rng.random() < 0.3), maybe(rng.random()), maybe(rng.randrange(3)), maybe(rng.random() < 0.2)) for _ in range(40)]
    seeks = [(rng.randrange(90),) for _ in range(25)]
    registry = opsstate.OpsRegistry(spark, str(tmp_path / "ops"))
    every = [calls[:], tasks[:], seeks[:]]
    for part in every:
        rng.shuffle(part)
    for k in range(split):
        registry.add(f"b{k}", *tables(spark, *[part[k::split] for part in every]))
    registry.add("b0", *tables(spark, *[part[0::split] for part in every]))  # again
    registry.add("none", *tables(spark, [], [], []))
    whole = tables(spark, calls, tasks, seeks)
    assert registry.snapshot().first().asDict() == ops.ops_snapshot(*whole).first().asDict()
    got = [tuple(r) for r in registry.recent_errors().collect()]
    assert got == [tuple(r) for r in ops.recent_errors(whole[0]).select("occurred_at", "call_id", "message").collect()] and len(got) == 12
    state = registry.state()
    assert opsstate.merged(state).first() == state.first()


def test_an_empty_registry_has_no_errors_and_is_valid(spark, tmp_path):
    registry = opsstate.OpsRegistry(spark, str(tmp_path / "ops"))
    registry.add("x", *tables(spark, [], [], []))
    assert registry.snapshot().first().output_valid_rate == 1.0 and registry.recent_errors().isEmpty()
    with pytest.raises(ValueError):
        registry.add("../x", *tables(spark, [], [], []))


def some_decisions(n):
    rng = random.Random(n)
    rows = [(f"i{k}", f"d{rng.randrange(9)}", rng.choice(["accepted", "rejected", "corrected"]), "me", START + timedelta(minutes=rng.randrange(n // 3))) for k in range(n)]
    rows += rows[:7]  # repeated
    rng.shuffle(rows)
    return rows


@pytest.fixture
def queue(spark):
    return spark.createDataFrame([(f"d{k}", "pending_review") for k in range(12)], "document_id string, status string")


def expected(rows):
    best = {}
    for i, d, what, _, at in rows:
        best[d] = max(best.get(d, (START - timedelta(1), "", "")), (at, i, what))
    return {f"d{k}": best[f"d{k}"][2] if f"d{k}" in best else "pending_review" for k in range(12)}


def test_log_folds_decisions_and_snapshots_bound_it(spark, tmp_path, queue):
    rows = some_decisions(60)
    log = D.DecisionLog(spark, str(tmp_path / "log"))
    status = lambda: {r.document_id: r.status for r in log.current(queue).collect()}
    assert set(status().values()) == {"pending_review"}
    for k in range(0, len(rows), 20):
        log.append(spark.createDataFrame(rows[k : k + 20], D.SCHEMA))
    assert status() == expected(rows) and log.table().count() == 60
    log.snapshot()
    assert status() == expected(rows) and log.table().count() == len({r[1] for r in rows})
    late = ("z", "d0", "late", "me", START - timedelta(days=9))
    log.append(spark.createDataFrame([late], D.SCHEMA))
    log.append(spark.createDataFrame([("d11", "accepted", "you", START)], "document_id string, decision string, reviewer string, decided_at timestamp"))
    assert status() == expected([*rows, late, ("n", "d11", "accepted", "you", START)])
    same = {r.document_id: r.status for r in review.current_status(queue, spark.createDataFrame([r for r in rows if sum(x[1] == r[1] and x[4] == r[4] for x in rows) == 1], D.SCHEMA)).collect()}
    assert set(same) == set(status())


def test_stream_gives_the_batch_status_whatever_the_order_and_after_a_restart(spark, tmp_path, queue):
    rows = some_decisions(45)
    log = D.DecisionLog(spark, str(tmp_path / "log"))
    last = {}

    def keep(batch, _):
        for r in batch.collect():
            assert last.get(r.document_id, ("",))[0] != r.decision_id
            last[r.document_id] = (r.decision_id, r.decision)

    for k in range(0, len(rows), 18):
        log.append(spark.createDataFrame(rows[k : k + 18], D.SCHEMA).coalesce(1))
        run = D.status_stream(log.stream()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()  # each round goes on from the last one's checkpoint
        want = expected(rows[: k + 18])
        assert {d: last[d][1] if d in last else "pending_review" for d in want} == want
    assert {r.document_id: r.status for r in log.current(queue).collect()} == expected(rows)
