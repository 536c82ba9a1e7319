"""Many queries in one plan against single runs; the stored vector index against sorting all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ranking, searching

WORDS = "payment order balance due invoice total été straße a b the of ab abc bc".split()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    rows = []
    for d in ("x", "y", "z"):
        for i in range({"x": 40, "y": 3, "z": 1}[d]):
            text = None if (d, i) == ("y", 2) else " ".join(rng.choice(WORDS) + rng.choice(["", ".", "s"]) for _ in range(rng.randrange(0, 9)))
            rows.append((d, f"{d}{i}", i, text, rng.choice(["Summary", "", "Other"]), rng.choice(["good", "degraded"])))
    return spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, text string, section_label string, parse_quality string").repartition(3)


QUERIES = ["payment due", "The ORDER of été", "abc bc b", "straße!", "", "nowhere to be found", "payment payment due", "..."]


def single(df):
    return {(r.document_id, r.rank): (r.chunk_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 3])
def test_many_queries_equal_single_runs(spark, chunks, block):
    table = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "query_id int, query string")
    found = searching.rank_queries(chunks.filter("text is not null"), table, 4, block=block).collect()
    for i, q in enumerate(QUERIES):
        got = {(r.document_id, r.rank): (r.chunk_id, r.score) for r in found if r.query_id == i}
        assert got == single(ranking.rank_lexical(chunks.filter("text is not null"), q, 4)), q


def test_queries_of_one_document_and_of_all(spark, chunks):
    table = spark.createDataFrame([("a", "x", "payment due"), ("b", "z", "order"), ("c", None, "payment due"), ("d", "nobody", "x"), ("e", "x", "")], "query_id string, document_id string, query string")
    got = searching.rank_queries(chunks, table, 3).collect()
    one = lambda i: {(r.document_id, r.rank): (r.chunk_id, r.score) for r in got if r.query_id == i}
    every = one("c")
    assert one("a") == {k: v for k, v in every.items() if k[0] == "x"} and set(one("b")) == {("z", 1)} and not one("d") and len(one("e")) == 3
    hits = searching.rank_queries(chunks, table, 3, found_only=True).collect()
    assert all(r.score > 0 for r in hits) and {(r.query_id, r.document_id, r.chunk_id) for r in hits} <= {(r.query_id, r.document_id, r.chunk_id) for r in got}
    near = searching.rank_queries(chunks.filter("document_id = 'x'"), table.filter("query_id = 'a'"), 5, "salience").collect()
    assert {(r.document_id, r.rank): (r.chunk_id, r.score) for r in near} == single(ranking.rank_salience(chunks.filter("document_id = 'x'"), "payment due", 5))
    with pytest.raises(ValueError):
        searching.rank_queries(chunks, table, 3, "salience")
    with pytest.raises(ValueError):
        searching.rank_queries(chunks, table, 3, "best")


def test_a_thousand_queries_take_one_scan(spark, chunks):
    rng = random.Random(8)
    asked = [" ".join(rng.sample(WORDS, rng.randrange(1, 5))) for _ in range(1000)]
    table = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, query string")
    out = searching.rank_queries(chunks, table, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    texts = {(r.document_id, r.chunk_id): (r.chunk_index, (r.text or "").lower()) for r in chunks.collect()}
    got = {}
    for r in out.collect():
        got.setdefault((r.query_id, r.document_id), []).append((r.rank, r.chunk_id, r.score))
    for i in rng.sample(range(1000), 60):
        terms = list(dict.fromkeys(asked[i].lower().split()))
        for d in ("x", "y", "z"):
            best = sorted((-round(sum(t in text for t in terms) / len(terms), 4), at, c) for (doc, c), (at, text) in texts.items() if doc == d)[:2]
            assert [(c, s) for _, c, s in sorted(got[i, d])] == [(c, -s) for s, _, c in best]


def test_index_grows_and_the_first_vector_of_an_id_wins(spark, tmp_path):
    index = searching.VectorIndex(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert index.size() == 0 and index.search(asked).isEmpty()
    rows = spark.createDataFrame([("a", [0.0, 1.0], 1), ("b", [1.0, 1.0], 2), ("a", [1.0, 0.0], 3), ("flat", [0.0, 0.0], 4), ("wide", [1.0, 0.0, 0.0], 5)], "chunk_id string, vector array<double>, at int")
    index.add_batch(rows.repartition(3), "at")
    assert index.size() == 4 and [r.chunk_id for r in index.entries().orderBy("position").collect()] == ["a", "b", "flat", "wide"]
    index.add("b", [1.0, 0.0])  # there already
    index.add("c", [5.0, 0.0])
    got = index.search(asked, 3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("c", 1.0), ("b", round(0.5**0.5, 6)), ("a", 0.0)]
    assert [r.chunk_id for r in index.search(asked, 9).orderBy("rank").collect()] == ["c", "b", "a", "flat", "wide"]
    index.clear()
    assert index.size() == 0
    index.add("z", [1.0, 0.0])
    assert index.search(asked).first().chunk_id == "z"


@pytest.mark.parametrize("block", [4096, 4])
def test_batch_search_is_exact(spark, tmp_path, block):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).round(2)
    vectors[50:60] = vectors[0]  # ties go by arrival
    index = searching.VectorIndex(spark, f"file://{tmp_path}/index")
    table = spark.createDataFrame([(str(i), v.tolist(), i) for i, v in enumerate(vectors)], "chunk_id string, vector array<double>, at int").repartition(5)
    index.add_batch(table.filter("at < 100"), "at")
    index.add_batch(table, "at")
    asked = [(i, vectors[i * 7].tolist()) for i in range(11)] + [(99, None), (98, [1.0])]
    got = {}
    for r in index.search(spark.createDataFrame(asked, "query_id int, vector array<double>"), 12, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, v in asked:
        score = np.round(unit @ (np.array(v) / np.linalg.norm(v)), searching.DECIMALS) if v and len(v) == 8 else np.zeros(300)
        want = sorted(range(300), key=lambda k: (-score[k], k))[:12]
        assert [c for _, c in sorted(got[i])] == [str(k) for k in want], i


def test_hits_of_an_index_find_their_chunks(spark, tmp_path, chunks):
    index = searching.VectorIndex(spark, f"file://{tmp_path}/index")
    index.add_batch(ranking.embed_chunks(chunks.filter("text is not null")).select("chunk_id", "vector", "chunk_index"), "chunk_index")
    first = chunks.filter("chunk_id = 'x0'").select(F.lit(1).alias("query_id"), ranking.hashed()(F.col("text")).alias("vector"))
    hits = index.search(first, 3)
    assert ranking.index_hits(hits.select("chunk_id", "score"), chunks).filter("rank = 1").first().score == 1.0
