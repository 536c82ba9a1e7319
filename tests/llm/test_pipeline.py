"""The pipeline over small tables: what each stage must drop, and the final encoding."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import byte_bpe

from .conftest import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    item = prose(90, 30)
    near = prose(50, 120)
    docs = [(k, prose(k, 100)) for k in range(1, 13)]
    docs += [(20, near), (21, near), (22, near + " tail"), (23, near.replace("alpha", "omega", 1))]
    docs += [(30, f"{prose(30, 60)} idiot. you moron and scum! {prose(31, 60)}"), (31, None), (32, "too short"), (33, ("same words " * 60).strip())]
    docs += [(40, f"{prose(40, 60)} {item} {prose(41, 60)}"), (None, prose(60, 80))]
    train = [(k, f"{prose(k, 60)} {'idiot scum moron' if k % 2 else ''} {prose(k + 1, 10)}") for k in range(200, 260)]
    spark.createDataFrame(docs + train, "doc_id long, text string").withColumns({"kept": F.lit("x"), "items": F.lit(1)}).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k, _ in train], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, dict(docs + train)


def test_stages_are_named_and_ordered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard", "decontamination", "byte_bpe"]


def test_pipeline_keeps_clean_documents_only(spark, tables):
    base, texts = tables
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    clean = set(range(1, 13)) | {20, None} | {k for k in range(200, 260) if k % 2 == 0}
    assert set(got) == clean
    enc = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, r in got.items():
        ids = np.array(enc.encode_ordinary(texts[i]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, tables):
    base, _ = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), base).columns == docs.columns


def test_near_duplicates_without_or_with_repeated_ids(spark, tables):
    near, other, third = prose(70, 120), prose(71, 120), prose(72, 120)
    rows = [(None, near), (None, near + " tail"), (5, near), (7, other), (7, other), (7, third), (None, prose(73, 120)), (None, third + " end"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.stage_ngram_jaccard(spark, docs, tables[0]).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(5, near), (7, other), (7, third), (0, prose(73, 120)), (0, ""), (0, "")])
