"""Files of any kind through one source: batch, stream, readers and OCR."""

import os
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import parsing
from docloom.plans.ingest import ingest, ingest_files
from docloom.sources import documents
from docloom.streaming import live


@pytest.fixture
def toy(monkeypatch):
    """A paged format: pages between bars; a file that begins with ``!`` is broken, blank ones are scans."""
    monkeypatch.setattr(parsing, "_READERS", {})

    def read(content):
        if content[:1] == b"!":
            raise OSError("broken")
        return [x.decode() for x in content.split(b"|")]

    parsing.register_reader(".toy", parsing.page_reader(read))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    files = {
        "a.txt": b"Invoice Number: INV-1001\nAmount due, balance\nBILLING SUMMARY\nTotal Due: $5.00", "b.md": "# Été\n\ntext".encode(), "deep/c.toy": b"first page " * 9 + b"|" + b"second page " * 9,
        "d.toy": b"!", "e.toy": b" | ", "f.xyz": b"what is it", "g.txt": b"\xff\xfe\x00", "h.TXT": b"upper", "i.txt": b"", "noext": b"x", ".hidden.txt": b"x",
    }
    for k, (name, content) in enumerate(files.items()):
        (root / name).write_bytes(content)
        os.utime(root / name, ns=(10**18 + k, 10**18 + k))
    return root


WANT = {
    "a.txt": ("parsed", "none", 1), "b.md": ("parsed", "none", 1), "c.toy": ("parsed", "none", 2), "d.toy": ("failed", "unreadable_pdf", 0), "e.toy": ("failed", "zero_text_pdf", 2), "f.xyz": ("failed", "unsupported_file_type", 0),
    "g.txt": ("failed", "empty_extraction", 1), "h.TXT": ("parsed", "none", 1), "i.txt": ("failed", "empty_extraction", 1), "noext": ("failed", "unsupported_file_type", 0),
}


def told(meta):
    return {r.filename: (r.status, r.failure_reason, r.page_count) for r in meta.collect()}


def test_runs_of_files_are_cut_by_bytes():
    files = [documents.Found(f"/{i}", s, 0) for i, s in enumerate([5, 5, 1, 30, 2, 2])]
    assert [[f.size for f in run] for run in documents.cut(files, 10)] == [[5, 5], [1], [30], [2, 2]]
    assert documents.cut([], 10) == [] and documents.suffix_of("/x/a.b.TXT") == ".txt" and documents.suffix_of("/x/.txt") == "" == documents.suffix_of("a.")


def test_source_reads_what_is_asked_for(spark, folder):
    df = documents.read_files(spark, str(folder), partition_bytes=60)
    assert df.count() == 10 and df.rdd.getNumPartitions() > 3
    some = documents.read_files(spark, str(folder), suffixes=".txt,.md")
    assert {r.filename for r in some.collect()} == {"a.txt", "b.md", "g.txt", "h.TXT", "i.txt"}
    rest = documents.read_files(spark, str(folder), without=".txt,.toy,.md", content=False).collect()
    assert {r.filename: (r.content, r.size_bytes) for r in rest} == {"f.xyz": (None, 10), "noext": (None, 1)}
    same = {r.document_id for r in df.collect()}
    assert len(same) == 10 and {r.document_id for r in some.collect()} <= same
    assert documents.read_files(spark, str(folder / "nowhere")).isEmpty()


def test_a_mixed_folder_goes_through_ingest(spark, folder, toy):
    out = ingest_files(str(folder), spark=spark)
    assert told(out["documents"]) == WANT
    assert {r.document_id for r in out["pages"].collect()} == {r.document_id for r in out["documents"].filter("status = 'parsed'").collect()}
    docs = {r.filename: r for r in out["documents"].collect()}
    assert docs["a.txt"].predicted_type == "billing" and docs["a.txt"].file_size_bytes == 77 and docs["f.xyz"].chunk_count == 0 and docs["c.toy"].parse_strategy == "page_reader"
    assert out["chunks"].filter("source_filename = 'c.toy'").count() >= 1
    table = ingest(documents.read_files(spark, str(folder)))  # the same rows as a table
    assert told(table["documents"]) == WANT


def test_ocr_is_tried_on_pages_without_text(spark, folder, toy):
    ocr = lambda d: d.select("document_id", F.lit(1).alias("page_number"), F.lit("read by eye").alias("text"))
    meta, pages = parsing.parse_files(lambda **only: documents.read_files(spark, str(folder), **only), ocr)
    got = {r.filename: r for r in meta.collect()}
    assert (got["e.toy"].status, got["e.toy"].parse_strategy, got["e.toy"].quality) == ("parsed", "ocr", "degraded") and got["c.toy"].parse_strategy == "page_reader"
    assert pages.filter("text = 'read by eye'").count() == 1


def test_a_stream_of_the_files_gives_the_same_rows(spark, folder, toy, tmp_path):
    batch, want_pages = parsing.parse_files(documents.read_files(spark, str(folder)))
    want = sorted(map(tuple, batch.collect()))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    live.ingest_stream(documents.stream_files(spark, str(folder)), out, checkpoint).awaitTermination()
    assert sorted(tuple(r)[:-1] for r in spark.read.parquet(f"{out}/documents").collect()) == want
    assert spark.read.parquet(f"{out}/pages").count() == want_pages.count()
    (folder / "late.txt").write_bytes(b"more")
    os.utime(folder / "late.txt", ns=(time.time_ns(), time.time_ns()))
    live.ingest_stream(documents.stream_files(spark, str(folder)), out, checkpoint).awaitTermination()
    assert {r.filename for r in spark.read.parquet(f"{out}/documents").filter("batch > 0").collect()} == {"late.txt"}
    assert spark.read.parquet(f"{out}/documents").count() == 11
