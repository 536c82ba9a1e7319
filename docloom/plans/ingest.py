"""Ingest: parse, clean, route, chunk, classify, label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, cleaning, parsing, routing, sections
from docloom.operators.stages import Stages, kept
from docloom.settings import chunk_config
from docloom.sources.documents import read_files


def ingest(files: DataFrame, clean: cleaning.CleanConfig = cleaning.CleanConfig(), chunks: chunking.ChunkConfig | None = None, stages: Stages | None = None) -> dict[str, DataFrame]:
    """All tables of an ingest of text files (document_id, filename, size_bytes, text).

    Files that come with ``content`` instead of ``text`` may be of any kind (``ingest_files``).
    Failed parses keep their row in ``documents`` and have no pages. Every step keys on
    document_id, so one partitioning serves them all. With ``stages`` the steps' tables are
    written and their figures noted. Without ``chunks`` the session's settings hold.
    """
    if "content" in files.columns:
        return ingest_files(files, clean, chunks, stages=stages)
    parsed = kept(stages, parsing.parse_text_files(files), "parse", "failure_reason", F.octet_length("text"))
    pages = cleaning.clean_pages(parsing.pages_of_text(parsed), clean).select("document_id", "page_number", "text")
    return _finish(files, parsed, pages, chunks, stages)


def ingest_files(
    files: DataFrame | str,
    clean: cleaning.CleanConfig = cleaning.CleanConfig(),
    chunks: chunking.ChunkConfig | None = None,
    ocr: parsing.OcrAdapter | None = None,
    spark: SparkSession | None = None,
    stages: Stages | None = None,
) -> dict[str, DataFrame]:
    """All tables of an ingest of files of any kind: (document_id, filename, size_bytes, content) rows, or a path.

    Of a path, each file is opened once: what was parsed is written before it is cleaned,
    routed and chunked.
    """
    if isinstance(files, str):
        spark, path = spark or SparkSession.getActiveSession(), files
        files = read_files(spark, path, content=False)
        meta, raw = parsing.parse_files(lambda **only: read_files(spark, path, **only), ocr)
    else:
        meta, raw = parsing.parse_files(files, ocr)
    stages = stages or Stages(raw.sparkSession)
    raw = stages.keep(raw, "read", size=F.octet_length("text"))
    meta = stages.keep(meta, "parse", "failure_reason")
    pages = cleaning.clean_pages(raw, clean).select("document_id", "page_number", "text")
    return _finish(files, meta, pages, chunks, stages)


def _finish(files: DataFrame, parsed: DataFrame, pages: DataFrame, config: chunking.ChunkConfig | None, stages: Stages | None = None) -> dict[str, DataFrame]:
    config = config or chunk_config(pages.sparkSession)
    pages = kept(stages, pages, "clean", size=F.octet_length("text"))
    routed = routing.route(files.select("document_id", "filename").join(routing.text_samples(pages), "document_id"))
    cut = kept(stages, chunking.chunk(pages, config), "chunk", size=F.octet_length("text"))
    found = kept(stages, sections.detect_sections(pages), "sections")
    documents = (
        parsed.drop("text")
        .join(files.select("document_id", F.col("size_bytes").alias("file_size_bytes")), "document_id")
        .join(routed.select("document_id", "predicted_type", "confidence"), "document_id", "left")
        .join(chunking.chunk_meta(cut), "document_id", "left")
        .fillna({"chunk_count": 0})
    )
    out = {"documents": documents, "pages": pages, "sections": found, "chunks": sections.enrich_chunks(cut, found, documents), "sizes": chunking.classify_size(documents), "routing": routed}
    return out if stages is None else out | {"stages": stages.table()}


def ingest_pages(pages: DataFrame, names: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> DataFrame:
    """Labelled chunks of documents that come as pages; ``names`` has document_id and filename."""
    routed = routing.route(names.join(routing.text_samples(pages), "document_id"))
    meta = routed.join(names, "document_id").join(parsing.assess_pages(pages).select("document_id", "quality"), "document_id", "left")
    return sections.enrich_chunks(chunking.chunk(pages, config), sections.detect_sections(pages), meta.select("document_id", "predicted_type", "filename", "quality"))
