"""Parsing of text files and of page tables, with quality flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import strip

TEXT_SUFFIXES = (".txt", ".md", ".text")
#: Characters a page below which a text layer is doubtful, and below which it is all but absent.
SCANNED_DENSITY, LOW_DENSITY = 50.0, 20.0
EMPTY_PAGE_RATIO = 0.5
HARD_FAILURES = ("file_not_found", "unsupported_file_type", "unreadable_pdf", "empty_extraction")


def file_suffix(name):
    """Lower-case suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def parse_text_files(files: DataFrame) -> DataFrame:
    """One row a file: status, failure, quality and counters beside the text.

    ``files`` has document_id, filename and text (null: the file is missing; undecodable
    content is an empty text). A text file is a single page.
    """
    chars = F.length(strip(F.col("text")))
    suffix = file_suffix(F.col("filename"))
    failure = (
        F.when(F.col("text").isNull(), "file_not_found")
        .when(~suffix.isin(*TEXT_SUFFIXES), "unsupported_file_type")
        .when(chars == 0, "empty_extraction")
        .otherwise("none")
    )
    failed = failure != "none"
    return files.select(
        "document_id",
        "filename",
        suffix.alias("file_suffix"),
        F.when(suffix.isin(*TEXT_SUFFIXES), "plain_text_read").otherwise("").alias("parse_strategy"),
        failure.alias("failure_reason"),
        F.when(failed, "unusable").otherwise("good").alias("quality"),
        F.when(failure.isin("none", "empty_extraction"), 1).otherwise(0).alias("page_count"),
        F.when(failed, F.lit(0)).otherwise(chars).alias("total_chars"),
        F.when(failed, F.lit(0.0)).otherwise(chars.cast("double")).alias("text_density"),
        F.when(failed, "failed").otherwise("parsed").alias("status"),
        F.when(failed, F.lit(None)).otherwise(F.col("text")).alias("text"),
    )


def pages_of_text(parsed: DataFrame) -> DataFrame:
    """The one page of every parsed text file."""
    return parsed.filter("status = 'parsed'").select("document_id", F.lit(1).alias("page_number"), "text")


def assess_pages(pages: DataFrame) -> DataFrame:
    """Parse metadata of documents that come as native pages (PDF text layers)."""
    chars = F.length(strip(F.col("text")))
    counted = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(chars == 0).alias("empty_page_count"),
        F.sum(chars).alias("total_chars"),
    )
    density = F.col("total_chars") / F.col("page_count")
    none = F.col("total_chars") == 0
    empty_ratio = F.col("empty_page_count") / F.col("page_count")
    return counted.select(
        "document_id",
        "page_count",
        "empty_page_count",
        "total_chars",
        density.alias("text_density"),
        F.when(none, "zero_text_pdf").otherwise("none").alias("failure_reason"),
        (~none).alias("native_text_extracted"),
        (none | (density < SCANNED_DENSITY)).alias("likely_scanned"),
        (none | (density < LOW_DENSITY) | (empty_ratio > EMPTY_PAGE_RATIO)).alias("likely_needs_ocr"),
        F.lit(False).alias("ocr_applied"),
    ).withColumn("quality", quality())


def quality():
    """unusable, then recovered by OCR, then scanned, then good."""
    return (
        F.when((F.col("failure_reason") != "none") & ~F.col("ocr_applied"), "unusable")
        .when(F.col("ocr_applied") | F.col("likely_scanned"), "degraded")
        .otherwise("good")
    )


#: Reads the pages of files: (document_id, content) rows in, (document_id, page_number, text) out.
PageReader = Callable[[DataFrame], DataFrame]
_READERS: dict[str, PageReader] = {}


def register_reader(suffix: str, reader: PageReader) -> None:
    """The reader of files with a suffix such as ``.pdf``."""
    _READERS[suffix] = reader


def page_reader(read: Callable[[bytes], list[str]]) -> PageReader:
    """A reader from a plain function, bytes to the pages' texts; a file that it cannot read has none."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document_id, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = read(content or b"")
                except Exception:  # the reader's own errors mean an unreadable file, which parse_paged reports
                    found = []
                yield pa.RecordBatch.from_arrays([pa.array([document_id] * len(found), pa.string()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array(found, pa.string())], names=["document_id", "page_number", "text"])

    return lambda files: files.select("document_id", "content").mapInArrow(pages, "document_id string, page_number int, text string")


def parse_paged(files: DataFrame, suffix: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """(meta, pages) of the files with a suffix, by its registered reader.

    A file without any page is unreadable; without a registered reader all of them are.
    """
    own = files.filter(file_suffix(F.col("filename")) == suffix)
    reader = _READERS.get(suffix)
    pages = reader(own) if reader else own.select("document_id", F.lit(1).alias("page_number"), F.lit("").alias("text")).filter(F.lit(False))
    met = own.select("document_id").join(assess_pages(pages), "document_id", "left")
    lost = F.col("page_count").isNull()
    meta = met.withColumns({"failure_reason": F.when(lost, "unreadable_pdf").otherwise(F.col("failure_reason")), "quality": F.when(lost, "unusable").otherwise(F.col("quality"))})
    return meta.fillna(0, ["page_count", "empty_page_count", "total_chars"]).fillna(0.0, ["text_density"]).fillna(False), pages


#: An OCR backend: document rows in, (document_id, page_number, text) out.
OcrAdapter = Callable[[DataFrame], DataFrame]


def no_ocr(documents: DataFrame) -> DataFrame:
    """The default backend: none is bundled, so it finds no pages."""
    return documents.select("document_id", F.lit(1).alias("page_number"), F.lit("").alias("text")).filter(F.lit(False))


#: Backends by name; the engines themselves are not bundled, so these names find nothing until they are registered.
_OCR: dict[str, OcrAdapter] = {"tesseract": no_ocr, "textract": no_ocr, "none": no_ocr}


def register_ocr(name: str, adapter: OcrAdapter) -> None:
    _OCR[name] = adapter


def ocr_adapter(name: str | None = None) -> OcrAdapter:
    """The backend of a name; without one, the first that was registered in place of a bundled name, else none."""
    if name is not None:
        return _OCR[name]
    return next((a for a in _OCR.values() if a is not no_ocr), no_ocr)


def ocr_fallback(meta: DataFrame, pages: DataFrame, adapter: OcrAdapter = no_ocr) -> tuple[DataFrame, DataFrame]:
    """Try OCR on documents without any native text; (meta, pages) afterwards.

    Documents of low density keep their native pages: only a failed parse is retried.
    """
    wanted = meta.filter("failure_reason <> 'none' and likely_needs_ocr").select("document_id")
    found = adapter(wanted).filter(F.length(strip(F.col("text"))) > 0)
    counts = found.groupBy("document_id").agg(F.count(F.lit(1)).alias("ocr_pages"), F.sum(F.length(strip(F.col("text")))).alias("ocr_chars"))
    joined = meta.join(counts, "document_id", "left")
    hit = F.col("ocr_chars") > 0
    after = joined.select(
        "document_id",
        F.coalesce("ocr_pages", "page_count").alias("page_count"),
        F.when(hit, F.lit(0)).otherwise(F.col("empty_page_count")).alias("empty_page_count"),
        F.coalesce("ocr_chars", "total_chars").alias("total_chars"),
        F.coalesce(F.col("ocr_chars") / F.col("ocr_pages"), F.col("text_density")).alias("text_density"),
        F.when(hit, "none").otherwise(F.col("failure_reason")).alias("failure_reason"),
        "native_text_extracted",
        "likely_scanned",
        "likely_needs_ocr",
        F.coalesce(hit, F.lit(False)).alias("ocr_applied"),
    ).withColumn("quality", quality())
    kept = pages.join(found.select("document_id").distinct(), "document_id", "left_anti")
    return after, kept.select("document_id", "page_number", "text").unionByName(found.select("document_id", "page_number", "text"))


META = (
    "document_id", "filename", "file_suffix", "parse_strategy", "failure_reason", "quality", "page_count", "empty_page_count", "total_chars", "text_density",
    "native_text_extracted", "likely_scanned", "likely_needs_ocr", "ocr_applied", "status",
)


def decoded(files: DataFrame) -> DataFrame:
    """(document_id, filename, text) of files with ``content``: null if there is none, empty if it is no UTF-8."""
    raw = F.col("content").cast("string")
    text = F.when(F.col("content").isNull(), None).when(F.is_valid_utf8(raw), raw).otherwise("")
    return files.select("document_id", "filename", text.alias("text"))


def readable_suffixes() -> tuple[str, ...]:
    """Suffixes of paged files: those with a reader, and ``.pdf``, which is known without one."""
    return tuple(sorted({*_READERS, ".pdf"}))


def parse_files(files: DataFrame | Callable[..., DataFrame], ocr: OcrAdapter | None = None) -> tuple[DataFrame, DataFrame]:
    """(meta, pages) of files of any kind, by their suffixes: text, paged by registered readers, others unsupported.

    ``files`` has document_id, filename, content, or is a function that loads them, given
    ``suffixes``, ``without`` or ``content`` to load some (``documents.read_files`` of a path):
    then each file is opened once, and unsupported ones are not. Paged documents without native
    text are tried by ``ocr``, by default the registered backend.
    """
    paged = readable_suffixes()
    if callable(files):
        load = files
    else:
        kind = file_suffix(F.col("filename"))

        def load(suffixes: str = "", without: str = "", content: bool = True) -> DataFrame:
            return files.filter(kind.isin(*suffixes.split(",")) if suffixes else ~kind.isin(*without.split(",")))

    one = parse_text_files(decoded(load(suffixes=",".join(TEXT_SUFFIXES))))
    parsed = one.filter("status = 'parsed'").select("document_id", F.lit(1).alias("page_number"), "text")
    no = F.lit(False)
    text = one.withColumns({"empty_page_count": F.when(F.col("failure_reason") == "empty_extraction", 1).otherwise(0), "native_text_extracted": F.col("status") == "parsed", "likely_scanned": no, "likely_needs_ocr": no, "ocr_applied": no})
    metas, tables = [text.select(*META)], [parsed]
    for suffix in paged:
        own = load(suffixes=suffix)
        meta, pages = ocr_fallback(*parse_paged(own, suffix), ocr or ocr_adapter())
        failed = F.col("quality") == "unusable"
        named = own.select("document_id", "filename").join(meta, "document_id").withColumns(
            {
                "file_suffix": F.lit(suffix),
                "parse_strategy": F.when(F.col("ocr_applied"), "ocr").otherwise("page_reader"),
                "status": F.when(failed, "failed").otherwise("parsed"),
            }
        )
        metas.append(named.select(*META))
        tables.append(pages.join(named.filter("status = 'parsed'").select("document_id"), "document_id", "left_semi").select("document_id", F.col("page_number").cast("int"), "text"))
    rest = load(without=",".join((*TEXT_SUFFIXES, *paged)), content=False)
    metas.append(
        rest.select(
            "document_id", "filename", file_suffix(F.col("filename")).alias("file_suffix"), F.lit("").alias("parse_strategy"), F.lit("unsupported_file_type").alias("failure_reason"), F.lit("unusable").alias("quality"),
            *[F.lit(0).alias(c) for c in ("page_count", "empty_page_count", "total_chars")], F.lit(0.0).alias("text_density"),
            *[F.lit(False).alias(c) for c in ("native_text_extracted", "likely_scanned", "likely_needs_ocr", "ocr_applied")], F.lit("failed").alias("status"),
        )
    )
    types = {"page_count": "long", "empty_page_count": "long", "total_chars": "long"}
    meta, pages = None, None
    for m, t in zip(metas, [*tables, None]):
        m = m.select(*[F.col(c).cast(types[c]) if c in types else F.col(c) for c in META])
        meta = m if meta is None else meta.unionByName(m)
        pages = t if pages is None else pages if t is None else pages.unionByName(t)
    return meta, pages
