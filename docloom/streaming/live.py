"""Stateless document operators and windowed counters over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.parsing import OcrAdapter, parse_files, parse_text_files
from docloom.operators.routing import route


def route_stream(files: DataFrame) -> DataFrame:
    """Parse and route a stream of text files; one page a file, so nothing is gathered."""
    parsed = parse_text_files(files).filter("status = 'parsed'")
    return route(parsed.select("document_id", "filename", F.col("text").alias("sample")))


def ingest_stream(files: DataFrame, folder: str, checkpoint: str, ocr: OcrAdapter | None = None) -> StreamingQuery:
    """Parse a stream of files (``documents.stream_files``) into ``folder``/documents and ``folder``/pages, and stop when all are read.

    Every batch has a folder of its own, which a batch that runs again writes anew, so what
    is read back has each file once.
    """

    def one(batch: DataFrame, number: int) -> None:
        meta, pages = parse_files(batch.persist(), ocr)
        meta.write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
        pages.write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")
        batch.unpersist()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts and value sums by type and window; events later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
