"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are dealt by ranges of their key and sorted inside each range. The ranges' totals,
one row a range, give each range its offset, and a running sum inside the range gives each
row its place: global prefix sums without a global sort or a single-task window over rows.
The line of all bytes is cut at equal targets: a row goes to the shard in which its middle
byte falls, so shards are contiguous in key order and no shard's size is further from the
target than one row's size.

Only (key, size, checksum) move; texts stay where they are. Rows with equal keys are
ordered by the checksum and the size of their text, rows that agree in all three by a number
of their own, so a key that many rows share, or one row many times, is cut like any run of
rows. Keys may be numbers, dates or strings. Null key: first in the order. Null text: size
``overhead`` alone. Empty table: empty result. Further columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import Workspace


def prefix_sums(rows: DataFrame, key: str, sizes: list[str], ranges: int, ties: tuple[str, ...] = (), ws: Workspace | None = None) -> DataFrame:
    """Add, for each column of ``sizes``, ``before_<size>`` (its sum over all earlier rows) and ``all_<size>``."""
    ws = ws or Workspace(rows.sparkSession, "sums")
    order = [F.col(key).asc_nulls_first(), *ties, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # A row's number tells its range and its place there.
    dealt = ws.save(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftrightunsigned("_at", 33))
    totals = dealt.groupBy("_range").agg(*[F.sum(s).alias(f"_{s}") for s in sizes])
    # One row a range: their number is a parameter, so these windows are bounded.
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_{s}").over(running), F.lit(0)).alias(f"_offset_{s}") for s in sizes],
        *[F.sum(f"_{s}").over(every).alias(f"all_{s}") for s in sizes],
    )
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(offsets), "_range")
        .select("*", *[(F.col(f"_offset_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sizes])
        .drop("_at", "_range", *[f"_offset_{s}" for s in sizes])
    )


def byte_shards(
    docs: DataFrame,
    shards: int = 24,
    overhead: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; ``slot`` counts from 0 inside
    a shard, in key order. ``buckets`` are the ranges that rows are dealt to.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    # The one pass over the texts; what follows reads this narrow table.
    rows = ws.save(docs.select(
        F.col(id_col).alias("key"),
        (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    ), "sizes")
    placed = prefix_sums(rows, "key", ["size", "one"], buckets, ("text_crc32", "size"), ws)
    shard = F.least(F.expr(f"cast((before_size * 2 + size) * {shards} div (all_size * 2) as int)"), F.lit(shards - 1))
    placed = placed.withColumn("shard", shard)
    # The rows before a shard's first one: one row a shard.
    first = placed.groupBy("shard").agg(F.min("before_one").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(id_col), "size", "text_crc32", "shard", (F.col("before_one") - F.col("first")).alias("slot")
    )
