"""Places of rows in the order of their group, without a group in one task.

Rows are dealt by ranges of (group, order, own number) and sorted inside each range; the
own number splits rows that agree in all else. One count for each group in a range, at
most ranges plus groups of them, gives each range its offset in the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import Workspace

#: Counts of groups in ranges up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_COUNTS = 200_000


def placed(rows: DataFrame, group: str, order: list[Column], ws: Workspace, name: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the group from 0, and ``n``, the group's rows.

    Groups are not null. Rows that agree in group and order stand in any order.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie")
    sorted_ = ranged.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    table = ws.save(sorted_, name).withColumn("_range", F.shiftrightunsigned("_at", 33))
    counts = table.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n")
    )
    counts = ws.save(counts, f"{name}-counts")
    few = counts.count() <= BROADCAST_COUNTS
    met = table.join(F.broadcast(counts) if few else counts, [group, "_range"])
    return met.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "n")
