"""Metrics of stages from the engine: counted by the action that writes a stage, not by another one."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.operators.parsing import HARD_FAILURES
from docloom.sources.settled import settle

#: Kinds of failure that a stage counts one by one; others are counted together.
KINDS = (*HARD_FAILURES, "zero_text_pdf")


@dataclass
class Stages:
    """Writes the tables of a run and notes rows, failures, bytes and time of each, in order.

    The figures are observed in the tasks that write the table. The time is the action's, so it
    holds what the table is made of since the last one that was written.
    """

    spark: SparkSession
    rows: list[tuple] = field(default_factory=list)

    def keep(self, df: DataFrame, name: str, failures: str | None = None, size: Column | None = None) -> DataFrame:
        """Write ``df`` and return it read back; ``failures`` names its column of kinds, ``none`` for none."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        kind = F.coalesce(F.col(failures), F.lit("none")) if failures else F.lit("none")
        counts = [F.count_if(kind == k).alias(f"k{i}") for i, k in enumerate(KINDS)]
        total = F.coalesce(F.sum(size), F.lit(0)).cast("long") if size is not None else F.max(F.lit(None).cast("long"))
        began = time.monotonic()
        out = settle(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(kind != "none").alias("failed"), total.alias("bytes"), *counts), name)
        took = int((time.monotonic() - began) * 1000)
        got = seen.get
        kinds = {k: got[f"k{i}"] for i, k in enumerate(KINDS) if got[f"k{i}"]}
        other = got["failed"] - sum(kinds.values())
        self.rows.append((len(self.rows) + 1, name, got["rows"], got["failed"], kinds | ({"other": other} if other else {}), got["bytes"], took))
        return out

    def table(self) -> DataFrame:
        """(position, stage, rows, failed, failures, bytes, duration_ms) of the stages so far."""
        return self.spark.createDataFrame(self.rows, "position int, stage string, rows long, failed long, failures map<string, long>, bytes long, duration_ms long")


def kept(stages: Stages | None, df: DataFrame, name: str, failures: str | None = None, size: Column | None = None) -> DataFrame:
    """``df`` as a stage of a run, or as it is where none is noted."""
    return df if stages is None else stages.keep(df, name, failures, size)
