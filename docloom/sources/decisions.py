"""Review decisions as an append-only log with snapshots, and as a stateful stream.

A document's status is its newest decision: by time, then by the decision's id. That is a
maximum, so decisions may come late, twice and in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "decision_id string, document_id string, decision string, reviewer string, decided_at timestamp"
_COLUMNS = ("decision_id", "document_id", "decision", "reviewer", "decided_at")


def newest(decisions: DataFrame) -> DataFrame:
    """The decision that counts for each document."""
    rest = [c for c in _COLUMNS if c != "document_id"]
    best = F.max_by(F.struct(*rest), F.struct("decided_at", "decision_id"))
    return decisions.groupBy("document_id").agg(best.alias("d")).select("document_id", "d.*").select(*_COLUMNS)


class DecisionLog:
    """Decisions below a folder: parts that are only ever added, and a snapshot that bounds them.

    A snapshot holds the newest decision of each document and takes the place of the parts that
    it was made of; it is written before they go, and what is in both counts once. One writer
    of snapshots at a time; any number that append.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[str]:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(sc._jsc.hadoopConfiguration())
        found = sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []
        done = [p for p in found if files.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}/_SUCCESS"))]
        return [f"{self.path}/{p}" for p in done]

    def append(self, decisions: DataFrame) -> None:
        """Add (document_id, decision, reviewer, decided_at) rows; one without ``decision_id`` is given one."""
        if "decision_id" not in decisions.columns:
            decisions = decisions.withColumn("decision_id", F.uuid())
        types = dict(x.strip().split(" ") for x in SCHEMA.split(","))
        decisions.select(*[F.col(c).cast(types[c]).alias(c) for c in _COLUMNS]).write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")

    def table(self) -> DataFrame:
        """All decisions that are kept, each once."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*parts).dropDuplicates(["decision_id"])

    def current(self, queue: DataFrame) -> DataFrame:
        """The queue with the status that the decisions give."""
        last = newest(self.table()).select("document_id", "decision")
        return queue.join(last, "document_id", "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")

    def snapshot(self) -> None:
        """Replace all parts by the newest decision of each document."""
        parts = self._parts()
        if not parts:
            return
        newest(self.table()).write.parquet(f"{self.path}/snapshot-{uuid.uuid4().hex}")
        sc = self.spark.sparkContext
        for part in parts:
            at = sc._jvm.org.apache.hadoop.fs.Path(part)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def stream(self) -> DataFrame:
        """The log's parts as a stream of decisions."""
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/part-*")


def status_stream(decisions: DataFrame) -> DataFrame:
    """Updates (document_id, decision, reviewer, decided_at, decision_id) of a stream of decisions.

    Extension: the state of a document is the decision that counts so far; a row comes out when
    a decision takes its place, so the last row of a document is its status, whatever the order
    in which decisions came. Written in update mode.
    """
    schema = "document_id string, decision string, reviewer string, decided_at timestamp, decision_id string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for batch in batches:
            for d in batch.itertuples(index=False):
                now = (int(d.micros), d.decision_id, d.decision, d.reviewer)
                if best is None or now[:2] > best[:2]:
                    best = now
        if best is not None and best != held:
            state.update(best)
            yield pd.DataFrame([(key[0], best[2], best[3], pd.Timestamp(best[0], unit="us"), best[1])], columns=["document_id", "decision", "reviewer", "decided_at", "decision_id"])

    rows = decisions.filter("document_id is not null and decided_at is not null").select("document_id", F.unix_micros("decided_at").alias("micros"), F.coalesce("decision_id", F.lit("")).alias("decision_id"), "decision", "reviewer")
    return rows.groupBy("document_id").applyInPandasWithState(fold, schema, "micros long, decision_id string, decision string, reviewer string", "update", GroupStateTimeout.NoTimeout)
