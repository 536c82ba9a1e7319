"""Model calls: hooks over prompt rows, and a store of answers that survives lost executors.

A hook is a function from prompt rows to (document_id, response) rows, or a table of
recorded responses. Calls of a batch run together, bounded, each with its own time limit
and retries. With a store, equal prompts are called once, ever: prompts are told by the
digest of model, system and user prompt, those that the store knows are never sent, and
each task files its answers batch by batch, so that what runs again after a failure calls
the model for the unfinished batch alone.
"""

from __future__ import annotations

import hashlib
import heapq
import inspect
import io
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ops import RETRYABLE
from docloom.sources.settled import settle

Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CallPolicy:
    """How a model is called: a time limit, retries of errors that may pass, a growing pause between them."""

    retries: int = 1
    timeout_s: float = 20.0
    backoff_ms: int = 250
    provider: str = ""
    model: str = ""
    #: Whether errors that are not likely to pass are tried again too.
    retry_all: bool = True
    #: Calls in flight in a task, and the prompts that it files together.
    parallel: int = 8
    batch: int = 64


def _retryable(message: str) -> bool:
    low = message.lower()
    return any(m in low for m in RETRYABLE)


def _told(complete: Callable) -> Callable[[str, str], str]:
    """A function of (system, user); a function of one argument is given the user prompt alone."""
    named = [p for p in inspect.signature(complete).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]
    return complete if len(named) > 1 else lambda system, user: complete(user)


def answers(complete: Callable[[str, str], str], prompts: list[tuple[str, str]], policy: CallPolicy) -> list[tuple]:
    """(response, attempts, error, retryable, latency_ms) of each (system, user) prompt, in order.

    At most ``policy.parallel`` calls are in flight. A call over its time is given up and its
    late answer dropped; threads are daemons, so one that hangs does not hold its worker.
    Pauses before a retry hold up no other call.
    """
    done: queue.Queue = queue.Queue()
    waiting = [(0.0, i, 1) for i in range(len(prompts))]  # (not before, prompt, attempt)
    heapq.heapify(waiting)
    flying: dict[tuple[int, int], float] = {}
    began: dict[int, float] = {}
    out: list[tuple | None] = [None] * len(prompts)

    def call(i: int, attempt: int) -> None:
        try:
            said = complete(*prompts[i]), None
        except Exception as e:  # the provider's error is the row's result
            said = None, f"{type(e).__name__}: {e}"
        done.put((i, attempt, *said))

    def settle_one(i: int, attempt: int, response: str | None, error: str | None) -> None:
        now = time.monotonic()
        again = error is not None and _retryable(error)
        if error is not None and attempt <= policy.retries and (again or policy.retry_all):
            heapq.heappush(waiting, (now + policy.backoff_ms * attempt / 1000, i, attempt + 1))
        else:
            out[i] = (response, attempt, error and error[:200], again, int((now - began[i]) * 1000))

    while any(x is None for x in out):
        now = time.monotonic()
        while waiting and len(flying) < policy.parallel and waiting[0][0] <= now:
            _, i, attempt = heapq.heappop(waiting)
            began.setdefault(i, now)
            flying[i, attempt] = now + policy.timeout_s
            threading.Thread(target=call, args=(i, attempt), daemon=True).start()
        soonest = [*flying.values(), *([waiting[0][0]] if waiting and len(flying) < policy.parallel else [])]
        try:
            i, attempt, response, error = done.get(timeout=max(min(soonest) - time.monotonic(), 0.001))
            if flying.pop((i, attempt), None) is not None:
                settle_one(i, attempt, response, error)
        except queue.Empty:
            now = time.monotonic()
            for i, attempt in [k for k, until in flying.items() if until <= now]:
                del flying[i, attempt]
                settle_one(i, attempt, None, "TimeoutError: timed out")
    return out


_ANSWER = "response string, attempts int, error string, retryable boolean, latency_ms long, provider string, model string"
_NAMES = ["response", "attempts", "error", "retryable", "latency_ms", "provider", "model"]


def _asked(prompts: DataFrame) -> DataFrame:
    """(document_id, model, system_prompt, user_prompt); what a table of prompts lacks is empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in prompts.columns else F.lit("")
    return prompts.select("document_id", text("model").alias("model"), text("system_prompt").alias("system_prompt"), text("user_prompt").alias("user_prompt"))


def model_hook(complete: Callable, retries: int | None = None, policy: CallPolicy | None = None) -> Model:
    """A hook from a plain function of (system, user), or of the user prompt alone.

    Rows: document_id, response, attempts, error, retryable, latency_ms, provider, model (the
    row's own, else the policy's). Failures are rows with a typed error. Without a policy the
    session's settings hold.
    """
    told = _told(complete)

    def ask(prompts: DataFrame) -> DataFrame:
        from docloom.settings import call_policy  # it builds on this module

        held = policy or call_policy(prompts.sparkSession)
        return _called(prompts, told, held if retries is None else replace(held, retries=retries))

    return ask


def _called(prompts: DataFrame, told: Callable[[str, str], str], policy: CallPolicy) -> DataFrame:
    """The answers of a function to prompt rows."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), policy.batch):
                part = batch.iloc[at : at + policy.batch]
                got = answers(told, list(zip(part["system_prompt"], part["user_prompt"])), policy)
                rows = [(i, *a, policy.provider, m or policy.model) for i, m, a in zip(part["document_id"], part["model"], got)]
                yield pd.DataFrame(rows, columns=["document_id", *_NAMES])

    return _asked(prompts).mapInPandas(call, f"document_id string, {_ANSWER}")


def prompt_digest(model: Column, system: Column, user: Column) -> Column:
    """The SHA-256 by which a prompt is known; parts are told apart by their lengths."""
    sized = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (model, system, user)]
    return F.sha2(F.concat(*sized), 256)


class ResponseStore:
    """Answers by prompt digest, as Parquet files in a folder that all executors share.

    A file holds the answers of one batch of one task. It is written under another name and
    then moved, so it is whole or not there, and a batch that is run again finds it. Files
    are only ever added; ``compact`` joins them.
    """

    SCHEMA = f"digest string, {_ANSWER}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        """One answer of each prompt; failures are never kept."""
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(at).type != pyarrow.fs.FileType.Directory or not any(x.path.endswith(".parquet") for x in fs.get_file_info(pyarrow.fs.FileSelector(at))):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/*.parquet").dropDuplicates(["digest"])

    def hook(self, complete: Callable, policy: CallPolicy = CallPolicy()) -> Model:
        """A hook that asks the store first and the function for what is missing, each prompt once."""
        told = _told(complete)
        path = self.path
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(at, recursive=True)

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, folder = pyarrow.fs.FileSystem.from_uri(path)
            for batch in batches:
                for at in range(0, len(batch), policy.batch):
                    part = batch.iloc[at : at + policy.batch]
                    name = f"{folder}/{hashlib.sha256(''.join(part['digest']).encode()).hexdigest()}.parquet"
                    if files.get_file_info(name).type == pyarrow.fs.FileType.File:  # an earlier try came so far
                        with files.open_input_file(name) as f:
                            kept = pq.read_table(pa.BufferReader(f.read())).to_pandas()
                        part = part[~part["digest"].isin(kept["digest"])]
                        name = f"{folder}/{uuid.uuid4().hex}.parquet"
                        yield kept[["digest", *_NAMES]]
                    if not len(part):
                        continue
                    got = answers(told, list(zip(part["system_prompt"], part["user_prompt"])), policy)
                    rows = [(d, *a, policy.provider, m or policy.model) for d, m, a in zip(part["digest"], part["model"], got)]
                    found = pd.DataFrame(rows, columns=["digest", *_NAMES])
                    good = found[found["error"].isna()]
                    if len(good):
                        _file(files, name, good)
                    yield found

        def ask(prompts: DataFrame) -> DataFrame:
            keyed = settle(_asked(prompts).withColumn("digest", prompt_digest(F.col("model"), F.col("system_prompt"), F.col("user_prompt"))), "prompts")
            known = self.table()
            missing = keyed.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti").select("digest", "model", "system_prompt", "user_prompt")
            # Written and sorted, so that a task which is run again has the same batches.
            missing = settle(missing.repartition("digest").sortWithinPartitions("digest"), "missing")
            fresh = settle(missing.mapInPandas(call, self.SCHEMA), "answers")
            return keyed.select("document_id", "digest").join(known.unionByName(fresh), "digest").drop("digest")

        return ask

    def compact(self) -> None:
        """Join all files into few; run it while no hook does."""
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        old = [x.path for x in files.get_file_info(pyarrow.fs.FileSelector(folder)) if x.path.endswith(".parquet")]
        if not old:
            return
        whole = settle(self.table(), "compacted")
        whole.write.mode("append").parquet(self.path)
        for name in old:
            files.delete_file(name)


def _file(files: pyarrow.fs.FileSystem, name: str, rows: pd.DataFrame) -> None:
    """Write a batch's answers whole: under another name first, then moved."""
    schema = pa.schema([("digest", pa.string()), ("response", pa.string()), ("attempts", pa.int32()), ("error", pa.string()), ("retryable", pa.bool_()), ("latency_ms", pa.int64()), ("provider", pa.string()), ("model", pa.string())])
    sink = io.BytesIO()
    pq.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False), sink)
    own = f"{name}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(own) as out:
        out.write(sink.getvalue())
    files.move(own, name)


def provider_calls(responses: DataFrame) -> DataFrame:
    """The calls of a hook as rows of the operational metrics."""
    return responses.select("document_id", "provider", "model", "latency_ms", F.col("error").isNull().alias("success"), "retryable", F.col("error").alias("message"))


def degraded_responses(responses: DataFrame) -> DataFrame:
    """Typed answers for the documents whose call failed: nothing is summarised, and a person is asked.

    (document_id, status, summary_text, review_recommended, retryable, attempts, provider, model, message)
    """
    failed = responses.filter(F.col("error").isNotNull())
    status = F.when(F.col("retryable"), "provider_unavailable").otherwise("provider_error")
    return failed.select(
        "document_id", status.alias("status"), F.lit("").alias("summary_text"), F.lit(True).alias("review_recommended"), "retryable", "attempts", "provider", "model", F.col("error").alias("message")
    )


def recorded(responses: DataFrame) -> Model:
    """A hook that looks responses up in a table: by digest, where it has one, else by document."""
    if "digest" in responses.columns:
        keyed = lambda prompts: _asked(prompts).select("document_id", prompt_digest(F.col("model"), F.col("system_prompt"), F.col("user_prompt")).alias("digest"))
        return lambda prompts: keyed(prompts).join(responses, "digest", "left").drop("digest")
    return lambda prompts: prompts.select("document_id").join(responses, "document_id", "left")
