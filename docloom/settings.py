"""Settings of the library, read from the session: ``spark.docloom.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from docloom.operators.chunking import ChunkConfig
from docloom.operators.models import CallPolicy


@dataclass(frozen=True)
class Settings:
    """Defaults; a session's value replaces one, in the type of its default."""

    storage_dir: str = "storage"
    chunk_size: int = 800
    chunk_overlap: int = 200
    max_llm_chunks: int = 10
    llm_provider: str = ""
    llm_model: str = ""
    llm_timeout_s: float = 20.0
    llm_max_retries: int = 1
    llm_retry_backoff_ms: int = 250
    embedding_dim: int = 64
    debug: bool = False


def load_settings(spark: SparkSession) -> Settings:
    """The settings of a session; a value that does not fit its type is an error that names it."""
    found = {}
    for f in fields(Settings):
        key = f"spark.docloom.{f.name}"
        said = spark.conf.get(key, None)
        if said is None:
            continue
        kind = type(f.default)
        try:
            found[f.name] = {"true": True, "false": False}[said.lower()] if kind is bool else kind(said)
        except (KeyError, ValueError):
            raise ValueError(f"{key}: {said!r} is no {kind.__name__}") from None
    return Settings(**found)


def chunk_config(spark: SparkSession) -> ChunkConfig:
    """How documents are cut where a run does not say."""
    held = load_settings(spark)
    return ChunkConfig(chunk_size=held.chunk_size, overlap=held.chunk_overlap)


def call_policy(spark: SparkSession) -> CallPolicy:
    """How models are called where a run does not say."""
    held = load_settings(spark)
    return CallPolicy(retries=held.llm_max_retries, timeout_s=held.llm_timeout_s, backoff_ms=held.llm_retry_backoff_ms, provider=held.llm_provider, model=held.llm_model)
