"""Chunk rankers, the vector index and rank fusion.

Every ranker works inside a document over any number of documents: scores are columns,
ranks a window over (document_id), which Spark turns into a group limit when only the
best are kept. Ties keep chunk order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import cosine, hash_embedding, query_terms, term_share

# Sections that weigh more.
HIGH_VALUE_SECTIONS = ("summary", "conclusion", "findings", "recommendations", "diagnosis", "treatment plan", "billing summary", "damage assessment")
RRF_K = 60


def ranked(scored: DataFrame, top_k: int | None, score: str = "score", tie: str = "chunk_index") -> DataFrame:
    """Add rank from 1 inside each document, and keep the best ``top_k``."""
    order = Window.partitionBy("document_id").orderBy(F.desc(score), tie)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def lexical_score(text: Column, query: str) -> Column:
    """Share of the query's terms found as substrings; 0 for an empty query."""
    terms = query_terms(query)
    return F.round(term_share(text, terms), 4) if terms else F.lit(0.0)


def rank_lexical(chunks: DataFrame, query: str, top_k: int | None = 10) -> DataFrame:
    return ranked(chunks.withColumn("score", lexical_score(F.col("text"), query)), top_k)


def salience_score(query: str | Column, total: Column) -> Column:
    """Position, section, parse quality and query overlap; peaks in a document's middle.

    The query is a text, or an array column of its terms.
    """
    index = F.col("chunk_index")
    place = index / F.greatest(total - 1, F.lit(1))
    score = (
        F.lit(0.2) * (1 - F.abs(2 * place - 1))
        + F.when(index < 3, 0.15).otherwise(0.0)
        + F.when(index >= total - 3, 0.10).otherwise(0.0)
        + F.when(F.lower("section_label").isin(*HIGH_VALUE_SECTIONS), 0.25).otherwise(0.0)
        - F.when(F.col("parse_quality") == "degraded", 0.1).when(F.col("parse_quality") == "unusable", 0.3).otherwise(0.0)
    )
    terms = query if isinstance(query, Column) else query_terms(query)
    if isinstance(query, Column) or terms:
        score = score + F.lit(0.3) * term_share(F.col("text"), terms)
    return F.round(F.greatest(score, F.lit(0.0)), 4)


def rank_salience(chunks: DataFrame, query: str, top_k: int | None = 10) -> DataFrame:
    """Chunks by salience; see ``salience_score``."""
    with_total = chunks.withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    return ranked(with_total.withColumn("score", salience_score(query, F.col("_total"))).drop("_total"), top_k)


#: An embedder turns a text column into an array of doubles; texts of any table, in one plan.
Embedder = Callable[[Column], Column]


def hashed(dim: int = 64) -> Embedder:
    """The deterministic embedder that needs no model."""
    return lambda text: hash_embedding(text, dim)


def embedder(embed: Callable[[list[str]], list[list[float]]]) -> Embedder:
    """An embedder from a plain function over a batch of texts, called once an Arrow batch."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return vectors


def embed_chunks(chunks: DataFrame, dim: int = 64, embed: Embedder | None = None) -> DataFrame:
    """(document_id, chunk_id, chunk_index, vector) by an embedder, the hashed one if none is given."""
    return chunks.select("document_id", "chunk_id", "chunk_index", (embed or hashed(dim))(F.col("text")).alias("vector"))


def vector_index(entries: DataFrame) -> DataFrame:
    """An index keeps the first vector of an id; ``position`` gives the order of arrival."""
    return entries.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "chunk_id"]), "position").alias("e")).select("chunk_id", "e.*")


def vector_search(index: DataFrame, vector: list[float], top_k: int = 10, tie: str = "position") -> DataFrame:
    """The ``top_k`` nearest entries of the whole index by cosine: a scan and one top-k."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return index.withColumn("score", cosine(F.col("vector"), query)).orderBy(F.desc("score"), tie).limit(top_k)


def rank_vector(chunks: DataFrame, query: str, top_k: int | None = 10, dim: int = 64, embed: Embedder | None = None) -> DataFrame:
    """Cosine to the query's vector inside each document; 0 for an empty query."""
    of = embed or hashed(dim)
    score = F.round(cosine(of(F.col("text")), of(F.lit(query))), 4) if query else F.lit(0.0)
    return ranked(chunks.withColumn("score", score), top_k)


def rank_embedded(chunks: DataFrame, query: str, top_k: int | None = 10, embed: Embedder | None = None) -> DataFrame:
    """The vector ranking by a configured embedder; without one there is nothing to rank by."""
    if embed is None:
        raise ValueError("no embedder is configured")
    return rank_vector(chunks, query, top_k, embed=embed)


def index_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked hits of an index beside their chunks; hits whose chunk is not there are dropped.

    ``hits`` has chunk_id and score; ranks follow the hits' order, with gaps where one was dropped.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_id"))  # a top-k: few rows
    return hits.select("chunk_id", "score", place.alias("rank")).join(chunks, "chunk_id")


Reranker = Callable[[DataFrame, str, int], DataFrame]
_RERANKERS: dict[str, Reranker] = {}


def register_reranker(name: str, reranker: Reranker) -> None:
    """``reranker(results, query, top_k)`` returns ranked rows."""
    _RERANKERS[name] = reranker


def rerank(results: DataFrame, query: str, top_k: int = 10, name: str = "score") -> DataFrame:
    """Rerank by a registered reranker. No pair model is bundled: ``cross_encoder`` raises until one is registered."""
    if name not in _RERANKERS:
        raise NotImplementedError(f"no reranker is registered as {name}")
    return _RERANKERS[name](results, query, top_k)


def fuse(lists: list[tuple[str, DataFrame]], top_k: int | None = 10, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ties go to the first list that has the chunk."""
    parts = [d.select("document_id", "chunk_id", F.lit(i).alias("list"), "rank") for i, (_, d) in enumerate(lists)]
    joined = reduce(DataFrame.unionByName, parts)
    fused = joined.groupBy("document_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "first")
    out = fused.withColumn("rank", F.row_number().over(order)).drop("first")
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def rerank_by_score(results: DataFrame, top_k: int = 10) -> DataFrame:
    """Sort a ranked list by its scores again; equal scores keep their rank order."""
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "rank")
    return results.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_k).drop("rank").withColumnRenamed("_r", "rank")


register_reranker("score", lambda results, query, top_k: rerank_by_score(results, top_k))


SIGNALS = ("lexical", "vector", "salience")


def fuse_signals(chunks: DataFrame, query: str, signals: tuple[str, ...] = SIGNALS, wide: int = 30, dim: int = 64, k: int = RRF_K) -> DataFrame:
    """The chunks that any signal has among its first ``wide``, with (score, rank) of each and of the fusion.

    Equal to ``fuse`` of the single rankings, on one scan: all scores are columns of the same
    rows, all ranks windows of one partitioning. Columns are ``<signal>_score``, ``<signal>_rank``
    (null beyond ``wide``), ``score`` and ``rank``.
    """
    whole = Window.partitionBy("document_id")
    out = chunks.withColumn("_total", F.count(F.lit(1)).over(whole))
    of = hashed(dim)
    score = {
        "lexical": lambda: lexical_score(F.col("text"), query),
        "vector": lambda: F.round(cosine(of(F.col("text")), of(F.lit(query))), 4) if query else F.lit(0.0),
        "salience": lambda: salience_score(query, F.col("_total")),
    }
    out = out.withColumns({f"{s}_score": score[s]() for s in signals})
    out = out.withColumns({f"{s}_rank": F.row_number().over(whole.orderBy(F.desc(f"{s}_score"), "chunk_index")) for s in signals})
    out = out.withColumns({f"{s}_rank": F.when(F.col(f"{s}_rank") <= wide, F.col(f"{s}_rank")) for s in signals})
    out = out.filter(F.coalesce(*[F.col(f"{s}_rank") for s in signals]).isNotNull())
    total = sum((F.coalesce(1.0 / (F.lit(k) + F.col(f"{s}_rank")), F.lit(0.0)) for s in signals), F.lit(0.0))
    first = F.coalesce(*[F.when(F.col(f"{s}_rank").isNotNull(), F.struct(F.lit(i).alias("list"), F.col(f"{s}_rank").alias("rank"))) for i, s in enumerate(signals)])
    out = out.withColumns({"score": F.round(total, 6), "_first": first})
    return out.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "_first"))).drop("_first", "_total")


def retrieve_hybrid(chunks: DataFrame, query: str, top_k: int = 10, candidate_multiplier: int = 3, dim: int = 64) -> DataFrame:
    """Lexical, vector and salience candidates, fused. Long form with a ``signal`` column.

    Each signal gives ``candidate_multiplier`` times ``top_k`` candidates to the fusion.
    """
    rows = fuse_signals(chunks, query, SIGNALS, top_k * candidate_multiplier, dim)
    named = [(s, F.col(f"{s}_rank"), F.col(f"{s}_score")) for s in SIGNALS] + [("fused", F.col("rank"), F.col("score"))]
    hits = [F.when(rank <= top_k, F.struct(F.lit(name).alias("signal"), rank.alias("rank"), score.alias("score"))) for name, rank, score in named]
    return rows.select("document_id", "chunk_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("document_id", "h.signal", "chunk_id", "h.rank", "h.score")


def search(chunks: DataFrame, query: str, ranker: str = "salience", top_k: int = 10) -> DataFrame:
    """The search entry: lexical or salience ranking, at most 50 results a document."""
    if ranker not in ("lexical", "salience") or not 1 <= top_k <= 50:
        raise ValueError("ranker must be lexical or salience, top_k between 1 and 50")
    return (rank_lexical if ranker == "lexical" else rank_salience)(chunks, query, top_k)
