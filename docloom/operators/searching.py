"""Search with many queries at once: lexical rankings for query rows, and a stored vector index.

Queries asked of one document meet its chunks by a join. Queries asked of all documents are
taken in blocks of BLOCK_QUERIES: one automaton over a block's terms is sent to all tasks and
reads each text once, whatever the number of queries; a task keeps the best chunks of each
(query, document) that it has seen, so what is shuffled is bounded by the answer. Vectors
are met in the same way: a block of queries is one matrix, a batch of entries another, and
their product leaves the best of each query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.ranking import salience_score
from docloom.functions.scalars import terms_of, term_share
from docloom.sources.settled import settle

#: Queries that one pass over the chunks, or the vectors, answers.
BLOCK_QUERIES = 4096
#: Rows of a document that are scored against a block together.
ROWS = 1024
#: Decimals by which scores of vectors are compared.
DECIMALS = 9


def _blocks(queries: DataFrame, size: int) -> Iterator[DataFrame]:
    """The queries in blocks of about ``size`` rows, by a hash of their id."""
    n = queries.count()
    parts = -(-n // size)
    for k in range(parts):
        yield queries.filter(F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(parts)) == k) if parts > 1 else queries


def rank_queries(chunks: DataFrame, queries: DataFrame, top_k: int = 10, ranker: str = "lexical", found_only: bool = False, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, document_id, chunk_id, chunk_index, score, rank): each query's best chunks in each of its documents.

    ``queries`` has query_id and query, and may have document_id: a query with one is asked of
    that document, others of all. Scores and ranks are those of ``rank_lexical`` and (for queries
    of one document) ``rank_salience``; with ``found_only`` chunks without any of a query's terms
    are left out. Query ids are unique; a query without terms scores 0 everywhere.
    """
    if ranker not in ("lexical", "salience"):
        raise ValueError("ranker must be lexical or salience")
    asked = queries if "document_id" in queries.columns else queries.withColumn("document_id", F.lit(None).cast("string"))
    asked = settle(asked.select("query_id", "document_id", terms_of(F.col("query")).alias("terms")), "queries")
    parts = []
    everywhere = asked.filter("document_id is null").drop("document_id")
    if not everywhere.isEmpty():
        if ranker != "lexical":
            raise ValueError("queries of all documents are ranked lexically")
        parts += [_rank_everywhere(chunks, some, top_k, found_only) for some in _blocks(everywhere, block)]
    own = asked.filter("document_id is not null")
    share = term_share(F.col("text"), F.col("terms"))
    if ranker == "lexical":
        scored = chunks.join(own, "document_id").withColumn("score", F.round(share, 4))
    else:
        total = chunks.withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
        scored = total.join(own, "document_id").withColumn("score", salience_score(F.col("terms"), F.col("_total")))
    if found_only:
        scored = scored.filter(share > 0)
    parts.append(scored.select("query_id", "document_id", "chunk_id", "chunk_index", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_index")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def _rank_everywhere(chunks: DataFrame, queries: DataFrame, top_k: int, found_only: bool) -> DataFrame:
    """The chunks of each (query, document) that can be among its best, by one scan of the texts."""
    rows = queries.select("query_id", "terms").collect()  # a block
    ids = pa.array([r.query_id for r in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(queries.schema["query_id"].dataType.simpleString(), pa.string()))
    terms = sorted({t for r in rows for t in r.terms})
    place = {t: i for i, t in enumerate(terms)}
    of = np.concatenate([np.full(len(r.terms), k) for k, r in enumerate(rows)]).astype(np.int64)
    which = np.array([place[t] for r in rows for t in r.terms], np.int64)
    order = np.argsort(which, kind="stable")
    holders, starts = of[order], np.searchsorted(which[order], np.arange(len(terms) + 1))
    sent = chunks.sparkSession.sparkContext.broadcast((ids, terms, holders, starts, np.array([max(len(r.terms), 1) for r in rows])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids, terms, holders, starts, sizes = sent.value
        machine = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            machine.add_word(t, i)
        machine.make_automaton()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            docs = batch.column(0).to_pylist()
            index = batch.column(2).to_numpy()
            at = 0
            while at < len(docs):
                end = at + 1
                while end < min(len(docs), at + ROWS) and docs[end] == docs[at]:
                    end += 1
                hits = np.zeros((end - at, len(ids)), np.int32)
                for k in range(at, end):
                    seen = {i for _, i in machine.iter(texts[k] or "")} if terms else ()
                    for i in seen:
                        hits[k - at, holders[starts[i] : starts[i + 1]]] += 1
                score = (hits.astype(np.int64) * 20000 + sizes) // (2 * sizes)  # ten-thousandths, half up
                first = np.lexsort((np.broadcast_to(index[at:end, None], score.shape), -score), axis=0)[:top_k]
                row, query = first.ravel(), np.tile(np.arange(len(ids)), len(first))
                if found_only:
                    some = hits[row, query] > 0
                    row, query = row[some], query[some]
                if len(row):
                    own = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(query)), batch.column(0).take(own), batch.column(1).take(own), batch.column(2).take(own), pa.array(score[row, query] / 10000.0)],
                        names=["query_id", "document_id", "chunk_id", "chunk_index", "score"],
                    )
                at = end

    kind = {"bigint": "long", "int": "int"}.get(queries.schema["query_id"].dataType.simpleString(), "string")
    schema = f"query_id {kind}, document_id string, chunk_id string, chunk_index int, score double"
    return chunks.select("document_id", "chunk_id", F.col("chunk_index").cast("int"), F.lower("text").alias("text")).mapInArrow(scan, schema)


class VectorIndex:
    """Vectors by id in a folder: Parquet parts that are only ever added, until ``clear``.

    The first vector of an id wins, in the folder and in a batch. ``position`` gives the order
    of arrival: the part's number, then the place in the part. What was added is seen by the
    next search. One writer at a time; any number of readers.
    """

    SCHEMA = "chunk_id string, position long, vector array<double>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _parts(self) -> list[str]:
        files, path = self._folder()
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def entries(self) -> DataFrame:
        """(chunk_id, position, vector) of all entries."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts])

    def add_batch(self, vectors: DataFrame, order: str | None = None) -> None:
        """Add (chunk_id, vector) rows whose ids are not there yet; ``order`` names the column of their arrival."""
        place = F.col(order) if order else F.monotonically_increasing_id()
        rows = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"), place.alias("at"))
        first = rows.groupBy("chunk_id").agg(F.min_by(F.struct("vector", "at"), "at").alias("e"))
        new = first.join(self.entries().select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "e.vector", "e.at")
        parts = self._parts()
        number = int(parts[-1].split("-")[0]) + 1 if parts else 0
        ranked = settle(new, "entries").repartitionByRange("at", "chunk_id").sortWithinPartitions("at", "chunk_id")
        # The part's number, then the partition's and the row's, which follow the order of arrival.
        own = F.monotonically_increasing_id()
        place = F.shiftleft(F.lit(number).cast("long"), 48) + F.shiftleft(F.shiftrightunsigned(own, 33), 28) + own.bitwiseAND(F.lit((1 << 28) - 1))
        ranked.select("chunk_id", place.alias("position"), "vector").write.parquet(f"{self.path}/{number:08d}-{uuid.uuid4().hex}")

    def add(self, chunk_id: str, vector: list[float]) -> None:
        self.add_batch(self.spark.createDataFrame([(chunk_id, [float(x) for x in vector])], "chunk_id string, vector array<double>"))

    def clear(self) -> None:
        files, path = self._folder()
        files.delete(path, True)

    def size(self) -> int:
        return self.entries().count()

    def search(self, queries: DataFrame, top_k: int = 10, block: int = BLOCK_QUERIES) -> DataFrame:
        """(query_id, chunk_id, position, score, rank) of each query's nearest entries by cosine, exactly.

        ``queries`` has query_id and vector. Vectors of another length or without one score 0.
        Scores are compared at DECIMALS decimals, equal ones by arrival.
        """
        entries = self.entries()
        asked = settle(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "asked")
        parts = [nearest(entries, some, top_k) for some in _blocks(asked, block)]
        if not parts:
            return self.spark.createDataFrame([], "query_id string, chunk_id string, position long, score double, rank int")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
        return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def _unit(vectors: list, wide: int) -> np.ndarray:
    """Rows of length one; zeros for a vector of another length, or none."""
    out = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == wide:
            out[i] = v
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def nearest(entries: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, chunk_id, position, score): of each task's entries the nearest to every query of a block."""
    rows = queries.collect()  # a block
    kind = queries.schema["query_id"].dataType.simpleString()
    ids = pa.array([r.query_id for r in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string()))
    by_width: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_width.setdefault(len(r.vector or ()), []).append(i)
    matrices = {wide: (np.array(at), _unit([rows[i].vector for i in at], wide)) for wide, at in by_width.items()}
    sent = queries.sparkSession.sparkContext.broadcast((ids, matrices))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrices = sent.value
        n = len(ids)
        score, place, name = np.zeros((0, n)), np.zeros((0, n), np.int64), np.zeros((0, n), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = part.column(2).to_pylist()
                new = np.zeros((len(vectors), n))
                for wide, (which, matrix) in matrices.items():
                    new[:, which] = np.round(_unit(vectors, wide) @ matrix.T, DECIMALS) + 0.0
                own = part.column(1).to_numpy()
                names = np.array(part.column(0).to_pylist(), object)
                score = np.concatenate((score, new))
                place = np.concatenate((place, np.broadcast_to(own[:, None], new.shape)))
                name = np.concatenate((name, np.broadcast_to(names[:, None], new.shape)))
                best = np.lexsort((place, -score), axis=0)[:top_k]
                score, place, name = (np.take_along_axis(x, best, axis=0) for x in (score, place, name))
        if len(score):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.tile(np.arange(n), len(score)))), pa.array(name.ravel(), pa.string()), pa.array(place.ravel()), pa.array(score.ravel())], names=["query_id", "chunk_id", "position", "score"]
            )

    return entries.select("chunk_id", "position", "vector").mapInArrow(scan, f"query_id {kind}, chunk_id string, position long, score double")
