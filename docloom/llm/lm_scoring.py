"""Language-model scores: the likelihood of a text over all subword segmentations.

An existing subword vocabulary spans a lattice over each word: an edge for every
piece that matches the word's bytes (a leading space marks the word's start), and an
edge for every byte, so no word is without a path. Pieces weigh by their unigram
probability; a forward recursion in log space sums all segmentations, and a text's
log10 probability is the sum over its words plus its end. Words do not share
pieces, so a word's marginal depends on the word alone and is worked out once for
each distinct word of the corpus, not once for each occurrence.

The vocabulary file's own scores are merge ranks, no log probabilities. The unigram
probabilities are therefore counted: how often each piece occurs when the file's own
tokenizer segments the training words (end tokens counted beside), smoothed by 0.5.

Word counts cover all documents. The most frequent ``frequent`` words (24 bytes each)
are broadcast; the remaining occurrences meet their word's row in a shuffle join, where
no key is hot, since the frequent words are gone. Words meet by two hashes with seeds drawn
for the run.

Null, empty or wordless text: the end token alone. Repeated rows: each is scored (and
counted in training). Empty table: empty result. A null id belongs to the training
fold. Without training rows, counts are 0 and the smoothed probabilities uniform.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.store import Workspace

#: Words whose counts and marginals are broadcast: 24 bytes each, 6 MB at most.
FREQUENT = 1 << 18
#: Distinct words that a task holds before it sends them.
HELD = 1 << 18


@functools.lru_cache(maxsize=2)
def load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@functools.lru_cache(maxsize=2)
def pieces(model_path: str) -> dict[int, bytes]:
    """The bytes of each piece that can occur inside one word; control pieces are left out."""
    sp = load(model_path)
    out = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        if sp.is_byte(i):
            out[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
            continue
        piece = sp.id_to_piece(i)
        raw = piece.replace("▁", " ").encode()
        if b" " not in raw[1:] and raw:
            out[i] = raw
    return out


class Lattice:
    """Marginal word likelihoods from piece log probabilities (natural logs)."""

    def __init__(self, weights: list[tuple[bytes, float]]):
        self.edges: dict[bytes, float] = {}
        for raw, w in weights:  # a byte piece and a character piece may share their bytes: both are edges
            old = self.edges.get(raw)
            self.edges[raw] = w if old is None else max(old, w) + math.log1p(math.exp(-abs(old - w)))
        self.prefixes = {raw[:k] for raw in self.edges for k in range(1, len(raw) + 1)}

    def log_likelihood(self, word: bytes) -> float:
        """Natural log of the summed weight of all segmentations of a space and the word."""
        s = b" " + word
        n = len(s)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        terms[0].append(0.0)
        edges, prefixes = self.edges, self.prefixes
        for i in range(n):
            into = terms[i]
            if not into:
                continue
            if len(into) == 1:
                a = into[0]
            else:
                top = max(into)
                a = top + math.log(sum(math.exp(t - top) for t in into))
            j = i + 1
            while j <= n:
                cut = s[i:j]
                if cut not in prefixes:
                    break
                w = edges.get(cut)
                if w is not None:
                    terms[j].append(a + w)
                j += 1
            terms[i] = ()
        last = terms[n]
        if not last:
            return -math.inf
        top = max(last)
        return top + math.log(sum(math.exp(t - top) for t in last))


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def vocabulary(rows: DataFrame, seed: int) -> DataFrame:
    """(h, word, n_all, n_train) of every distinct word; ``rows`` has text and held_out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = textkit.HashTable(HELD.bit_length() + 1)
        seen: list[bytes] = []
        hashes: list[np.ndarray] = []
        every, train = np.zeros(HELD, np.int64), np.zeros(HELD, np.int64)

        def send() -> pa.RecordBatch:
            n = len(seen)
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(seen, pa.binary()), pa.array(every[:n].copy()), pa.array(train[:n].copy())], names=["h", "word", "n_all", "n_train"]
            )

        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for row, texts in textkit.slices(batch.column(0)):
                low = texts.lower()
                w = textkit.words(low)
                h, first, back = np.unique(low.hash(w.start, w.end, seed), return_index=True, return_inverse=True)
                n = np.bincount(back, minlength=len(h))
                taught = np.bincount(back, weights=~held[row : row + len(texts)].astype(bool)[w.doc], minlength=len(h)).astype(np.int64)
                for lo in range(0, len(h), HELD // 2):
                    part = slice(lo, lo + HELD // 2)
                    hp, fp = h[part], first[part]
                    if len(seen) + len(hp) > HELD:
                        yield send()
                        table.clear()
                        seen, hashes = [], []
                        every[:], train[:] = 0, 0
                    at = table.get(hp)
                    new = np.flatnonzero(at < 0)
                    at[new] = len(seen) + np.arange(len(new))
                    table.put(hp[new], at[new])
                    hashes.append(hp[new])
                    seen += [low.cut(a, b) for a, b in zip(w.start[fp[new]].tolist(), w.end[fp[new]].tolist())]
                    every[at] += n[part]
                    train[at] += taught[part]
        yield send()

    sent = rows.select("text", "held_out").mapInArrow(count, "h long, word binary, n_all long, n_train long")
    return sent.groupBy("h", "word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def piece_counts(words: DataFrame, model_path: str) -> np.ndarray:
    """How often each piece occurs in the training words, by piece id.

    Each task sends one row a piece of the fixed vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model_path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            for at in range(0, len(n), 5000):
                ids = sp.encode([x.decode("utf-8", "replace") for x in batch.column(0).slice(at, 5000).to_pylist()], num_threads=1)
                flat = np.fromiter((i for one in ids for i in one), np.int64)
                weight = np.repeat(n[at : at + 5000], [len(one) for one in ids])
                total += np.bincount(flat, weights=weight, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    found = words.filter("n_train > 0").select("word", "n_train").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(load(model_path).get_piece_size(), np.int64)
    total[found["piece"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def weigh(counts: np.ndarray, ends: int, model_path: str) -> tuple[list[tuple[bytes, float]], float]:
    """(piece bytes with natural-log probabilities, the end token's)."""
    known = pieces(model_path)
    total = sum(int(counts[i]) for i in known) + ends
    norm = math.log(total + 0.5 * (len(known) + 1))
    return [(raw, math.log(counts[i] + 0.5) - norm) for i, raw in known.items()], math.log(ends + 0.5) - norm


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more.

    Counts are read at 16 steps an octave: a histogram of a few hundred rows, whatever
    the vocabulary, so no task sends its own top list.
    """
    step = F.floor(F.log2("n_all") * 16)
    bins = sorted(words.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n_all").alias("least")).collect(), reverse=True)
    cut, total = 1 << 62, 0
    for row in bins:
        total += row["words"]
        if total > most:
            break
        cut = row["least"]
    return cut


def lm_scores(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    seed, second = textkit.new_seed(), textkit.new_seed()
    words = ws.save(vocabulary(rows, seed), "words")
    ends = rows.filter("not held_out").count()
    total, distinct = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    n, v = total + ends, distinct + (ends > 0)
    # Without training rows every count is 0 and the constant alone remains.
    log_norm = math.log10(n + 0.5 * (v + 1))

    weights, end_log = weigh(piece_counts(words, model_path), ends, model_path)
    sent_weights = spark.sparkContext.broadcast(weights)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent_weights.value)
        for batch in batches:
            seen = batch.column(1).to_pylist()
            score = [lattice.log_likelihood(x) / math.log(10) for x in seen]
            again = textkit.hash_all(seen, second).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(again), batch.column(2), batch.column(3), pa.array(score, pa.float64())], names=["h", "g", "n_all", "n_train", "lp"])

    scored = ws.save(words.mapInArrow(marginal, "h long, g long, n_all long, n_train long, lp double"), "scored")
    ws.drop("words")
    top = scored.filter(F.col("n_all") >= frequent_from(scored, frequent)).select("h", "n_train", "lp").toPandas()
    sent = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64).view(np.uint64), top["n_train"].to_numpy(np.int64), top["lp"].to_numpy(float)))

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, n_words long, known long, base double, lp double, rare array<struct<h: long, g: long, tf: long>>"
    rare_type = pa.struct([("h", pa.int64()), ("g", pa.int64()), ("tf", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, lps = sent.value
        table = textkit.HashTable(max(4, (2 * len(keys) + 1).bit_length()))
        table.put(keys, np.arange(len(keys)))
        logs = np.log10(counts + 0.5)
        for batch in batches:
            for row, texts in textkit.slices(batch.column(1)):
                low = texts.lower()
                w = textkit.words(low)
                h = low.hash(w.start, w.end, seed)
                at = table.get(h)
                hit = at >= 0
                add = lambda x: np.bincount(w.doc[hit], weights=x[at[hit]], minlength=len(texts)).astype(float)
                far = np.flatnonzero(~hit)
                far = far[np.lexsort((h[far], w.doc[far]))]
                hr, dr, gr = h[far], w.doc[far], low.hash(w.start[far], w.end[far], second)
                new = np.flatnonzero(np.concatenate(([True], (hr[1:] != hr[:-1]) | (dr[1:] != dr[:-1])))) if len(hr) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(hr)))
                cuts = np.searchsorted(dr[new], np.arange(len(texts) + 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(hr[new].view(np.int64)), pa.array(gr[new].view(np.int64)), pa.array(tf)], fields=list(rare_type))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(texts)),
                        batch.column(2).slice(row, len(texts)),
                        pa.array(np.diff(w.first)),
                        pa.array(add((counts > 0).astype(float)).astype(np.int64)),
                        pa.array(add(logs)),
                        pa.array(add(lps)),
                        pa.ListArray.from_arrays(pa.array(cuts), rare),
                    ],
                    names=["id", "held_out", "n_words", "known", "base", "lp", "rare"],
                )

    part = ws.save(rows.select("id", "text", "held_out").mapInArrow(split, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    met = (
        part.select("row", F.explode("rare").alias("r"))
        .select("row", "r.h", "r.g", "r.tf")
        .join(scored.select("h", "g", "n_train", F.col("lp").alias("word_lp")), ["h", "g"])
        .groupBy("row")
        .agg(
            F.sum(F.col("tf") * F.log10(F.col("n_train") + 0.5)).alias("r_base"),
            F.sum(F.col("tf") * F.col("word_lp")).alias("r_lp"),
            F.sum(F.when(F.col("n_train") > 0, F.col("tf")).otherwise(0)).alias("r_known"),
        )
    )
    tokens = F.col("n_words") + 1
    zero = F.lit(0.0)
    return part.drop("rare").join(met, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("r_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero) + math.log10(ends + 0.5) - tokens * log_norm).alias("base_score"),
        (F.col("lp") + F.coalesce("r_lp", zero) + end_log / math.log(10)).alias("score"),
    )
