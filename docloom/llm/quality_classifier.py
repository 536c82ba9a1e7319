"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its evidence is what can be counted in it and in the
lines beside it (letters by kind, signs, words, repeats); a transition score ties
neighbours together, so a line that tells little by itself is read as its surroundings
are. Forward and backward messages give each line's marginal probability. A document's
bad share is the mean of its lines' marginals, weighted by their bytes; a logistic curve
of that share, fitted on the training documents, is the score.

Messages are normalised products of 2 x 2 matrices, taken by doubling over all lines of a
batch at once, up to each document's edges. A document of a million lines takes twenty
steps like any other, and equal texts have equal scores whatever stands beside them.

Labels belong to documents, lines have none. A first fit reads every line as its document;
in documents of low quality the lines that it holds for good are then taken as good, all
but the worst, and the field is fitted to that by L-BFGS. The training rows are those
labelled outside the held-out fold; beyond ``fit_rows`` documents or ``fit_lines`` lines
in all, a share of them by the hash of their id. Documents of over LONGEST lines are left
out of the fit, never out of the scoring. The driver gets the features of these lines alone.

Null or empty text: one line without content, scored like others. Texts without breaks are
one line. Long texts are read whole. Repeated rows: each is scored. Several labels of one
id: the largest. Empty table: empty result. Where the training rows lack one of the labels,
every score is the smoothed share of the other's. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.store import Workspace
from docloom.llm.textkit import U64, mix

#: Labelled documents and their lines for the fit, about.
FIT_ROWS, FIT_LINES = 100_000, 100_000
#: Lines of a document in the fit.
LONGEST = 1024
#: Weight of the squared parameters in the fit, and its steps.
RIDGE, STEPS = 1.0, 60

GOOD, BAD = 0, 1


def _bytes(chars: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in chars]] = True
    return flags


_UPPER, _LOWER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789")
_STOP, _PAUSE = _bytes(".!?"), _bytes(",;:'\"()-")
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT | _STOP | _PAUSE)
_WIDE = np.arange(256) >= 128
_CALL = _bytes("!")

#: What is counted in a line; all lie between 0 and about 1.
NAMES = (
    "bias", "bytes", "words", "word_bytes", "longest_word", "upper", "digit", "sign", "call", "pause", "stop", "wide", "signed_words", "upper_words", "repeated", "stutter", "again", "ends", "wordless",
)


def line_features(texts: textkit.Texts) -> tuple[np.ndarray, textkit.Spans]:
    """(one row of NAMES for every line, the lines)."""
    lines = textkit.lines(texts)
    d, n = texts.data, len(lines.start)
    size = (lines.end - lines.start).astype(float)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        return (total[lines.end] - total[lines.start]).astype(float)

    upper, lower = _UPPER[d], _LOWER[d]
    n_upper, n_lower, wide = count(upper), count(lower), count(_WIDE[d])
    w = textkit.words(texts)
    line = np.searchsorted(lines.end, w.start, "right")  # a word's line is the first that ends behind its start
    n_words = np.bincount(line, minlength=n).astype(float)
    length = (w.end - w.start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, line, length)
    last = d[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    caps = np.concatenate(([0], np.cumsum(upper, dtype=np.int32)))
    small = np.concatenate(([0], np.cumsum(lower, dtype=np.int32)))
    shouted = (caps[w.end] - caps[w.start] > 1) & (small[w.end] == small[w.start])
    signed = _SIGN[last] | _CALL[last]
    h = texts.hash(w.start, w.end, textkit.OWN_SEED)
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=n)
    of_words = lambda flags: np.bincount(line[flags], minlength=n) / np.maximum(n_words, 1)

    key = texts.hash(lines.start, lines.end, textkit.OWN_SEED) ^ mix(lines.doc.astype(U64))
    _, first = np.unique(key, return_index=True)
    again = np.ones(n)
    again[first] = 0
    ends = np.zeros(n)
    some = size > 0
    ends[some] = _STOP[d[lines.end[some] - 1]]
    letters = np.maximum(n_upper + n_lower + wide / 2, 1)
    wordless = n_words == 0
    long_ = np.maximum(size, 1)
    columns = (
        np.ones(n), np.log1p(size) / 10, np.log1p(n_words) / 8, np.minimum(size / np.maximum(n_words, 1) / 20, 2), np.log1p(longest) / 5, n_upper / letters, count(_DIGIT[d]) / long_, count(_SIGN[d]) / long_ * 5,
        count(_CALL[d]) / long_ * 5, count(_PAUSE[d]) / long_ * 5, count(_STOP[d]) / long_ * 5, wide / long_, of_words(signed), of_words(shouted), (n_words - distinct) / np.maximum(n_words, 1), of_words(stutter), again * ~wordless, ends, wordless,
    )
    return np.stack(columns, axis=1).astype(np.float32), lines


def beside(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it in its document; zeros at the edges."""
    n, wide = own.shape
    out = np.zeros((n, 3 * wide), np.float64)
    out[:, :wide] = own
    same = (doc[1:] == doc[:-1])[:, None]
    out[1:, wide : 2 * wide] = own[:-1] * same
    out[:-1, 2 * wide :] = own[1:] * same
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (rows of four), each scaled to a sum of 1."""
    out = np.stack((a[:, 0] * b[:, 0] + a[:, 1] * b[:, 2], a[:, 0] * b[:, 1] + a[:, 1] * b[:, 3], a[:, 2] * b[:, 0] + a[:, 3] * b[:, 2], a[:, 2] * b[:, 1] + a[:, 3] * b[:, 3]), axis=1)
    return out / out.sum(axis=1, keepdims=True)


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, each row rounded alike wherever it stands, which BLAS does not promise."""
    return (x * w).sum(axis=1)


class Field(NamedTuple):
    """Parameters: the weights of a bad line's evidence, transition scores (from, to) and start scores."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def messages(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(filtered forward, backward messages, line potentials, log normaliser of each line)."""
        n = len(x)
        score = _dot(x, self.weights)
        top = np.maximum(score, 0)
        potential = np.stack((np.exp(-top), np.exp(score - top)), axis=1)  # scaled to 1 at most
        change = np.exp(self.trans)
        step = (change[None] * potential[:, None, :]).reshape(n, 4)
        opening = np.exp(self.start) * potential[first]
        step[first] = np.concatenate((opening, opening), axis=1)
        starts = np.flatnonzero(first)
        lines = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, lines)
        behind = np.repeat(lines, lines) - 1 - place
        longest = int(lines.max())
        ahead = step / step.sum(axis=1, keepdims=True)
        gap = 1
        while gap < longest:
            at = np.flatnonzero(place >= gap)
            ahead[at] = _times(ahead[at - gap], ahead[at])
            gap *= 2
        forward = ahead[:, :2] + ahead[:, 2:]
        forward /= forward.sum(axis=1, keepdims=True)
        back = np.full((n, 4), 0.25)
        inner = np.flatnonzero(~first[1:])  # lines that have one behind them
        back[inner] = step[inner + 1] / step[inner + 1].sum(axis=1, keepdims=True)
        gap = 1
        while gap < longest:
            at = np.flatnonzero(behind >= gap)
            back[at] = _times(back[at], back[at + gap])
            gap *= 2
        backward = np.stack((back[:, 0] + back[:, 1], back[:, 2] + back[:, 3]), axis=1)
        before = np.zeros((n, 2))
        before[1:] = forward[:-1] @ change
        before[first] = np.exp(self.start)
        return forward, backward, potential, np.log((before * potential).sum(axis=1)) + top

    def bad(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each line's marginal probability of being bad."""
        forward, backward, _, _ = self.messages(x, first)
        both = forward * backward
        return both[:, BAD] / both.sum(axis=1)

    def loss(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Negative log-likelihood of line labels with its ridge, and the gradient of all parameters."""
        forward, backward, potential, norm = self.messages(x, first)
        both = forward * backward
        marginal = both / both.sum(axis=1, keepdims=True)
        at = np.flatnonzero(~first)
        pair = forward[at - 1][:, :, None] * np.exp(self.trans)[None] * (potential[at] * backward[at])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        value = norm.sum() - (x[y == BAD] @ self.weights).sum() - (seen * self.trans).sum() - self.start[y[first]].sum()
        value += ridge / 2 * ((self.weights**2).sum() + (self.trans**2).sum() + (self.start**2).sum())
        slope = [
            x.T @ (marginal[:, BAD] - y) + ridge * self.weights,
            (pair.sum(axis=0) - seen + ridge * self.trans).ravel(),
            marginal[first].sum(axis=0) - np.bincount(y[first], minlength=2) + ridge * self.start,
        ]
        return float(value), np.concatenate(slope)

    def flat(self) -> np.ndarray:
        return np.concatenate((self.weights, self.trans.ravel(), self.start))

    @staticmethod
    def of(flat: np.ndarray) -> Field:
        return Field(flat[:-6], flat[-6:-2].reshape(2, 2), flat[-2:])


def descend(loss, at: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth convex function (value, gradient) by L-BFGS with halved steps."""
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, g in reversed(past):
            a = s @ way / (s @ g)
            way -= a * g
            kept.append(a)
        if past:
            s, g = past[-1]
            way *= (s @ g) / (g @ g)
        else:
            way /= max(np.abs(slope).sum(), 1)
        for (s, g), a in zip(past, reversed(kept)):
            way += s * (a - g @ way / (s @ g))
        stride = 1.0
        for _ in range(30):
            there = at - stride * way
            found, fresh = loss(there)
            if found <= value - 1e-4 * stride * (slope @ way):
                break
            stride /= 2
        else:
            break
        s, g = there - at, fresh - slope
        if s @ g > 1e-10:
            past = [*past, (s, g)][-memory:]
        done = value - found < 1e-6 * abs(value)
        at, value, slope = there, found, fresh
        if done:
            break
    return at


class Model(NamedTuple):
    """The field and the curve of a document's bad share; without a field the score is ``share``."""

    field: Field | None
    curve: np.ndarray
    share: float

    def score(self, bad_share: np.ndarray) -> np.ndarray:
        if self.field is None:
            return np.full(len(bad_share), self.share)
        z = _dot(np.stack((bad_share, np.sqrt(bad_share), np.ones(len(bad_share))), axis=1), self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _firsts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(int(counts.sum()), bool)
    out[np.concatenate(([0], np.cumsum(counts)[:-1]))] = True
    return out


def bad_shares(bad: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weighted mean of each document's lines."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.add.reduceat(bad * weight, starts) / np.add.reduceat(weight, starts)


def fit(own: np.ndarray, weight: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """A model from the lines of documents (``counts`` lines each) and the documents' labels."""
    share = (float((labels == 1).sum()) + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Model(None, np.zeros(3), share)
    doc = np.repeat(np.arange(len(counts)), counts)
    x, first = beside(own, doc), _firsts(counts)
    low = labels[doc] == 0
    odds = x @ _logistic(x, low.astype(float), RIDGE)
    starts = np.flatnonzero(first)
    worst = np.maximum.reduceat(odds, starts)[doc]
    y = (low & ((odds > 0) | (odds >= worst))).astype(np.int64)
    zero = np.zeros(x.shape[1] + 6)
    field = Field.of(descend(lambda p: Field.of(p).loss(x, first, y, RIDGE), zero))
    m = bad_shares(field.bad(x, first), weight, counts)
    curve = _logistic(np.stack((m, np.sqrt(m), np.ones(len(m))), axis=1), (labels == 1).astype(float), 0.1)
    return Model(field, curve, share)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _share(df: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 32)) < math.floor(share * (1 << 32)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, fit_lines: int, ws: Workspace) -> Model:
    """The model of the training rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and id is not null")
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label")).filter(~held_out("id"))
    n = known.count()
    if n > fit_rows:
        known = _share(known, "id", fit_rows / n, "rows")
    near = F.broadcast(known) if min(n, fit_rows) <= 1_000_000 else known
    breaks = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(near, "id")
    rows = ws.save(rows.withColumn("lines", breaks).filter(F.col("lines") <= LONGEST), "train")
    total = rows.agg(F.sum("lines")).first()[0] or 0
    if total > fit_lines:
        rows = _share(rows, "id", fit_lines / total, "lines")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textkit.slices(batch.column(0)):
                own, lines = line_features(texts)
                size = (lines.end - lines.start + 1).astype(np.float32)
                cut = lines.first.tolist()
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (own, size)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, len(texts)), *packed], names=["label", "own", "size"])

    got = rows.select("text", "label").mapInArrow(read, "label int, own binary, size binary").toPandas()
    ws.drop("train")
    if not len(got):
        return Model(None, np.zeros(3), 0.5)
    weight = [np.frombuffer(x, np.float32) for x in got["size"]]
    own = np.frombuffer(b"".join(got["own"]), np.float32).reshape(-1, len(NAMES))
    return fit(own, np.concatenate(weight).astype(float), np.array([len(x) for x in weight]), got["label"].to_numpy())


def line_marginals(texts: textkit.Texts, model: Model) -> tuple[np.ndarray, textkit.Spans]:
    """(probability that a line is bad, the lines) of all texts."""
    own, lines = line_features(texts)
    counts = np.diff(lines.first)
    if model.field is None:
        return np.full(len(own), 1 - model.share), lines
    return model.field.bad(beside(own, lines.doc), _firsts(counts)), lines


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.5,
    fit_rows: int = FIT_ROWS,
    fit_lines: int = FIT_LINES,
) -> DataFrame:
    """(id, held_out, score, predicted, bad_share, bad_lines) of every row; ``bad_lines`` are (line, start byte, bytes, probability)."""
    model = learn(docs, labels, id_col, text_col, label_col, fit_rows, fit_lines, Workspace(docs.sparkSession, "quality"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    line = pa.struct([("line", pa.int64()), ("start", pa.int64()), ("bytes", pa.int64()), ("bad", pa.float64())])
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, bad_share double, bad_lines array<struct<line: long, start: long, bytes: long, bad: double>>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textkit.slices(batch.column(1)):
                bad, lines = line_marginals(texts, sent.value)
                size = lines.end - lines.start
                shares = bad_shares(bad, size + 1.0, np.diff(lines.first))
                score = sent.value.score(shares)
                at = np.flatnonzero(bad >= 0.5)
                doc = lines.doc[at]
                told = [at - lines.first[doc], lines.start[at] - texts.offsets[doc], size[at], bad[at]]
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x) for x in told], fields=list(line)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(shares), found],
                    names=["id", "score", "predicted", "bad_share", "bad_lines"],
                )

    return rows.mapInArrow(judge, schema).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted", "bad_share", "bad_lines")
