"""Toxicity by a weighted finite-state pattern grammar.

Words become class symbols through a lexicon: insult, suspect, threat, target (who is
spoken to or of), negation, reported speech, clause end, other. Four small transducers
read the symbols: one emits the attacks, the others remember a target, a negation that
is still in force and an open report. Composed once into a single deterministic machine,
they turn a text into matched clauses: an attack with the state in which it stands
(targeted, negated, reported). A targeted insult and a denied or quoted one are
different outputs with weights of their own. Only the counts of matched clauses by
kind and state enter a score; a word has no weight.

The lexicon starts with listed words and grows by the training rows: a word that at
least SUPPORT toxic ones hold is an insult or a suspect by the lower bound of its
log-odds between toxic and other rows, in whatever language; a listed attack word that
the rows speak against becomes an ordinary one. In the training rows themselves a word
is classified without the row that is read, so the weights are fitted on classes as
they are on unseen rows. The weights come from a ridge logistic regression.

The training rows are a sample of the labelled ones outside the held-out fold: all, or
where there are more than ``fit_rows``, those whose id's hash lies below that share.
Every word of theirs with SUPPORT is a candidate; the lexicon holds all that are classified.

Null, empty or wordless text: no clause, so the base score. Long texts are read whole.
Repeated rows: each is scored. Several labels of one id: the largest. Empty table: empty
result. Without both labels the weights are the grammar's defaults. Extra columns are
left out by ``toxicity`` and kept by ``toxicity_filter``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.store import Workspace
from docloom.llm.textkit import U64

#: Labelled rows for the fit, about.
FIT_ROWS = 100_000
#: Words after a negation that it reaches.
REACH = 4
#: Toxic rows that a learned word needs.
SUPPORT = 3
#: The lexicon's hashes; a word that is made to share one with a listed word is read as that word.
SEED = 8
#: Lower bounds of the log-odds from which a word is a suspect and an insult.
SUSPECT_ODDS, INSULT_ODDS = 1.0, 2.0

# The lexicon's words, by class.
INSULTS = """
idiot idiots moron morons stupid clown clowns loser losers scum trash pathetic worthless disgusting imbecile imbeciles
moronic idiotic dumbass bastard bastards jackass scumbag scumbags lowlife lowlifes degenerate degenerates vermin filth
subhuman freak freaks retard retards retarded asshole assholes bitch bitches dickhead prick whore slut cunt twat
wanker fuckface fucker motherfucker shithead dipshit bullshit garbage
""".split()
THREATS = "kill murder strangle stab shoot behead slaughter exterminate lynch burn rape beat destroy hurt".split()
TARGETS = """
you your yours yourself you're youre u he him she her they them their those these people everyone
du dich dir dein deine ihr euch sie ihn ihm ihnen diese leute
tu te toi ton ta vous votre il elle ils elles lui eux ces gens
tú ti usted ustedes él ella ellos ellas esos esas gente
""".split()
NEGATIONS = """
not no never isn't aren't wasn't weren't don't doesn't didn't won't can't cannot neither nor hardly without
nicht kein keine keinen nie niemals ohne weder
ne pas jamais aucun aucune sans ni
nunca jamás sin ningún ninguna tampoco
""".split()
REPORTS = """
said says say saying called calls calling quoted quotes quote wrote writes reported reports claims claimed alleged allegedly stated according
sagte sagt sagten nannte nennt schrieb schreibt behauptet laut angeblich
dit disait disent appelle appelait écrit selon prétend
dijo dice dicen llamó llama escribió según afirma
""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, SUSPECT = range(8)
_CLASSES = ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
#: Attacks by the kind that the grammar emits.
KINDS = (INSULT, THREAT, SUSPECT)


class Transducer:
    """A deterministic machine over class symbols: ``step[state][symbol] = (state, output)``."""

    def __init__(self, step: list[list[tuple[int, tuple]]]):
        self.step = step

    def compose(self, other: Transducer) -> Transducer:
        """Both machines on one tape: paired states, joined outputs."""
        wide = len(other.step)
        return Transducer(
            [
                [(s * wide + t, o + p) for (s, o), (t, p) in zip(mine, theirs)]
                for mine in self.step
                for theirs in other.step
            ]
        )

    def run(self, symbols: list[int]) -> Iterator[tuple[int, tuple]]:
        """(position, output) at every attack."""
        state = 0
        for at, symbol in enumerate(symbols):
            state, output = self.step[state][symbol]
            if symbol in KINDS:
                yield at, output


def _memory(opens: int, reach: int | None = None) -> Transducer:
    """Remembers ``opens`` until the clause ends, or for ``reach`` words."""
    top = reach or 1

    def go(state: int, symbol: int) -> tuple[int, tuple]:
        if symbol == END:
            return 0, (0,)
        if symbol == opens:
            return top, (1,)
        return (max(state - 1, 0) if reach else state), (int(state > 0),)

    return Transducer([[go(state, symbol) for symbol in range(8)] for state in range(top + 1)])


def grammar(reach: int = REACH) -> Transducer:
    """attack o target o negation o report; an output is (kind, targeted, negated, reported)."""
    attack = Transducer([[(0, (KINDS.index(symbol) if symbol in KINDS else 0,)) for symbol in range(8)]])
    return attack.compose(_memory(TARGET)).compose(_memory(NEGATION, reach)).compose(_memory(REPORT))


#: Features: the 24 clause outputs by kind and state, then the three kinds whatever the state.
CLAUSES = 8 * len(KINDS)
FEATURES = CLAUSES + len(KINDS)


def _default_weights() -> tuple[np.ndarray, float]:
    w = np.zeros(FEATURES)
    for kind in (0, 1):
        for target in (0, 1):
            for negated in (0, 1):
                for reported in (0, 1):
                    base = 1.0 if kind == 0 else 1.5 * target
                    w[kind * 8 + target * 4 + negated * 2 + reported] = base * (1 + 0.5 * target) * (0.3 if negated else 1) * (0.4 if reported else 1)
    return w, -1.5


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True

_machine: list[Transducer] = []


def _hash(word: str) -> int:
    return int(textkit.hash_all([word.encode()], SEED)[0])


def odds(pos: np.ndarray, neg: np.ndarray, toxic: float, other: float) -> np.ndarray:
    """Lower bounds of the words' log-odds between toxic and other rows (one side, 95 %)."""
    pos, neg = pos + 0.5, neg + 0.5
    return np.log(pos / (toxic + 1)) - np.log(neg / (other + 1)) - 1.64 * np.sqrt(1 / pos + 1 / neg)


class Lexicon(NamedTuple):
    """Sorted word hashes and their classes: as they are, and without one toxic or one other row that holds the word."""

    words: np.ndarray
    classes: np.ndarray

    @staticmethod
    def learned(words: np.ndarray, pos: np.ndarray, neg: np.ndarray, toxic: int, other: int) -> Lexicon:
        """The listed words, and the given ones by the rows that hold them."""
        listed = {_hash(word): symbol for symbol, some in _CLASSES for word in some}
        every, at = np.unique(np.concatenate((np.array(list(listed), U64), words)), return_index=True)
        seen = np.zeros((2, len(every)), np.int64)
        place = np.searchsorted(every, words)
        seen[0, place], seen[1, place] = pos, neg
        fixed = np.array([listed.get(int(h), OTHER) for h in every], np.uint8)
        classes = np.zeros((3, len(every)), np.uint8)
        for k, (less_pos, less_neg) in enumerate(((0, 0), (1, 0), (0, 1))):
            p, n = np.maximum(seen[0] - less_pos, 0), np.maximum(seen[1] - less_neg, 0)
            bound = odds(p, n, max(toxic - less_pos, 0), max(other - less_neg, 0))
            found = np.where((p >= SUPPORT) & (bound >= INSULT_ODDS), INSULT, np.where((p >= SUPPORT) & (bound >= SUSPECT_ODDS), SUSPECT, OTHER))
            against = (p + n >= SUPPORT) & (p * (other + 1) < n * (toxic + 1))
            attack = np.isin(fixed, KINDS)
            classes[k] = np.where(fixed == OTHER, found, np.where(attack & against, OTHER, fixed))
        kept = (classes != OTHER).any(axis=0)
        return Lexicon(every[kept], classes[:, kept])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is no word of the lexicon."""
        table = _probe(self)
        near = np.flatnonzero(table[(h >> U64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.words, h[near]), len(self.words) - 1)
        out = np.full(len(h), -1, np.int64)
        hit = self.words[place] == h[near]
        out[near[hit]] = place[hit]
        return out


_probes: list[tuple[Lexicon, np.ndarray]] = []


def _probe(lexicon: Lexicon) -> np.ndarray:
    """Which first 16 bits the lexicon's hashes have; most words fail here."""
    if not _probes or _probes[0][0] is not lexicon:
        table = np.zeros(1 << 16, bool)
        table[(lexicon.words >> U64(48)).astype(np.int64)] = True
        _probes[:] = [(lexicon, table)]
    return _probes[0][1]


def listed() -> Lexicon:
    """The lexicon before any row is seen."""
    return Lexicon.learned(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0)


class Words(NamedTuple):
    """The words of some texts: hashes, their text, whether a clause ends before them."""

    h: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    broken: np.ndarray


def split(texts: textkit.Texts) -> Words:
    low = texts.lower()
    inside = _WORD_BYTE[low.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[low.offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    stops = np.concatenate(([0], np.cumsum(_CLAUSE_END[low.data])))
    broken = np.zeros(len(start), bool)
    broken[1:] = stops[start[1:]] > stops[end[:-1]]
    return Words(low.hash(start, end, SEED), np.searchsorted(low.offsets, start, "right") - 1, np.searchsorted(start, low.offsets), broken)


def clauses(texts: textkit.Texts, lexicon: Lexicon | None = None, variants: np.ndarray | None = None) -> list[list[int]]:
    """Per text the flat list feature, count, feature, count, ... of its matched clauses.

    ``variants`` names the classes that hold for each text: 1 and 2 leave out one toxic or one other row.
    """
    lexicon = lexicon or listed()
    if not _machine:
        _machine.append(grammar())
    words = split(texts)
    known = lexicon.find(words.h)
    of = np.zeros(len(known), np.int64) if variants is None else variants[words.doc]
    symbol = np.where(known >= 0, lexicon.classes[of, np.maximum(known, 0)], OTHER)
    attack = np.isin(symbol, KINDS)
    out: list[list[int]] = [[] for _ in range(len(texts))]
    # Runs of other words only let a negation expire, so REACH of them stand for any number.
    told = np.flatnonzero((symbol != OTHER) | words.broken)
    for i in np.unique(words.doc[attack]).tolist():
        a, b = words.first[i], words.first[i + 1]
        at = told[np.searchsorted(told, a) : np.searchsorted(told, b)]
        gaps = np.minimum(np.diff(at, prepend=a) - 1, REACH)
        symbols: list[int] = []
        for gap, cut, one in zip(gaps.tolist(), words.broken[at].tolist(), symbol[at].tolist()):
            symbols += [OTHER] * gap
            if cut:
                symbols.append(END)
            symbols.append(one)
        count: dict[int, int] = {}
        for _, (kind, target, negated, reported) in _machine[0].run(symbols):
            for f in (kind * 8 + target * 4 + negated * 2 + reported, CLAUSES + kind):
                count[f] = count.get(f, 0) + 1
        out[i] = [x for f in sorted(count) for x in (f, count[f])]
    return out


def _dense(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), FEATURES))
    for k, row in enumerate(rows):
        x[k, row[0::2]] = np.log1p(row[1::2])
    return x


def fit(rows: list[list[int]], labels: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps; the defaults unless both labels occur."""
    if len(set(labels.tolist())) < 2:
        return _default_weights()
    x = np.concatenate((_dense(rows), np.ones((len(rows), 1))), axis=1)
    w = np.zeros(FEATURES + 1)
    penalty = np.full(FEATURES + 1, ridge)
    penalty[CLAUSES:] = ridge / 10  # a state's weight is a departure from its kind's
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _features(docs: DataFrame, passed: list[str], text_col: str, lexicon, variant_col: str | None = None) -> DataFrame:
    """``passed`` and the clauses of every row; ``lexicon`` is a broadcast one."""
    names = docs.columns
    at = [names.index(c) for c in passed]
    text_at = names.index(text_col)
    variant_at = names.index(variant_col) if variant_col else -1
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed] + ["clauses array<int>"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textkit.slices(batch.column(text_at)):
                variants = batch.column(variant_at).slice(row, len(texts)).to_numpy(zero_copy_only=False) if variant_col else None
                found = pa.array(clauses(texts, lexicon.value, variants), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(row, len(texts)) for i in at] + [found], names=[*passed, "clauses"])

    return docs.mapInArrow(read, schema)


def _probability(found: list[list[int]], weights: tuple[np.ndarray, float]) -> np.ndarray:
    w, bias = weights
    z = [bias + sum(w[f] * np.log1p(n) for f, n in zip(r[0::2], r[1::2])) for r in found]
    return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def _judged(docs: DataFrame, text_col: str, model: Model, threshold: float, keep) -> DataFrame:
    """Every row with score, predicted and clauses (``keep`` null), or the columns of those below the threshold."""
    text_at = docs.columns.index(text_col)
    others = [f for f in docs.schema.fields if f.name != text_col]
    at = [docs.columns.index(f.name) for f in others]
    names = [f"c{i}" for i in at] + ["score", "predicted", "clauses"]
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in zip(at, others)] + ["score double, predicted int, clauses array<int>"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, *weights = sent.value
        for batch in batches:
            for row, texts in textkit.slices(batch.column(text_at)):
                found = clauses(texts, lexicon)
                p = _probability(found, weights)
                if keep:
                    yield batch.slice(row, len(texts)).filter(pa.array(p < threshold))
                else:
                    judged = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, len(texts)) for i in at), *judged], names=names)

    if keep:
        return docs.mapInArrow(read, docs.schema)
    return docs.mapInArrow(read, schema).withColumnsRenamed({f"c{i}": f.name for i, f in zip(at, others)})


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from the fit: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(label, text) of the training rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and id is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).filter(~held_out("id"))
    n = known.count()
    if n > fit_rows:
        share = math.floor(fit_rows / n * (1 << 32))
        known = known.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fit")), F.lit(1 << 32)) < share)
    near = F.broadcast(known) if min(n, fit_rows) <= 1_000_000 else known
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(near, "id").select("label", "text")


def _word_counts(rows: DataFrame, only) -> DataFrame:
    """(h, n) of the words of the rows' texts, each once a row; summed by task. ``only``: broadcast sorted hashes that count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = only.value if only is not None else None
        total = np.zeros(0 if wanted is None else len(wanted), np.int64)
        for batch in batches:
            for _, texts in textkit.slices(batch.column(0)):
                words = split(texts)
                h, doc = words.h, words.doc
                if wanted is not None:
                    place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    hit = wanted[place] == h
                    h, doc = place[hit].astype(U64), doc[hit]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
                if wanted is not None:
                    total += np.bincount(h[first].astype(np.int64), minlength=len(wanted))
                else:
                    h, n = np.unique(h[first], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
        if wanted is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    return rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, ws: Workspace) -> Model:
    """The lexicon and the weights of the training rows.

    Words of toxic rows are counted first, then only those with SUPPORT in the others. What
    reaches the driver are the candidates (bounded by the sample) and one short list of clauses a row.
    """
    spark = docs.sparkSession
    rows = ws.save(_sampled(docs, labels, id_col, text_col, label_col, fit_rows), "train")
    sizes = {r["label"]: r["n"] for r in rows.groupBy(F.col("label").cast("boolean").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(listed(), *_default_weights())
    pos = ws.save(_word_counts(rows.filter("label <> 0"), None).filter(F.col("n") >= SUPPORT), "toxic-words")
    seen = pos.orderBy("h").toPandas()
    table = np.sort(np.concatenate((seen["h"].to_numpy(np.int64).view(U64), np.array([_hash(w) for _, some in _CLASSES for w in some], U64))))
    wanted = np.unique(table)
    only = spark.sparkContext.broadcast(wanted)
    neg = _word_counts(rows.filter("label = 0"), only).toPandas()
    counts = np.zeros((2, len(wanted)), np.int64)
    for k, found in enumerate((seen, neg)):
        counts[k, np.searchsorted(wanted, found["h"].to_numpy(np.int64).view(U64))] = found["n"]
    lexicon = Lexicon.learned(wanted, counts[0], counts[1], sizes[1], sizes[0])
    sent = spark.sparkContext.broadcast(lexicon)
    marked = rows.select("text", F.when(F.col("label") != 0, 1).otherwise(2).alias("variant"))
    fitted = _features(marked, ["variant"], "text", sent, "variant").toPandas()
    ws.drop("train", "toxic-words")
    return Model(lexicon, *fit([list(c) for c in fitted["clauses"]], (fitted["variant"] == 1).to_numpy(float)))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted, clauses) of every row."""
    ws = Workspace(docs.sparkSession, "toxicity")
    model = learn(docs, labels, id_col, text_col, label_col, fit_rows, ws)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = _judged(rows, "_text", model, threshold, keep=False)
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", "predicted", "clauses")


def toxicity_filter(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The rows whose score is below the threshold, with their own columns.

    The model is learned first; the second pass judges every row beside its text, so no
    join brings verdicts back.
    """
    model = learn(docs, labels, id_col, text_col, label_col, fit_rows, Workspace(docs.sparkSession, "toxicity"))
    return _judged(docs, text_col, model, threshold, keep=True)
