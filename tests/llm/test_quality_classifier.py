"""The field's sums against all labellings, its gradient, and its verdicts on rows kept from the fit."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import quality_classifier as Q
from docloom.llm import textkit


def a_field(rng, wide):
    return Q.Field(rng.normal(size=wide), rng.normal(size=(2, 2)), rng.normal(size=2))


def by_hand(field, x):
    """(log normaliser, marginals of bad) from every labelling of one document."""
    score = x @ field.weights
    total, bad = 0.0, np.zeros(len(x))
    for y in itertools.product((0, 1), repeat=len(x)):
        z = np.exp(field.start[y[0]] + sum(score[t] * y[t] for t in range(len(x))) + sum(field.trans[a, b] for a, b in zip(y, y[1:])))
        total += z
        bad += z * np.array(y)
    return np.log(total), bad / total


def test_messages_equal_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([1, 5, 2, 9, 1, 1, 7])
    field, x = a_field(rng, 4), rng.normal(size=(int(counts.sum()), 4))
    first = Q._firsts(counts)
    _, _, _, norm = field.messages(x, first)
    got = field.bad(x, first)
    at = 0
    for n in counts.tolist():
        log_z, bad = by_hand(field, x[at : at + n])
        assert np.allclose(norm[at : at + n].sum(), log_z) and np.allclose(got[at : at + n], bad)
        at += n


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    counts = np.array([4, 1, 6])
    field, x = a_field(rng, 3), rng.normal(size=(11, 3))
    first, y = Q._firsts(counts), rng.integers(0, 2, 11)
    _, slope = field.loss(x, first, y, 0.7)
    flat = field.flat()
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-5
        up, down = (Q.Field.of(flat + s).loss(x, first, y, 0.7)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-4


def test_steps_reach_the_minimum():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(6, 6))
    hill = a @ a.T + np.eye(6)
    top = rng.normal(size=6)
    got = Q.descend(lambda p: (float((p - top) @ hill @ (p - top)), 2 * hill @ (p - top)), np.zeros(6), steps=200)
    assert np.allclose(got, top, atol=1e-2)


def test_long_documents_do_not_lose_their_messages():
    rng = np.random.default_rng(9)
    n = 30_000
    field, x = Q.Field(np.array([3.0]), np.array([[2.0, -2.0], [-2.0, 2.0]]), np.zeros(2)), rng.normal(size=(n, 1))
    first = np.zeros(n, bool)
    first[0] = True
    got = field.bad(x, first)
    score, change = x[:, 0] * 3, np.exp(field.trans)
    ahead, back = np.ones((n, 2)), np.ones((n, 2))
    for t in range(n):
        ahead[t] = (ahead[t - 1] @ change if t else 1.0) * np.array([1, np.exp(score[t])])
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        back[t] = change @ (np.array([1, np.exp(score[t + 1])]) * back[t + 1])
        back[t] /= back[t].sum()
    both = ahead * back
    assert np.isfinite(got).all() and np.allclose(got, both[:, 1] / both.sum(axis=1), atol=1e-9)


def count_by_hand(line):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", line) if w]
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return len(words), len(set(words)), stutter, float(not words), float(line[-1:] in (".", "!", "?") and line != "")


def test_line_features_are_counts_of_their_line():
    texts = ["one two two\n\nTHREE!! FOUR!! x\nend.", "", "a", "é é é\n \t \n5 5 6"]
    column = pa.array(texts, pa.string())
    (_, slice_), = textkit.slices(column)
    own, lines = Q.line_features(slice_)
    name = {n: i for i, n in enumerate(Q.NAMES)}
    every = [line for t in texts for line in t.split("\n")]
    assert len(every) == len(own) and np.diff(lines.first).tolist() == [len(t.split("\n")) for t in texts]
    for row, line in zip(own, every):
        n, distinct, stutter, wordless, ends = count_by_hand(line)
        assert np.isclose(row[name["words"]], np.log1p(n) / 8) and np.isclose(row[name["repeated"]], (n - distinct) / max(n, 1), atol=1e-6)
        assert np.isclose(row[name["stutter"]], stutter / max(n, 1), atol=1e-6) and row[name["wordless"]] == wordless and row[name["ends"]] == ends
    assert np.isclose(own[2][name["upper_words"]], 2 / 3, atol=1e-6)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "the", "of", "and", "quick", "brown", "fox", "été"]
    rows, labels = [], []
    for i in range(900):
        plain = lambda: " ".join(rng.choice(words, rng.integers(4, 14))).capitalize() + "."
        junk = [lambda: " ".join(w + rng.choice(["###", "$$$"]) for w in rng.choice(words, 8)), lambda: " ".join(w.upper() + "!!" for w in rng.choice(words, 8)), lambda: " | ".join(rng.choice(words, 8)), lambda: " ".join([str(rng.choice(words))] * 12)][i % 4]
        bad = i % 6 == 0
        lines = [junk() if bad and (k % 3 or k == 0) else plain() for k in range(rng.integers(1, 9))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_rows_kept_from_the_fit_are_told_apart(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (2002, "\n\n\n"), (None, "Plain text."), (7, rows[7][1])], "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "label", "id", "lines", "quality", "bad_share")})
    table = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    got = Q.quality_classifier(docs, table).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 for r in got)
    want = dict(labels)
    kept = [r for r in got if r.held_out and r.doc_id in want]
    assert len(kept) > 200 and np.mean([r.predicted == want[r.doc_id] for r in kept]) > 0.98
    marked = {r.doc_id: r.bad_lines for r in got}
    mixed = next(i for i, t in rows if i % 6 == 0 and t.count("\n") >= 4 and i % 4 != 3)
    raw = dict(rows)[mixed].encode()
    said = {b.line: raw[b.start : b.start + b.bytes].decode() for b in marked[mixed]}
    assert all(dict(rows)[mixed].split("\n")[k] == line for k, line in said.items()) and 0 in said
    empty = {r.doc_id: r.score for r in got if r.doc_id in (2000, 2001)}
    assert empty[2000] == empty[2001]


def test_bounds_of_the_fit_leave_verdicts_as_they_are(spark, corpus):
    rows, labels = corpus
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in Q.quality_classifier(docs, table, fit_rows=400, fit_lines=600).collect()}
    assert np.mean([got[i] == y for i, y in labels]) > 0.95


def test_without_both_labels_scores_are_their_share(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    ones = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    n = docs.filter(~Q.held_out("doc_id")).count()
    assert {r.score for r in Q.quality_classifier(docs, ones).collect()} == {(n + 1) / (n + 2)}
    assert {r.score for r in Q.quality_classifier(docs, ones.limit(0)).collect()} == {0.5}
    assert Q.quality_classifier(docs.limit(0), ones).isEmpty()


def test_equal_texts_score_alike_whatever_stands_beside_them():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(3 * len(Q.NAMES) + 6,))) / 3
    model = Q.Model(Q.Field.of(x), np.array([-2.0, -3.0, 1.7]), 0.5)
    own = ["", "One line.", "Some lines!\nAnd more of them\n\n### and $$$", "x\n" * 40]
    scores = {t: set() for t in own}
    for k in range(12):
        beside = [f"Filler {i}. " * (1 + i % 5) + "\nof lines" * (i * k % 23) for i in range(k)]
        for batch in ([*own, *beside], [*beside, *own], [t for pair in zip(own, [*beside, "", "", "", ""]) for t in pair]):
            (_, texts), = textkit.slices(pa.array(batch))
            bad, lines = Q.line_marginals(texts, model)
            got = model.score(Q.bad_shares(bad, lines.end - lines.start + 1.0, np.diff(lines.first)))
            for t, s in zip(batch, got.tolist()):
                if t in scores:
                    scores[t].add(s)
    assert all(len(s) == 1 for s in scores.values()), scores
