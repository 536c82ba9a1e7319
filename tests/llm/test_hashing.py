"""Hashes of byte ranges: strings that share a hash of a simpler kind, byte comparison in tables."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lm_scoring, ngram_jaccard, quality_rules, textkit, token_counts, token_output

JSON = P.path("byte_bpe_50k.json")


def thue_morse(n: int) -> tuple[str, str]:
    """A word whose polynomial hash modulo 2**64 is that of its complement, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def texts_of(names: list[bytes]) -> tuple[textkit.Texts, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in names])
    return textkit.Texts(np.frombuffer(b"".join(names), np.uint8), np.array([0, ends[-1] if len(ends) else 0])), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)


SIZES = [512, 1024, 2048, 4096, 8192]


@pytest.mark.parametrize("n", SIZES)
def test_thue_morse_words_differ(n):
    a, b = thue_morse(n)
    pair = textkit.hash_all([a.encode(), b.encode(), a.encode()], 7)
    assert pair[0] != pair[1] and pair[0] == pair[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=600), min_size=1, max_size=12), st.integers(0, 2**64 - 1))
def test_hash_follows_the_bytes_alone(names, seed):
    texts, start, end = texts_of([b"x", *names])
    h = texts.hash(start, end, seed)[1:]
    assert (h == textkit.hash_all(names, seed)).all()
    assert len(set(h.tolist())) == len(set(names))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=40), min_size=1, max_size=20), min_size=1, max_size=6), st.booleans())
def test_unit_table_tells_strings_of_one_hash_apart(rounds, same):
    table = textkit.UnitTable(8)
    told: list[bytes] = []

    def learn(names):
        told.extend(names)
        return np.arange(len(told) - len(names), len(told))

    for names in rounds:
        texts, start, end = texts_of(names)
        if same:  # every string has the same hash
            texts.hash = lambda a, b, seed: np.full(len(a), 5, np.uint64)
        got = table.rows(texts, start, end, learn)
        assert [told[i] for i in got.tolist()] == names


def test_operators_tell_thue_morse_texts_apart(spark):
    words = [w for n in SIZES for w in thue_morse(n)]
    rows = [(i, w) for i, w in enumerate(words)] + [(100 + i, f"{w}\n{w}\n{v} {v} {v} tail") for i, (w, v) in enumerate(zip(words[::2], words[1::2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lib = dict(zip([i for i, _ in rows], token_output.encode_whole([t for _, t in rows], JSON)))
    crc = {r.doc_id: r for r in token_output.token_output(docs, JSON, end_id=0).collect()}
    import zlib

    for i, ids in lib.items():
        assert crc[i].ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes()), i
    path = P.path("word_bpe_49k.json")
    count = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert [count[i] for i, _ in rows] == token_counts.lengths([t for _, t in rows], path).tolist()
    joined = ngram_jaccard.ngram_jaccard(docs, size=4, num=85, den=100).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in joined)
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.quality_rules(docs).collect() if r.doc_id >= 100} == dict.fromkeys(range(100, 105), 1)
    seen = lm_scoring.vocabulary(docs.selectExpr("text", "false AS held_out"), 3).collect()
    want = {hashlib.sha256(w.encode()).hexdigest(): 3 if k % 2 == 0 else 4 for k, w in enumerate(words)} | {hashlib.sha256(b"tail").hexdigest(): 5}
    assert {hashlib.sha256(bytes(r.word)).hexdigest(): r.n_all for r in seen} == want
