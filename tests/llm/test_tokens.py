"""Encoders, token counts and token files against their libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from docloom.llm import byte_bpe, textkit, token_counts, token_output

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (300, 40), (50, 20)])
def test_byte_bpe_equals_the_library(docs, rows, chunk, overlap):
    enc = byte_bpe.load(RANKS, P.PATTERN)
    want = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.digests(byte_bpe.byte_bpe(docs, RANKS, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap)).collect()
    assert bag(got) == bag(want)


def stitched(text, chunk, overlap):
    starts = byte_bpe.chunk_starts(len(text), chunk, overlap)
    ends = [[s + e for e in byte_bpe.boundaries(text[s : s + chunk], P.PATTERN, s + chunk >= len(text))] for s in starts]
    return byte_bpe.stitch(ends, starts, text, P.PATTERN, chunk)


def test_stitched_pieces_encode_like_the_whole_text():
    rng = np.random.default_rng(3)
    for _ in range(600):
        most = int(rng.choice([1, 3, 30, 200]))
        parts = ["a" * int(rng.integers(1, most + 1)), " ", "  ", "\n", "don't", "'s", "'re", "12" * int(rng.integers(1, most + 1)), "!?", ".", "é", "好", " x"]
        text = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(8, 60)))
        cuts = stitched(text, 20, int(rng.choice([4, 9])))
        assert cuts[0] == 0 and cuts[-1] == len(text) and cuts == sorted(set(cuts))
        got = [i for a, b in zip(cuts, cuts[1:]) for i in byte_bpe.encode_text(text[a:b], RANKS, P.PATTERN).tolist()]
        assert got == byte_bpe.encode_text(text, RANKS, P.PATTERN).tolist()


def test_stitching_goes_on_after_a_run_longer_than_an_overlap():
    text = "word " * 2000 + "x" * 1500 + " tail" * 3000
    cuts = stitched(text, 1000, 64)
    assert max(b - a for a, b in zip(cuts, cuts[1:])) < 4000 and len(cuts) > 25
    whole = "a" * 500
    assert stitched(whole, 100, 20) == [0, 500]


def test_byte_bpe_refuses_a_large_overlap(docs):
    with pytest.raises(ValueError):
        byte_bpe.byte_bpe(docs, RANKS, P.PATTERN, chunk_chars=100, overlap_chars=60)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(docs, rows, name):
    path = P.path(name)
    want = [(i, len((t or "").encode()), int(token_counts.lengths([t or ""], path)[0]), bool(token_counts.lengths([t or ""], path)[0] > 100)) for i, t in rows]
    got = token_counts.token_counts(docs, path, max_tokens=100, frequent=8, capacity=16).collect()
    assert bag(got) == bag(want)


def test_token_output_round_trip(docs, rows):
    got = token_output.token_output(docs, JSON, shard_tokens=500).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*token_output.encode_whole([t or ""], JSON)[0], 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert bag(got) == bag(want)


def test_wavelet_shard_answers():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 300, 5000).astype(np.uint32)
    shard = token_output.WaveletShard(token_output.build(ids, np.array([2000, 3000]), pa.array([7, 9]), 16))
    assert (shard.ids() == ids).all()
    assert [shard.access(i) for i in (0, 1, 4999)] == ids[[0, 1, 4999]].tolist()
    for symbol in (int(ids[3]), 299, 60000):
        places = np.flatnonzero(ids == symbol)
        assert shard.count(symbol) == len(places) and shard.locate(symbol) == places.tolist()
        assert shard.count(symbol, 1000, 4000) == ((places >= 1000) & (places < 4000)).sum()
    assert shard.document(1)[:5].tolist() == ids[2000:2005].tolist()


def test_empty_tables(nothing):
    assert byte_bpe.digests(byte_bpe.byte_bpe(nothing, RANKS, P.PATTERN)).count() == 0
    assert token_counts.token_counts(nothing, P.path("word_bpe_49k.json")).count() == 0
    assert token_output.token_output(nothing, JSON).count() == 0


def test_word_hashing_agrees_with_splitting():
    texts = ["a  b\nc", "", " x ", "\n\nq\n", "Ünï é"]
    raw = [t.encode() for t in texts]
    t = textkit.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    w = textkit.words(t)
    assert [t.cut(a, b) for a, b in zip(w.start, w.end)] == [x for r in raw for x in r.split()]
    ln = textkit.lines(t)
    assert [[t.cut(ln.start[k], ln.end[k]) for k in range(ln.first[i], ln.first[i + 1])] for i in range(len(texts))] == [r.split(b"\n") for r in raw]


def test_hash_table_holds_what_it_is_given():
    table = textkit.HashTable(8)
    keys = textkit.mix(np.arange(1, 101, dtype=np.uint64))
    table.put(keys, np.arange(100))
    assert (table.get(keys) == np.arange(100)).all() and (table.get(keys + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_add_up_to_the_librarys_ids(name):
    path = P.path(name)
    texts = ["it's don't x1y2", "ABC <|endoftext|> d", "á ëx,   zz q", "1234 5.6%", "Ünïcode—dash … »quote« ×÷", "你好, world 2²", "\x1c\x1d a\x85b", "fin. (x) 's 'll'a", "İI ΣΑΣ", " \n ", "", None, "é'é", "e\u0301 a\u0301,", "tab\tand\nbreak\n", "x," * 40, "A1b2 " * 30]
    rng = np.random.default_rng(8)
    parts = ["word", "Word", ",", ".", " ", " ", "\n", "7", "é", "'", "ß", "!", "—", "\t"]
    texts += ["".join(parts[k] for k in rng.integers(0, len(parts), 40)) for _ in range(300)]
    for _, cut in textkit.slices(pa.array(texts)):
        assert token_counts.count_slice(cut, path, None).tolist() == token_counts.lengths([t or "" for t in texts], path).tolist()
        if name.startswith("byte"):
            ids, n = token_output.encode_slice(cut, path, 0)
            ends = np.cumsum(n)
            assert [ids[e - k : e - 1].tolist() for e, k in zip(ends, n)] == token_output.encode_whole([t or "" for t in texts], path)


def test_shards_refuse_ids_that_do_not_fit():
    ids = np.array([1, 70000, 3], np.uint32)
    with pytest.raises(ValueError):
        token_output.build(ids, np.array([3]), pa.array([1]), 16)
    shard = token_output.WaveletShard(token_output.build(ids, np.array([3]), pa.array([1]), 17))
    assert shard.ids().tolist() == ids.tolist() and shard.access(1) == 70000 and shard.locate(70000) == [1]


def test_token_queries_take_any_id_and_extra_columns(spark, rows):
    from pyspark.sql import functions as F

    long = "lorem ipsum, dolor 12 " * 150_000  # longer than a slice of the batch kernels
    table = spark.createDataFrame([(str(i), t) for i, t in rows] + [("long", long)], "`the id` string, text string")
    table = table.withColumns({c: F.lit(1) for c in ("id", "ids", "decoded", "row", "_id", "_text", "n_tokens", "chunk")})
    lib = {i: t or "" for i, t in [(str(i), t) for i, t in rows] + [("long", long)]}
    got = byte_bpe.digests(byte_bpe.byte_bpe(table, RANKS, P.PATTERN, id_col="the id"), id_col="the id").collect()
    assert {r["the id"]: r.decoded_sha256 for r in got}["long"] == hashlib.sha256(long.encode()).hexdigest() and len(got) == len(rows) + 1
    counts = token_counts.token_counts(table, P.path("word_bpe_49k.json"), id_col="the id").collect()
    assert {r["the id"]: r.n_tokens for r in counts if r["the id"] != "None"} == {i: int(token_counts.lengths([t], P.path("word_bpe_49k.json"))[0]) for i, t in lib.items() if i != "None"}
    ids = token_output.token_output(table, JSON, id_col="the id").collect()
    assert len(ids) == len(rows) + 1 and {r["the id"]: r.n_tokens for r in ids}["long"] == len(token_output.encode_whole([long], JSON)[0]) + 1


def test_frequent_units_come_from_all_tasks(spark):
    texts = [("common words " * 50 + f"rare{k}x{k * 7} ",) for k in range(400)]
    keys, n = token_counts.frequent_table(spark.createDataFrame(texts, "text string").repartition(9), P.path("word_bpe_49k.json"), "text", 2, 16)
    want = {int(textkit.Texts(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash(np.array([0]), np.array([len(w)]))[0]) for w in (b"common", b"words")}
    assert set(map(int, keys)) == want and n.tolist() == [1, 1]
