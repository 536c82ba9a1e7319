"""Operators without SQL against plain readings of their methods."""

import math

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from pyspark.sql import functions as F

from docloom.llm import lm_scoring, quality_rules, url_filters

from .conftest import prose


def power_iteration(n, edges, weight, damping=0.85):
    """Personalised PageRank; what reaches a host without links goes back to the seeds."""
    step = np.zeros((n, n))
    for a in range(n):
        out = sorted({b for x, b in edges if x == a and b != a})
        step[a] = weight / weight.sum() if not out else 0
        for b in out:
            step[a, b] = 1 / len(out)
    x = weight.copy()
    for _ in range(2000):
        x = (1 - damping) * weight + damping * x @ step
    return x


@pytest.mark.parametrize("seed,most", [(1, 300_000), (2, 0)])
def test_walks_equal_power_iteration(spark, monkeypatch, seed, most):
    monkeypatch.setattr(url_filters, "BROADCAST_HOSTS", most)
    rng = np.random.default_rng(seed)
    n = 14
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n - 4, (22, 2))} | {(0, n - 1), (3, n - 2)}  # the last ones have no links
    host = lambda k: f"h{k}.{'net' if k in (3, 5) else 'org' if k in (0, 7) else 'io'}"
    pages = [(k, f"http://{host(k)}/fr/", " ".join(f'<a href="http://{host(b)}/x">' for a, b in sorted(edges) if a == k)) for k in range(n)] + [(99, f"http://{host(5)}/other", None)]
    rules = [url_filters.Rule("net/fr/", "block"), url_filters.Rule("org/fr/", "allow")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "trust", "score", "src", "weight")})
    got = {r.page_id: r for r in url_filters.url_filter(table, rules, tolerance=1e-9).collect()}
    blocked, allowed = np.zeros(n), np.zeros(n)
    blocked[[3, 5]], allowed[[0, 7]] = (1.0, 0.5), 1.0
    trust = power_iteration(n, edges, allowed)
    distrust = power_iteration(n, {(b, a) for a, b in edges}, blocked)
    for k in range(n):
        assert abs(got[k].trust - trust[k]) < 1e-6 and abs(got[k].distrust - distrust[k]) < 1e-6, k
    assert abs(sum(got[k].trust for k in range(n)) - 2) < 1e-6 and got[99].host == host(5) and got[99].verdict in ("allow", "block")


def by_hand(word, weights):
    """The summed weight of every way to cut a space and the word into pieces."""
    s, total = b" " + word, 0.0
    for cuts in range(1 << (len(s) - 1)):
        ends = [i + 1 for i in range(len(s) - 1) if cuts >> i & 1] + [len(s)]
        w, at = 1.0, 0
        for e in ends:
            w *= weights.get(s[at:e], 0.0)
            at = e
        total += w
    return total


def test_scores_equal_all_segmentations(spark):
    path = P.path("piece_bpe_32k.model")
    texts = [(k, t) for k, t in enumerate(["the cat", "The the hat", None, "", "été ab", "catch that", "zq", "a a a"])]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), path, frequent=3).collect()}
    known = lm_scoring.pieces(path)
    counts = np.zeros(lm_scoring.load(path).get_piece_size(), np.int64)
    ends = 0
    words = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    for k, t in texts:
        if not got[k].held_out:
            ends += 1
            for w in words(t):
                for i in lm_scoring.load(path).encode(w.decode()):
                    counts[i] += 1
    total = sum(int(counts[i]) for i in known) + ends + 0.5 * (len(known) + 1)
    weights = {}
    for i, raw in known.items():
        weights[raw] = weights.get(raw, 0.0) + (counts[i] + 0.5) / total
    for k, t in texts:
        want = math.log10((ends + 0.5) / total) + sum(math.log10(by_hand(w, weights)) for w in words(t))
        assert abs(got[k].score - want) < 1e-8, (k, t)


def banded(raw, bands, ratio):
    """The verdict by the last band whose length is reached."""
    rows = [r for r in bands if len(raw) >= r[0]]
    return None if not rows else "repetitive" if ratio < rows[-1][1] else "incompressible" if ratio > rows[-1][2] else None


def test_bands_reject_by_length(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(chr(c) for c in rng.integers(0x21, 0x7F, n))
    many = lambda t: " ".join(f"{t}{k % 40}" for k in range(3000))
    texts = [prose(1, 60), prose(2, 4000), "same words here " * 400, noise(3000), prose(3, 700) + " " + noise(9000), many("lorem"), prose(5, 900) * 3, " ".join(noise(7) for _ in range(3000)), prose(6, 900) + " " + " ".join(noise(60) for _ in range(200)), "x", ""]
    b = quality_rules.Bands()
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    squeeze = zstandard.ZstdCompressor(level=b.level)
    reasons = set()
    for k, t in enumerate(texts):
        raw = t.encode()
        whole = len(squeeze.compress(raw)) / len(raw) if raw else None
        parts = [raw[i : i + b.chunk_bytes] for i in range(0, len(raw), b.chunk_bytes)] if len(raw) > b.chunk_bytes else []
        bad = sum(len(p) for p in parts if banded(p, b.chunk, len(squeeze.compress(p)) / len(p)))
        want = (banded(raw, b.whole, whole) if raw else None) or ("chunks" if raw and bad / len(raw) > b.chunk_share else None)
        assert got[k].reason == ("base" if got[k].base_failed else want) and got[k].kept == (not got[k].base_failed and want is None), k
        assert got[k].ratio == whole and abs(got[k].bad_share - (bad / len(raw) if raw else 0)) < 1e-12
        reasons.add(got[k].reason)
    assert {None, "base", "incompressible"} <= reasons and len(reasons) >= 4


@pytest.mark.parametrize("spread", [0, 700, 1 << 20])
def test_chunks_give_the_same_ids_wherever_they_are_worked_on(spark, rows, spread):
    from docloom.llm import byte_bpe

    path = P.path("byte_bpe_50k.tiktoken")
    more = [(100, "a" * 5000 + " b" * 900), (101, "don't 's  x" * 300), (102, "\n \n  " * 800 + "end"), (103, prose(9, 500))]
    table = spark.createDataFrame([*rows, *more], "doc_id long, text string").repartition(3)
    got = byte_bpe.byte_bpe(table, path, P.PATTERN, chunk_chars=300, overlap_chars=40, spread_chars=spread).collect()
    want = sorted((str(i), byte_bpe.encode_text(t or "", path, P.PATTERN).astype("<u4").tobytes(), (t or "").encode()) for i, t in [*rows, *more])
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want


def literal_hits(items, text, size=8):
    """Items of ordinary words of which the text holds half of the windows, or all of a short one's."""
    words = lambda t: (t or "").lower().replace(".", "").split()
    own = words(text)
    have = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
    out = []
    for name, item in items:
        w = words(item)
        windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        if windows and sum(x in have for x in windows) >= 0.5 * len(windows):
            out.append(name)
    return out


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination_finds_the_windows_that_plain_reading_finds(spark, most):
    from docloom.llm import decontamination

    rng = np.random.default_rng(6)
    words = "river stone window garden bright number follow market little winter answer silver copper ladder farmer bottle candle forest mirror basket".split()
    sentence = lambda n: " ".join(rng.choice(words, n))
    items = [("b", sentence(40)), ("a", sentence(30)), (None, sentence(35)), ("c", None), ("d", "")]
    texts = []
    for k in range(40):
        name, item = items[k % 3]
        w = item.split()
        part = [w, w[: len(w) // 4], w[3 : 3 + 3 * len(w) // 4], []][k % 4]
        texts.append((k, " ".join([sentence(20), *part, sentence(20)]) + "."))
    texts += [(100, None), (101, ""), (None, items[0][1] + " " + items[2][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("name", "item", "h", "width", "n", "none", "s")})
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("name", F.lit("x"))
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, broadcast_windows=most).collect()}
    for k, text in texts:
        want = sorted(literal_hits(items, text), key=lambda n: (n is None, n or ""))
        assert list(got[k]["items"]) == want and got[k].contaminated == bool(want), (k, got[k], want)
    assert got[None]["items"] == ["b", None] and sum(r.contaminated for r in got.values()) > 15


def test_link_tasks_get_texts_and_not_their_hashes(spark):
    import random
    import time

    from docloom.llm import ngram_jaccard as J

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(1500)] for _ in range(20)]
    rows = [(10 * i + k, " ".join([*b[: 1500 - k], "end"]), i, k) for k in range(10) for i, b in enumerate(base)]  # no copy beside another
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc long, text string")
    dealt = spark.createDataFrame([(i, c, 0, True, True, i) for i, _, c, _ in rows], "doc long, cluster long, task long, left boolean, right boolean, component long")

    def written():
        time.sleep(1)
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    links = J._linked(docs, dealt, J.Shingles(5, 1), J.Plan(80, 100), True).collect()
    sent = written() - before
    assert len(links) == 9 * 20 and all(r.a // 10 == r.b // 10 for r in links)
    assert 0 < sent < sum(len(t) for _, t, _, _ in rows)


def test_large_leaves_of_the_same_members_are_joined_once(spark, tmp_path):
    from docloom.llm import ngram_jaccard as J
    from docloom.llm.store import Workspace

    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(common, 330, replace=False), rng.integers(0, 1 << 62, 70).astype(np.uint64)))) for _ in range(300)]
    points = [(k, len(x), bytearray(J.coded(J.point(x, 256)))) for k, x in enumerate(sets)] + [(900, 400, bytearray()), (901, 400, bytearray())]
    members = [*range(300), 900]
    split = [(leaf, part, members[part::2]) for leaf in range(12) for part in (0, 1)]
    # Leaves that share their least member and little else stay apart.
    split += [(20 + k, 0, [-5, *range(40 * k, 40 * k + 40)]) for k in range(5)] + [(30, 0, [-9, 900, 901])]
    points.append((-5, 400, bytearray()))
    points.append((-9, 400, bytearray()))
    parts = [(k, 0) for k in range(10)] + [(901, 900), (-9, 900)]
    ws = Workspace(spark, "large-leaves")
    got = J._within_leaves(
        spark.createDataFrame([], "list long, members array<long>"),
        ws.save(spark.createDataFrame(split, "leaf long, part long, members array<long>"), "split"),
        ws.save(spark.createDataFrame(parts, "node long, component long"), "parts"),
        ws.save(spark.createDataFrame(points, "doc long, n long, vector binary"), "points"),
        J.Plan(60, 100),
        ws,
    ).collect()
    tasks = {}
    for r in got:
        tasks.setdefault((r.cluster, r.task), set()).add(r.doc)
    sizes = sorted(len(x) for x in tasks.values())
    assert sizes == [41] * 5 + [301]
    assert {frozenset(x) for x in tasks.values()} == {frozenset(members), *(frozenset([-5, *range(40 * k, 40 * k + 40)]) for k in range(5))}


def test_points_travel_coded():
    from docloom.llm import ngram_jaccard as J

    x = np.random.default_rng(1).integers(0, 1 << 62, 300).astype(np.uint64)
    p = J.point(x, J.width(300))
    assert np.array_equal(np.frombuffer(J.decoded(J.coded(p)), np.uint8), p) and len(J.coded(p)) < len(p) // 2
    assert J.decoded(J.coded(np.array([256, 1]))) == b""
