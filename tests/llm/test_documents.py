"""Filters, joins and scores against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontamination, lm_scoring, ngram_jaccard, quality_rules, sharding, textkit, toxicity, url_filters
from docloom.llm.components import components
from docloom.llm.store import Workspace

from .conftest import WORDS, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute_components(rows, size, num, den):
    """component by id, over all pairs."""
    known = [(i, shingles(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_copies(n, base, seed):
    """Copies of one text with a few words changed, links and near misses among them."""
    rng = np.random.default_rng(seed)
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for at in rng.integers(0, len(w), rng.integers(0, 8)):
            w[at] = WORDS[rng.integers(len(WORDS))] + "z"
        out.append(" ".join(w[: len(w) - rng.integers(0, 6)]))
    return out


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_equals_all_pairs(spark, rows, size, num, den, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    more = near_copies(70, prose(9, 90), 1) + near_copies(30, prose(10, 25), 2) + near_copies(20, prose(11, 8), 3)
    every = rows + [(100 + k, t) for k, t in enumerate(more)]
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(every, "doc_id long, text string").repartition(4), size, num, den).collect()
    want = brute_components(every, size, num, den)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in every)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t, size))) for i, t in every)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_splits_hot_leaves(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    every = list(enumerate(near_copies(150, prose(9, 90), 4) + near_copies(40, prose(9, 90) + " " + prose(12, 25), 5)))
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(every, "doc_id long, text string").repartition(2), 4, 85, 100, links=False, hot=8).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(every, 4, 85, 100)


def test_points_are_bounded_in_the_narrower_width():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5, 90, 300, 1000)]
    sets += [np.unique(np.concatenate((x[: len(x) * 2 // 3], sets[3]))) for x in sets]
    packed = [ngram_jaccard.point(x, ngram_jaccard.width(len(x))).astype(np.uint8).tobytes() for x in sets]
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert ngram_jaccard.bounds([packed[a]], [packed[b]])[0] >= len(np.intersect1d(x, y))
    assert ngram_jaccard.bounds([b""], [packed[0]])[0] > 1 << 30


def test_plan_never_misses_a_link():
    plan = ngram_jaccard.Plan(85, 100)
    for b in range(7, 400):
        for a in range(-(-85 * b // 100), b + 1):
            own, up = plan.filings(np.array([a])), plan.filings(np.array([b]))
            cls = int(up[0][0])
            assert cls in {int(x[0]) for x in own} and plan.blocks[cls] > plan.apart(a, b)
            assert plan.apart(a, b) >= a + b - 2 * plan.needed(a, b)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(41)}, **{1000 + k: 1000 for k in range(60)}}


def base_counts(text):
    raw = (text or "").encode()
    w = WORD.findall(raw)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for k in range(len(w) - 2):
        places.setdefault(tuple(w[k : k + 3]), []).append(k)
    marked = {p + j for v in places.values() if len(v) > 1 for p in v for j in range(3)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", raw)), dup, len(marked)


def test_quality_counts_and_verdicts(spark, docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    want = Counter((i, *base_counts(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    rng = np.random.default_rng(0)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 12)) for _ in range(120))
    same = " ".join(f"w{k % 7}x{k}" if k % 97 == 0 else "same" for k in range(3000))
    judged = quality_rules.quality_rules(spark.createDataFrame([(1, prose(1, 400)), (2, noise), (3, same)], "doc_id long, text string"), max_repeat_percent=100).collect()
    assert {r.doc_id: r.reason for r in judged} == {1: None, 2: None if noise is None else judged[[r.doc_id for r in judged].index(2)].reason, 3: "repetitive"}


def test_quality_bands_reject_incompressible_text():
    import base64

    import zstandard

    raw = base64.b85encode(np.random.default_rng(1).bytes(40000))
    assert quality_rules.Bands().verdict(raw, zstandard.ZstdCompressor(3))[2] == "incompressible"


def test_filters_keep_their_columns(spark, wide):
    kept = quality_rules.quality_filter(wide)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 9, 10, 16, None}
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    calm = toxicity.toxicity_filter(wide, labels)
    assert calm.columns == wide.columns and 15 not in {r.doc_id for r in calm.collect()}
    items = spark.createDataFrame([(1, prose(3, 60))], "item_id long, text string")
    clean = decontamination.decontamination_filter(wide, items)
    assert clean.columns == wide.columns and Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in wide.collect() if r.doc_id != 16)


def test_grammar_reads_clauses_not_words():
    machine = toxicity.grammar()
    you_idiot = [toxicity.TARGET, toxicity.OTHER, toxicity.INSULT]
    not_idiot = [toxicity.NEGATION, toxicity.OTHER, toxicity.INSULT]
    said_idiot = [toxicity.REPORT, toxicity.OTHER, toxicity.INSULT, toxicity.END, toxicity.INSULT]
    assert [o for _, o in machine.run(you_idiot)] == [(0, 1, 0, 0)]
    assert [o for _, o in machine.run(not_idiot)] == [(0, 0, 1, 0)]
    assert [o for _, o in machine.run(said_idiot)] == [(0, 0, 0, 1), (0, 0, 0, 0)]


def replayed(text, classes):
    """Matched clauses by word, one after the other: (kind, targeted, negated, reported) and how often."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    count, target, negated, reported = Counter(), False, 0, False
    for m in re.finditer(r"[.!?;\n]|[0-9a-z'\u0080-\U0010ffff]+", low):
        symbol = classes.get(m[0], "")
        if m[0] in ".!?;\n":
            target = reported = False
            negated = 0
            continue
        target, reported = target or symbol == "target", reported or symbol == "report"
        now = symbol == "negation" or negated > 0
        negated = toxicity.REACH if symbol == "negation" else max(negated - 1, 0)
        if symbol in ("insult", "threat"):
            count[int(symbol == "threat"), int(target), int(now), int(reported)] += 1
    return count


def test_clauses_equal_a_replay():
    classes = {w: name for name, some in (("insult", toxicity.INSULTS), ("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) for w in some}
    rng = np.random.default_rng(5)
    pool = ["You", "idiot", "scum", "kill", "not", "said", "a", "the", "Ünd", "x", "x", "y", "never", "quoted", "trash"]
    texts = [None, "", "...", "idiot"] + ["".join(pool[rng.integers(len(pool))] + str(rng.choice([" ", " ", " ", ". ", "\n", ", "])) for _ in range(rng.integers(1, 60))) for _ in range(200)]
    (_, cut), = list(textkit.slices(pa.array(texts)))
    for text, found in zip(texts, toxicity.clauses(cut)):
        want = replayed(text, classes)
        flat = Counter({k * 8 + t * 4 + n * 2 + r: c for (k, t, n, r), c in want.items()})
        for (k, *_), c in want.items():
            flat[toxicity.CLAUSES + k] += c
        assert dict(zip(found[0::2], found[1::2])) == dict(flat)


def test_toxicity_learns_words_of_any_language(spark):
    """Words of the toxic rows become attacks; words of both kinds of rows do not."""
    rude = ["schufté", "lumpig", "canaillé", "estúpidoz"]
    rng = np.random.default_rng(6)
    bad = [bool(x) for x in rng.random(400) < 0.3]
    said = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    rows = [(k, f"{said(25)} {rude[k % 4] + ' ' + rude[k // 3 % 4] if bad[k] else 'höflich'} {said(25)}") for k in range(400)]
    rows += [(k, t + " denounced") for k, t in rows[:200]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(bad[k])) for k in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and len(held) > 100 and all(r.predicted == int(bad[r.doc_id]) for r in held)
    assert toxicity.toxicity(table, labels, fit_rows=60).count() == len(rows)


def test_toxicity_of_empty_tables(spark, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert toxicity.toxicity_filter(nothing, labels.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " \n")], "doc_id long, text string")
    assert {r.predicted for r in toxicity.toxicity(blank, labels.limit(0)).collect()} == {0}


def test_toxicity_learns_and_scores_every_row(spark, docs, rows):
    train = [(k, f"{prose(k, 30)} {'idiot scum' if k % 3 == 0 else ''} {prose(k + 500, 30)}") for k in range(200, 500)]
    table = docs.unionByName(spark.createDataFrame(train, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in train], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == len(rows) + len(train)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 200]
    assert held and all(r.predicted == int(r.doc_id % 3 == 0) and 0 <= r.score <= 1 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.doc_id: r.predicted for r in got}[15] == 1


def test_decontamination_catches_new_slots(spark):
    item = "If Anna buys 12 kg of apples at 3 dollars per box then how much does Anna pay the seller at noon on that day"
    other = item.replace("Anna", "Bruno").replace("12", "40").replace(" 3 ", " 7 ")
    mixed = item.replace("Anna pay", "Carla pay")
    docs = [(1, f"{prose(1, 50)}. {item} {prose(2, 50)}"), (2, f"{prose(3, 50)}. {other} {prose(4, 50)}"), (3, f"{prose(5, 40)}. {mixed}"), (4, prose(6, 200)), (5, None), (6, ""), (7, item), (7, item)]
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short"), (14, item)], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (1 << 20, 0):
        got = decontamination.decontaminate(table, bench, broadcast_windows=most).collect()
        assert Counter((r.doc_id, tuple(r["items"])) for r in got) == Counter({(1, (10, 14)): 1, (2, (10, 14)): 1, (3, ()): 1, (4, ()): 1, (5, ()): 1, (6, ()): 1, (7, (10, 14)): 2})
    assert decontamination.decontaminate(table, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.decontaminate(table.limit(0), bench).count() == 0


def test_lattice_sums_all_segmentations():
    lattice = lm_scoring.Lattice([(b" a", math.log(0.2)), (b" ", math.log(0.1)), (b"a", math.log(0.3)), (b"b", math.log(0.1)), (b"ab", math.log(0.05))])
    want = 0.2 * 0.1 + 0.1 * 0.3 * 0.1 + 0.1 * 0.05
    assert abs(math.exp(lattice.log_likelihood(b"ab")) - want) < 1e-12


def test_lm_scores_against_counting(docs, rows):
    got = lm_scoring.lm_scores(docs, P.path("piece_bpe_32k.model"), frequent=5).collect()
    tokens = [(i, [w.lower() for w in WORD.findall((t or "").encode())] + [b"\x00"]) for i, t in rows]
    taught = [w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in ws]
    c, n = Counter(taught), len(taught)
    norm = math.log10(n + 0.5 * (len(c) + 1))
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10(c[w] + 0.5) - norm for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == pytest.approx(scores[2]) and scores[3] < scores[1]


def test_lm_on_an_empty_table(nothing):
    assert lm_scoring.lm_scores(nothing, P.path("piece_bpe_32k.model")).count() == 0


def test_shards_are_contiguous_and_balanced(docs, rows, nothing):
    got = sorted(sharding.byte_shards(docs, shards=5, buckets=3).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total, before = sum(r["size"] for r in got), 0
    for r in got:
        assert r.shard == min((2 * before + r["size"]) * 5 // (2 * total), 4)
        before += r["size"]
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.byte_shards(nothing).count() == 0


def test_sharding_stays_native(docs):
    plan = sharding.byte_shards(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def page(i, url, links=()):
    return (i, url, "".join(f'<a class="x" href="{x}">t</a>' for x in links))


def test_url_rules_and_propagation(spark):
    rules = [url_filters.Rule(p, v) for p, v in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]
    pages = [
        page(1, "http://A.Example.NET/en/x?q"), page(2, "http://a.example.net/de/"), page(3, "https://example.com/de/1#t"), page(4, "https://b.example.com/en/1"), page(5, "http://x.org/fr/"), page(6, None), page(7, "no scheme"), page(8, "http://y.net"),
        page(20, "http://spam.com/a", ["http://bad.net/x", "//bad.net/y", "/own"]), page(21, "http://bad.net/x"), page(22, "http://good.io/a"), page(23, "http://z.org/fr/1", ["https://good.io/"]), page(24, "http://calm.io/"), page(24, "http://calm.io/"),
    ]
    got = url_filters.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    seen = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(pages)
    assert seen[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and seen[2][2:] == ("net/", "block") and seen[3][2:] == ("example.com/de/", "block")
    assert seen[4][2:] == (None, "allow") and seen[5][2:] == ("org/fr/", "allow") and seen[6] == ("", "", None, "allow") and seen[7] == ("", "", None, "allow")
    assert seen[8] == ("y.net", "", None, "allow") and seen[20][2:] == (None, "block") and seen[22][3] == "allow" and seen[24][3] == "allow"
    by = {r.page_id: r for r in got}
    assert by[22].trust > 0 and by[20].distrust > by[20].trust
    assert url_filters.url_filter(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


LONG = "The old miller walked along the river every morning to count how many sacks of grain his three sons had carried from the barn to the boat before noon while their neighbour wrote the weight of each sack in a small green book that she kept under the table for the yearly market in town where all farmers met again at last"
SHORT = "which of these rivers flows through the largest number of different countries before reaching seas"


def caught(item, text):
    return [i for i, _ in decontamination.Items([(1, item)], 8, 0.5).matches(f"{prose(1, 40)}. {text}. {prose(2, 40)}")] == [1]


def test_decontamination_adds_up_shifted_windows(spark):
    w, s = LONG.split()[:59], SHORT.split()
    question = "When Anna buys some apples then how much money does Anna give the old seller after lunch if Anna takes them home"
    texts = [" ".join(x) for x in (w[10:42], w[:29] + ["quite"] + w[29:], w[:29] + w[30:], s[:7] + ["quite"] + s[8:])] + [question.replace("Anna", "Mary Ann")]
    items = [" ".join(w), " ".join(w), " ".join(w), " ".join(s), question]
    assert len(w) == 59 and len(s) == 15
    assert [caught(i, t) for i, t in zip(items, texts)] == [True] * 5
    assert not caught(" ".join(w), " ".join(w[:12])) and not caught(" ".join(w), " ".join(reversed(w)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame([(k, f"{prose(k, 30)}. {t}") for k, t in enumerate(texts)], "doc_id long, text string")
    for most in (1 << 20, 0):
        assert all(r.doc_id in r["items"] for r in decontamination.decontaminate(table, bench, broadcast_windows=most).collect())


def test_decontamination_sees_copies_in_other_case(spark):
    item = "If Anna buys 12 kg of apples at 3 dollars per box then how much does Anna pay the seller at noon on that day"
    german = "Heute kauft der Bauer im Dorf am Fluss eine Kuh und ein Schaf vom Markt der Stadt neben der großen Kirche aus Stein"
    ends = "The boat left Paris. Then Tom saw Lyon. There Ann met Bob. Later Kim sold Rex. Now Max owns Leo. Soon Eva left Rome."
    pairs = [(item, item.lower()), (item, item.upper()), (german, german.lower()), (german, german.upper()), (ends, ends.replace(".", " ;"))]
    assert [caught(i, t) for i, t in pairs] == [True] * 5
    assert not caught(german, german.upper()[:40])
    bench = spark.createDataFrame(list(enumerate(i for i, _ in pairs)), "item_id long, text string")
    table = spark.createDataFrame([(k, f"{prose(k, 30)}. {t}") for k, (_, t) in enumerate(pairs)], "doc_id long, text string")
    for most in (1 << 20, 0):
        assert all(r.doc_id in r["items"] for r in decontamination.decontaminate(table, bench, broadcast_windows=most).collect())


def test_decontamination_drops_conflicting_windows_only(spark):
    item = "If Anna buys 12 kg of apples at 3 dollars per box then how much does Anna pay the seller at noon on that day"
    story = " ".join(LONG.split()[:29] + ["as", "Emil", "said"] + LONG.split()[29:45] + ["and", "Emil", "knew"] + LONG.split()[45:59])
    pairs = [(item, item.replace("12", "5").replace(" 3 ", " 5 ")), (story, story.replace("Emil knew", "Otto knew"))]
    assert [caught(i, t) for i, t in pairs] == [True] * 2
    shape = "If Otto likes 9 of those 4 big red dogs from Rome then why would Emil not feed Hans or Max"
    assert not caught(item, shape)
    bench = spark.createDataFrame(list(enumerate(i for i, _ in pairs)), "item_id long, text string")
    table = spark.createDataFrame([(k, f"{prose(k, 30)}. {t}") for k, (_, t) in enumerate(pairs)], "doc_id long, text string")
    for most in (1 << 20, 0):
        assert all(r.doc_id in r["items"] for r in decontamination.decontaminate(table, bench, broadcast_windows=most).collect())


def test_jaccard_counts_every_link(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    more = near_copies(70, prose(9, 90), 1) + near_copies(20, prose(11, 8), 3)
    every = rows + [(100 + k, t) for k, t in enumerate(more + more[:9])]
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(every, "doc_id long, text string").repartition(4), 4, 85, 100).collect()
    sets = {i: shingles(t, 4) for i, t in every if i is not None}
    want = {i: sum(j != i and bool(s) and 100 * len(s & t) >= 85 * len(s | t) > 0 for j, t in sets.items()) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == want and len(got) == len(every)
    assert all(r.n_links is None for r in got if r.doc_id is None)


def test_url_walk_ends_by_its_tolerance(spark):
    pages = [page(1, "http://bad.net/x", ["http://linker.com/"]), page(2, "http://linker.com/a", ["http://bad.net/x"])]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filters.url_filter(table, [url_filters.Rule("net/", "block")], tolerance=1e-3).collect()}
    assert abs(got[2].distrust - 0.4595) < 0.006 and abs(got[1].distrust - 0.5405) < 0.006
    with pytest.raises(RuntimeError, match="distrust walk"):
        url_filters.url_filter(table, [url_filters.Rule("net/", "block")], steps=2)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shards_of_a_hot_key_and_of_strings(spark, kind):
    rows = [(5 if k % 3 else k, prose(k, 1 + k % 40)) for k in range(300)] + [(None, prose(k, 3)) for k in range(60)] + [(7, None)]
    name = lambda i: None if i is None else i if kind == "long" else f"same-prefix-{i:04d}"
    table = spark.createDataFrame([(name(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(4).withColumns({c: F.lit(1) for c in ("key", "size", "one", "shard", "_bucket")})
    got = sharding.byte_shards(table, shards=6, buckets=8).collect()
    size = lambda t: len((t or "").encode()) + 8
    want = sorted(((name(i) is not None, name(i) or 0 if kind == "long" else name(i) or "", zlib.crc32((t or "").encode()), size(t)) for i, t in rows))
    total, before, places, slots = sum(x[3] for x in want), 0, [], Counter()
    for _, i, crc, n in want:
        shard = min((2 * before + n) * 6 // (2 * total), 5)
        places.append((i, n, crc, shard, slots[shard]))
        slots[shard] += 1
        before += n
    assert Counter((r.doc_id if r.doc_id is not None else 0 if kind == "long" else "", r.size, r.text_crc32, r.shard, r.slot) for r in got) == Counter(places)


def test_verdict_columns_do_not_clash(spark, wide):
    judged = quality_rules.quality_rules(wide, keep_text=True)
    assert {"_own_kept", "_own_n_words", "_own_reason", "kept"} <= set(judged.columns) and judged.filter("_own_kept = 1").count() == wide.count()
    items = spark.createDataFrame([(1, prose(3, 60))], "item_id long, text string")
    for most in (1 << 20, 0):
        found = decontamination.decontaminate(wide, items, keep_text=True, broadcast_windows=most)
        assert "_own_items" in found.columns and {r.doc_id for r in found.filter("contaminated").collect()} == {16}
        assert decontamination.decontaminate(wide, items, broadcast_windows=most).columns == ["doc_id", "items", "covered", "contaminated"]


def test_operators_on_texts_without_words(spark):
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " \n"), (2, "")], "doc_id long, text string")
    assert [r.n_words for r in quality_rules.quality_rules(blank).collect()] == [0] * 4
    assert {r.n_tokens for r in lm_scoring.lm_scores(blank, P.path("piece_bpe_32k.model")).collect()} == {1}
    got = ngram_jaccard.ngram_jaccard(blank, links=False).collect()
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in got} == {(1, 1, 0), (2, 2, 0), (None, None, 0)} and len(got) == 4


def test_short_items_are_caught_at_any_place(spark):
    items = ["Name the capital of France", "Berlin lies north of the old city walls", "Who wrote the Iliad", "12 plus 30 equals 42", "Otto Bauer"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(k, shape.format(t)) for k, t in enumerate(items) for shape in ("{}", f"{prose(k, 20)} and {{}} {prose(k + 9, 20)}", f"{prose(k, 20)}. {{}}. {prose(k + 9, 20)}")]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    missed = [(r.doc_id, r["items"]) for r in got if r.doc_id not in r["items"]]
    assert not missed
