"""The trie against one that is built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import conversation_trie as T
from docloom.llm import queries
from docloom.llm.store import Workspace

SCHEMA = "conv_id long, turn long, role string, text string"


def originals(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).hexdigest()
            out[c].append((t is not None, t or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for key, of in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        leaves = sum(not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below) for k in below)
        ends = ",".join(map(str, sorted(c for c in of if len(convs[c]) == len(key))))
        parent = min(members[key[:-1]]) if key else None
        out.add((min(of), len(key), parent, len(of), sum(len(k) == len(key) + 1 for k in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-120, -95), *range(0, n), *range(100, 100 + n), 777]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "bot", None]), rng.choice(["hé", "a", "b", "", None, "long \U0001f600 text"])))
    rows += [(777, 3, "user", "tie")] * 4 + [(778, t, "user", f"turn {t}") for t in range(60)] + [(None, 1, "user", "nobody's")]
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(4)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("piece,hubs,chunk,few", [(12, 100_000, 8192, 200_000), (2, 2, 3, 0)])
def test_nodes_equal_a_trie_built_by_hand(spark, tmp_path, monkeypatch, piece, hubs, chunk, few):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "BROADCAST_ROWS", few)
    monkeypatch.setattr(T.prefix_trie, "__defaults__", (hubs,))
    rows = some_rows(piece, 14)
    spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("conv", "depth", "k0", "pos", "n", "piece")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    found = [tuple(r) for r in got.collect()]
    want = brute(rebuilt(originals(rows)))
    assert set(found) == want and len(found) == len(want)


def test_suffixes_say_what_each_conversation_owns(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (3, 0, "u", "a"), (4, 0, "u", "zz"), (4, 1, "u", "a")]
    nodes, suffix = T.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in suffix.select("conv", "length", "owned_from", "leaf", "shared").collect()} == {(1, 2, 0, True, 0), (2, 2, 2, True, 1), (3, 1, 2, False, 1), (4, 2, 1, True, 0)}
    assert nodes.filter("depth = 0").select("n_convs", "n_children", "n_leaves", "saved").first() == (4, 2, 3, 2)


def test_tables_without_conversations(spark):
    assert T.conversation_trie(spark.createDataFrame([], SCHEMA))[0].isEmpty()
    assert T.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA))[0].isEmpty()
