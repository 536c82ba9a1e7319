"""The manifest against trees built by hand, at every depth of its levels."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle_manifest as M

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root, and each node's siblings."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for k in range(len(run)):
                for leaf in at[i + k]:
                    paths[leaf].append(run[1 - k] if len(run) > 1 else None)
            up.append(H(*run))
            owners.append(sum(at[i : i + 2], []))
        nodes, at = up, owners
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, H(*map(enc, r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in groups}
    root, over = climb([trees[g][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for x, p in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            out[x[3][0], x[2], trees[g][0], root, tuple(p + over[k])] += 1
    return out


def rows_of(n):
    langs = [None, "", "en", "de", "é", "Z"]
    rows = [(i * 7 % 1000, f"src{i % 3}", langs[min(i % 11, 5)], None if i % 13 == 0 else i, None if i % 17 == 0 else "téxt " * (i % 5)) for i in range(n)]
    return rows + [(5, "a", "en", 1, "same")] * min(n, 37) + [(None, None, None, None, None)] * min(n, 3) + [(None, None, "en", 3, "")] * min(n, 1)


def found(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(s.digest for s in r.proof)) for r in df.collect())


@pytest.mark.parametrize("n,bits,top", [(0, 12, 8192), (1, 12, 8192), (300, 12, 8192), (300, 3, 8192), (300, 2, 6), (90, 1, 1)])
def test_manifest_equals_trees_built_by_hand(spark, n, bits, top):
    rows = rows_of(n)
    table = spark.createDataFrame(rows, COLUMNS).repartition(3).withColumns({c: F.lit(1) for c in ("tree", "pos", "n", "digest", "block", "proof", "_id")})
    got = M.merkle_manifest(table, bits=bits, top=top, carried={"root_": F.lit("kept")})
    assert got.columns == ["doc_id", "lang", "leaf", "root_", "subroot", "root", "proof"]
    assert found(got) == (brute(rows) if rows else Counter())
    assert got.filter(M.folded(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


def test_tampering_is_found(spark):
    rows = [(i, "s", "en" if i % 4 else None, i, f"text {i}") for i in range(40)]
    table = spark.createDataFrame(rows, COLUMNS)
    manifest = M.merkle_manifest(table, bits=3)
    other = table.filter("doc_id <> 9").withColumn("text", F.when(F.col("doc_id") == 7, "text 8").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "s", "en", 1, "new")], COLUMNS))
    assert {tuple(r) for r in M.failures(other, manifest).collect()} == {(7, "changed"), (9, "removed"), (99, "added")}
    assert M.failures(table, manifest).isEmpty()


def test_values_do_not_run_together():
    assert enc("1:2") == "3:1:2" and H(enc(1), enc(None)) != H(enc("1"), enc("-"))
