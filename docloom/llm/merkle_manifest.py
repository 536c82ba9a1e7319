"""Merkle manifest of a dataset: a leaf a row, a tree a group, a tree over the groups.

H is the lowercase hex SHA-256 of its inputs, joined; digests are joined as hex text. A
leaf is H of the row's columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and
its value. The leaves of a group ascend by id; while more than one node is left, every
two neighbours (the last alone, where their number is odd) become their H. What is left
is the group's subroot; the subroots, by group (null first, then bytewise), give the root
in the same way. A row's proof lists its path's siblings from leaf to root, null on
levels where it stands alone.

Large aligned blocks of 2 ** ``bits`` leaves are reduced where they are, so one node a
block is left. Up to ``top`` of those go to the driver, which builds the upper trees and
sends back one suffix path a block; where there are more, they are reduced in blocks as
well, level by level, until few enough are left. Executors then hash their blocks again,
note each row's siblings inside it and append the suffix. Texts are read once, for the
leaf; what moves is a digest, the id and the group. Driver memory: ``top`` nodes with
paths of about log2(``top``) digests each.

Null ids come first in a group; rows of one id stand in the order of their leaves, rows
equal in all columns in any order: their leaves are the same, their proofs differ. Null or
empty groups, texts and other values are told apart by their encoding. Empty table: no
rows. Columns that are not listed are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.ordering import placed
from docloom.llm.store import Workspace

#: Leaves of a block, as a power of two.
BITS = 12
#: Nodes that the driver builds upper trees of.
TOP = 1 << 13

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<digest: string, left: boolean>"
_STEP = pa.struct([("digest", pa.string()), ("left", pa.bool_())])


def encoded(value: Column) -> Column:
    """A value as a leaf's input."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The leaf of a row with these values."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def parent(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], steps: int | None = None) -> list[list[str]]:
    """All levels from these nodes up, ``steps`` of them or until one node is left."""
    out = [nodes]
    while len(out) <= steps if steps is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([parent(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def path(tree: list[list[str]], at: int) -> list[tuple[str | None, bool]]:
    """(sibling, whether it stands left) on every level below the last."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((level[other] if other < len(level) else None, other < at))
        at >>= 1
    return out


def _steps(n: int, bits: int) -> int | None:
    """Levels that a block of a tree of n nodes is reduced by: all of its own, if the tree has further blocks."""
    return bits if n > 1 << bits else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block), which follow one another, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, i - start))
            last, start = keys[start], i
    if held:
        yield pa.Table.from_batches(held)


def _paths(tree: list[list[str]]) -> pa.ListArray:
    """The paths of all first nodes, level by level in bulk."""
    n, high = len(tree[0]), len(tree) - 1
    digests: list[str | None] = [None] * (n * high)
    left = [False] * (n * high)
    for k, level in enumerate(tree[:-1]):
        for i in range(n):
            other = i >> k ^ 1
            if other < len(level):
                digests[i * high + k] = level[other]
                left[i * high + k] = bool(i >> k & 1)
    steps = pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(left, pa.bool_())], fields=list(_STEP))
    return pa.ListArray.from_arrays(pa.array([i * high for i in range(n + 1)], pa.int32()), steps)


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes (tree, pos, n, digest, ...) by block, in order."""
    return nodes.withColumn("block", F.shiftright("pos", bits)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _roots(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, n, digest) of the next level of blocks."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            n = table.column("n")[0].as_py()
            root = levels(table.column("digest").to_pylist(), _steps(n, bits))[-1][0]
            first = table.slice(0, 1)
            blocks = -(-n // (1 << bits))
            yield pa.RecordBatch.from_arrays([first.column("tree").combine_chunks(), first.column("block").combine_chunks(), pa.array([blocks]), pa.array([root])], names=["tree", "pos", "n", "digest"])

    return _blocks(nodes, bits).select("tree", "block", "n", "digest").mapInArrow(reduce, "tree string, pos long, n long, digest string")


def _inside(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` with ``block`` and ``proof``, each node's path inside its block."""
    dealt = _blocks(nodes, bits)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema.fields)}, proof array<{STEP}>"

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            tree = levels(table.column("digest").to_pylist(), _steps(table.column("n")[0].as_py(), bits))
            whole = table.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*whole.columns, _paths(tree)], names=[*whole.schema.names, "proof"])

    return dealt.mapInArrow(climb, schema)


def _forest(nodes: DataFrame, ws: Workspace, name: str, bits: int, top: int) -> tuple[DataFrame, dict[str, str] | None]:
    """(tree, pos, proof, subroot) of the ``nodes`` (tree, pos, n, digest, ...) with their other columns; the subroots, if few.

    ``nodes`` is a written table: it is read twice.
    """
    roots = ws.save(_roots(nodes, bits), f"{name}-blocks")
    subroots: dict[str, str] | None = None
    if roots.count() <= top:
        found: dict[str, list[tuple[int, str]]] = {}
        for r in roots.collect():
            found.setdefault(r.tree, []).append((r.pos, r.digest))
        rows, subroots = [], {}
        for tree, some in found.items():
            up = levels([digest for _, digest in sorted(some)])
            subroots[tree] = up[-1][0]
            rows += [(tree, pos, path(up, pos), up[-1][0]) for pos, _ in some]
        suffix = F.broadcast(nodes.sparkSession.createDataFrame(rows, f"tree string, block long, suffix array<{STEP}>, subroot string"))
    elif roots.filter("n > 1").isEmpty():  # every tree is one block
        suffix = roots.select("tree", F.col("pos").alias("block"), F.expr(f"cast(array() as array<{STEP}>)").alias("suffix"), F.col("digest").alias("subroot"))
    else:
        above, subroots = _forest(roots, ws, f"{name}+", bits, top)
        suffix = ws.save(above.select("tree", F.col("pos").alias("block"), F.col("proof").alias("suffix"), "subroot"), f"{name}-suffix")
    met = _inside(nodes, bits).join(suffix, ["tree", "block"])
    return met.select(*nodes.columns, F.concat("proof", "suffix").alias("proof"), "subroot"), subroots


def merkle_manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    carried: dict[str, Column] | None = None,
    bits: int = BITS,
    top: int = TOP,
) -> DataFrame:
    """(id, group, leaf, carried columns, subroot, root, proof) of every row.

    ``carried`` are further expressions over ``docs`` that each row takes along.
    """
    ws = Workspace(docs.sparkSession, "manifest")
    extra = carried or {}
    at = F.col(f"`{group_col}`").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), at), F.lit(""))  # sorts null first and has no null
    kept = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{group_col}`").alias("_group"), *[c.alias(f"_x{k}") for k, c in enumerate(extra.values())]]
    rows = ws.save(docs.select(tree.alias("tree"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("digest"), *kept), "leaves")
    nodes = ws.save(placed(rows, "tree", [F.col("_id").asc_nulls_first(), F.col("digest")], ws, "sorted"), "placed")
    ws.drop("sorted", "sorted-counts", "leaves")
    found, subroots = _forest(nodes, ws, "rows", bits, top)

    if subroots is not None:
        names = sorted(subroots, key=str.encode)
        up = levels([subroots[t] for t in names])
        rows = [(t, path(up, k), up[-1][0]) for k, t in enumerate(names)]
        tops = F.broadcast(docs.sparkSession.createDataFrame(rows, f"tree string, over array<{STEP}>, root string"))
    else:
        line = found.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("under"), F.col("subroot").alias("digest"))
        line = ws.save(placed(ws.save(line, "subroots"), "tree", [F.col("under")], ws, "line"), "line-placed")
        over, _ = _forest(line, ws, "groups", bits, top)
        tops = over.select(F.col("under").alias("tree"), F.col("proof").alias("over"), F.col("subroot").alias("root"))
    out = found.join(tops, "tree")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_group").alias(group_col),
        F.col("digest").alias("leaf"),
        *[F.col(f"_x{k}").alias(c) for k, c in enumerate(extra)],
        "subroot",
        "root",
        F.concat("proof", "over").alias("proof"),
    )


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        beside = F.coalesce(step["digest"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    return F.aggregate(proof, start, up)


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["digest"]), ""), 256)


def failures(docs: DataFrame, manifest: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id") -> DataFrame:
    """(id, reason) of rows that a manifest with unique ids does not vouch for: ``changed``, ``added`` or ``removed``."""
    now = docs.select(F.col(f"`{id_col}`").alias("id"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("now"))
    then = manifest.select(F.col(f"`{id_col}`").alias("id"), "root", "proof", F.lit(True).alias("listed"))
    met = now.join(then, now["id"].eqNullSafe(then["id"]), "full").select(F.coalesce(now["id"], then["id"]).alias(id_col), "now", "root", "proof", "listed")
    reason = F.when(F.col("listed").isNull(), "added").when(F.col("now").isNull(), "removed").when(folded(F.col("now"), F.col("proof")) != F.col("root"), "changed")
    return met.select(id_col, reason.alias("reason")).filter("reason is not null")
