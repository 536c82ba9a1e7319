"""Exact n-gram Jaccard join over an index of count vectors.

A document's shingles are hashed into groups; the counts of the groups are a point.
The shared shingles of two documents cannot outnumber the summed minima of their
coordinates, so two documents of sizes a and b can only link when that sum reaches
``ceil(t / (1 + t) * (a + b))``; equivalently their points are at most
``(a + b) * (1 - t) / (1 + t)`` apart in the L1 distance.

In so many dimensions a tree of bounding boxes alone would visit nearly every leaf
(README, "Count vectors"), so the index has two levels:

* Leaves. The groups are dealt into ``D + 1 + e`` blocks, D being the largest
  distance that a link allows in the size class. Two linked points agree in all but
  D blocks, so they share at least ``1 + e`` leaves: a block and its exact counts. Every
  point is filed under its blocks' counts in its own size class and the next.
* Rare leaves. Leaves have one order for all points: blocks without any shingle first,
  then the leaves of most members. A point leaves out its first ``e`` leaves of that
  order. Two linked points share ``e`` leaves before the last one they share, so
  neither leaves that one out, and a point with no more than ``e`` shared leaves has no
  link at all. So a passage that many documents share makes no large leaf of them.
* Stars. Each leaf's members are paired with its least one. Pairs that the summed
  minima of their points cannot exclude form stars around that document; a star's
  members are joined with it and with each other in blocks through a bulk-loaded
  R-tree, which bounds the overlap of two boxes, then of two points, by the summed
  minima. Pairs that survive are verified on their shingle sets unless links found
  before connect them already, so a block returns fewer links than it has members.
* What the stars leave open. Where the members of a leaf lie in different components,
  those outside the largest one are joined with all through the same tree over their
  points alone; the surviving pairs form stars again and are verified.

A point has about as many groups as half the document's shingles, so its bound tells
long documents apart as well as short ones. Points of different width are folded to the
narrower one. Only the sets of pairs that the points let pass travel.

Equal sets are collapsed first, map-side and globally. Filings travel as packed arrays,
to the leaf's bucket and from there to the member's. A leaf of more than HOT members in
one task counts as one of the largest: its members go to their own buckets at once, and
only a notice goes to the leaf's. Its star is made in two steps over salted parts.

The result is exact up to 64-bit hashes of shingles, whose seed is drawn for the run. ``component`` is the smallest id
reachable by links. The links that components need are only some; n_links counts all,
over the pairs of distinct sets in each component: the other ids whose set is linked
with the row's or equal to it.

Null or wordless text: no shingles, linked with nothing. Fewer words than ``size``: the
whole sequence is the only shingle. Repeated ids: the rows are one node, its number of
links the largest that one of its texts has. Null ids: the row is returned with a null
component and number of links. Empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.components import components
from docloom.llm.store import Workspace
from docloom.llm.textkit import U64, mix

#: Fine groups in a block, and the fewest coordinates of a point.
FINE = 1 << 12
GROUPS = 64
#: One spare block for so many that may differ.
SPARE = 4
#: Entries that a task holds before it sorts and sends them: 16 bytes each.
FLUSH = 1 << 18
#: Members of a leaf in one task from which it counts as one of the largest, and the rank that it has then.
HOT, LARGEST = 1024, 1 << 30
#: Rows up to which the tasks of documents are joined to their texts by a broadcast; beyond, by a shuffle.
BROADCAST_IDS = 500_000
#: Documents of a star or of one side of a leaf that a task joins, and the shingles of a star's task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Members of a leaf that one task holds against those outside the largest component, and how many of the latter.
FAR, OUTSIDE = 2048, 1024
#: Shingles that a task counts at once.
COLUMNS = 1 << 13


class Plan:
    """Size classes and block counts for a threshold num / den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        if not 0 < num <= den:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den = num, den
        low, starts = 1, []
        while self.apart(low, low) < 1 and low < largest:
            low += 1
        while low < largest:
            starts.append(low)
            low = max(low + 1, -(-low * den // num))
        self.starts = np.array(starts, np.int64)
        ends = np.append(self.starts[1:], largest) - 1
        allowed = np.array([self.apart(int(e), int(e)) for e in ends], np.int64)
        self.spare = 1 + allowed // SPARE
        self.blocks = allowed + 1 + self.spare

    def apart(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def needed(self, a, b):
        """The least overlap of linked sets of these sizes."""
        return -(-(a + b) * self.num // (self.num + self.den))

    def filings(self, n: np.ndarray) -> list[np.ndarray]:
        """Per document its own class and the next; -1 where it is not filed."""
        if not len(self.starts):
            return []
        own = np.searchsorted(self.starts, n, "right") - 1
        up = np.minimum(own + 1, len(self.starts) - 1)
        fits = (own + 1 < len(self.starts)) & (n * self.den >= self.num * self.starts[up]) & (n > 0)
        return [own, np.where(fits, own + 1, -1)]


class Shingles(NamedTuple):
    """Words of a shingle, and the seed of its hashes."""

    size: int
    seed: int


def shingle_sets(texts: textkit.Texts, how: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their counts."""
    size = how.size
    low = texts.lower()
    spans = textkit.words(low)
    h = low.hash(spans.start, spans.end, how.seed)
    win, at = textkit.windows(h, spans, size)
    first = np.searchsorted(at, spans.first)
    count = np.diff(spans.first)
    sets = []
    for i in range(len(texts)):
        if count[i] >= size:
            sets.append(np.unique(win[first[i] : first[i + 1]]))
        elif count[i]:
            short = np.full(1, count[i], U64)
            for k in range(spans.first[i], spans.first[i + 1]):
                short = mix(short * U64(0x9E3779B97F4A7C15) + h[k : k + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, U64))
    n = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), n


def width(n: int) -> int:
    """Coordinates of the point of ``n`` shingles: the power of two from n / 2 on."""
    return max(GROUPS, 1 << max(0, (n - 1) // 2).bit_length())


def point(h: np.ndarray, wide: int) -> np.ndarray:
    """The count vector of a set."""
    return np.bincount((mix(h) & U64(wide - 1)).astype(np.int64), minlength=wide).astype(np.int32)


def coded(vector: np.ndarray) -> bytes:
    """A point as it travels: a byte a count, Huffman-coded; empty if a count is over 255."""
    if vector.max() > 255:
        return b""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(vector.astype(np.uint8).tobytes()) + coder.flush()


def decoded(vector: bytes) -> bytes:
    """A byte a count."""
    return zlib.decompress(vector, -15) if vector else b""


def fold(vectors: np.ndarray, wide: int) -> np.ndarray:
    """Points, one a row, in fewer coordinates."""
    if vectors.shape[1] == wide:
        return vectors
    return vectors.reshape(len(vectors), -1, wide).sum(axis=1, dtype=np.int64)


def prints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set, as two rows."""
    doc = np.repeat(np.arange(len(n)), n)
    fp = np.zeros((2, len(n)), U64)
    for k in (0, 1):
        np.add.at(fp[k], doc, mix(h + U64(k + 1)))
    return fp


def leaves(h: np.ndarray, n: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, document index) of every filing; a row of spare leaves still to be left out for even and odd classes.

    A leaf's last bit is that of its class, and a document is filed in two that follow one another.
    """
    doc = np.repeat(np.arange(len(n)), n)
    mixed = mix(h ^ U64(0xA5A5A5A5A5A5A5A5))
    out_leaf, out_doc = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    left = np.full((2, len(n)), NO_SPARE, np.int64)
    for cls in plan.filings(n):
        filed = cls >= 0
        k = np.where(filed, plan.blocks[np.maximum(cls, 0)], 0)
        if not k.any():
            continue
        base = np.concatenate(([0], np.cumsum(k)))
        take = filed[doc] if not filed.all() else slice(None)
        d = doc[take]
        group = mixed[take] % (k[d] * FINE).astype(U64)
        slot = base[d] + (group % k[d].astype(U64)).astype(np.int64)
        total = np.zeros(base[-1], U64)
        np.add.at(total, slot, mix(group + U64(1)))
        keep = np.bincount(slot, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(n)), k)
        block = np.arange(base[-1]) - base[owner]
        salt = mix((cls[owner].astype(U64) << U64(32)) + block.astype(U64))
        leaf = mix(total ^ salt) & ~U64(1) | (cls[owner] & 1).astype(U64)
        spare = plan.spare[np.maximum(cls, 0)]
        void = np.bincount(owner[~keep], minlength=len(n))
        for i in np.flatnonzero(filed & (void > spare)).tolist():  # more empty blocks than may be left out
            at = base[i] + np.flatnonzero(~keep[base[i] : base[i + 1]])
            keep[at[np.argsort(leaf[at], kind="stable")[spare[i] :]]] = True
        here = np.flatnonzero(filed)
        left[cls[here] & 1, here] = np.minimum(np.maximum(spare - void, 0)[here], NO_SPARE - 1)
        out_leaf.append(leaf[keep])
        out_doc.append(owner[keep])
    return np.concatenate(out_leaf), np.concatenate(out_doc), left


#: What stands for the spare leaves of a class in which a document is not filed.
NO_SPARE = 0xFFFF

_INDEX = "kind string, a long, b long, m int"
_ARRAYS = ("leaf", "ids", "m", "hot", "sets", "equals", "points", "cells")
_SENT = "bucket int, source int, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def _index(docs: DataFrame, how: Shingles, plan: Plan, buckets: int, hot: int = HOT) -> DataFrame:
    """Points (kind p: id, set size), leaves (c: leaf, member, members) and equal sets (e: two ids).

    A set of m members gives m - 1 pairs, each with its least member. A leaf is there
    only for the members that do not leave it out.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        filled = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, texts in textkit.slices(batch.column(1)):
                h, n = shingle_sets(texts, how)
                fp = prints(h, n)
                held.append((ids[row : row + len(n)], n, fp, *leaves(h, n, plan)))
                filled += len(held[-1][3])
                if filled > FLUSH:
                    yield _packed(held, buckets, hot)
                    filled = 0
        if held:
            yield _packed(held, buckets, hot)
        textkit.release()

    def by_bucket(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, rows = None, []
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bucket"] != now and rows:
                        yield work(rows)
                        rows = []
                    now = row["bucket"]
                    rows.append(row)
            if rows:
                yield work(rows)
            textkit.release()

        return run

    sent = docs.mapInArrow(file, _SENT).repartition("bucket").sortWithinPartitions("bucket")
    sent = sent.mapInArrow(by_bucket(lambda rows: _gathered(rows, buckets)), _SENT).repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(by_bucket(_ranked), _INDEX)


def _stars(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries are the least of their key, pairs of the least with the others)."""
    order = np.lexsort((ids, *keys))
    first = np.ones(len(ids), bool)
    if len(ids) > 1:
        first[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    starts = np.flatnonzero(first)
    least = np.repeat(ids[order[starts]], np.diff(np.append(starts, len(ids)))) if len(ids) else ids
    pairs = np.stack([least, ids[order]], axis=1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return order[starts], np.unique(pairs, axis=0) if len(pairs) else pairs.astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    """The bytes of integers, all lowest bytes first: those that are always zero then compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _loosened(raw: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


def _spread(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each id."""
    return ((mix(ids.astype(np.int64).view(U64)) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _cuts(part: np.ndarray, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """The order by bucket and each bucket's places in it."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(buckets + 1))
    return order, [slice(at[b], at[b + 1]) for b in range(buckets)]


def _messages(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([r.get("source", -1) for r in rows], pa.int32())]
    return pa.RecordBatch.from_arrays(columns + [pa.array([r.get(c) for r in rows], pa.binary()) for c in _ARRAYS], names=["bucket", "source", *_ARRAYS])


def _packed(held: list[tuple], buckets: int, least: int) -> pa.RecordBatch:
    """What a task sends: filings to the leaves' buckets; points, its own equal sets and members of hot leaves to the documents'."""
    ids, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    fp, left = (np.concatenate([x[k] for x in held], axis=1) for k in (2, 5))
    shift = np.cumsum([0] + [len(x[0]) for x in held])
    leaf = np.concatenate([x[3] for x in held])
    owner = np.concatenate([x[4] + s for x, s in zip(held, shift)])
    held.clear()
    some = np.flatnonzero(n > 0)
    lead, equals = _stars([fp[1][some], fp[0][some]], ids[some])
    lead = some[lead]
    filed = np.zeros(len(ids), bool)
    filed[lead] = True
    take = filed[owner]
    leaf, member = leaf[take], ids[owner[take]]
    order = np.argsort(leaf, kind="stable")
    leaf, member = leaf[order], member[order]
    starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1]))) if len(leaf) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(leaf)))
    hot = np.repeat(count >= least, count)
    # A leaf is its bucket and 32 bits more: two that fall together give candidates and no links.
    bucket = lambda x: ((x >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    whole = bucket(leaf) << 32 | (leaf & U64(0xFFFFFFFF)).astype(np.int64)
    notice = whole[starts[count >= least]]
    hot_cells = np.stack([whole[hot], member[hot]], axis=1)
    whole, member = whole[~hot], member[~hot]
    cut = np.searchsorted(whole, np.arange(buckets + 1) << 32)
    sets = np.stack([fp[0][lead].view(np.int64), fp[1][lead].view(np.int64), ids[lead]], axis=1)
    set_order, set_at = _cuts(bucket(fp[0][lead]), buckets)
    point_order, point_at = _cuts(_spread(ids, buckets), buckets)
    points = np.stack([ids, n, left[0] << 16 | left[1]], axis=1)[point_order]
    equal_order, equal_at = _cuts(_spread(equals[:, 1], buckets), buckets)
    cell_order, cell_at = _cuts(_spread(hot_cells[:, 1], buckets), buckets)
    rows = []
    for b in range(buckets):
        own = slice(cut[b], cut[b + 1])
        row = {
            "bucket": b, "leaf": _squeezed(whole[own].astype(np.uint32)), "ids": _squeezed(member[own]), "hot": (notice[notice >> 32 == b] & 0xFFFFFFFF).astype(np.uint32).tobytes(),
            "sets": sets[set_order[set_at[b]]].tobytes(), "equals": equals[equal_order[equal_at[b]]].tobytes(), "points": _squeezed(points[point_at[b]].reshape(-1)), "cells": hot_cells[cell_order[cell_at[b]]].tobytes(),
        }
        if any(row[c] for c in _ARRAYS if c in row):
            rows.append(row)
    return _messages(rows)


def _read(rows: list[dict], column: str, kind, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] or b"" for r in rows), kind).reshape(-1, wide)


def _gathered(rows: list[dict], buckets: int) -> pa.RecordBatch:
    """One bucket of leaves: the shared ones with their number of members, sent to the members' buckets; the rest passes through."""
    here = rows[0]["bucket"]
    leaf = np.concatenate([_loosened(r["leaf"] or b"", np.uint32) for r in rows])
    ids = np.concatenate([_loosened(r["ids"] or b"", np.int64) for r in rows])
    hot = np.unique(_read(rows, "hot", np.uint32, 1))
    order = np.argsort(leaf, kind="stable")
    leaf, ids = leaf[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1]))) if len(leaf) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(leaf)))
    count[np.isin(leaf[starts], hot)] = LARGEST
    m = np.repeat(count, np.diff(np.append(starts, len(leaf)))).astype(np.int32)
    shared = m > 1
    leaf, ids, m = leaf[shared], ids[shared], m[shared]
    order, at = _cuts(_spread(ids, buckets), buckets)
    leaf, ids, m = leaf[order], ids[order], m[order]
    sets = _read(rows, "sets", np.int64, 3)
    _, equals = _stars([sets[:, 1], sets[:, 0]], sets[:, 2])
    equals = np.concatenate([equals.reshape(-1, 2), _read(rows, "equals", np.int64, 2)])
    out = [{"bucket": b, "source": here, "leaf": _squeezed(leaf[p]), "ids": _squeezed(ids[p]), "m": _squeezed(m[p])} for b, p in enumerate(at) if p.stop > p.start]
    points = b"".join(_loosened(r["points"], np.int64).tobytes() for r in rows if r["points"])
    out.append({"bucket": here, "points": _squeezed(np.frombuffer(points, np.int64)), "equals": equals.tobytes(), "cells": b"".join(r["cells"] or b"" for r in rows)})
    return _messages(out)


def _ranked(rows: list[dict]) -> pa.RecordBatch:
    """One bucket of documents: points, equal sets and the leaves that the documents do not leave out."""
    filed = [r for r in rows if r["source"] >= 0]
    far = [(_loosened(r["leaf"], np.uint32).astype(np.int64) | r["source"] << 32, _loosened(r["ids"], np.int64), _loosened(r["m"], np.int32).astype(np.int64)) for r in filed]
    hot = _read(rows, "cells", np.int64, 2)
    leaf, ids, m = (np.concatenate(x) for x in zip(*far, (hot[:, 0], hot[:, 1], np.full(len(hot), LARGEST))))
    points = np.frombuffer(b"".join(_loosened(r["points"], np.int64).tobytes() for r in rows if r["points"]), np.int64).reshape(-1, 3)
    equals = _read(rows, "equals", np.int64, 2)
    known, own = np.unique(points[:, 0], return_inverse=True)
    spare = np.full((2, len(known)), NO_SPARE, np.int64)
    np.minimum.at(spare[0], own, points[:, 2] >> 16)  # an id of several texts leaves out what all of them may
    np.minimum.at(spare[1], own, points[:, 2] & 0xFFFF)
    odd = leaf & 1
    order = np.lexsort((leaf, -m, odd, ids))
    leaf, ids, m, odd = (x[order] for x in (leaf, ids, m, odd))
    if len(ids):
        fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (odd[1:] != odd[:-1])))
        again = np.concatenate(([False], (leaf[1:] == leaf[:-1]) & ~fresh[1:]))
        place = np.cumsum(~again)
        first = np.flatnonzero(fresh)
        place -= np.repeat(place[first], np.diff(np.append(first, len(ids))))
        keep = ~again & (place >= spare[odd, np.searchsorted(known, ids)])
        leaf, ids, m = leaf[keep], ids[keep], m[keep]
    kinds = pa.array(["p"] * len(points) + ["e"] * len(equals) + ["c"] * len(ids), pa.string())
    none = np.zeros(len(points) + len(equals), np.int64)
    columns = [np.concatenate((points[:, 0], equals[:, 0], leaf)), np.concatenate((points[:, 1], equals[:, 1], ids)), np.concatenate((none, m)).astype(np.int32)]
    return pa.RecordBatch.from_arrays([kinds, *map(pa.array, columns)], names=["kind", "a", "b", "m"])


class CountTree:
    """A bulk-loaded R-tree over count vectors; boxes are kept as coordinate maxima."""

    def __init__(self, vectors: np.ndarray, n: np.ndarray, leaf: int = 16):
        order = np.argsort(n, kind="stable")
        parts = [order]
        while parts and len(parts[0]) > leaf:
            split = []
            for p in parts:
                axis = int(np.argmax(vectors[p].var(axis=0))) if len(p) > 1 else 0
                p = p[np.argsort(vectors[p, axis], kind="stable")]
                split += [p[: len(p) // 2], p[len(p) // 2 :]]
            parts = split
        self.leaves = [p for p in parts if len(p)]
        self.levels = [(np.array([vectors[p].max(axis=0) for p in self.leaves]), np.array([n[p].min() for p in self.leaves]))]
        while len(self.levels[-1][0]) > 1:
            high, low = self.levels[-1]
            pairs = range(0, len(high), 2)
            self.levels.append((np.array([high[i : i + 2].max(axis=0) for i in pairs]), np.array([low[i : i + 2].min() for i in pairs])))

    def near_leaves(self, other: CountTree, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves whose boxes may hold a linked pair."""
        top = max(len(self.levels), len(other.levels)) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            a = self.levels[min(level, len(self.levels) - 1)]
            b = other.levels[min(level, len(other.levels) - 1)]
            if np.minimum(a[0][i], b[0][j]).sum(dtype=np.int64) < plan.needed(int(a[1][i]), int(b[1][j])):
                continue
            if level == 0:
                yield self.leaves[i], other.leaves[j]
                continue
            left = [i] if level > len(self.levels) - 1 else [x for x in (2 * i, 2 * i + 1) if x < len(self.levels[level - 1][0])]
            right = [j] if level > len(other.levels) - 1 else [x for x in (2 * j, 2 * j + 1) if x < len(other.levels[level - 1][0])]
            stack += [(level - 1, x, y) for x in left for y in right]


class _Union:
    """Components by index."""

    def __init__(self, comp: np.ndarray):
        _, self.of = np.unique(comp, return_inverse=True)

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def connect(comp: np.ndarray, n: np.ndarray, vectors: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """Links between indices of the two sides that join different components.

    Equal sides give a self-join. Boxes, then points are bounded by summed minima; what
    is left is verified unless a link found before already connects the pair.
    """
    union = _Union(comp)
    a, b = CountTree(vectors[left], n[left]), CountTree(vectors[right], n[right])
    out = []
    for p, q in a.near_leaves(b, plan):
        p, q = left[p], right[q]
        if len(np.unique(np.concatenate((union.of[p], union.of[q])))) == 1:
            continue
        top = np.minimum(vectors[p][:, None, :], vectors[q][None, :, :]).sum(axis=2)
        ok = (top >= plan.needed(n[p][:, None], n[q][None, :])) & (union.of[p][:, None] != union.of[q][None, :])
        for i, j in zip(*np.nonzero(ok)):
            i, j = int(p[i]), int(q[j])
            if union.of[i] == union.of[j]:
                continue
            if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= plan.needed(len(sets[i]), len(sets[j])):
                union.join(i, j)
                out.append((i, j))
    return out


def _sets(docs: DataFrame, how: Shingles, carried: list[str]) -> DataFrame:
    """``doc``, ``carried`` and the shingles of the documents' ``text``."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc", *carried)) + ", shingles binary"
    return docs.mapInArrow(lambda batches: _shingled(batches, how, ["doc", *carried]), schema)


def _shingled(batches: Iterator[pa.RecordBatch], how: Shingles, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with the columns ``kept`` and the shingles of ``text`` instead of it."""
    for batch in batches:
        for row, texts in textkit.slices(batch.column("text")):
            h, n = shingle_sets(texts, how)
            cut = np.concatenate(([0], np.cumsum(n)))
            shingles = pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, len(n)) for c in kept], shingles], names=[*kept, "shingles"])


def _points(docs: DataFrame, how: Shingles) -> DataFrame:
    """(doc, n, vector) of the documents, the vectors coded; an empty one excludes nothing."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textkit.slices(batch.column(1)):
                h, n = shingle_sets(texts, how)
                cut = np.concatenate(([0], np.cumsum(n)))
                points = [coded(point(h[i:j], width(j - i))) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(points, pa.binary())], names=["doc", "n", "vector"])

    return docs.mapInArrow(build, "doc long, n long, vector binary")


def bounds(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The summed minima of pairs of points, a byte a count, in the coordinates of the narrower one; an empty one bounds nothing."""
    wide = np.array([(len(x), len(y)) for x, y in zip(left, right)], np.int64).reshape(-1, 2)
    out = np.full(len(wide), 1 << 40, np.int64)
    for la, lb in np.unique(wide, axis=0).tolist():
        least = min(la, lb)
        if not least:
            continue
        every = np.flatnonzero((wide == (la, lb)).all(axis=1))
        step = max(1, (1 << 21) // max(la, lb))
        for k in range(0, len(every), step):
            at = every[k : k + step]
            a, b = (fold(np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), w), least) for side, w in ((left, la), (right, lb)))
            out[at] = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return out


def _possible(pairs: DataFrame, points: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that the summed minima of their points do not exclude, with the size of b."""
    num, den = plan.num, plan.den

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(num, den)
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            top = bounds(*([decoded(x) for x in batch.column(c).to_pylist()] for c in ("va", "vb")))
            yield batch.select(["a", "b", "nb"]).filter(pa.array(top >= p.needed(na, nb)))

    for side in ("b", "a"):
        pairs = pairs.join(points.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("vector").alias(f"v{side}")), side)
    return pairs.mapInArrow(bound, "a long, b long, nb long")


def _linked(docs: DataFrame, dealt: DataFrame, how: Shingles, plan: Plan, few: bool) -> DataFrame:
    """Links (a, b) inside the tasks of ``dealt`` (doc, cluster, task, left, right, component).

    A task joins its left documents with its right ones. Texts travel, not their shingles:
    hashes are longer than the words that they stand for, and nothing compresses them.
    """
    num, den = plan.num, plan.den
    place, kept = ["cluster", "task"], ["doc", "cluster", "task", "left", "right", "component"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(num, den)
        for table in _groups(_shingled(batches, how, kept), place):
            doc, comp, left, right = (table.column(c).to_numpy() for c in ("doc", "component", "left", "right"))
            sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            wide = width(int(n.min()))
            vectors = np.stack([point(x, wide) for x in sets])
            found = connect(comp, n, vectors, sets, np.flatnonzero(left), np.flatnonzero(right), p)
            if found:
                at = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc[at[:, 0]]), pa.array(doc[at[:, 1]])], names=["a", "b"])
            if n.sum() > 1 << 20:
                textkit.release()

    rows = docs.join(F.broadcast(dealt) if few else dealt, "doc").select("text", *kept)
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(join, "a long, b long")


def ngram_jaccard(
    docs: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    links: bool = True,
    hot: int = HOT,
) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row; links need ``den * shared >= num * all``.

    Ids are integers. Without ``links`` the last column is left out and only the links
    that components need are verified.
    """
    with_links = links
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    plan, how = Plan(num, den), Shingles(size, textkit.new_seed())
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = rows.filter("doc is not null")
    index = ws.save(_index(known, how, plan, buckets, hot), "index")

    equals = index.filter("kind = 'e'").select("a", "b")
    lists, split = _members(index.filter("kind = 'c'").select(F.col("a").alias("leaf"), F.col("b").alias("doc"), "m"), ws)
    stars = ws.save(_leaf_stars(lists, split).distinct(), "stars")
    inside = lists.select(F.explode("members").alias("doc")).unionByName(split.select(F.explode("members").alias("doc")))
    wanted = ws.save(inside.distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    points = ws.save(_points(known.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi"), how), "points")
    kept = ws.save(_possible(stars, points, plan), "kept")
    ws.drop("wanted")

    # The first star of each document, then the other pairs whose ends are still apart.
    lead = kept.groupBy("b").agg(F.min(F.struct("a", "nb")).alias("s")).select("s.a", "b", "s.nb")
    parts = ws.save(components(equals.unionByName(_verified(known, lead, None, how, plan, ws, "lead")), ws, "parts"), "parts-lead")
    rest = kept.join(lead, ["a", "b"], "left_anti")
    parts = _merged(parts, _verified(known, rest, parts, how, plan, ws, "rest"), ws, "rest")
    tasks = _within_leaves(lists, split, parts, points, plan, ws)
    links = ws.save(_linked(known, tasks, how, plan, tasks.count() <= BROADCAST_IDS), "open-links")
    parts = _merged(parts, links, ws, "open")
    ws.drop("lists", "split", "stars", "points", "kept", "within", "lead-links", "rest-links", "open-links")

    sizes = index.filter("kind = 'p'").select(F.col("a").alias("doc"), F.col("b").alias("n_shingles"))
    out = sizes.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").select(
        F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id")
    )
    nameless = _sets(rows.filter("doc is null"), how, [])
    none = F.lit(None).cast("long")
    nameless = nameless.select(F.col("doc").alias(id_col), (F.octet_length("shingles") / 8).cast("long").alias("n_shingles"), none.alias("component_id"))
    if with_links:
        counted = _link_counts(known, parts, how, plan, ws).withColumnRenamed("doc", id_col)
        out = out.join(counted, id_col, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        nameless = nameless.withColumn("n_links", none)
    return out.unionByName(nameless)


def _link_counts(docs: DataFrame, parts: DataFrame, how: Shingles, plan: Plan, ws: Workspace) -> DataFrame:
    """(doc, n_links) of the documents in ``parts``.

    All links lie inside components, so the distinct sets of each are compared with one
    another, all pairs, in blocks of BLOCK; a pair of sets lies in one task. Tasks return
    sums a set, weighted by the ids that have the other set, and no pairs.
    """
    members = parts.select(F.col("node").alias("doc"), "component")
    rows = docs.join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, "doc")
    rows = ws.save(_prints(rows.select("doc", "text", "component"), how), "prints")
    key = ["component", "f", "g"]
    classes = ws.save(rows.groupBy(key).agg(F.min("doc").alias("doc"), F.countDistinct("doc").alias("weight")), "classes")
    split = classes.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("component", (F.floor((F.col("m") - 1) / BLOCK) + 1).cast("long").alias("blocks"))
    dealt = classes.join(split, "component").withColumn("mine", F.pmod(F.xxhash64("f", "g"), F.col("blocks")))
    dealt = dealt.select("doc", *key, "weight", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = ws.save(dealt.select("doc", *key, "weight", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")), "class-tasks")
    texts = docs.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_IDS else dealt, "doc")
    num, den = plan.num, plan.den

    def count(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        fp = prints(np.concatenate(sets), n).view(np.int64)
        _, own = np.unique(np.stack([table.column(c).to_numpy() for c in ("f", "g")], axis=1), axis=0, return_index=True)
        same = (fp[0] == table.column("f").to_numpy()) & (fp[1] == table.column("g").to_numpy())
        if not same.all() or len(own) < len(n):  # rows of one id: another text, or the same again
            at = np.flatnonzero(same)
            _, first = np.unique(fp[:, at], axis=1, return_index=True)
            table, sets, n = table.take(at[first]), [sets[i] for i in at[first]], n[at[first]]
        weight, mine = (table.column(c).to_numpy() for c in ("weight", "mine"))
        left, right = np.flatnonzero(mine == group[1].as_py()), np.flatnonzero(mine == group[2].as_py())
        linked = overlaps(sets, left, right) >= Plan(num, den).needed(n[left][:, None], n[right][None, :])
        total = np.zeros(len(n), np.int64)
        if group[1] == group[2]:
            np.fill_diagonal(linked, False)
        else:
            total[right] = weight[left] @ linked
        total[left] = linked @ weight[right]
        textkit.release()
        return table.select(key).append_column("links", pa.array(total))

    sums = _sets(texts, how, [*key, "weight", "mine", "i", "j"]).groupBy("component", "i", "j").applyInArrow(count, "component long, f long, g long, links long")
    sums = ws.save(sums.groupBy(key).agg(F.sum("links").alias("links")), "class-links")
    each = rows.join(classes.select(*key, "weight"), key).join(sums, key, "left")
    return ws.save(each.groupBy("doc").agg(F.max(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counted")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each left set shares with each right one."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, slot, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc, slot = doc[times[slot] > 1], slot[times[slot] > 1]
    order = np.argsort(slot, kind="stable")
    doc, slot = doc[order], np.unique(slot[order], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(slot[-1]) + 1 if len(slot) else 0, COLUMNS):
        i, j = np.searchsorted(slot, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[doc[i:j], slot[i:j] - at] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def _prints(docs: DataFrame, how: Shingles) -> DataFrame:
    """(doc, component, f, g) of (doc, text, component): both fingerprints of the set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in textkit.slices(batch.column(1)):
                h, n = shingle_sets(texts, how)
                fp = prints(h, n).view(np.int64)
                kept = [batch.column(i).slice(row, len(n)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fp[0]), pa.array(fp[1])], names=["doc", "component", "f", "g"])

    return docs.mapInArrow(build, "doc long, component long, f long, g long")


def _labelled(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with both (ca, cb)."""
    for side in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.filter("ca <> cb")


def _merged(parts: DataFrame, links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component) after further links: only the components that they connect are worked on again."""
    joined = _labelled(links, parts)
    if joined.isEmpty():
        return parts
    joined = ws.save(joined, f"{name}-joined")
    alone = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti")
    every = parts.unionByName(alone.withColumn("component", F.col("node")))
    top = components(joined.select("ca", "cb"), ws, f"tops-{name}").select(F.col("node").alias("component"), F.col("component").alias("top"))
    return ws.save(every.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), f"parts-{name}")


def _verified(docs: DataFrame, pairs: DataFrame, parts: DataFrame | None, how: Shingles, plan: Plan, ws: Workspace, name: str) -> DataFrame:
    """Links that connect what the pairs hold apart: the pairs' stars, block by block.

    Every block holds the star's first document.
    """
    both = _labelled(pairs, parts) if parts is not None else pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    both = ws.save(both, f"{name}-pairs")
    blocks = F.greatest(F.floor((F.count(F.lit(1)) - 1) / BLOCK), F.floor(F.sum("nb") / BLOCK_SHINGLES)) + 1
    counts = both.groupBy("a").agg(blocks.cast("long").alias("blocks"), F.min("ca").alias("ca"))
    yes = F.lit(True)
    arms = both.drop("ca").join(counts.select("a", "blocks"), "a").select(F.col("b").alias("doc"), F.col("a").alias("cluster"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("task"), yes.alias("left"), yes.alias("right"), F.col("cb").alias("component"))
    hubs = counts.select(F.col("a").alias("doc"), F.col("a").alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("task"), yes.alias("left"), yes.alias("right"), F.col("ca").alias("component"))
    tasks = ws.save(arms.unionByName(hubs), f"{name}-tasks")
    found = ws.save(_linked(docs, tasks, how, plan, tasks.count() <= BROADCAST_IDS), f"{name}-links")
    ws.drop(f"{name}-pairs", f"{name}-tasks")
    return found


def _members(cells: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The leaves' members: each distinct list once (list, members), and those of large leaves by part (leaf, part, members).

    A list has about BLOCK members at most.
    """
    sized = cells.filter(F.col("m") < LARGEST).withColumn("m", F.col("m").cast("long"))
    hot = cells.filter(F.col("m") == LARGEST).select("leaf", "doc")
    sized = sized.unionByName(hot.join(hot.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")), "leaf"))
    small = sized.filter(F.col("m") <= BLOCK).groupBy("leaf").agg(F.sort_array(F.collect_set("doc")).alias("members"))
    small = small.filter(F.size("members") > 1).select("members").distinct()
    lists = ws.save(small.select(F.monotonically_increasing_id().alias("list"), "members"), "lists")
    part = F.pmod(F.xxhash64("doc"), F.floor((F.col("m") - 1) / BLOCK) + 1).cast("long")
    large = sized.filter(F.col("m") > BLOCK).groupBy("leaf", part.alias("part")).agg(F.sort_array(F.collect_set("doc")).alias("members"))
    return lists, ws.save(large, "split")


def _leaf_stars(lists: DataFrame, split: DataFrame) -> DataFrame:
    """(a, b): the least member of each leaf with the others; in a large leaf part by part, then over the parts' least ones."""
    arms = lists.select("members").unionByName(split.select("members"))
    arms = arms.select(F.col("members")[0].alias("a"), F.explode(F.expr("slice(members, 2, size(members))")).alias("b"))
    heads = split.select("leaf", F.col("members")[0].alias("b"))
    return arms.unionByName(heads.join(heads.groupBy("leaf").agg(F.min("b").alias("a")), "leaf").filter("a <> b").select("a", "b"))


def _within_leaves(lists: DataFrame, split: DataFrame, parts: DataFrame, points: DataFrame, plan: Plan, ws: Workspace) -> DataFrame:
    """Tasks (doc, cluster, task, left, right, component) of documents that share a leaf, lie in different components and pass the bound.

    Leaves of two members hold a star and no more. The others are taken together by their
    least member, since leaves with the same one have much the same members; large ones are
    where that leaves no more pairs to join. Where the
    members are not one component, those outside the largest one are joined with all,
    through the tree; a task holds OUTSIDE of the former and FAR of the latter at most, and
    a leaf of one task has each member once, whichever side it is on. Out
    come the documents of any pair that the points let pass, not the pairs: their sets
    meet in a task of their own, which returns only links that connect components.
    """
    of = parts.select(F.col("node").alias("doc"), "component")
    small = lists.filter(F.size("members") > 2).select(F.lit(0).alias("kind"), F.col("members")[0].alias("leaf"), F.explode("members").alias("doc")).distinct()
    rows = small.unionByName(split.select(F.lit(1).alias("kind"), "leaf", F.explode("members").alias("doc")))
    rows = ws.save(rows.join(of, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "grouped")
    key = ["kind", "leaf"]
    tops = ws.save(_open(rows), "open-leaves")
    large = tops.filter("kind = 1")
    together = rows.join(large.select(*key, "head"), key).select(F.lit(2).alias("kind"), F.col("head").alias("leaf"), "doc", "component").distinct()
    together = ws.save(together, "together")
    apart = large.groupBy(F.col("head").alias("leaf")).agg(F.sum(F.col("m") * F.col("out")).alias("pairs"))
    united = ws.save(_open(together).join(apart, "leaf").filter("m * out <= pairs").drop("pairs"), "united")
    alone = tops.join(united.select(F.lit(1).alias("kind"), "head"), ["kind", "head"], "left_anti")
    blocks = lambda n, most: (F.floor((F.col(n) - 1) / most) + 1).cast("long")
    parted = lambda tops: tops.select(*key, "main", blocks("out", OUTSIDE).alias("lefts"), blocks("m", FAR).alias("rights"))
    opened = ws.save(rows.join(parted(alone), key).unionByName(together.join(parted(united), key)), "opened")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    # Sides of a member: 1 outside the largest component, 2 any member, 3 both.
    sides = lambda n: F.lit(n).alias("side")
    zero = F.lit(0).cast("long")
    once = opened.filter("lefts = 1 and rights = 1").select(*key, zero.alias("i"), zero.alias("j"), "doc", "component", F.when(F.col("component") == F.col("main"), 2).otherwise(3).alias("side"))
    many = opened.filter("lefts > 1 or rights > 1")
    near = many.filter("component <> main").withColumn("i", deal("lefts")).select(*key, "i", every("rights").alias("j"), "doc", "component", sides(1))
    far = many.withColumn("j", deal("rights")).select(*key, every("lefts").alias("i"), "j", "doc", "component", sides(2))
    dealt = once.unionByName(near).unionByName(far).join(points, "doc")
    num, den = plan.num, plan.den

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(num, den)
        for table in _groups(batches, ["kind", "leaf", "i", "j"]):
            doc, comp, n, side = (table.column(c).to_numpy() for c in ("doc", "component", "n", "side"))
            left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            if len(left) and len(right):
                found = _tree_pairs(comp, n, [decoded(x) for x in table.column("vector").to_pylist()], left, right, p)
                if len(found):
                    some = table.take(pa.array(found))
                    key = [some.column(c).combine_chunks() for c in ("kind", "leaf", "i", "j")]
                    flags = [pa.array(side[found] & k > 0) for k in (1, 2)]
                    columns = [some.column("doc").combine_chunks(), *key, *flags, some.column("component").combine_chunks()]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "kind", "leaf", "i", "j", "left", "right", "component"])

    place = [*key, "i", "j"]
    met = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(join, "doc long, kind int, leaf long, i long, j long, left boolean, right boolean, component long")
    tasks = met.select("doc", F.xxhash64("kind", "leaf").alias("cluster"), F.xxhash64("i", "j").alias("task"), "left", "right", "component")
    out = ws.save(tasks, "within")
    ws.drop("grouped", "open-leaves", "together", "united", "opened")
    return out


def _open(rows: DataFrame) -> DataFrame:
    """The leaves (kind, leaf) of several components: the largest one (main), all members (m), those outside it (out) and the least one (head)."""
    key = ["kind", "leaf"]
    sizes = rows.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
    tops = sizes.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("c"), F.min("least").alias("head"))
    return tops.filter("c > 1").select(*key, F.col("main.component").alias("main"), "m", (F.col("m") - F.col("main.n")).alias("out"), "head")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with one key, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        fresh = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *fresh.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(int(c[a]) for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _tree_pairs(comp: np.ndarray, n: np.ndarray, points: list[bytes], left: np.ndarray, right: np.ndarray, plan: Plan) -> np.ndarray:
    """The rows of any pair (left, right) of different components that the bound lets pass.

    An empty point is not known and excludes nothing.
    """
    known = [x for x in points if x]
    wide = min(map(len, known), default=1)
    vectors = np.full((len(points), wide), 0xFFFF, np.uint16)
    for at in {len(x) for x in known}:
        rows = [i for i, x in enumerate(points) if len(x) == at]
        vectors[rows] = fold(np.frombuffer(b"".join(points[i] for i in rows), np.uint8).reshape(len(rows), at), wide)
    a, b = CountTree(vectors[left], n[left]), CountTree(vectors[right], n[right])
    hit = np.zeros(len(points), bool)
    for p, q in a.near_leaves(b, plan):
        p, q = left[p], right[q]
        apart = comp[p][:, None] != comp[q][None, :]
        if not apart.any():
            continue
        top = np.minimum(vectors[p][:, None, :], vectors[q][None, :, :]).sum(axis=2, dtype=np.uint32)
        ok = apart & (top >= plan.needed(n[p][:, None], n[q][None, :]))
        hit[p[ok.any(axis=1)]] = True
        hit[q[ok.any(axis=0)]] = True
    return np.flatnonzero(hit)
