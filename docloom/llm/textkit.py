"""Vectorised word and line hashing over Arrow string columns.

Texts are read straight from the Arrow buffers. Byte ranges are hashed eight bytes at a
time for all ranges of a batch at once, so there is no Python object per word; long ones
go to XXH3 one by one. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D,
i.e. the pattern ``[^\\x20\\x09-\\x0D]+``.

A hash has 64 bits and a seed. Tables that live in one process take OWN_SEED, drawn at
its start; what several tasks must agree on takes a seed that the driver draws for the
run. So no text can be made to collide, and among 10**7 distinct strings the chance that
any two do is below 10**-5. ``UnitTable`` also compares the bytes.
"""

from __future__ import annotations

import ctypes
import secrets
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; temporaries take about 40 bytes for each.
SLICE_BYTES = 1 << 19

#: Ranges of more bytes are hashed one by one.
LONG = 256

U64 = np.uint64
#: The seed where none is given: a hash that anyone can work out.
SEED = 0
#: The seed of tables that no other process reads.
OWN_SEED = secrets.randbits(64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def new_seed() -> int:
    """A seed for one run, to be drawn by the driver and sent to all its tasks."""
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Texts:
    """A run of texts as one byte buffer: ``data[offsets[i]:offsets[i + 1]]`` is text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._lanes = data, offsets, None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """A-Z lower-cased, other bytes as they are."""
        return Texts(_LOWER[self.data], self.offsets)

    def lane(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes from each place as one number; those from ``left`` on are 0."""
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        return self._lanes[at] & _KEEP[np.minimum(left, 8)]

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        start, size = np.asarray(start), np.asarray(end) - start
        out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed))
        short = size <= LONG
        now = slice(None) if short.all() else np.flatnonzero(short)
        at, left = start[now], size[now]
        while len(at):
            out[now] = mix(out[now] ^ self.lane(at, left))
            more = np.flatnonzero(left > 8)
            now = more if isinstance(now, slice) else now[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(~short).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[start[i] : start[i] + size[i]], seed)
        return out

    def cut(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def hash_all(names: list[bytes], seed: int) -> np.ndarray:
    """The hashes of these strings, as ``Texts.hash`` gives them."""
    ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
    starts = np.concatenate(([0], ends[:-1])) if len(names) else ends
    data = np.frombuffer(b"".join(names), np.uint8)
    return Texts(data, np.array([0, len(data)])).hash(starts, ends, seed)


class Spans(NamedTuple):
    """Byte ranges with the text each belongs to; ``first[i]:first[i + 1]`` are those of text i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def _spans(start: np.ndarray, end: np.ndarray, texts: Texts) -> Spans:
    doc = np.searchsorted(texts.offsets, start, "right") - 1
    first = np.searchsorted(start, texts.offsets)
    return Spans(start, end, doc, first)


def words(texts: Texts) -> Spans:
    """All words, in order."""
    solid = ~_SPACE[texts.data]
    edge = np.zeros(len(solid) + 1, bool)  # a text begins here or the last one ends
    edge[texts.offsets] = True
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return _spans(start, end, texts)


def lines(texts: Texts) -> Spans:
    """All pieces between newline bytes, empty ones too; a text of no bytes has one."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    start = np.sort(np.concatenate((texts.offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((breaks, texts.offsets[1:])), kind="stable")
    # Texts without bytes share their start with the next text, so positions alone do not tell them apart.
    count = 1 + texts.per_text(texts.data == 0x0A)
    first = np.concatenate(([0], np.cumsum(count)))
    return Spans(start, end, np.repeat(np.arange(len(texts)), count), first)


def windows(hashes: np.ndarray, spans: Spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows inside one text, and the index of each one's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(spans.doc[:n] == spans.doc[size - 1 :])
    out = np.zeros(len(at), U64)
    for k in range(size):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[at + k]
    return mix(out), at


# Kinds of bytes: what is no ASCII letter, digit, sign or white space is not known yet.
_LETTER, _DIGIT, _SIGN, _BLANK, _UNKNOWN = range(5)
_KIND = np.full(256, _UNKNOWN, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[39] = _UNKNOWN


def unit_starts(texts: Texts, outer: np.ndarray) -> np.ndarray:
    """First bytes of the units of all texts: ``outer`` flags, and changes between letters, digits, signs and white space.

    Pre-tokenizers that tell letters, digits and signs apart split there for certain. A run between
    ``outer`` flags with an apostrophe, or a character whose kind its bytes do not tell, is one unit.
    A space belongs to what follows it.
    """
    d = texts.data
    if not len(d):
        return np.zeros(0, np.int64)
    kind = _KIND[d]
    lead = np.flatnonzero((d >= 0xC3) & (d <= 0xC9))  # U+00C0 to U+027F are letters but for two signs
    lead = lead[lead + 1 < len(d)]
    lead = lead[(d[lead] != 0xC3) | ((d[lead + 1] != 0x97) & (d[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = _LETTER
    begin = outer.copy()
    begin[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    run = np.cumsum(begin) - 1
    whole = np.zeros(int(run[-1]) + 1, bool)
    whole[run[kind == _UNKNOWN]] = True
    split = np.zeros(len(d), bool)
    split[1:] = (kind[1:] != kind[:-1]) & (d[:-1] != 0x20)
    return np.flatnonzero(begin | split & ~whole[run])


def release() -> None:
    """Give freed memory back to the system; a worker that waits should hold none."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) for runs of rows of about SLICE_BYTES; nulls are empty texts."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, Texts(raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop
    release()


class HashTable:
    """Open-addressing map from 64-bit hashes to small integers, filled and probed in bulk.

    Its memory is fixed at creation: 16 bytes a slot. ``full()`` tells when half the
    slots are taken; the owner then clears it.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, U64)  # 0 is an empty slot; a hash of 0 is stored as 1
        self.values = np.zeros(1 << bits, np.int64)
        self.used = 0

    def full(self) -> bool:
        return self.used > len(self.keys) // 2

    def clear(self) -> None:
        self.keys[:] = 0
        self.used = 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where it is unknown."""
        h = np.maximum(h, U64(1))
        out = np.full(len(h), -1, np.int64)
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that are not in the table yet."""
        h = np.maximum(h, U64(1))
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        self.used += len(h)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = free & (self.keys[slot] == h[todo])
            self.values[slot[won]] = values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)


class UnitTable:
    """A number for each byte string that was added, found by hash and told apart by its bytes.

    Strings that share a hash with another one, or find no room, are not kept: they stay unknown.
    """

    def __init__(self, bits: int):
        self.table = HashTable(bits)
        self.values, self.begin, self.size = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool = np.zeros(1 << 16, np.uint8)
        self.n = self.bytes = 0

    def full(self) -> bool:
        return self.table.full()

    def clear(self) -> None:
        self.table.clear()
        self.n = self.bytes = 0

    def get(self, h: np.ndarray, texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each range, -1 where it is unknown."""
        row = self.table.get(h)
        hit = np.flatnonzero(row >= 0)
        own, at, left = row[hit], start[hit], end[hit] - start[hit]
        same = self.size[own] == left
        bad = [hit[~same]]
        hit, own, at, left = hit[same], own[same], at[same], left[same]
        place = self.begin[own]
        lanes = np.ndarray(len(self.pool) - 7, "<u8", self.pool, strides=(1,))
        while len(hit):
            differ = (lanes[place] & _KEEP[np.minimum(left, 8)]) != texts.lane(at, left)
            bad.append(hit[differ])
            more = np.flatnonzero(~differ & (left > 8))
            hit, place, at, left = hit[more], place[more] + 8, at[more] + 8, left[more] - 8
        out = np.where(row >= 0, self.values[np.maximum(row, 0)], -1)
        out[np.concatenate(bad)] = -1
        return out

    def put(self, h: np.ndarray, names: list[bytes], values: np.ndarray) -> None:
        """Add distinct strings; of those with one hash the first is kept."""
        _, first = np.unique(h, return_index=True)
        first = first[self.table.get(h[first]) < 0][: len(self.table.keys) // 4]
        size = np.fromiter((len(names[i]) for i in first.tolist()), np.int64, len(first))
        self._room(len(first), int(size.sum()))
        part = slice(self.n, self.n + len(first))
        self.values[part], self.size[part] = values[first], size
        self.begin[part] = self.bytes + np.cumsum(size) - size
        raw = b"".join([names[i] for i in first.tolist()])
        self.pool[self.bytes : self.bytes + len(raw)] = np.frombuffer(raw, np.uint8)
        self.table.put(h[first], np.arange(part.start, part.stop))
        self.n, self.bytes = part.stop, self.bytes + len(raw)

    def _room(self, units: int, size: int) -> None:
        if self.n + units > len(self.values):
            grow = max(self.n + units, 2 * len(self.values)) - len(self.values)
            self.values, self.begin, self.size = (np.concatenate((x, np.zeros(grow, np.int64))) for x in (self.values, self.begin, self.size))
        if self.bytes + size + 8 > len(self.pool):  # a lane may be read at the last byte
            self.pool = np.concatenate((self.pool, np.zeros(max(self.bytes + size + 8, 2 * len(self.pool)) - len(self.pool), np.uint8)))

    def rows(self, texts: Texts, start: np.ndarray, end: np.ndarray, learn) -> np.ndarray:
        """The number of every range; ``learn`` gives those of a list of unknown strings."""
        if self.full():
            self.clear()
        h = texts.hash(start, end, OWN_SEED)
        out = self.get(h, texts, start, end)
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out
        cut = lambda at: [texts.cut(a, b) for a, b in zip(start[at].tolist(), end[at].tolist())]
        new, first = np.unique(h[miss], return_index=True)
        names = cut(miss[first])
        self.put(new, names, learn(names))
        out[miss] = self.get(h[miss], texts, start[miss], end[miss])
        miss = miss[out[miss] < 0]
        if len(miss):  # no room, or a hash that another string has
            names = cut(miss)
            some = {name: i for i, name in enumerate(dict.fromkeys(names))}
            out[miss] = np.asarray(learn(list(some)))[[some[name] for name in names]]
        return out
