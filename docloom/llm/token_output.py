"""Token ids in wavelet-matrix shards.

A shard file holds the ids of a run of documents as a wavelet matrix: one bit-plane
for each bit of an id, most significant first; each plane lists the bit of every
token, stably partitioned by the bits above. Planes are cut into blocks that are
compressed on their own, and a directory holds each block's place and the ones before
it, so rank and select touch one block a plane. From the one file ``WaveletShard``
answers the id at a position, the count of an id in a range, the place of its k-th
occurrence, all its places, and a document's or the whole shard's ids.

Encoding goes through a cache of units: where no two white-space characters meet, a
byte-level tokenizer splits a text before every space, around other white space and
between letters, digits and signs, so a text's ids are those of its units, joined. Runs
that hold an apostrophe or a character whose kind the bytes do not tell are one unit up
to the next space. Texts with white space side by side, with white space outside ASCII
or with special strings are encoded whole. Units that the cache lacks go to the library
as one text, a line each: a line break is a token of its own there, and no unit has one.

Files are written under a temporary name and renamed, so a task that is run again
leaves the same file. A shard holds at most ``shard_tokens`` tokens and a document,
the unit of memory of both passes.

Null text: no ids but the end id. Repeated rows: each is written. Rows of equal ids are
ordered by a hash of their text, so that one id may fill many partitions. Null ids come
first. Empty table: no file, empty result. An id that ``bits`` cannot hold is an error;
by default they are as many as the vocabulary needs. Further columns are not read. One
text is the least unit of work: about 60 bytes of memory for each byte of the longest.
"""

from __future__ import annotations

import functools
import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import sharding, textkit
from docloom.llm.store import Workspace

MAGIC = b"DLWAVE01"
#: Bits of a compressed block, and tokens after which a shard is closed.
BLOCK_BITS = 1 << 18
SHARD_TOKENS = 1 << 22
#: Units that a worker's cache holds, and the ids that they may have together.
CACHE_BITS = 21
#: Units that go to the library as one text.
JOINED = 512


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_whole(texts: list[str], path: str) -> list[list[int]]:
    """Ids by the library itself, special strings handled as its default."""
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def line_break(path: str) -> int:
    """The id of a line break, where that is a token of its own between two words; else -1."""
    (one, joined, left, right) = encode_whole(["\n", "a\n b", "a", " b"], path)
    return one[0] if len(one) == 1 and joined == left + one + right else -1


def encode_units(units: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units one after the other, how many each has).

    Units go to the library JOINED at a time; those that are or end with white space alone, and all
    where the breaks do not come back as they went in, one by one.
    """
    sizes = np.zeros(len(units), np.int64)
    mark = line_break(path)
    plain = [i for i, u in enumerate(units) if mark >= 0 and u and not textkit._SPACE[u[-1]] and b"\n" not in u]
    alone = np.ones(len(units), bool)
    texts = [b"\n".join([units[i] for i in plain[k : k + JOINED]]).decode("utf-8", "replace") for k in range(0, len(plain), JOINED)]
    got: list[np.ndarray] = [np.zeros(0, np.uint32)]
    for k, found in enumerate(encode_whole(texts, path) if texts else []):
        flat = np.array(found, np.uint32)
        at = np.flatnonzero(flat == mark)
        some = plain[k * JOINED : (k + 1) * JOINED]
        if len(at) == len(some) - 1:
            alone[some] = False
            sizes[some] = np.diff(at, prepend=-1, append=len(flat)) - 1
            got.append(flat[flat != mark])
    rest = np.flatnonzero(alone)
    found = encode_whole([units[i].decode("utf-8", "replace") for i in rest.tolist()], path) if len(rest) else []
    sizes[rest] = [len(x) for x in found]
    out = np.zeros(int(sizes.sum()), np.uint32)
    single = np.repeat(alone, sizes)
    out[~single] = np.concatenate(got)
    out[single] = np.fromiter((i for one in found for i in one), np.uint32, int(sizes[rest].sum()))
    return out, sizes


@functools.lru_cache(maxsize=4)
def _specials(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in load(path).get_added_tokens_decoder().values())


class UnitCache:
    """Ids of white-space units by their bytes; cleared when it is full."""

    def __init__(self, path: str):
        self.path = path
        self.table = textkit.UnitTable(CACHE_BITS)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.units = self.ids = 0

    def rows(self, texts: textkit.Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cache row of every unit; new units are encoded."""
        if self.table.full():
            self.table.clear()
            self.units = self.ids = 0
        return self.table.rows(texts, start, end, self._learn)

    def _learn(self, names: list[bytes]) -> np.ndarray:
        flat, sizes = encode_units(names, self.path)
        self._room(len(names), len(flat))
        self.begin[self.units : self.units + len(names)] = self.ids + np.cumsum(sizes) - sizes
        self.length[self.units : self.units + len(names)] = sizes
        self.pool[self.ids : self.ids + len(flat)] = flat
        rows = self.units + np.arange(len(names))
        self.units, self.ids = self.units + len(names), self.ids + len(flat)
        return rows

    def _room(self, units: int, ids: int) -> None:
        if self.units + units > len(self.begin):
            grow = max(self.units + units, 2 * len(self.begin)) - len(self.begin)
            self.begin, self.length = (np.concatenate((x, np.zeros(grow, np.int64))) for x in (self.begin, self.length))
        if self.ids + ids > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(self.ids + ids, 2 * len(self.pool)) - len(self.pool), np.uint32)))


def _odd(texts: textkit.Texts, path: str) -> np.ndarray:
    """Texts that must be encoded whole."""
    d = texts.data
    space = textkit._SPACE[d]
    pad = np.concatenate((d, np.zeros(2, np.uint8)))
    one, two = pad[1:-1], pad[2:]
    edge = np.zeros(len(d) + 1, bool)
    edge[texts.offsets] = True
    next_space = np.concatenate((space[1:], [False])) if len(d) else space
    flags = space & next_space & ~edge[1:]
    flags |= (d >= 0x1C) & (d <= 0x1F)
    flags |= (d == 0xC2) & ((one == 0x85) | (one == 0xA0))
    flags |= (d == 0xE1) & (one == 0x9A)
    flags |= (d == 0xE2) & ((one == 0x81) | (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)))
    flags |= (d == 0xE3) & (one == 0x80)
    odd = texts.per_text(flags) > 0
    raw = None
    for special in _specials(path):
        raw = raw if raw is not None else d.tobytes()
        at = raw.find(special)
        while at >= 0:
            odd[np.searchsorted(texts.offsets, at, "right") - 1] = True
            at = raw.find(special, at + 1)
    return odd


_caches: dict[str, UnitCache] = {}


def encode_slice(texts: textkit.Texts, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, each with the end id; how many each has)."""
    cache = _caches.setdefault(path, UnitCache(path))
    odd = _odd(texts, path)
    start = textkit.unit_starts(texts, texts.data == 0x20)
    end = np.append(start[1:], len(texts.data)).astype(np.int64)
    doc = np.searchsorted(texts.offsets, start, "right") - 1
    use = ~odd[doc]
    start, end, doc = start[use], end[use], doc[use]
    row = cache.rows(texts, start, end)
    size = cache.length[row]
    count = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
    whole = np.flatnonzero(odd)
    found = encode_whole([texts.cut(int(texts.offsets[i]), int(texts.offsets[i + 1])).decode("utf-8", "replace") for i in whole], path) if len(whole) else []
    count[whole] = [len(x) for x in found]
    count += 1
    place = np.concatenate(([0], np.cumsum(count)))
    out = np.full(place[-1], end_id, np.uint32)
    total = int(size.sum())
    before = np.cumsum(size) - size
    # The k-th unit's ids go behind those of the units before it and the end ids of earlier texts.
    units_before = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64))))
    shift = np.repeat(place[doc] + before - units_before[doc] - before, size)
    source = np.repeat(cache.begin[row] - before, size) + np.arange(total)
    out[np.arange(total) + shift] = cache.pool[source]
    for i, ids in zip(whole.tolist(), found):
        out[place[i] : place[i] + len(ids)] = ids
    return out, count


def build(ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array, bits: int) -> bytes:
    """The bytes of a shard file."""
    squeeze = zstandard.ZstdCompressor(level=1)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    n = len(x)
    blocks = -(-n // BLOCK_BITS) if n else 0
    zeros, ones, sizes, payload = [], [], [], []
    for level in range(bits):
        bit = (x >> x.dtype.type(bits - 1 - level)) & x.dtype.type(1) != 0
        zeros.append(n - int(np.count_nonzero(bit)))
        for b in range(blocks):
            part = bit[b * BLOCK_BITS : (b + 1) * BLOCK_BITS]
            packed = squeeze.compress(np.packbits(part, bitorder="little").tobytes())
            ones.append(int(np.count_nonzero(part)))
            sizes.append(len(packed))
            payload.append(packed)
        x = np.concatenate((x[~bit], x[bit]))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("doc", doc_ids.type), ("n", pa.int64())])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts)], names=["doc", "n"]))
    table = squeeze.compress(sink.getvalue())
    head = struct.pack("<8sQQQQ", MAGIC, n, bits, blocks, len(table))
    return b"".join([head, np.array(zeros, "<u8").tobytes(), np.array(ones, "<u8").tobytes(), np.array(sizes, "<u8").tobytes(), table, *payload])


class WaveletShard:
    """Reads a shard file's bytes; blocks are decompressed as they are needed."""

    def __init__(self, raw: bytes):
        magic, self.n, self.bits, self.blocks, table = struct.unpack_from("<8sQQQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self._raw, at = raw, struct.calcsize("<8sQQQQ")
        cells = self.bits * self.blocks
        take = lambda k: np.frombuffer(raw, "<u8", k, at).astype(np.int64)
        self.zeros = take(self.bits)
        at += 8 * self.bits
        ones = take(cells).reshape(self.bits, self.blocks)
        at += 8 * cells
        sizes = take(cells)
        at += 8 * cells
        self._before = np.concatenate((np.zeros((self.bits, 1), np.int64), np.cumsum(ones, axis=1)), axis=1)
        self._docs = (at, table)
        self._places = at + table + np.concatenate(([0], np.cumsum(sizes)))
        self._open = zstandard.ZstdDecompressor()
        self._block = functools.lru_cache(maxsize=64)(self._load)

    @functools.cached_property
    def documents(self) -> pa.RecordBatch:
        """(doc, n) in order; n counts the end id."""
        at, size = self._docs
        return pa.ipc.open_stream(self._open.decompress(self._raw[at : at + size])).read_next_batch()

    def _load(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        cell = level * self.blocks + block
        bits = np.unpackbits(np.frombuffer(self._open.decompress(self._raw[self._places[cell] : self._places[cell + 1]]), np.uint8), bitorder="little")
        bits = bits[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]
        return bits, np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK_BITS)[0][i % BLOCK_BITS])

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        before = int(self._before[level][block])
        return before + int(self._block(level, block)[1][rest]) if rest else before

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        before = self._before[level] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self._before[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        run = self._block(level, block)[1]
        run = run if bit else np.arange(len(run)) - run
        return block * BLOCK_BITS + int(np.searchsorted(run, k - int(before[block]) + 1)) - 1

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in a range of positions."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def locate(self, symbol: int) -> list[int]:
        """All positions of an id."""
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id too."""
        n = self.documents.column("n").to_numpy()
        start = int(n[:k].sum())
        return np.array([self.access(i) for i in range(start, start + int(n[k]))], np.uint32)

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        y = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._load(level, b)[0] for b in range(self.blocks)]).astype(bool) if self.blocks else np.zeros(0, bool)
            x = np.empty(self.n, kind)
            z = int(self.zeros[level])
            x[~bit], x[bit] = y[:z], y[z:]
            x |= bit.astype(kind) << kind(self.bits - 1 - level)
            y = x
        return y.astype(np.uint32)


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    bits: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write all shards below ``folder`` (a URI that all executors reach) in ascending id order.

    Lazy: the files exist once the manifest (order, path, n_tokens, n_docs) is evaluated.
    """
    wide = bits or max(1, max(load(tokenizer_path).get_vocab_size() - 1, end_id).bit_length())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        docs_: list[pa.Array] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, counts, docs_, held, number
            n = np.concatenate(counts)
            raw = build(np.concatenate(ids), n, pa.concat_arrays(docs_), wide)
            path = f"{base}/part-{part:06d}-{number:06d}.wave"
            temporary = f"{path}.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as out:
                out.write(raw)
            files.move(temporary, path)
            row = [pa.array([part << 32 | number], pa.int64()), pa.array([path]), pa.array([held], pa.int64()), pa.array([len(n)], pa.int64())]
            ids, counts, docs_, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(row, names=["order", "path", "n_tokens", "n_docs"])

        for batch in batches:
            for row, texts in textkit.slices(batch.column(1)):
                got, n = encode_slice(texts, tokenizer_path, end_id)
                ids.append(got)
                counts.append(n)
                docs_.append(batch.column(0).slice(row, len(texts)))
                held += len(got)
                if held >= shard_tokens:
                    yield close()
        if counts:
            yield close()

    keys = ["_id", "_hash", "_row"]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    return ordered.mapInArrow(write, "order long, path string, n_tokens long, n_docs long")


def read_shards(manifest: DataFrame, folder: str, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``manifest`` has path and start, the ids before each shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_stream(path) as source:
                    shard = WaveletShard(source.read())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                n = shard.documents.column("n").to_numpy()
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [shard.documents.column("doc"), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"]
                )

    return manifest.select("path", "start").mapInArrow(read, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_output(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    bits: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
    folder: str | None = None,
) -> DataFrame:
    """Write the shards and return what reading them back gives for each document."""
    ws = Workspace(docs.sparkSession, "tokens")
    folder = folder or ws.path("shards")
    manifest = ws.save(write_shards(docs, tokenizer_path, folder, id_col, text_col, end_id, bits, shard_tokens), "manifest")
    placed = sharding.prefix_sums(manifest, "order", ["n_tokens"], 64).withColumnRenamed("before_n_tokens", "start")
    files = max(1, manifest.count())
    spread = ws.save(placed.select("order", "path", "start"), "placed").repartitionByRange(files, "order")
    return read_shards(spread, folder, docs.schema[id_col].dataType.simpleString(), id_col)
