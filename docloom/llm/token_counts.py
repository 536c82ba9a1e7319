"""Token counts by a map-side two-tier lookup.

A text's count is the sum over its units: places at which its tokenizer's pre-tokens
split for certain (between letters, digits, signs and white space; a run with an
apostrophe or a character of unknown kind is one unit). The first tier is a compact
hash table (64-bit hash to length) of the most frequent units, broadcast once; the
second is a table that each worker fills by encoding what it misses. No pre-token is
ever shuffled by its key: each task sends one bounded summary as one row.

The frequent units come from all documents: each task keeps a frequency summary of at
most ``capacity`` units (counts of evicted ones are carried as the summary's error, as
in Misra and Gries); summaries are merged in a tree of two levels, each merge as bounded
as its parts, and the driver gets one of them, whatever the number of tasks. The table
changes the speed only, never a count.

Which units hold is read from the tokenizer's file: for byte-level BPE and for patterns
that drop white space there are two tiers; sentencepiece and any other kind of file are
encoded text by text. So are texts that hold a special string, and in byte-level files
texts with white space side by side or outside ASCII.

Null text: no bytes, no tokens. Repeated rows: each is counted. Ties of frequency: the
smaller hash. Empty table: empty result. Further columns of the input are not read,
whatever their names. One text is the least unit of work: about 60 bytes of memory for
each byte of the longest.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkit, token_output
from docloom.llm.textkit import UnitTable

#: Entries of the broadcast table: a unit, its hash and its length each.
FREQUENT = 1 << 14
#: Units that a summary holds.
CAPACITY = 1 << 14
#: Summaries of the first level of merging.
MERGES = 64
#: A worker's table has 2**22 slots, 64 MB, and is cleared when half full.
CACHE_BITS = 22


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file: ``.model`` by sentencepiece, else by tokenizers."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def lengths(texts: list[str], path: str) -> np.ndarray:
    """Token counts of the texts, by the library itself."""
    if path.endswith(".model"):
        return np.fromiter(map(len, load(path).encode(texts, num_threads=1)), np.int64, len(texts))
    encoded = load(path).encode_batch_fast(texts, add_special_tokens=False)
    return np.fromiter(map(len, encoded), np.int64, len(texts))


#: What a file may say for its units to add up.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KEEPS_UNITS = ("NFC", "Lowercase", "Replace")


@functools.lru_cache(maxsize=4)
def kind(path: str) -> tuple[str, bool]:
    """("words", "bytes" or "whole", whether A-Z fold): how a file's texts fall into units."""
    if path.endswith(".model"):
        return "whole", False
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    parts = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    norms, pres = parts(said.get("normalizer"), "normalizers"), parts(said.get("pre_tokenizer"), "pretokenizers")
    if not norms and len(pres) == 1 and pres[0]["type"] == "ByteLevel" and pres[0].get("use_regex", True) and not pres[0]["add_prefix_space"]:
        return "bytes", False
    spaces = all(n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in norms if n["type"] == "Replace")
    cut = pres and pres[0]["type"] == "Split" and pres[0]["pattern"].get("Regex") == _PATTERN and pres[0]["behavior"] == "Removed" and pres[0]["invert"]
    rest = all(p["type"] == "ByteLevel" and not p.get("use_regex", True) and not p["add_prefix_space"] for p in pres[1:])
    if cut and rest and spaces and all(n["type"] in _KEEPS_UNITS for n in norms):
        return "words", any(n["type"] == "Lowercase" for n in norms)
    return "whole", False


def units(texts: textkit.Texts, path: str) -> tuple[textkit.Texts, np.ndarray, np.ndarray, np.ndarray]:
    """(texts as they are hashed, first bytes, ends, text of each unit)."""
    how, folds = kind(path)
    if folds:
        texts = texts.lower()
    if how == "bytes":
        start = textkit.unit_starts(texts, texts.data == 0x20)
        end = np.append(start[1:], len(texts.data)).astype(np.int64)
        return texts, start, end, np.searchsorted(texts.offsets, start, "right") - 1
    blank = textkit._SPACE[texts.data]
    outer = np.zeros(len(blank), bool)
    outer[1:] = blank[1:] != blank[:-1]
    start = textkit.unit_starts(texts, outer)
    end = np.append(start[1:], len(texts.data)).astype(np.int64)
    solid = ~blank[start]
    start, end = start[solid], end[solid]
    return texts, start, end, np.searchsorted(texts.offsets, start, "right") - 1


_caches: dict[str, UnitTable] = {}


def _cache(path: str) -> UnitTable:
    if path not in _caches:
        _caches[path] = UnitTable(CACHE_BITS)
    return _caches[path]


class Frequent(NamedTuple):
    """The first tier: units, their hashes by ``seed`` and their token counts."""

    seed: int
    keys: np.ndarray
    names: list[bytes]
    counts: np.ndarray

    def table(self) -> UnitTable:
        out = UnitTable(max(4, (4 * len(self.keys) + 1).bit_length()))
        out.put(self.keys, self.names, self.counts)
        return out


def count_slice(texts: textkit.Texts, path: str, frequent: UnitTable | None, seed: int = 0) -> np.ndarray:
    """Token counts of a run of texts through the two tiers."""
    odd = _odd(texts, path)
    low, start, end, doc = units(texts, path)
    use = ~odd[doc]
    start, end, doc = start[use], end[use], doc[use]
    n = frequent.get(low.hash(start, end, seed), low, start, end) if frequent is not None else np.full(len(start), -1, np.int64)
    miss = np.flatnonzero(n < 0)
    if len(miss):
        n[miss] = _cache(path).rows(low, start[miss], end[miss], lambda names: lengths([x.decode("utf-8", "replace") for x in names], path))
    total = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
    whole = np.flatnonzero(odd)
    if len(whole):
        total[whole] = lengths([texts.cut(int(texts.offsets[i]), int(texts.offsets[i + 1])).decode("utf-8", "replace") for i in whole], path)
    return total


class Summary:
    """The most frequent units of what it has seen: hashes, counts and bytes of at most ``capacity``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts, self.names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, name) -> None:
        """Add distinct units; ``name(places)`` gives their bytes, for those that are new."""
        if len(keys) > self.capacity:  # the rest is below its capacity-th count
            keep = np.argpartition(-counts, self.capacity)[: self.capacity]
            keys, counts = keys[keep], counts[keep]
        else:
            keep = np.arange(len(keys))
        order = np.argsort(self.keys)
        place = np.searchsorted(self.keys, keys, sorter=order)
        old = np.zeros(len(keys), bool)
        inside = place < len(order)
        old[inside] = self.keys[order[place[inside]]] == keys[inside]
        self.counts[order[place[old]]] += counts[old]
        names = np.empty(int((~old).sum()), object)
        names[:] = name(keep[~old])
        self.keys, self.counts, self.names = np.append(self.keys, keys[~old]), np.append(self.counts, counts[~old]), np.append(self.names, names)
        if len(self.keys) > self.capacity:
            cut = np.partition(self.counts, -self.capacity)[-self.capacity - 1]
            keep = self.counts > cut
            self.keys, self.counts, self.names = self.keys[keep], self.counts[keep] - cut, self.names[keep]

    def row(self, bucket: int) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, self.names), np.int64, len(self.names))
        packed = [self.keys.tobytes(), self.counts.tobytes(), sizes.tobytes(), b"".join(self.names)]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], names=["bucket", "keys", "counts", "sizes", "names"])


_SUMMARY = "bucket int, keys binary, counts binary, sizes binary, names binary"


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int64)).tolist()
    names = [row["names"][a:b] for a, b in zip([0, *ends], ends)]
    return np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64), names


def frequent_table(docs: DataFrame, path: str, text_col: str, size: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, token counts) of at most ``size`` frequent units of all texts."""
    found = frequent_units(docs, path, text_col, size, capacity, textkit.SEED)
    return found.keys, found.counts


def frequent_units(docs: DataFrame, path: str, text_col: str, size: int, capacity: int, seed: int) -> Frequent:
    """At most ``size`` frequent units of all texts."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(capacity)
        for batch in batches:
            for _, texts in textkit.slices(batch.column(0)):
                low, start, end, _ = units(texts, path)
                keys, first, n = np.unique(low.hash(start, end, seed), return_index=True, return_counts=True)
                own.add(keys, n, lambda at: [low.cut(a, b) for a, b in zip(start[first[at]].tolist(), end[first[at]].tolist())])
        if len(own.keys):
            yield own.row(TaskContext.get().partitionId() % MERGES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(capacity)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, names = _unpacked(batch.slice(i, 1).to_pylist()[0])
                own.add(keys, counts, lambda at: [names[i] for i in at.tolist()])
        if len(own.keys):
            yield own.row(0)

    parts = docs.select(F.col(text_col)).mapInArrow(seen, _SUMMARY).repartition(MERGES, "bucket").mapInArrow(merge, _SUMMARY)
    found = parts.coalesce(1).mapInArrow(merge, _SUMMARY).collect()
    if not found:
        return Frequent(seed, np.zeros(0, np.uint64), [], np.zeros(0, np.int64))
    keys, counts, names = _unpacked(found[0].asDict())
    top = np.lexsort((keys, -counts))[:size]
    names = [names[i] for i in top.tolist()]
    return Frequent(seed, keys[top], names, lengths([x.decode("utf-8", "replace") for x in names], path))


def token_counts(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    frequent: int = FREQUENT,
    capacity: int = CAPACITY,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    tiers = kind(path)[0] != "whole"
    sent = docs.sparkSession.sparkContext.broadcast(frequent_units(rows, path, "text", frequent, capacity, textkit.new_seed())) if tiers else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table() if tiers else None
        for batch in batches:
            for row, texts in textkit.slices(batch.column(1)):
                if tiers:
                    n = count_slice(texts, path, table, sent.value.seed)
                else:
                    cuts = texts.offsets.tolist()
                    n = lengths([texts.cut(a, b).decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(np.diff(texts.offsets)), pa.array(n), pa.array(n > max_tokens)],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)


def _odd(texts: textkit.Texts, path: str) -> np.ndarray:
    """Texts that the library must see whole."""
    if kind(path)[0] == "bytes":
        return token_output._odd(texts, path)
    out = np.zeros(len(texts), bool)
    raw = texts.data.tobytes()
    for special in token_output._specials(path):
        at = raw.find(special)
        while at >= 0:
            out[np.searchsorted(texts.offsets, at, "right") - 1] = True
            at = raw.find(special, at + 1)
    return out
