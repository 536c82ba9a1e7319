"""Byte-level BPE encoding and decoding over overlapping chunks.

Every text is cut into chunks of ``chunk_chars`` characters that overlap by
``overlap_chars``; a text that fits is one chunk. Chunks are pre-tokenised each from its
own first character. A chunk's pre-tokens are right from the first boundary that it
shares with its (right) predecessor, since the pattern looks only ahead: two scans that
meet at a position stay together. Neighbours are stitched at such a boundary in their
overlap, and the pieces between stitches are encoded. Where an overlap holds no common
boundary (one run of letters longer than the overlap), the predecessor's scan goes on
from its last sure boundary into the next chunks until the scans meet; only what lies
between is one piece. Decoding concatenates the raw bytes of the ids.

Texts are worked on in parallel, and so are the chunks and the pieces of a text of more
than ``spread_chars`` characters: those are dealt to all tasks, which for a shorter text
would cost more than the work itself. The rows are the same either way. A row's text, its
boundaries and its ids must fit in one task, like the row itself.

Null text: encoded as empty (no ids). Repeated rows: each is encoded on its own. Null
ids are ids like others. Empty table: empty result. Further columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import Workspace

#: Characters of a chunk, and those that it shares with the next.
CHUNK_CHARS = 1 << 13
OVERLAP_CHARS = 1 << 9
#: Characters of a text from which its chunks are dealt to all tasks.
SPREAD_CHARS = 1 << 20
#: Characters that may follow a pre-token and still decide where it ends.
MARGIN = 3
#: Pieces that go to one row of the encoding step.
TOGETHER = 8


@functools.lru_cache(maxsize=4)
def load(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens; kept for the worker's life."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def vocabulary(ranks_path: str, pattern: str) -> list[bytes]:
    """The bytes of each id."""
    enc = load(ranks_path, pattern)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def encode_text(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """uint32 ids of one text."""
    return load(ranks_path, pattern).encode_to_numpy(text, disallowed_special=())


def decode_ids(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    """The raw bytes of the ids, concatenated."""
    return b"".join(map(vocabulary(ranks_path, pattern).__getitem__, ids.tolist()))


def boundaries(text: str, pattern: str, trusted_end: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk.

    Unless the chunk ends its text, the pre-tokens within MARGIN of its end are left out:
    more text might change them, as the letters do that make a sign an apostrophe's ending.
    """
    ends = [m.end() for m in regex.finditer(pattern, text)]
    if not trusted_end:
        while ends and ends[-1] > len(text) - MARGIN:
            ends.pop()
    return ends


def chunk_starts(n: int, chunk: int, overlap: int) -> list[int]:
    """First characters of the chunks of a text of n characters."""
    step = chunk - overlap
    return list(range(0, max(n - overlap, 1), step))


def stitch(ends: list[list[int]], starts: list[int], text: str, pattern: str, chunk: int) -> list[int]:
    """Where the pieces begin, plus the text's length.

    ``ends[i]`` are the boundaries of chunk i's scan, as positions in the text; a chunk's
    start counts as one of its own scan.
    """
    n, cuts, last = len(text), [0], 0  # the scan of chunk ``last`` is right from the last cut on
    for i in range(1, len(starts)):
        if i <= last:
            continue
        at = _meet(text, ends[last], ends[i], max(starts[i], cuts[-1]), starts[i])
        if at is None:
            at, i = _run_on(ends, starts, text, pattern, chunk, last, cuts[-1])
        last = i
        if at is not None and at > cuts[-1]:
            cuts.append(at)
    return [*cuts, n] if cuts[-1] < n or n == 0 else cuts


def _meet(text: str, known: list[int], other: list[int], low: int, start: int) -> int | None:
    """The first boundary from ``low`` on that both scans have; ``other`` begins at ``start``.

    A piece must not end with white space: alone, it would hide what follows the run.
    """
    found = set(other)
    found.add(start)
    return next((e for e in known[bisect.bisect_left(known, low) :] if e in found and not text[e - 1].isspace()), None)


def _run_on(ends: list[list[int]], starts: list[int], text: str, pattern: str, chunk: int, last: int, low: int) -> tuple[int | None, int]:
    """(where the right scan, carried on past chunk ``last``, meets that of a later chunk; that chunk).

    The scan goes over twice as many chunks each time, so its work is linear in the gap.
    """
    known = [e for e in ends[last] if e >= low]
    sure, step = (known[-1] if known else low), 1
    while True:
        reach = min(last + step, len(starts) - 1)
        stop = min(starts[reach] + chunk, len(text))
        scan = [sure + e for e in boundaries(text[sure:stop], pattern, stop == len(text))]
        for i in range(last + 1, reach + 1):
            at = _meet(text, scan, ends[i], starts[i], starts[i])
            if at is not None:
                return at, i
        if reach == len(starts) - 1:
            return None, reach
        step *= 2


def byte_bpe(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    spread_chars: int = SPREAD_CHARS,
) -> DataFrame:
    """Encode every text: (id, ids binary of little-endian uint32, decoded binary).

    ``chunk_chars`` must exceed twice ``overlap_chars``. The ids and decoded bytes of a
    null text are empty.
    """
    if chunk_chars <= 2 * overlap_chars:
        raise ValueError("chunk_chars must exceed twice overlap_chars")
    kept = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    several = F.coalesce(F.length("text"), F.lit(0)) > max(spread_chars, chunk_chars)

    def coded(texts: list[str]) -> list[np.ndarray]:
        return [encode_text(t, ranks_path, pattern).astype("<u4") for t in texts]

    def whole(text: str) -> np.ndarray:
        """The ids of one text, by its chunks."""
        if len(text) <= chunk_chars:
            return coded([text])[0]
        starts = chunk_starts(len(text), chunk_chars, overlap_chars)
        ends = [[s + e for e in boundaries(text[s : s + chunk_chars], pattern, s + chunk_chars >= len(text))] for s in starts]
        cuts = stitch(ends, starts, text, pattern, chunk_chars)
        return np.concatenate(coded([text[a:b] for a, b in zip(cuts, cuts[1:])]))

    def both(ids: list[np.ndarray]) -> list[pa.Array]:
        """Ids and decoded bytes as columns."""
        return [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode_ids(x, ranks_path, pattern) for x in ids], pa.binary())]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *both([whole(t or "") for t in part.column(1).to_pylist()])], names=["id", "ids", "decoded"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pre-token boundaries of each chunk, as positions in the whole text."""
        for batch in batches:
            out = [[start + e for e in boundaries(text, pattern, last)] for text, start, last in zip(*(batch.column(c).to_pylist() for c in ("chunk", "start", "last")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("start"), pa.array(out, pa.list_(pa.int32()))], names=["row", "start", "ends"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces between stitches, some of them together where they follow one another."""
        for batch in batches:
            for i in range(batch.num_rows):
                row, text, scans = (batch.column(c)[i].as_py() for c in ("row", "text", "scans"))
                scans.sort(key=lambda s: s["start"])
                cuts = stitch([s["ends"] or [] for s in scans], [s["start"] for s in scans], text, pattern, chunk_chars)
                pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
                groups = [pieces[k : k + TOGETHER] for k in range(0, len(pieces), TOGETHER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(groups), pa.int64()), pa.array(range(len(groups)), pa.int32()), pa.array(groups, pa.list_(pa.string()))], names=["row", "k", "pieces"]
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                done = np.concatenate(coded(part.column("pieces")[0].as_py()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), pa.array([done.tobytes()], pa.binary())], names=["row", "k", "ids"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), *both([np.frombuffer(part.column("ids")[0].as_py(), "<u4")])], names=["id", "ids", "decoded"])

    ws = Workspace(docs.sparkSession, "byte-bpe")
    long = ws.save(rows.filter(several).withColumn("row", F.monotonically_increasing_id()), "long")
    starts = F.sequence(F.lit(0), F.length("text") - F.lit(overlap_chars + 1), F.lit(chunk_chars - overlap_chars))
    chunks = long.select("row", "text", F.explode(starts).alias("start")).select(
        "row", "start", F.expr(f"substring(text, start + 1, {chunk_chars})").alias("chunk"), (F.col("start") + chunk_chars >= F.length("text")).alias("last")
    )
    scans = chunks.repartition("row", "start").mapInArrow(scan, "row long, start int, ends array<int>")
    gathered = scans.groupBy("row").agg(F.collect_list(F.struct("start", "ends")).alias("scans"))
    pieces = long.select("row", "text").join(gathered, "row").mapInArrow(cut, "row long, k int, pieces array<string>")
    parts = pieces.repartition("row", "k").mapInArrow(encode, "row long, k int, ids binary")
    joined = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")).select(
        "row", F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids")
    )
    coded_type = f"id {kept}, ids binary, decoded binary"
    stitched = long.select("row", "id").join(joined, "row").select("id", "ids").mapInArrow(decode, coded_type)
    return rows.filter(~several).mapInArrow(single, coded_type).unionByName(stitched).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``byte_bpe`` rows, by built-in functions."""
    return encoded.select(
        F.col(f"`{id_col}`"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
