"""Quality rules with compression bands.

Text is compressed by zstandard as a whole and in fixed chunks. Repetitive text
shrinks too much, random text too little; both limits depend on length, since short
inputs carry the frame's overhead and offer little to repeat. A document is rejected
when its whole ratio leaves its length's band, or when chunks that leave theirs hold
more than ``chunk_share`` of its bytes. Ratios are compressed bytes over raw bytes.

The base counts (words, symbols, repeated lines and repeated word windows) come from
the same pass, vectorised over the Arrow buffers.

Null or wordless text: all counts 0, rejected by the base rule (fewer words than
``min_words``). Long texts are compressed whole, never by a prefix. Repeated rows:
judged alike. Empty table: empty result. Further columns are kept by
``quality_filter`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.textkit import U64, mix


@dataclass(frozen=True)
class Bands:
    """Limits on compression ratios by length.

    Each row of ``whole`` and ``chunk`` is (least bytes, lowest ratio, highest ratio);
    the last row whose bytes are reached holds. Lengths below the first row are not judged.
    """

    whole: tuple[tuple[int, float, float], ...] = ((128, 0.20, 1.00), (512, 0.16, 0.85), (2048, 0.12, 0.74), (16384, 0.08, 0.68), (65536, 0.06, 0.66))
    chunk: tuple[tuple[int, float, float], ...] = ((1024, 0.12, 0.80),)
    chunk_bytes: int = 4096
    chunk_share: float = 0.5
    level: int = 3

    def outside(self, rows: tuple[tuple[int, float, float], ...], size: int, packed: int) -> str | None:
        """``repetitive`` or ``incompressible``, or None inside the band."""
        held = None
        for least, low, high in rows:
            if size >= least:
                held = (low, high)
        if held is None:
            return None
        ratio = packed / size
        return "repetitive" if ratio < held[0] else "incompressible" if ratio > held[1] else None

    def verdict(self, raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float | None, float, str | None]:
        """(whole ratio, share of bytes in chunks outside their band, reason to reject)."""
        if not raw:
            return None, 0.0, None
        packed = len(compressor.compress(raw))
        reason = self.outside(self.whole, len(raw), packed)
        bad = 0
        if len(raw) > self.chunk_bytes:
            for at in range(0, len(raw), self.chunk_bytes):
                piece = raw[at : at + self.chunk_bytes]
                if self.outside(self.chunk, len(piece), len(compressor.compress(piece))):
                    bad += len(piece)
        share = bad / len(raw)
        if reason is None and share > self.chunk_share:
            reason = "chunks"
        return packed / len(raw), share, reason


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(texts: textkit.Texts) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = textkit.words(texts)
    n_words = np.diff(w.first)
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[w.start] = 1
    np.add.at(inside, w.end, -1)  # a word may end where the next text's first one starts
    solid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    chars = texts.per_text(solid & ((texts.data & 0xC0) != 0x80))
    symbols = texts.per_text(_SYMBOL[texts.data])

    ln = textkit.lines(texts)
    worded = np.searchsorted(w.start, ln.end) > np.searchsorted(w.start, ln.start)
    at = np.flatnonzero(worded)
    key = texts.hash(ln.start[at], ln.end[at], textkit.OWN_SEED) ^ mix(ln.doc[at].astype(U64))
    _, firsts = np.unique(key, return_index=True)
    again = np.ones(len(at), bool)
    again[firsts] = False
    dup_lines = np.bincount(ln.doc[at[again]], minlength=len(texts))

    win, first = textkit.windows(texts.hash(w.start, w.end, textkit.OWN_SEED), w, 3)
    win = win ^ mix(w.doc[first].astype(U64) + U64(0x51))
    order = np.argsort(win, kind="stable")
    same = win[order[1:]] == win[order[:-1]]
    hit = np.zeros(len(win), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    mark = np.zeros(len(w.start), bool)
    for k in range(3):
        mark[first[hit] + k] = True
    repeat = np.bincount(w.doc[mark], minlength=len(texts))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = (*COUNTS, "base_failed", "kept", "ratio", "bad_share", "reason")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    bands: Bands = Bands(),
    keep_text: bool = False,
) -> DataFrame:
    """(id, base counts, base_failed, kept, ratio, bad_share, reason) of every row.

    With ``keep_text`` the whole row is passed on beside its verdict instead of its id; its
    own columns with the name of one of these are then called ``_own_<name>``.
    """
    clash = [c for c in VERDICT if c in docs.columns and (keep_text or c in (id_col, text_col))]
    docs = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    id_col, text_col = (f"_own_{c}" if c in clash else c for c in (id_col, text_col))
    carried = docs if keep_text else docs.select(id_col, text_col)
    names = carried.columns
    passed = [i for i, c in enumerate(names) if keep_text or c == id_col]
    prefix = ", ".join(f"`{names[i]}` {carried.schema[i].dataType.simpleString()}" for i in passed)
    schema = prefix + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, ratio double, bad_share double, reason string"
    text_at = names.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for row, texts in textkit.slices(batch.column(text_at)):
                count = base_counts(texts)
                failed = (count["n_words"] < min_words) | (100 * count["n_repeat_words"] > max_repeat_percent * count["n_words"])
                cut = texts.offsets.tolist()
                seen = [bands.verdict(texts.cut(a, b), compressor) for a, b in zip(cut, cut[1:])]
                reason = [None if f else r for f, (_, _, r) in zip(failed, seen)]
                kept = ~failed & np.array([r is None for r in reason], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(row, len(texts)) for i in passed]
                    + [pa.array(count[c].astype(np.int64)) for c in COUNTS]
                    + [
                        pa.array(failed),
                        pa.array(kept),
                        pa.array([s[0] for s in seen], pa.float64()),
                        pa.array([s[1] for s in seen], pa.float64()),
                        pa.array(["base" if f else r for f, r in zip(failed, reason)], pa.string()),
                    ],
                    names=[names[i] for i in passed] + [*COUNTS, "base_failed", "kept", "ratio", "bad_share", "reason"],
                )

    return carried.mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, **settings) -> DataFrame:
    """The rows that the rules keep, with their own columns only."""
    judged = quality_rules(docs, keep_text=True, **settings).filter("kept")
    return judged.select(*[F.col(f"`_own_{c}`" if c in VERDICT else f"`{c}`").alias(c) for c in docs.columns])
