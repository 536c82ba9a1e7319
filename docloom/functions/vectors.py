"""Embeddings and cosines of whole Arrow batches, bit by bit those of ``scalars``."""

from __future__ import annotations

import hashlib

import numpy as np


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, added from left to right like a fold."""
    return np.cumsum(x, axis=1)[:, -1]


def hash_embeddings(texts: list[str | None], dim: int = 64) -> np.ndarray:
    """``scalars.hash_embedding`` of each text, one a row; NaN for a null."""
    raw, nulls = bytearray(), []
    rounds = -(-4 * dim // 32)
    for i, text in enumerate(texts):
        if text is None:
            nulls.append(i)
        digest = hashlib.sha256((text or "").encode()).digest()
        grown = hashlib.sha256()
        raw += digest
        for _ in range(rounds - 1):
            grown.update(digest)
            digest = grown.digest()
            raw += digest
    v = np.frombuffer(raw, ">u4").reshape(len(texts), -1)[:, :dim] / 2147483648.0 - 1.0
    norm = np.sqrt(_total(v * v))
    v = v / np.where(norm == 0, 1.0, norm)[:, None]
    v[nulls] = np.nan
    return v


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``scalars.cosine`` of the rows."""
    norms = np.sqrt(_total(a * a)) * np.sqrt(_total(b * b))
    return np.where(norms == 0, 0.0, _total(a * b) / np.where(norms == 0, 1.0, norms))
