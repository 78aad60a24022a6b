"""Feature matrices of sequences: k-mer shares, position one-hot, position codes, and a kernel's bandwidth."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from helixframe.functions.bases import BASES
from helixframe.operators.sampling import hash_order


def encode(texts: list[str]) -> np.ndarray:
    """Base codes, a row a string; all strings have one length."""
    table = np.full(256, 255, dtype=np.uint8)
    for i, b in enumerate(BASES):
        table[ord(b)] = i
    out = table[np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)].reshape(len(texts), -1)
    if (out == 255).any():
        raise ValueError("strings may hold A, C, G and T only")
    return out


def one_hot(codes: np.ndarray) -> np.ndarray:
    return np.eye(4)[codes]


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] - k + 1), dtype=np.int64)
    for i in range(k):
        out = out * 4 + codes[:, i : codes.shape[1] - k + 1 + i]
    return out


def kmer_names(ks: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    return ["".join(p) for k in ks for p in product(BASES, repeat=k)] + ["gc_share"]


def kmer_matrix(codes: np.ndarray, ks: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Shares of every k-mer, then of GC: 85 columns for k from 1 to 3."""
    parts = []
    for k in ks:
        w = _windows(codes, k)
        parts.append(np.stack([np.bincount(row, minlength=4**k) for row in w]) / w.shape[1] if len(w) else np.empty((0, 4**k)))
    gc = ((codes == 1) | (codes == 2)).mean(axis=1, keepdims=True) if len(codes) else np.empty((0, 1))
    return np.concatenate([*parts, gc], axis=1)


def position_matrix(codes: np.ndarray) -> np.ndarray:
    """One-hot bases and base pairs by position, then k-mer shares: 200 + 784 + 85 columns at length 50."""
    n = len(codes)
    pairs = np.eye(16)[_windows(codes, 2)]
    return np.concatenate([one_hot(codes).reshape(n, -1), pairs.reshape(n, -1), kmer_matrix(codes)], axis=1)


def position_codes(codes: np.ndarray, ks: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Active columns of the implicit one-hot design: base-4 code plus 64 times the slot."""
    parts, slot = [], 0
    for k in ks:
        w = _windows(codes, k)
        parts.append(w + 64 * np.arange(slot, slot + w.shape[1]))
        slot += w.shape[1]
    return np.concatenate(parts, axis=1)


class Standard:
    """Columns to mean 0 and population deviation 1; constant columns are left at 0."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(axis=0)
        scale = x.std(axis=0)
        self.scale = np.where(scale < 1e-12, 1.0, scale)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


def mean_squared_distance(rows: DataFrame, pairs: int, seed: int) -> float:
    """Mean squared distance of standardised k-mer features over pairs of rows in hash order: a bounded sample for a bandwidth."""
    from pyspark.sql import functions as F

    chosen = rows.select("sample_index", "sequence").orderBy(hash_order(F.col("sample_index"), seed), "sample_index").limit(2 * pairs).collect()
    x = kmer_matrix(encode([r["sequence"] for r in chosen]))
    x = Standard(x)(x)
    half = len(x) // 2
    return float(((x[:half] - x[half : 2 * half]) ** 2).sum(axis=1).mean())
