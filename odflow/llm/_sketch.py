"""Fast similarity sketching of shingle sets, and exact comparison of two of them (numpy)."""

from __future__ import annotations

import numpy as np

from odflow.llm._words import U, mix, seeds, unique

_MASK = U(0xFFFFFFFF)


def distinct(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats, with the new ranges."""
    parts = [unique(sh[a:b]) for a, b in zip(at[:-1], at[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else sh[:0]), np.concatenate([[0], np.cumsum(sizes)])


def fingerprints(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each whole set: equal sets have equal pairs."""
    out = []
    for salt in (U(0xA5A5A5A5A5A5A5A5), U(0x0F1E2D3C4B5A6978)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sh ^ salt))])
        out.append(mix(total[at[1:]] - total[at[:-1]] + salt).view(np.int64))
    return out[0], out[1]


def sketch(sh: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches (one row of ``bins`` values a set; an empty set gives zeros).

    Round r throws every element of a set into one hashed bin with the value r + u, u in
    [0, 1) hashed too; a bin keeps its least value.  After ``bins`` rounds, round bins + j
    offers all elements to bin j, so every bin is filled; a set takes part only until all
    its bins are, which for a large set is after the first rounds.  Two sets agree in a bin
    with the probability of their Jaccard similarity, and the agreements concentrate as
    those of independent samples do.
    """
    n = len(at) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(n * bins, empty, dtype=U)
    size = np.diff(at)
    live = np.flatnonzero(size > 0)
    salt = seeds(2 * bins, 7)
    owner, values = np.repeat(live, size[live]), sh
    for r in range(2 * bins):
        if not len(live):
            break
        h = mix(values ^ salt[r])
        if r < bins:
            b = ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
        else:
            b = np.full(len(h), r - bins, dtype=np.int64)
        np.minimum.at(out, owner * bins + b, (U(r) << U(32)) | (h & _MASK))
        open_ = (out.reshape(n, bins)[live] == empty).any(axis=1)
        if not open_.all():
            keep = np.zeros(n, dtype=bool)
            keep[live[open_]] = True
            live = live[open_]
            use = keep[owner]
            owner, values = owner[use], values[use]
    table = out.reshape(n, bins)
    table[size == 0] = 0
    return table


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` neighbouring bins; bands never share keys."""
    n, bins = table.shape
    bands = bins // rows
    cut = table[:, :bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(seeds(bands, 23), (n, bands)).copy()
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + cut[:, :, j])
    return key.view(np.int64)


def member(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` the sorted set ``b`` holds."""
    if not len(a) or not len(b):
        return np.zeros(len(a), dtype=bool)
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return b[at] == a


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
