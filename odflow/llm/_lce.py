"""Longest common extensions of word sequences over a difference cover (numpy).

Only positions whose residue lies in the cover are sorted.  A query compares the few words
up to the next offset at which both positions are sampled, and reads the rest from a
sparse table of minima over the sorted samples.  Several sequences lie in one array, each
followed by the word 0; queries are for two positions of one sequence.
"""

from __future__ import annotations

import numpy as np

from odflow.llm._words import U, mix, seeds

#: A perfect difference set; every residue modulo 13 is a difference of two of its members.
MODULUS = 13
COVER = (0, 1, 3, 9)

_IN = np.isin(np.arange(MODULUS), COVER)
#: For residues i and j the least offset that brings both into the cover.
_OFFSET = np.array([[next(d for d in range(MODULUS) if _IN[(i + d) % MODULUS] and _IN[(j + d) % MODULUS])
                     for j in range(MODULUS)] for i in range(MODULUS)])
_CLASS = np.cumsum(_IN) - 1


class Extensions:
    """LCE structure of ``words`` (unsigned, 0 only behind each sequence) with sequence numbers ``text``."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        v, n = MODULUS, len(words)
        self.words = np.concatenate([words, np.zeros(3 * v, U)])
        self.per = n // v + 1
        at = (np.array(COVER)[:, None] + v * np.arange(self.per)[None, :]).ravel()
        self.names = self._names(at, np.concatenate([text, np.full(3 * v, -1, text.dtype)]))
        order = np.argsort(self.names[-1][:-1], kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        self.table = self._minima(self._neighbours(order))

    def _names(self, at: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        """Ranks of runs of 1, 2, 4, ... blocks of ``MODULUS`` words at the samples, until all differ."""
        order = seeds(MODULUS, 41) | U(1)
        h = text[at].astype(U)
        for j in range(MODULUS):
            h = mix(h * order[j] + self.words[at + j])
        out = []
        while True:
            kinds, name = np.unique(h, return_inverse=True)
            out.append(np.append(name + 1, 0))  # the last place stands for all behind the end
            if len(kinds) == len(at) or 1 << len(out) > 2 * len(at):
                return out
            behind = np.minimum(np.arange(len(at)) + (1 << (len(out) - 1)), len(at))
            h = (out[-1][:-1].astype(U) << U(32)) | out[-1][behind].astype(U)

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common blocks of each sample and its predecessor in the order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        last = len(order)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            same = name[np.minimum(a, last)] == name[np.minimum(b, last)]
            step = same.astype(np.int64) << level
            common += step
            a += step
            b += step
        return common

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common blocks of two samples (positions)."""
        r = self.rank[_CLASS[i % MODULUS] * self.per + i // MODULUS]
        s = self.rank[_CLASS[j % MODULUS] * self.per + j // MODULUS]
        lo, hi = np.minimum(r, s), np.maximum(r, s)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            use = level == k
            out[use] = np.minimum(self.table[k][lo[use]], self.table[k][hi[use] - (1 << int(k))])
        return out

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` at the most."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        step = 0
        while len(live):
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            step += 1
            out[live] = step
            live = live[most[live] > step]
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from positions i < j of one sequence on."""
        near = _OFFSET[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, near)
        far = np.flatnonzero(out == near)
        a, b = i[far] + near[far], j[far] + near[far]
        blocks = MODULUS * self._sampled(a, b)
        rest = self._compared(a + blocks, b + blocks, np.full(len(far), MODULUS))
        out[far] += blocks + rest
        return out
