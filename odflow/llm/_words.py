"""Word hashing over Arrow text columns, vectorised in numpy.

A word is a run of bytes other than space, tab, LF, VT, FF and CR; A-Z are lower-cased first.
Texts are cut at word limits into pieces of about a megabyte, so memory does not follow the
length of the longest text (a single word longer than a piece is kept whole).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), bijective, over unsigned words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_P) + U(salt))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = seeds(256, 17)
#: Separators for word matching that looks past punctuation: all ASCII but letters and digits.
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[128:] = False
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    if len(cache.get("p", ())) < n:
        size = max(n, PIECE + 1024)
        for key, base in (("p", _P), ("q", _PINV)):
            steps = np.full(size, U(base))
            steps[0] = U(1)
            cache[key] = np.multiply.accumulate(steps)
    return cache["p"][:n], cache["q"][:n]


class _Own(dict):
    """A process's own table: task code, which is shipped by value, takes it along empty."""

    def __reduce__(self):
        return type(self), ()


_CACHE: dict = _Own()


def pieces(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """(first byte, end byte) of pieces that end between words or at the end of a text."""
    pos, n = 0, len(raw)
    while pos < n:
        end = min(pos + PIECE, n)
        while end < n:
            gap = np.flatnonzero(space[raw[end:end + 4096]])
            nxt = offsets[np.searchsorted(offsets, end)]
            stop = min(end + int(gap[0]) if len(gap) else n, int(nxt))
            if stop <= end + 4096:
                end = stop
                break
            end = min(end + 4096, n)
        yield pos, end
        pos = end


def word_spans(part: np.ndarray, cuts: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of ``part``; no word crosses a position in ``cuts``."""
    word = ~space[part]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[cuts] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    inner = cuts[cuts > 0]
    after[inner - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def span_hash(prefix: np.ndarray, q: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of bytes s..e-1 out of a running polynomial sum."""
    return mix((prefix[e] - prefix[s]) * q[s] + (e - s).astype(U))


def prefix_sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(len(part) + 1, _CACHE)
    prefix = np.zeros(len(part) + 1, U)
    np.cumsum(_BYTE[_LOWER[part]] * p[:-1], out=prefix[1:])
    return prefix, q


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the position of its first word (plus the end)."""
    hashes, starts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in pieces(raw, offsets, space):
        part = raw[a:b]
        cuts = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        s, e = word_spans(part, cuts, space)
        prefix, q = prefix_sums(part)
        hashes.append(span_hash(prefix, q, s, e))
        starts.append(s + a)
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(at, offsets)


_ORDER = seeds(64, 99) | U(1)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, and each text's range in them.

    A text with fewer words than that, but at least one, has its whole sequence as one.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + (np.arange(out[-1]) - out[:-1][text])
    size = np.minimum(n, width)[text]
    h = size.astype(U) * U(_P)
    for j in range(width):
        use = size > j
        if use.all():
            h = h + mix(words[at + j] + _ORDER[j])
        else:
            h[use] += mix(words[at[use] + j] + _ORDER[j])
        h = h * _ORDER[width + j]
    return mix(h), out


def unique(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def small_batches(batch: pa.RecordBatch, column: int, limit: int = 3 << 20):
    """Slices of a batch with about ``limit`` bytes of text each (one row at least)."""
    _, offsets = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
