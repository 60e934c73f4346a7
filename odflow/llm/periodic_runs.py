"""Runs of repeating words, found by extensions on a harmonic grid.

For each period q the grid holds the word numbers 0, q, 2q, ...  A run of four periods or
more covers a grid point behind which at least 2q + 1 words equal those q further, so the
common extensions of (x, x + q) to both sides give every run, at n/q queries a period and
n log n in all.  Pairs of grid points that differ in one of the next few words are left
aside at once; only texts with other pairs get the structure of ``_lce``, once forwards and
once backwards.  Each text is worked on in one task; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import _words
from odflow.llm._lce import Extensions

#: A run has so many words and so many periods at least.
WORDS, PERIODS = 6, 4
_GLANCE = 8


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte and hash (not 0) of each word as it stands, and the first word of each text."""
    starts, ends, hashes = [], [], []
    for a, b in _words.pieces(raw, offsets):
        part = raw[a:b]
        cuts = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        s, e = _words.word_spans(part, cuts)
        p, q = _words._powers(len(part) + 1, _words._CACHE)
        prefix = np.zeros(len(part) + 1, _words.U)
        np.cumsum(_words._BYTE[part] * p[:-1], out=prefix[1:])
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(_words.span_hash(prefix, q, s, e) | _words.U(1))
    cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    s = cat(starts, np.int64)
    return s, cat(ends, np.int64), cat(hashes, _words.U), np.searchsorted(s, offsets)


def _glanced(w: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, x, q): grid points behind which some words equal those q further."""
    order = np.argsort(-n, kind="stable")
    size, at = n[order], base[order]
    out = [(np.zeros(0, np.int64),) * 3]
    q = 1
    while len(size) and size[0] >= max(WORDS, PERIODS * q):
        use = int(np.searchsorted(-size, -max(WORDS, PERIODS * q), "right"))
        count = (size[:use] - 2 * q - 1) // q
        total = np.cumsum(count)
        x = np.repeat(at[:use] - q * (total - count), count) + q * np.arange(total[-1])
        x = x[w[x] == w[x + q]]
        for step in range(1, min(2 * q + 1, _GLANCE)):
            if not len(x):
                break
            x = x[w[x + step] == w[x + q + step]]
        if len(x):
            out.append((np.searchsorted(base, x, "right") - 1, x, np.full(len(x), q)))
        q += 1
    return tuple(np.concatenate(part) for part in zip(*out))


def word_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of several word sequences, by text, start, period.

    ``words`` are unsigned identities other than 0, sequence t being ``first[t]:first[t + 1]``.
    """
    n = np.diff(first)
    base = first[:-1] + np.arange(len(n))  # one word 0 behind each sequence
    w = np.zeros(len(words) + len(n), _words.U)
    w[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    text, x, q = _glanced(w, base, n)
    if not len(x):
        return (np.zeros(0, np.int64),) * 4
    # The structures hold only the texts with such pairs.
    some, pos = np.unique(text, return_inverse=True)
    size = n[some] + 1
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(some)), size)
    inner = np.arange(size.sum()) - start[owner]
    ahead = w[base[some][owner] + inner]
    back = w[base[some][owner] + np.where(inner < size[owner] - 1, size[owner] - 2 - inner, inner)]
    rel = x - base[text]
    i = start[pos] + rel
    forth = Extensions(ahead, owner).lce(i, i + q)
    keep = forth >= 2 * q + 1
    text, pos, rel, q, forth = text[keep], pos[keep], rel[keep], q[keep], forth[keep]
    j = start[pos] + size[pos] - 1 - rel
    before = Extensions(back, owner).lce(j - q, j) if len(j) else j
    begin, length = rel - before, before + q + forth
    # A run shows first at the grid point less than a period behind its start.
    keep = (before < q) & (length >= np.maximum(WORDS, PERIODS * q))
    text, begin, length, q = text[keep], begin[keep], length[keep], q[keep]
    order = np.lexsort((q, length, begin, text))
    text, begin, length, q = text[order], begin[order], length[order], q[order]
    # The same stretch under a multiple of its period is no run of its own.
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    text, begin, length, q = text[new], begin[new], length[new], q[new]
    order = np.lexsort((q, begin, text))
    return text[order], begin[order], length[order], q[order]


def _collapsed(raw, s, e, first, drop) -> pa.Array:
    """The words that stay, joined by one space, text by text."""
    keep = ~drop
    s, e = s[keep], e[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    last = np.zeros(len(s), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    out = raw.copy()
    out[e[~last]] = 32
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[s] += 1
    np.subtract.at(edge, e + ~last, 1)
    out = out[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    size = np.concatenate([[0], np.cumsum(e - s + ~last)])[at]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out))


def _batch(part: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = _words.buffers(part.column(1))
    s, e, words, first = _tokens(raw, offsets)
    text, begin, length, period = word_runs(words, first)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first[text] + begin + period, 1)
    np.subtract.at(edge, first[text] + begin + length, 1)
    runs = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(period)],
                                      names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(np.diff(first)), lists, _collapsed(raw, s, e, first, np.cumsum(edge[:-1]) > 0).cast(pa.string())],
        names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs, collapsed.

    Words are runs of bytes other than ASCII white space, told apart as they stand.  A run is
    a stretch of ``max(6, 4 * period)`` words or more that repeats with its smallest period
    and that no neighbouring word extends; ``runs`` lists (start, length, period) by start,
    then period, counted in words from 0.  ``collapsed`` holds the words that no run contains
    behind its first period, joined by one space.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``.  Ids are
    passed through, null and repeated ones too; every row is judged by itself.  Runs that
    share words are all listed.  A very long text is held whole by one task, at about 20
    bytes a byte of text.  Other columns are not read; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            for part in _words.small_batches(batch, 1):
                yield _batch(part)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                               "collapsed string")
    return out.withColumnRenamed("id", id_col)
