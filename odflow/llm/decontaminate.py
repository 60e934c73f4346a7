"""Benchmark decontamination: a BM25 index of the test items, queried by every passage.

The test items (cut into segments of at most ``SEGMENT`` words) are the indexed documents;
passages of the training texts are the queries.  A text's words are dealt into cells as long
as the longest segment, and two neighbouring cells are a passage, so every place where a
segment can stand lies whole in one passage.  A segment's score is its BM25 weight in the
passage's distinct words over its weight in its own, between 0 and 1.

Retrieval is block-max WAND: segments stand in blocks of ``BLOCK``, and for each word and block
that has it the index keeps the largest weight.  Summed over a passage's words these bound
every score in the block; only blocks whose bound reaches the threshold are scored.  There is
no pivot: the bounds of all blocks are summed, for many passages at once, as every segment at
or above the threshold is wanted and not the best few.

A retrieved item is confirmed on the whole text: the shares of the question's and the
answer's word shingles (and of the whole item's) that occur in the text.  The answer is the
item's last line, or the last sentence of an item of one line; the question is what comes
before.

A question or answer that leaks alone can weigh little in its segment, so a second index holds
the word shingles of every side of at least ``SIDE_WORDS`` words.  All shingles of all texts
are sought there, and every side that the confirmation accepts is a candidate, whatever its
segment scores.  Its own segments, weighed with the words' weights in all segments, are then
BM25 units too: a side that stands verbatim in a text scores 1.

The index holds at most about ``ITEMS`` items or ``INDEX_BYTES`` bytes of item text; a larger
benchmark is taken in blocks of that size, with one pass over the texts for each.  The words'
segment counts and the mean segment length are those of the whole benchmark in every block, so
scores do not depend on the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import _words
from odflow.llm._store import free_name, integer_id, written

SEGMENT, BLOCK = 128, 16
ITEMS, INDEX_BYTES = 2048, 4 << 20
#: A word in at least one of so many blocks has a row of all blocks; so many bounds are gathered at once.
DENSE, GATHER = 8, 1 << 20
K1, B = 1.2, 0.75
THRESHOLD = 0.4
WIDTH = 5
#: Confirmed if this share of all the item's shingles occurs ...
OVERLAP = 0.5
#: ... or this share of a question or answer of at least SIDE_WORDS words.
SIDE, SIDE_WORDS = 0.8, 13


def question_and_answer(text: str) -> tuple[str, str]:
    """The item's question and answer; an item of one sentence is all question."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    head, dot, tail = text.strip().rstrip(".").rpartition(". ")
    return (head + dot.strip(), tail) if dot else (text, "")


def _cut(words: np.ndarray) -> list[np.ndarray]:
    return [words[s:s + SEGMENT] for s in range(0, len(words), SEGMENT)]


def _hash_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return _words.word_hashes(*_words.buffers(pa.array(texts, pa.string())), _words.PUNCTUATED)


def _shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    return _words.unique(_words.shingles(words, np.array([0, len(words)]), width)[0])


def _shingle_sets(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """Each text's shingles with their width: ``WIDTH``, or all its words if they are fewer."""
    words, first = _hash_texts(texts)
    widths = [min(WIDTH, max(1, int(n))) for n in np.diff(first)]
    return [(w, _shingle_set(words[a:b], w)) for w, a, b in zip(widths, first[:-1], first[1:])]


class Index:
    """Block-max BM25 index of (item id, lower-cased text) pairs.

    ``whole`` has the statistics of a larger benchmark: segments, their mean length, sorted
    word hashes that hold those of the items, and the segments that hold each.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        parts = [question_and_answer(t) for _, t in items]
        self.shingles = list(zip(_shingle_sets([t for _, t in items]), _shingle_sets([q for q, _ in parts]),
                                 _shingle_sets([a for _, a in parts])))
        sides = [_hash_texts(list(p)) for p in parts]
        self.side_words = [tuple(int(n) for n in np.diff(f)) for _, f in sides]
        words, first = _hash_texts([t for _, t in items])
        segments, owner = [], []
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            cut = _cut(words[a:b])
            segments += cut
            owner += [i] * len(cut)
        order = np.argsort([len(s) for s in segments], kind="stable")
        segments = [segments[i] for i in order]
        self.owner = np.array([owner[i] for i in order], dtype=np.int64)
        self.cell = max([32, *map(len, segments)])
        self.blocks = -(-len(segments) // BLOCK)
        self.vocabulary = np.unique(words)
        term, seg, tf = [], [], []
        for i, s in enumerate(segments):
            t, n = np.unique(np.searchsorted(self.vocabulary, s), return_counts=True)
            term.append(t)
            tf.append(n)
            seg.append(np.full(len(t), i))
        if not segments:
            term, seg, tf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        term, seg, tf = map(np.concatenate, (term, seg, tf))
        length = np.array([len(s) for s in segments], dtype=float)
        df = np.bincount(term, minlength=len(self.vocabulary))
        count, mean = len(segments), max(length.mean(), 1) if len(length) else 1
        if whole is not None:
            count, mean, known, of_all = whole
            df = of_all[np.searchsorted(known, self.vocabulary)]
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[seg])
        own = np.bincount(seg, weight, minlength=len(segments))
        weight = weight / own[seg] if len(seg) else weight
        by = np.lexsort((seg, term))
        self.term, self.seg, self.weight = term[by], seg[by], weight[by]
        # One entry for each word and block that has it: its postings and its largest weight.
        key = self.term * max(self.blocks, 1) + self.seg // BLOCK
        self.key, start = np.unique(key, return_index=True)
        self.at = np.append(start, len(key))
        top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.top = top.astype(np.float32) * np.float32(1.00001)
        self.term_at = np.searchsorted(self.key, np.arange(len(self.vocabulary) + 1) * max(self.blocks, 1))
        # Words of many blocks have a row of all blocks (at most DENSE times their entries); row 0 is empty.
        many = np.flatnonzero(np.diff(self.term_at) * DENSE >= max(self.blocks, 1))
        self.row = np.zeros(len(self.vocabulary), np.int32)
        self.row[many] = np.arange(1, len(many) + 1)
        self.rows = np.zeros((len(many) + 1, self.blocks), np.float32)
        if len(many):
            r, entry = _ranges(self.term_at[many], self.term_at[many + 1])
            self.rows[r + 1, self.key[entry] % self.blocks] = self.top[entry]
        self.low = _low_bits(self.vocabulary)
        self._index_sides(sides, idf, mean)

    def _index_sides(self, sides: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float) -> None:
        """Shingles of the sides that can be confirmed alone, and their BM25 units."""
        self.side_item, self.side_size, self.side_units, runs, side = [], [], [], [], []
        for i, (words, first) in enumerate(sides):
            for j, n in enumerate(self.side_words[i]):
                if n < SIDE_WORDS:
                    continue
                shingles = self.shingles[i][1 + j][1]
                runs.append(shingles)
                side.append(np.full(len(shingles), len(self.side_item)))
                self.side_item.append(i)
                self.side_size.append(len(shingles))
                units = []
                for s in _cut(words[first[j]:first[j + 1]]):
                    t, tf = np.unique(np.searchsorted(self.vocabulary, s), return_counts=True)
                    w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
                    units.append((t, w / w.sum()))
                self.side_units.append(units)
        run = np.concatenate([np.zeros(0, _words.U), *runs])
        by = np.argsort(run, kind="stable")
        self.run_side = np.concatenate([np.zeros(0, np.int64), *side])[by]
        self.runs, at = np.unique(run[by], return_index=True)
        self.run_at = np.append(at, len(run))
        self.run_low = _low_bits(self.runs)

    def leaked_sides(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, side) where the text holds the share ``SIDE`` of the side's shingles."""
        if not len(self.runs) or not len(words):
            return []
        h, out = _words.shingles(words, first, WIDTH)
        at, run = _lookup(h, self.runs, self.run_low)
        pair = np.unique((np.searchsorted(out, at, "right") - 1) * len(self.runs) + run)
        text, run = pair // len(self.runs), pair % len(self.runs)
        row, posting = _ranges(self.run_at[run], self.run_at[run + 1])
        sides = len(self.side_item)
        key, n = np.unique(text[row] * sides + self.run_side[posting], return_counts=True)
        key = key[n / np.array(self.side_size)[key % sides] >= SIDE]
        return list(zip((key // sides).tolist(), (key % sides).tolist()))

    def side_score(self, side: int, passage: np.ndarray, term: np.ndarray) -> float:
        """The largest BM25 share of a segment of the side in one passage."""
        best = 0.0
        for t, w in self.side_units[side]:
            at = np.minimum(np.searchsorted(t, term), len(t) - 1)
            ok = t[at] == term
            if ok.any():
                best = max(best, float(np.bincount(passage[ok] - passage[0], w[at[ok]]).max()))
        return best

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that the index knows, and their numbers."""
        return _lookup(words, self.vocabulary, self.low)

    def passages(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct known words of each passage: (passage, word), and the texts' first passages."""
        n = np.diff(first)
        cells = -(-n // self.cell)
        base = np.concatenate([[0], np.cumsum(cells)])
        at, term = self.terms(words)
        text = np.searchsorted(first, at, "right") - 1
        cell = base[text] + (at - first[text]) // self.cell
        # A passage is a cell and the next one of its text; a text's last cell lies in the
        # passage before it, unless it is the only one.
        v, first_cell, last_cell = len(self.vocabulary), base[text], base[text + 1] - 1
        own = (cell < last_cell) | (cell == first_cell)
        before = cell > first_cell
        pair = _words.unique(np.concatenate([cell[own] * v + term[own], (cell[before] - 1) * v + term[before]]))
        return pair // v, pair % v, base

    def retrieve(self, words: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, segment, score) of all passages' segments at or above the threshold."""
        none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if not self.blocks or not len(words):
            return none
        passage, term, base = self.passages(words, first)
        if not len(passage):
            return none
        lo = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        hi = np.append(lo[1:], len(passage))
        out, i = [], 0
        most = max(1, GATHER // self.blocks)
        while i < len(lo):
            # As many passages as keep what is gathered bounded, one at least.
            j = max(i + 1, int(np.searchsorted(hi, lo[i] + most, "right")))
            where, block = np.nonzero(self._bounds(term[lo[i]:hi[j - 1]], lo[i:j] - lo[i]) >= threshold)
            out += [self._scores(where[k:k + 4096] + i, block[k:k + 4096], lo, hi, term, threshold)
                    for k in range(0, len(where), 4096)]
            i = j
        if not out:
            return none
        w, seg, score = map(np.concatenate, zip(*out))
        return np.searchsorted(base, passage[lo[w]], "right") - 1, seg, score

    def _bounds(self, term: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Upper bound of every score in each block, for passages whose words start at ``lo``."""
        bound = np.add.reduceat(self.rows[self.row[term]], lo, axis=0).astype(np.float64)
        few = np.flatnonzero(self.row[term] == 0)
        r, entry = _ranges(self.term_at[term[few]], self.term_at[term[few] + 1])
        passage = np.searchsorted(lo, few[r], "right") - 1
        return bound + np.bincount(passage * self.blocks + self.key[entry] % self.blocks, self.top[entry],
                                   bound.size).reshape(bound.shape)

    def _scores(self, where, block, lo, hi, term, threshold):
        row, at = _ranges(lo[where], hi[where])
        key = term[at] * self.blocks + block[row]
        entry = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = np.flatnonzero(self.key[entry] == key)
        r, posting = _ranges(self.at[entry[known]], self.at[entry[known] + 1])
        r = known[r]
        score = np.bincount(row[r] * BLOCK + self.seg[posting] % BLOCK, self.weight[posting], len(where) * BLOCK)
        hit = np.flatnonzero(score >= threshold)
        return where[hit // BLOCK], block[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]

    def hits(self, column: pa.Array, threshold: float) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item, score, overlap, question overlap, answer overlap) of the confirmed leaks."""
        words, first = _words.word_hashes(*_words.buffers(column), _words.PUNCTUATED)
        text, seg, score = self.retrieve(words, first, threshold)
        best: dict[tuple[int, int], float] = {}
        for t, s, x in zip(text.tolist(), seg.tolist(), score.tolist()):
            key = (t, int(self.owner[s]))
            best[key] = max(best.get(key, 0.0), x)
        last = -1
        for t, side in self.leaked_sides(words, first):
            if t != last:
                passage, term, _ = self.passages(words[first[t]:first[t + 1]], np.array([0, first[t + 1] - first[t]]))
                last = t
            key = (t, self.side_item[side])
            best[key] = max(best.get(key, 0.0), self.side_score(side, passage, term))
        out, last, have = [], -1, {}
        for (t, i), x in sorted(best.items()):
            if t != last:
                last, have = t, {}
            whole, q, a = (self._share(s, w, words[first[t]:first[t + 1]], have) for w, s in self.shingles[i])
            sides = any(o >= SIDE and n >= SIDE_WORDS for o, n in zip((q, a), self.side_words[i]))
            if whole >= OVERLAP or sides:
                out.append((t, i, x, whole, q, a))
        return out

    @staticmethod
    def _share(shingles: np.ndarray, width: int, words: np.ndarray, have: dict[int, np.ndarray]) -> float:
        if not len(shingles):
            return 0.0
        if width not in have:
            have[width] = _shingle_set(words, width)
        return float(np.isin(shingles, have[width]).mean())


def _low_bits(values: np.ndarray) -> np.ndarray:
    low = np.zeros(1 << 20, dtype=bool)
    low[(values & _words.U((1 << 20) - 1)).astype(np.int64)] = True
    return low


def _lookup(values: np.ndarray, known: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that are known, and their numbers among the sorted known ones."""
    at = np.flatnonzero(low[(values & _words.U((1 << 20) - 1)).astype(np.int64)])
    n = np.searchsorted(known, values[at])
    n[n == len(known)] = 0
    ok = known[n] == values[at] if len(known) else np.zeros(len(at), bool)
    return at[ok], n[ok]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers lo[i] .. hi[i] - 1: (i, number) in two arrays."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _segment_words(batches):
    """(block, word, segments with it) of each item, and its (block, null, segments, words)."""
    for batch in batches:
        words, first = _hash_texts(batch.column(1).to_pylist())
        for block, a, b in zip(batch.column(0).to_pylist(), first[:-1], first[1:]):
            cut = _cut(words[a:b])
            word, n = np.unique(np.concatenate([np.zeros(0, _words.U), *map(np.unique, cut)]), return_counts=True)
            m = len(word)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m + 1, block)), pa.array([*word.view(np.int64).tolist(), None], pa.int64()),
                 pa.array([*n.tolist(), len(cut)], pa.int64()), pa.array([0] * m + [int(b - a)], pa.int64())],
                names=["b", "w", "n", "words"])


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, with_ids: bool = True):
    """Broadcast indexes over blocks of the benchmark of bounded size."""
    if with_ids:
        integer_id(benchmark, item_col)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i") if with_ids else F.lit(0).cast("bigint").alias("i"),
                             F.lower(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // INDEX_BYTES))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("bigint"))
    whole = None
    if blocks > 1:
        per = written(items.select("b", "t").mapInArrow(_segment_words, "b bigint, w bigint, n bigint, words bigint")
                      .groupBy("b", "w").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "item-words")
        count, length = per.where("w IS NULL").agg(F.sum("n"), F.sum("words")).first()
        words = per.where("w IS NOT NULL")
        words = written(words.select("b", "w").join(words.groupBy("w").agg(F.sum("n").alias("n")), "w"), "item-words")
    for b in range(blocks):
        rows = items.where(F.col("b") == b).select("i", "t").collect()
        if blocks > 1:
            table = words.where(F.col("b") == b).select("w", "n").toArrow()
            known = table["w"].to_numpy().view(_words.U)
            by = np.argsort(known)
            whole = count, max(length / max(count, 1), 1), known[by], table["n"].to_numpy()[by]
        yield benchmark.sparkSession.sparkContext.broadcast(Index(sorted((r[0], r[1]) for r in rows), whole))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap) of every confirmed leak.

    Texts without a leak have no row.  Null texts are empty and leak nothing; a null id keeps
    its row.  Rows that repeat an id each bring their leaks.  Item ids are integers (others are
    an error); items with a null id or text are left out; an item without words matches
    nothing.  Very long texts are hashed by the megabyte and judged whole, passage by passage.
    Other columns are not read.  Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col), F.lower(text_col).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, `{item_col}` bigint, score double, overlap double, "
              "question_overlap double, answer_overlap double")
    out = None
    for shared in _indexes(benchmark, item_col, item_text_col):
        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in _words.small_batches(batch, 1):
                    found = index.hits(part.column(1), threshold)
                    cols = list(zip(*found)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0], pa.int64())),
                         pa.array([index.ids[i] for i in cols[1]], pa.int64()),
                         *(pa.array([round(x, 6) for x in c], pa.float64()) for c in cols[2:])],
                        names=[id_col, item_col, "score", "overlap", "question_overlap", "answer_overlap"])
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that leak an item; each row is judged where it lies.

    Items count whether they have an id or not.  Null and empty texts stay, repeated rows go or
    stay alike, very long texts are judged whole.  All columns, whatever their names, are passed
    through.  Empty tables give an empty result, an empty benchmark all rows.
    """
    out, lower = docs, free_name(docs, "__text")
    for shared in _indexes(benchmark, item_col, item_text_col, with_ids=False):
        names = out.columns

        def run(batches, shared=shared, names=names):
            for batch in batches:
                for part in _words.small_batches(batch, len(names)):
                    bad = [h[0] for h in shared.value.hits(part.column(len(names)), threshold)]
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[bad] = False
                    yield part.filter(pa.array(keep)).select(range(len(names)))
        out = out.select("*", F.lower(F.col(text_col)).alias(lower)).mapInArrow(run, docs.schema)
    return out
