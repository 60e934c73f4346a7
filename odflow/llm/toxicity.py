"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the embeddings of four hash buckets: the word, its first
three and first five bytes and its last four, so that words of one stem share a part.
Filters of widths 1, 2 and 3 run over a text's embeddings; each filter's largest value over
the whole text (max pooling) enters a logistic output.  Only a filter's best position
carries gradient.  Bucket embeddings start from the bucket's smoothed log-odds in their
first dimension; buckets that training never saw stay zero, so unseen words do not score.

Training uses every labelled row, whatever its length.  Rows are dealt by a hash of their id: a
quarter calibrates, the others train in shards of about ``SHARD_ROWS`` rows (of up to
``MOST_ROWS`` beyond ``SHARDS`` of them).  Bucket counts are summed over all shards.  In each
epoch every shard goes on from the common model over its own rows, batch by batch; the weights
become the mean over the shards by their rows, a bucket's embedding the mean over the shards that
changed it.  Only such changes move, and the driver holds the model alone.  The calibration rows,
drawn as labels come, turn the output into a probability by sums over all of them, and give each
language the threshold of its best F1 from counts of all their scores (of six digits); a language
with fewer than ``SUPPORT`` toxic calibration rows takes the threshold of all rows.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import _words
from odflow.llm._store import written

TRAIN_ROWS, CALIBRATE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 2500, 4000, 48 << 20, 1 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 16, (1, 2, 3)
EPOCHS, BATCH, SUPPORT = 6, 48, 20
SHARD_ROWS, SHARDS, MOST_ROWS, CHUNK = 3000, 64, 16384, 1024
WORDS_AT_ONCE = 1 << 16


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) bucket numbers of lower-cased texts, and each text's first word."""
    raw, offsets = _words.buffers(column)
    found, starts = [np.zeros((0, 4), np.int32)], [np.zeros(0, np.int64)]
    for a, b in _words.pieces(raw, offsets, _words.PUNCTUATED):
        part = raw[a:b]
        cuts = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        s, e = _words.word_spans(part, cuts, _words.PUNCTUATED)
        prefix, q = _words.prefix_sums(part)
        spans = ((s, e), (s, np.minimum(s + 3, e)), (s, np.minimum(s + 5, e)), (np.maximum(e - 4, s), e))
        rows = np.empty((len(s), 4), np.int32)
        for j, (x, y) in enumerate(spans):
            h = _words.span_hash(prefix, q, x, y) + _words.seeds(4, 31)[j]
            rows[:, j] = _words.mix(h) & _words.U(BUCKETS - 1)
        found.append(rows)
        starts.append(s + a)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), offsets)


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    filters: list = field(default_factory=list)      # per width: (width, DIM, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    shift: float = 0.0
    scale: float = 1.0
    base: float = 0.0
    constant: float | None = None
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.3

    def embed(self, rows: np.ndarray) -> np.ndarray:
        x = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x += self.table[rows[:, j]]
        return x

    def responses(self, x: np.ndarray, ends: np.ndarray):
        """Each width's filter responses at every word; a filter sees zeros past its text."""
        for k, w in enumerate(self.filters):
            y = x @ w[0]
            for j in range(1, len(w)):
                if len(x) > j:
                    z = x[j:] @ w[j]
                    for back in range(j):       # windows that begin so near a text's end
                        at = ends - 1 - back
                        z[at[(at >= 0) & (at < len(z))]] = 0
                    y[:-j] += z
            yield k, y

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each whole text (zero without words)."""
        n = len(first) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        seen = np.zeros(n, bool)
        ahead = max(WIDTHS) - 1
        for a in range(0, len(rows), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(rows))
            t0, t1 = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
            texts = np.arange(t0, t1)
            texts = texts[first[texts + 1] > first[texts]]
            ends = first[texts + 1] - a
            x = self.embed(rows[a:b + ahead])
            starts = np.maximum(first[texts] - a, 0)
            for k, y in self.responses(x, ends):
                top = np.maximum.reduceat(y[:b - a], starts, axis=0)
                cut = slice(k * FILTERS, (k + 1) * FILTERS)
                out[texts, cut] = np.where(seen[texts, None], np.maximum(out[texts, cut], top), top)
            seen[texts] = True
        return out

    def margin(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, first) + self.bias, 0) @ self.out + self.base

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        m = self.margin(*buckets(column)).astype(float)
        return np.round(_sigmoid(self.scale * m + self.shift), 6)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _texts(found: tuple[np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, first = found
    n = first[which + 1] - first[which]
    at = np.repeat(first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return rows[at], np.concatenate([[0], np.cumsum(n)])


def _started(pos: np.ndarray, neg: np.ndarray, toxic: int, other: int, seed: int = 11) -> Model:
    """The model before training, from the number of texts of either class with each bucket."""
    rng = np.random.default_rng(seed)
    model = Model()
    pos, neg = pos + 2.0, neg + 2.0
    seen = pos + neg > 4
    odds = np.log(pos / (toxic + 4)) - np.log(neg / (other + 4))
    model.table[seen] = rng.normal(0, 0.02, (int(seen.sum()), DIM))
    model.table[seen, 0] = 0.25 * odds[seen]
    for w in WIDTHS:
        f = rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32)
        f[:, 0] = np.abs(f[:, 0]) + 0.2
        model.filters.append(f)
    model.out = np.abs(rng.normal(0, 0.2, len(WIDTHS) * FILTERS)).astype(np.float32)
    model.base = -1.0
    return model


class _State:
    """A model in training: its weights, the squares seen by the embeddings, and Adam's moments."""

    def __init__(self, model: Model):
        self.model, self.seen_sq, self.steps = model, np.zeros(BUCKETS), 0
        self.adam = [[np.zeros(q.shape), np.zeros(q.shape)] for q in (*model.filters, model.bias, model.out, np.zeros(1))]

    def weights(self) -> np.ndarray:
        """Everything but the embeddings, as one vector."""
        m = self.model
        parts = [*m.filters, m.bias, m.out, np.array([m.base, self.steps]), *[x for pair in self.adam for x in pair]]
        return np.concatenate([np.ravel(x).astype(float) for x in parts])

    def take(self, vector: np.ndarray) -> None:
        m, at = self.model, 0

        def cut(like):
            nonlocal at
            at += like.size
            return vector[at - like.size:at].reshape(like.shape).astype(like.dtype)

        m.filters = [cut(f) for f in m.filters]
        m.bias, m.out = cut(m.bias), cut(m.out)
        base, steps = cut(np.zeros(2))
        m.base, self.steps = float(base), round(float(steps))
        self.adam = [[cut(x) for x in pair] for pair in self.adam]


def _best(model: Model, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each text, and the word where it begins."""
    n, size, ahead = len(first) - 1, len(WIDTHS) * FILTERS, max(WIDTHS) - 1
    pooled, best, seen = np.zeros((n, size), np.float32), np.zeros((n, size), np.int64), np.zeros(n, bool)
    every = np.arange(FILTERS)
    for a in range(0, len(rows), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, len(rows))
        texts = np.arange(np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left"))
        texts = texts[first[texts + 1] > first[texts]]
        starts, stops = np.maximum(first[texts] - a, 0), np.minimum(first[texts + 1], b) - a
        for k, r in model.responses(model.embed(rows[a:b + ahead]), first[texts + 1] - a):
            cut = slice(k * FILTERS, (k + 1) * FILTERS)
            for t, s, e in zip(texts, starts, stops):
                at = r[s:e].argmax(axis=0)
                top = r[s:e][at, every]
                more = top > pooled[t, cut] if seen[t] else np.ones(FILTERS, bool)
                pooled[t, cut] = np.where(more, top, pooled[t, cut])
                best[t, cut] = np.where(more, at + s + a, best[t, cut])
        seen[texts] = True
    return pooled, best


def _step(state: _State, rows, first, y) -> np.ndarray:
    """One batch; returns the buckets whose embeddings changed."""
    model, n = state.model, len(y)
    full = np.flatnonzero(np.diff(first) > 0)
    state.steps += 1
    pooled, best = _best(model, rows, first)
    z = pooled + model.bias
    act = np.maximum(z, 0)
    err = (_sigmoid(act @ model.out + model.base) - y) / n
    d_out, d_base = act.T @ err, np.array([err.sum()])
    d_act = np.outer(err, model.out) * (z > 0)
    d_bias = d_act.sum(axis=0)
    grads, touched, flow = [], [], []
    has = np.isin(np.arange(n), full)
    for k, w in enumerate(model.filters):
        g = np.zeros_like(w)
        cut = slice(k * FILTERS, (k + 1) * FILTERS)
        d, at = d_act[:, cut] * has[:, None], best[:, cut]
        for j in range(len(w)):
            live = np.where(at + j < first[1:, None], d, 0)
            x = model.embed(rows[np.minimum(at + j, len(rows) - 1)].reshape(-1, 4)) if len(rows) else np.zeros((n * FILTERS, DIM), np.float32)
            g[j] = np.einsum("tfd,tf->df", x.reshape(n, FILTERS, DIM), live)
            t, f = np.nonzero(live)
            touched.append(at[t, f] + j)
            flow.append(w[j].T[f] * live[t, f][:, None])
        grads.append(g)
    p, v = np.concatenate(touched), np.concatenate(flow)
    ids = np.zeros(0, np.int64)
    if len(p):
        flat = rows[p].ravel()
        order = np.argsort(flat, kind="stable")
        ids, starts = np.unique(flat[order], return_index=True)
        g = np.add.reduceat(np.repeat(v, 4, axis=0)[order], starts)
        state.seen_sq[ids] += (g * g).mean(axis=1)
        model.table[ids] -= (0.05 * g / np.sqrt(state.seen_sq[ids] + 1e-8)[:, None]).astype(np.float32)
    params = [*model.filters, model.bias, model.out]
    base = np.array([model.base])
    for q, g, (m, s) in zip([*params, base], [*grads, d_bias, d_out, d_base], state.adam):
        g = g + 1e-4 * q
        m *= 0.9
        m += 0.1 * g
        s *= 0.999
        s += 0.001 * g * g
        q -= (0.01 * (m / (1 - 0.9 ** state.steps)) / (np.sqrt(s / (1 - 0.999 ** state.steps)) + 1e-8)).astype(q.dtype)
    model.base = float(base[0])
    return ids


_PART = "chunk int, ids binary, data binary"


def _parts(ids: np.ndarray, data: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
    """Numbers (a row of ``data`` for each id), cut by chunk: what a shard says of a few buckets."""
    order = np.argsort(chunk, kind="stable")
    names, starts = np.unique(chunk[order], return_index=True)
    pieces = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), pa.array([ids[x].astype(np.int32).tobytes() for x in pieces], pa.binary()),
         pa.array([data[x].astype(np.float32).tobytes() for x in pieces], pa.binary())], names=["chunk", "ids", "data"])


def _read_parts(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int32)
    return ids, np.frombuffer(b"".join(table["data"].to_pylist()), np.float32).reshape(len(ids), width).astype(float)


def _summed(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards' numbers added up by chunk, on the driver as (ids, data): as large as the model."""

    def add(table):
        ids, data = _read_parts(table, width)
        own, inverse = np.unique(ids, return_inverse=True)
        total = np.zeros((len(own), width))
        order = np.lexsort((*data.T, inverse))      # the same sum whatever the order of arrival
        np.add.at(total, inverse[order], data[order])
        return pa.Table.from_batches([_parts(own, total, np.full(len(own), table["chunk"][0].as_py()))])

    return _read_parts(parts.groupBy("chunk").applyInArrow(add, _PART).toArrow(), width)


def _each(batches):
    """(shard, texts' buckets, labels) of slices of a shard's training rows."""
    for batch in batches:
        for part in _words.small_batches(batch, batch.schema.get_field_index("text"), 1 << 20):
            shard = part.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if b > a:
                    piece = part.slice(a, b - a)
                    yield int(shard[a]), buckets(piece.column("text")), piece.column("y").to_numpy().astype(np.int64)


def _counted(batches):
    """Number of texts of either class with each bucket, for each shard's part in a task."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _, (rows, first), y in _each(batches):
        for a, b, label in zip(first[:-1], first[1:], y):
            (pos if label else neg)[np.unique(rows[a:b])] += 1
    ids = np.flatnonzero(pos + neg)
    if len(ids):
        yield _parts(ids, np.stack([pos[ids], neg[ids]], 1), ids // CHUNK)


def _epoch(rows: DataFrame, state: _State, epoch: int) -> None:
    """Every shard goes on from ``state`` over its rows; ``state`` becomes the mean."""
    shared = rows.sparkSession.sparkContext.broadcast(state)
    width = DIM + 2

    def done(own, touched, n):
        """Rows times (1, change of the embedding, change of the squares) of the buckets that changed."""
        ids = np.flatnonzero(touched)
        start = shared.value
        data = np.column_stack([np.ones(len(ids)), own.model.table[ids] - start.model.table[ids], own.seen_sq[ids] - start.seen_sq[ids]])
        yield _parts(ids, n * data, ids // CHUNK)
        vector = own.weights() - start.weights()
        data = np.zeros((len(vector), width))
        data[:, 0], data[:, 1] = 1, vector
        yield _parts(BUCKETS + np.arange(len(vector)), n * data, np.full(len(vector), -1))  # behind the buckets

    def run(batches):
        now, own, touched, n = None, None, None, 0
        for shard, found, y in _each(batches):
            if shard != now:
                if n:
                    yield from done(own, touched, n)
                now, n, own = shard, 0, copy.deepcopy(shared.value)
                touched, rng = np.zeros(BUCKETS, bool), np.random.default_rng([11, epoch, shard])
            order = rng.permutation(len(y))
            for i in range(0, len(order), BATCH):
                which = order[i:i + BATCH]
                touched[_step(own, *_texts(found, which), y[which])] = True
            n += len(y)
        if n:
            yield from done(own, touched, n)

    ids, data = _summed(rows.mapInArrow(run, _PART), width)
    shared.destroy()
    weights, (ids, data) = data[ids >= BUCKETS], (ids[ids < BUCKETS], data[ids < BUCKETS])
    state.model.table[ids] += (data[:, 1:DIM + 1] / data[:, :1]).astype(np.float32)
    state.seen_sq[ids] += data[:, DIM + 1] / data[:, 0]
    state.take(state.weights() + weights[:, 1] / weights[:, 0])  # a chunk, so in order


def calibrate(model: Model, rows: DataFrame, prior: float = 1e-2) -> None:
    """Platt scaling on rows (text, lang, y) drawn as they come, then a threshold for each language.

    Both use every row: Newton's steps take sums over the rows' margins, the thresholds counts
    of rows and hits by language and score, at most a million and one scores a language.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in _words.small_batches(batch, 0, 1 << 20):
                m = shared.value.margin(*buckets(part.column(0))).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(m, pa.float64())], names=["lang", "y", "m"])

    table = written(rows.select("text", F.coalesce("lang", F.lit("None")).alias("lang"), "y").mapInArrow(
        run, "lang string, y int, m double"), "margins", 1 << 20)
    shared.destroy()
    model.scale, model.shift = _platt(table, prior)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.scale * F.col("m") + model.shift))
    scores = table.select("lang", "y", F.bround(1 / (1 + F.exp(-z)), 6).alias("score"))
    counts = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")]
    model.threshold = _best_threshold(scores.groupBy("score").agg(*counts).toArrow(), 0.3)
    enough = [r.lang for r in scores.groupBy("lang").agg(*counts).where((F.col("hits") >= SUPPORT) & (F.col("n") - F.col("hits") >= SUPPORT)).collect()]
    for lang in sorted(enough):
        found = scores.where(F.col("lang") == lang).groupBy("score").agg(*counts).toArrow()
        model.thresholds[lang] = _best_threshold(found, model.threshold)


def _platt(table: DataFrame, prior: float) -> tuple[float, float]:
    """Scale and shift of the margins ``m`` for the labels ``y``, by sums over all rows."""
    a, b, m, y = 1.0, 0.0, F.col("m"), F.col("y")
    for _ in range(50):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * m + b))
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p) + 1e-9
        n, *sums = table.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(x), F.lit(0.0)) for x in ((p - y) * m, p - y, w * m * m, w * m, w)]).first()
        g = np.array([sums[0] + prior * n * 0.01 * (a - 1), sums[1]])
        h = np.array([[sums[2] + prior * n * 0.01, sums[3]], [sums[3], sums[4]]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return round(float(max(a, 0.05)), 9), round(float(b), 9)


def _best_threshold(counts: pa.Table, otherwise: float) -> float:
    """The middle of the score gap at the best F1, from rows ``n`` and ``hits`` of each score."""
    counts = counts.sort_by([("score", "descending")])
    s, n, hit = (counts[c].to_numpy().astype(float) for c in ("score", "n", "hits"))
    n, hit = np.cumsum(n), np.cumsum(hit)
    if not len(s) or not hit[-1]:
        return otherwise
    k = int(np.argmax(2 * hit / (n + hit[-1])))
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(round((s[k] + below) / 2, 6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        label_col: str = "toxic") -> Model:
    """Train and calibrate on all labelled rows.

    Labels with a null id or label are left out; of several labels of an id the largest
    counts, of several documents the largest text and language.  Without rows of both classes
    the score is the share of toxic labels (0 without any label).
    """
    own = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
           .withColumn("h", F.xxhash64("id", F.lit(42))))
    n, toxic = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return Model(constant=float(toxic) / n if n else 0.0)
    rows = _labelled(docs, own, n, id_col, text_col, lang_col)
    train = rows.where("part = 1").select("text", "shard", "y")
    learn, bad = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not bad or bad == learn:
        return Model(constant=float(toxic) / n)
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    ids, data = _summed(train.mapInArrow(_counted, _PART), 2)
    pos[ids], neg[ids] = data.T
    state = _State(_started(pos, neg, bad, learn - bad))
    for epoch in range(EPOCHS):
        _epoch(train, state, epoch)
    calibrate(state.model, rows.where("part = 0"))
    return state.model


def _labelled(docs: DataFrame, own: DataFrame, n: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Every row of the labels ``own`` (id, y, h; ``n`` of them) that has a document, written by shards:
    text, lang, y, part (0 calibrates), h, id, shard."""
    shards = max(min(-(-n // SHARD_ROWS), SHARDS), -(-n // MOST_ROWS))
    # Of all texts only those with a label need to move: a bitmap over a hash of the labelled ids
    # (16 bits for each) leaves out nearly all others, the grouping by id the rest.
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(45)), F.lit(16 * n)) + 1
    bitmap = (own.select(F.bitmap_bucket_number(bit("id")).alias("bucket"), F.bitmap_bit_position(bit("id")).alias("at"))
              .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumns(
        {"bucket": F.bitmap_bucket_number(bit("id")), "at": F.bitmap_bit_position(bit("id"))})
    there = F.expr("shiftright(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) % 2 = 1")
    texts = texts.join(F.broadcast(bitmap), "bucket").where(there).select("id", F.lower("text").alias("text"), "lang", F.lit(1).alias("doc"))
    both = texts.unionByName(own.select("id", "y", "h"), allowMissingColumns=True)
    both = both.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(44)), F.lit(shards)).cast("int")).repartition(8 * shards, "shard")  # so few shards share a task
    rows = (both.groupBy("shard", "id").agg(*(F.max(c).alias(c) for c in ("text", "lang", "y", "h", "doc")))
            .where("y IS NOT NULL AND doc = 1")
            .withColumn("part", F.when(F.pmod(F.xxhash64("id", F.lit(43)), F.lit(4)) == 0, 0).otherwise(1)))
    return written(rows.sortWithinPartitions("shard", "h", "id").select("text", "lang", "y", "part", "h", "id", "shard"), "labelled")


def _sample(docs: DataFrame, own: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A bounded sample of the labels ``own`` (id, y, h) to look at: text, lang, y, part (0 calibrates), h, id.

    :func:`fit` and the queries do not use it; they learn from all labelled rows.
    """
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
             .withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
             .where(F.col("bytes") <= TEXT_BYTES))
    # The rows are chosen by lengths alone, before any text moves.
    sized = written(own.join(texts.groupBy("id").agg(F.max("bytes").alias("bytes")), "id")
                    .select("id", "y", "h", "bytes"), "labelled")
    calibration = F.pmod(F.xxhash64("id", F.lit(43)), F.lit(4)) == 0
    picks = [sized.where(calibration).orderBy("h", "id").limit(CALIBRATE_ROWS).withColumn("part", F.lit(0))]
    picks += [sized.where(~calibration & (F.col("y") == v)).orderBy("h", "id").limit(TRAIN_ROWS * (2 - v)).withColumn("part", F.lit(1))
              for v in (0, 1)]
    picked = picks[0].unionByName(picks[1]).unionByName(picks[2])
    # At most CALIBRATE_ROWS + 3 * TRAIN_ROWS ids go on.  Four classes and parts: each may take a
    # text more than its share of the bytes, which the share makes room for.
    room = max(SAMPLE_BYTES - 4 * TEXT_BYTES, 0)
    group = "PARTITION BY part, y"
    picked = (picked.withColumn("upto", F.expr(f"sum(bytes) OVER ({group} ORDER BY h, id)"))
              .withColumn("own", F.expr(f"sum(bytes) OVER ({group})")).withColumn("all", F.expr("sum(bytes) OVER ()"))
              .where((F.col("all") <= SAMPLE_BYTES) | (F.col("upto") <= TEXT_BYTES + F.col("own") * (room / F.greatest("all", F.lit(1)))))
              .select("id", "y", "h", "part"))
    return (texts.join(F.broadcast(picked), "id").groupBy("id").agg(*(F.max(c).alias(c) for c in ("text", "lang", "y", "h", "part")))
            .select(F.lower("text").alias("text"), "lang", "y", "part", "h", "id"))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """One row per document: id, score, threshold, rejected.

    ``score`` (0 to 1, six digits) depends on the whole text alone; ``threshold`` is that of
    the row's language (all rows' for a null or unknown one) and ``rejected`` is
    score >= threshold.  Null and empty texts, and texts without words, all get the score of
    the empty text.  Rows that repeat an id are scored one by one.
    """
    rows = docs.select(F.col(id_col), F.col(lang_col).alias("__lang"), F.lower(text_col).alias("__text"))
    return _scored(rows, model, 1, 2, [0], rows.schema[0].dataType.simpleString(), id_col)


def _scored(rows, model, lang_at, text_at, keep, kind, id_col):
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in _words.small_batches(batch, text_at, 1 << 20):
                score = m.score(part.column(text_at))
                least = np.array([m.thresholds.get(str(x), m.threshold) for x in part.column(lang_at).to_pylist()], float)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array(least), pa.array(score >= least)],
                    names=[id_col, "score", "threshold", "rejected"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, threshold double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n, lang_at = len(docs.columns), docs.columns.index(lang_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in _words.small_batches(batch, n, 1 << 20):
                least = np.array([m.thresholds.get(str(x), m.threshold) for x in part.column(lang_at).to_pylist()], float)
                keep = m.score(part.column(n)) < least
                yield part.filter(pa.array(keep)).select(range(n))

    return docs.select("*", F.lower(F.col(text_col)).alias("__text")).mapInArrow(run, docs.schema)
