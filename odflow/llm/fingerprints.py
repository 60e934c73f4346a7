"""Document fingerprints: a quartile bucket digest over hashed byte triplets.

Each byte of a text opens a window of five; the six triplets that hold the window's first
byte are hashed into 256 buckets.  A bucket's code is the quartile of its count among all
buckets (two bits); the digest is the text's length on a logarithmic scale, two ratios of
the quartiles and the 256 codes, 66 bytes in hex.  Digests are compared by a difference
score over codes and header; ``BOUND``, the mean difference of independent codes, or more
counts as wholly different.

A text is digested where it is read.  Where a text's neighbour in an order is needed, the
texts are range-partitioned once and compared while they stream by; only the first and last
text of each partition are set aside and met in a second, small step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm import _words
from odflow.llm._store import written

BUCKETS = 256
#: Mean difference of two digests with independent codes: 1.625 a bucket.
BOUND = 416.0
_PAIRS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
_WINDOW = 5
_CHUNK = 1 << 20
_HEAD = 2


def _tables() -> np.ndarray:
    """A permutation of the bytes for the window's first byte and for each place in each triplet."""
    words = _words.seeds((2 * len(_PAIRS) + 1) * 256, 1301).reshape(-1, 256)
    return np.argsort(words, axis=1).astype(np.uint8)


_TABLE = _tables()
#: Difference of two codes by their distance: opposite quartiles weigh most.
_APART = np.array([0, 1, 2, 6], dtype=np.int64)


def _counts(text: np.ndarray) -> np.ndarray:
    """Triplets in each bucket; behind the end of the text the bytes are 0."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _CHUNK):
        part = text[at:at + _CHUNK + _WINDOW - 1]
        m = min(_CHUNK, len(text) - at)
        if len(part) < m + _WINDOW - 1:
            part = np.concatenate([part, np.zeros(m + _WINDOW - 1 - len(part), np.uint8)])
        first = _TABLE[0][part[:m]]
        bucket = np.empty((len(_PAIRS), m), np.uint8)
        for k, (i, j) in enumerate(_PAIRS):
            np.bitwise_xor(_TABLE[2 * k + 1][part[i:i + m]], _TABLE[2 * k + 2][part[j:j + m]], out=bucket[k])
            bucket[k] ^= first
        out += np.bincount(bucket.ravel(), minlength=BUCKETS)
    return out


def digest(texts: list[np.ndarray]) -> np.ndarray:
    """Digests (rows of bytes) of texts given as byte arrays."""
    if not texts:
        return np.zeros((0, _HEAD + BUCKETS // 4), np.uint8)
    count = np.stack([_counts(t) for t in texts])
    q = np.partition(count, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    q1, q2, q3 = (q[:, k * BUCKETS // 4 - 1] for k in (1, 2, 3))
    code = sum((count > x[:, None]).astype(np.uint8) for x in (q1, q2, q3)).reshape(len(texts), -1, 4)
    body = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    size = np.array([len(t) for t in texts], np.float64)
    ratio = lambda x: np.minimum(15, 16 * x // np.maximum(q3, 1)).astype(np.uint8)
    head = np.stack([np.minimum(255, np.floor(8 * np.log2(size + 1))).astype(np.uint8), ratio(q1) << 4 | ratio(q2)], axis=1)
    return np.concatenate([head, body], axis=1)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 for a difference of ``BOUND`` or more."""
    parts = lambda x: [x[:, _HEAD:] >> s & 3 for s in (0, 2, 4, 6)]
    total = np.zeros(len(a), np.int64)
    for x, y in zip(parts(a), parts(b)):
        total += _APART[np.abs(x.astype(np.int8) - y.astype(np.int8))].sum(axis=1)
    for x, y in ((a[:, 0], b[:, 0]), (a[:, 1] >> 4, b[:, 1] >> 4), (a[:, 1] & 15, b[:, 1] & 15)):
        total += np.abs(x.astype(np.int64) - y.astype(np.int64))
    return np.maximum(0.0, 1.0 - total / BOUND)


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    raw, off = _words.buffers(column)
    return [raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _hex(column: Column | str) -> Column:
    return F.lower(F.hex(column))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, fingerprint.

    The fingerprint digests the whole text in UTF-8 as it stands; equal texts have equal
    fingerprints.  A null text is empty; an empty text has a fingerprint too (all codes 0).
    Very long texts are digested in chunks of a megabyte.  Ids are passed through, null and
    repeated ones too.  Other columns are not read; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            for part in _words.small_batches(batch, 2, 2 << 20):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _binary(digest(_rows_of(part.column(2))))],
                    names=["id", "n_chars", "digest"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, n_chars bigint, digest binary")
            .select(F.col("id").alias(id_col), "n_chars", _hex("digest").alias("fingerprint")))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Likeness, 0 to 1, of two fingerprint columns; null where one of them is."""
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        known = np.flatnonzero(np.asarray(x.is_valid()) & np.asarray(y.is_valid()))
        out = np.full(len(x), np.nan)
        width = _HEAD + BUCKETS // 4
        rows = [np.frombuffer(b"".join(bytes.fromhex(v.as_py()) for v in c.take(pa.array(known))), np.uint8).reshape(-1, width)
                for c in (x, y)]
        out[known] = likeness_of(*rows)
        return pa.array(out, mask=np.isnan(out))

    return run(a, b)


def _cut(text: np.ndarray, chars: int) -> int:
    """Bytes that the first ``chars`` code points of a UTF-8 text take."""
    for at in range(0, len(text), _CHUNK):
        lead = (text[at:at + _CHUNK] & 0xC0) != 0x80
        m = int(np.count_nonzero(lead))
        if chars < m:
            return at + int(np.flatnonzero(lead)[chars])
        chars -= m
    return len(text)


def _edited(texts: list[np.ndarray], n_chars: list[int], share: int) -> list[np.ndarray]:
    """Each text but the last with its tail exchanged for the head of the next."""
    out = []
    for text, n, after in zip(texts, n_chars, texts[1:]):
        tail = n // share
        out.append(np.concatenate([text[:_cut(text, n - tail)], after[:_cut(after, tail)]]))
    return out


_OUT = ["id", "kind", "part", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next", "text"]
_DONE, _FIRST, _LAST = 0, 1, 2


def _compared(ids: pa.Array, texts: list[np.ndarray], n_chars: list[int], share: int, kind: pa.DataType) -> pa.RecordBatch:
    """Finished rows for all texts but the last, each against the one behind it."""
    edited = _edited(texts, n_chars, share)
    m = len(edited)
    own, other = digest(texts), digest(edited)
    columns = [ids.slice(0, m).cast(kind), pa.array([_DONE] * m, pa.int32()), pa.array([0] * m, pa.int32()),
               pa.array(n_chars[:m], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
               _binary(own[:m]), _binary(other), pa.array(likeness_of(own[:m], other)),
               pa.array(likeness_of(own[:m], own[1:])), pa.nulls(m, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=_OUT)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of all texts, of edited texts, and their likeness: a measure of the digest's robustness.

    In the descending order of ids (null last; the first follows the last) each text's last
    ``n_chars / share`` code points are exchanged for the first as many, or all, of the next
    text.  One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited (likeness to the edited text) and near_next (to the next
    text).  A null text is empty.  Rows that repeat an id follow each other in the order of a
    hash of their texts.  A single row is its own next.  Very long texts are digested in
    chunks, one of them at a time whole in a task.  Other columns are not read; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("bigint").alias("n_chars"), text.alias("text"),
                       F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("tie"))
    order = [F.desc_nulls_last("id"), F.col("h"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n_chars", "text")
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, kind int, part int, n_chars bigint, edited_sha256 string, digest binary, edited_digest binary, "
              "near_edited double, near_next double, text string")

    def run(batches):
        from pyspark import TaskContext
        part, held = TaskContext.get().partitionId(), None

        def aside(row, kind):
            return pa.RecordBatch.from_arrays(
                [row.column(0), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), row.column(1),
                 *(pa.nulls(1, t) for t in (pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())),
                 row.column(2).cast(pa.string())], names=_OUT)

        for batch in batches:
            for few in _words.small_batches(batch, 2, 2 << 20):
                if held is None:
                    yield aside(few.slice(0, 1), _FIRST)
                    table = pa.Table.from_batches([few])
                else:
                    table = pa.Table.from_batches([held, few])
                held = few.slice(few.num_rows - 1, 1)
                if table.num_rows > 1:
                    ids = table.column(0).combine_chunks()
                    yield _compared(ids, _rows_of(table.column(2)), table.column(1).to_pylist(), share, ids.type)
        if held is not None:
            yield aside(held, _LAST)

    found = written(rows.mapInArrow(run, schema), "fingerprints")
    # One number for each partition that holds rows; partitions are in the order of their rows.
    parts = sorted(r[0] for r in found.where(F.col("kind") == _FIRST).select("part").collect())
    before = dict(zip(parts[1:] + parts[:1], parts))
    follow = docs.sparkSession.createDataFrame(list(before.items()), "part int, before int")
    ends = (found.where(F.col("kind") == _LAST).select("id", "n_chars", "text", "part")
            .join(found.where(F.col("kind") == _FIRST).join(F.broadcast(follow), "part")
                  .select(F.col("before").alias("part"), F.col("text").alias("next")), "part")
            .select("id", "n_chars", "text", "next"))

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                texts = [*_rows_of(row.column(2)), *_rows_of(row.column(3))]
                yield _compared(row.column(0), texts, row.column(1).to_pylist(), share, row.column(0).type)

    out = found.where(F.col("kind") == _DONE).unionByName(ends.mapInArrow(meet, schema))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", _hex("digest").alias("fingerprint"),
                      _hex("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
