"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

1. Each text becomes its whole set of hashed word shingles, a sketch of it, and band keys.
   Texts with the same set (a 128-bit identity over the whole set) form one class, so
   groups of copies enter what follows as one row.
2. Classes that share a band key form a bucket, and buckets that share members a family.
   Neither is expanded into pairs: a bucket is a star of id links, a family its components.
3. A family's texts are dealt out in chunks, and each text is compared, on full sets, with
   the family's centres, a few of its members chosen by hash: about ``CENTRES`` of them, and
   where these leave the family in several components about ``MORE``.  A family of no more members than
   that is thereby compared whole.
4. What remains in several components is joined on prefixes: two sets that reach the
   similarity share one of the first ``n - ceil(s n) + 1`` shingles of each in any common
   order, and not too far behind in either; in longer prefixes they share as
   many more, and bits of parity bound how far two sets differ.  Shingles that few centres hold come first, so
   pages of one template, which have only its text in common, meet nowhere.  Members outside a
   family's main component are paired with those of other components that they meet so, and
   the pairs are confirmed on full sets.  No link of a family is lost.

Pairs inside one component need no comparison, as only components are asked for.  With 40
bands of 6 bins, a pair at similarity 0.8 shares no band with probability 5e-6, at 0.9 with
2e-13.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import _sketch, _words
from odflow.llm._store import free_name, integer_id, written
from odflow.llm.components import TASK_LINKS, components

BANDS, ROWS = 40, 6
CENTRES, MORE = 8, 64
CHUNK = 512
#: Bits a set; beyond some thousand shingles they say little and the prefixes alone decide.
PARITY = 1024


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, first = _words.word_hashes(*_words.buffers(column))
    return _sketch.distinct(*_words.shingles(words, first, width))


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in _words.small_batches(batch, 1):
                sh, at = _sets(part.column(1), width)
                f1, f2 = _sketch.fingerprints(sh, at)
                keys = _sketch.band_keys(_sketch.sketch(sh, at, BANDS * ROWS), ROWS)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(f1), pa.array(f2), lists],
                    names=["id", "n", "f1", "f2", "bands"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = _sketch.overlap(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    two = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
           .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
           .select("a", "b", "text_a", "text_b"))

    def run(batches):
        for batch in batches:
            for part in _words.small_batches(batch, 3, 1 << 20):
                # A centre's text comes in many rows; its set is made once.
                left = part.column(2).dictionary_encode()
                which = left.indices.to_numpy()
                sa, at_a = _sets(left.dictionary, width)
                sb, at_b = _sets(part.column(3), width)
                ok = np.array([_reaches(sa[at_a[w]:at_a[w + 1]], sb[at_b[i]:at_b[i + 1]], percent)
                               for i, w in enumerate(which)], dtype=bool)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)),
                                                  part.column(1).filter(pa.array(ok))], names=["a", "b"])

    return two.mapInArrow(run, "a bigint, b bigint")


def _places(member: DataFrame, centres: int) -> DataFrame:
    """Chunks of (id, fam) rows: (id, fam, chunk, centre, copy, m), a family's centres in every chunk."""
    family = written(member.groupBy("fam").agg(F.count("*").alias("m")), "families", TASK_LINKS)
    chunks = F.ceil(F.col("m") / CHUNK)
    # All members of a small family, else so many on average, by a hash of the id.
    chosen = F.col("m") * F.pmod(F.xxhash64("id", F.lit(centres)), F.lit(1 << 20)) < centres << 20
    member = member.join(family, "fam").select(
        "id", "fam", "m", ((F.col("m") <= centres) | chosen).alias("centre"),
        F.pmod(F.xxhash64("id", F.lit(-1)), chunks).alias("own"), chunks.alias("chunks"))
    every = F.when(F.col("centre"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array("own"))
    return written(member.select("id", "fam", "m", "centre", "own", F.explode(every).alias("chunk"))
                   .select("id", "fam", "chunk", "centre", (F.col("chunk") != F.col("own")).alias("copy"), "m"), "places", TASK_LINKS)


def _parity(own: np.ndarray) -> list[int]:
    """``PARITY`` bits: whether an odd number of the set's shingles falls on each."""
    odd = np.bincount(((own ^ (own >> np.uint64(32))) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _compared(rows: DataFrame, width: int, percent: int, whole: int | None) -> DataFrame:
    """(fam, id, n, centres, prefix, parity) of each member: the centres it reaches, its rarest shingles and its bits.

    ``rows`` (fam, chunk, centre, copy, m, id, text): a chunk's centres come first; copies are
    there to be compared with only.  Only families of more than ``whole`` members have
    prefixes (None: no family has).
    """
    rows = rows.repartition("fam", "chunk").sortWithinPartitions("fam", "chunk", F.desc("centre"), "id")

    def answer(fam, i, m, own, centres):
        """The centres a set reaches, and the prefix of its shingles, those that few centres hold first."""
        seen, links = np.zeros(len(own), np.int8), []
        for c, other in centres:
            held = _sketch.member(own, other)
            both = int(held.sum())
            seen += held
            if both and c != i and 100 * both >= percent * (len(own) + len(other) - both):
                links.append(c)
        least = len(own) - -(-percent * len(own) // 100) + 1 if whole is not None and m > whole else 0
        return fam, i, len(own), links, own[np.lexsort((own, seen))[:least]].view(np.int64).tolist(), _parity(own) if least else []

    def batch_of(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)],
                                          names=["fam", "id", "n", "centres", "prefix", "parity"])

    def run(batches):
        here, centres, waiting = None, [], []
        for batch in batches:
            for part in _words.small_batches(batch, 6, 2 << 20):
                sh, at = _sets(part.column(6), width)
                fam, chunk, centre, copy, m, ids = (part.column(i).to_pylist() for i in range(6))
                out = []
                for k in range(part.num_rows):
                    if waiting and ((fam[k], chunk[k]) != here or not centre[k]):
                        # All centres of the chunk are there; those that are its members come next.
                        out += [answer(*w, centres) for w in waiting]
                        waiting = []
                    if (fam[k], chunk[k]) != here:
                        here, centres = (fam[k], chunk[k]), []
                    own = sh[at[k]:at[k + 1]]
                    if centre[k]:
                        own = own.copy()
                        centres.append((ids[k], own))
                        waiting += [] if copy[k] else [(fam[k], ids[k], m[k], own)]
                    else:
                        out.append(answer(fam[k], ids[k], m[k], own, centres))
                if out:
                    yield batch_of(out)
        if waiting:
            yield batch_of([answer(*w, centres) for w in waiting])

    return rows.mapInArrow(run, "fam bigint, id bigint, n bigint, centres array<bigint>, prefix array<bigint>, parity array<bigint>")


def _beyond_centres(found: DataFrame, of, root: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components of a family, by their prefixes."""
    member = written(of(found.where("size(prefix) > 0"), "id", "root", root).select("fam", "id", "n", "root", "prefix", "parity"), "rooted")
    part = member.groupBy("fam", "root").agg(F.count("*").alias("m"))
    open_ = written(part.groupBy("fam").agg(F.count("*").alias("parts"), F.max(F.struct("m", "root")).alias("main"))
                    .where("parts > 1").select("fam", F.col("main.root").alias("main")), "open")
    shingle = written(member.join(open_, "fam").select("fam", "id", "n", "root", (F.col("root") != F.col("main")).alias("outer"),
                                                       "prefix", "parity", F.posexplode("prefix").alias("at", "s")), "prefixes")
    met = written(shingle.groupBy("fam", "s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                  .where("lo < hi").select("fam", "s"), "met")
    shingle = shingle.join(met, ["fam", "s"])
    x = shingle.where("outer").select("fam", "s", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("root").alias("rx"),
                                      F.col("prefix").alias("px"), F.col("parity").alias("bx"))
    y = shingle.select("fam", "s", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("root").alias("ry"),
                       F.col("prefix").alias("py"), F.col("parity").alias("by"))
    # From the first shingle two sets share, no more can be common than either has behind it.
    room = (100 + percent) * F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) >= percent * (F.col("nx") + F.col("ny"))
    # Only where they meet first; both sides of a pair may be outside the main component.
    first = ~F.coalesce(F.arrays_overlap(F.slice("px", F.lit(1), F.col("ax")), F.slice("py", F.lit(1), F.col("ay"))), F.lit(False))
    # Sets with ``both`` shingles in common have at most ``n - both`` others in front of any of
    # them, so prefixes of ``n - both + k`` shingles share k.
    both = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent))
    least = F.least(F.size("px") - F.col("nx"), F.size("py") - F.col("ny")) + both
    shared = F.size(F.array_intersect("px", "py")) >= least
    # Bits differ only where a shingle of one set is missing in the other: no more than those may.
    differ = F.aggregate(F.zip_with("bx", "by", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    alike = (100 + percent) * differ <= (100 - percent) * (F.col("nx") + F.col("ny"))
    pairs = (x.join(y, ["fam", "s"]).where("rx <> ry").where(room).where(first).where(alike).where(shared)
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    pairs = written(pairs, "met-pairs", TASK_LINKS)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return _confirmed(pairs, written(texts.join(ids, "id", "left_semi"), "texts"), width, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of distinct
    ``width``-word shingles (a shorter text is one shingle).  ``component_id`` is the least id
    reachable by links, ``kept`` is doc_id = component_id.  Texts without words, empty and
    null texts have an empty set and link with nothing.  Ids are integers (others are an
    error); a row with a null id is linked with nothing, keeps a null component and is kept.
    Rows that share an id are one vertex of the link graph; each of them is returned.  Very
    long texts are hashed by the megabyte and held, as a set of shingles, one at a time and
    for the centres of one family.  Other columns are not read; an empty table gives an empty
    result.
    """
    integer_id(docs, id_col)
    rows = written(_sketched(docs, id_col, text_col, width), "sketches")
    real = rows.where("n > 0 AND id IS NOT NULL")
    classes = written(real.groupBy("n", "f1", "f2").agg(F.min("id").alias("c")), "classes")
    classed = real.join(classes, ["n", "f1", "f2"])
    reps = written(classed.where("id = c").select("id", "bands"), "bands")
    classed = written(classed.select("id", "n", "c").unionByName(
        rows.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("c"))), "classes")
    band = reps.select("id", F.explode("bands").alias("key"))
    shared = written(band.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("m"))
                     .where("m > 1").select("key", "centre"), "buckets")
    pairs = written(band.join(shared, "key").where("id != centre")
                    .select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs", TASK_LINKS)
    # An id with several texts may stand for several classes; they are one vertex.
    again = (classed.where("id IS NOT NULL").groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z"))
             .where("a < z").select("id", "a").join(classed.select("id", F.col("c").alias("b")), "id").select("a", "b"))
    of = lambda df, col, to, root: (df.join(root.select(F.col("node").alias(col), F.col("root").alias("__r")), col, "left")
                                    .withColumn(to, F.coalesce("__r", col)).drop("__r"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    member = written(of(ids, "id", "fam", components(pairs, "a", "b")), "members", TASK_LINKS)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # The one shuffle of all texts, by id and planned alike at every size; later steps read the families' texts.
    placed = written(texts.join(_places(member, CENTRES).hint("shuffle_merge"), "id")
                     .select("fam", "chunk", "centre", "copy", "m", "id", "text"), "texts")
    texts = placed.where("NOT copy").select("id", "text")
    found = written(_compared(placed, width, percent, None), "compared")
    near = lambda found: found.select(F.col("id").alias("a"), F.explode("centres").alias("b"))
    links = written(near(found).unionByName(again), "links", TASK_LINKS)
    root = components(links, "a", "b")
    # Families that the centres leave in several components, with more centres.
    rooted = of(found.select("fam", "id"), "id", "root", root)
    open_ = written(rooted.groupBy("fam").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
                    .where(f"m > {CENTRES} AND lo < hi").select("fam"), "open")
    member = written(member.join(open_, "fam", "left_semi"), "members", TASK_LINKS)
    placed = texts.join(_places(member, MORE), "id").select("fam", "chunk", "centre", "copy", "m", "id", "text")
    found = written(_compared(placed, width, percent, MORE), "compared")
    root = components(links.unionByName(near(found)), "a", "b")
    more = _beyond_centres(found, of, root, texts, width, percent)
    last = (components(of(of(more, "a", "ra", root), "b", "rb", root).select("ra", "rb"), "ra", "rb")
            .select(F.col("node").alias("r"), F.col("root").alias("last")))
    done = of(classed, "c", "r", root).join(last, "r", "left").withColumn("component", F.coalesce("last", "r"))
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                       F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the least id.

    Of rows that repeat a kept id one stays.  A row without an id counts as a document behind
    all those that have one; of equal texts without ids one stays.  Texts without words are
    nobody's duplicates and all stay.  All columns, whatever their names, are passed through.
    """
    integer_id(docs, id_col)
    key = free_name(docs, "__key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    behind = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 3)
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("bigint"), behind))
    found = near_duplicates(keyed.select(key, text.alias("text")), key, "text", width, percent)
    # Keys that go, and kept keys with words that several rows have.
    state = written(found.groupBy(key).agg(F.max(F.col("kept").cast("int")).alias("k"), F.count("*").alias("m"),
                                           F.max("n_shingles").alias("n")).where("k = 0 OR (m > 1 AND n > 0)"), "dropped")
    gone, twice = state.where("k = 0").select(key), state.where("k = 1").select(key)
    left = keyed.join(gone, key, "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    worded = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    copies = left.join(twice, key, "left_semi")
    rest = left.join(twice, key, "left_anti").unionByName(copies.where(~F.coalesce(worded, F.lit(False))))
    return rest.unionByName(copies.where(worded).dropDuplicates([key])).select(*docs.columns)
