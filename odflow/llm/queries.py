"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm import licenses, merkle, toxicity, warc
from odflow.llm._licence_texts import FULL, KNOWN, TITLED
from odflow.llm.chat import repair_chats
from odflow.llm.decontaminate import find_leaks
from odflow.llm.exact_dedup import exact_duplicates
from odflow.llm.fingerprints import edited_fingerprints
from odflow.llm.mixing import mix
from odflow.llm.near_dedup import near_duplicates
from odflow.llm.periodic_runs import periodic_runs
from odflow.llm.sharding import shard_documents
from odflow.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


_LOWER_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1_SQL = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, {_LOWER_ASCII}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s
  FROM word),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept
FROM sets s JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = s.doc_id
"""


@_query("op1_near_dedup", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


_OP2_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


@_query("op2_exact_dedup", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by block naming."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


@_query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item and the overlaps."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _canonical_sql(text: str) -> str:
    t = rf"lower(regexp_replace(coalesce({text}, ''), '(?im)^[ \t]*(copyright|\(c\)|©)[ \t]+(\(c\)|©|[0-9]{{4}})[^\n]*', '', 'g'))"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g')"
    for _, pattern, to in licenses.SPELLINGS:
        t = rf"regexp_replace({t}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"


def _op4_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(a)}, {quote(k)}, {quote(t)})" for a, k, t in KNOWN + TITLED)
    full = ", ".join(f"({quote(a)}, 'text', {quote(d)})" for a, d in FULL)
    return f"""
WITH known AS (
  SELECT kind, digest, min(licence) AS licence FROM (
    SELECT licence, kind, sha256(replace({_canonical_sql('text')}, chr(10), ' ')) AS digest FROM (VALUES {known}) v(licence, kind, text)
    UNION ALL SELECT * FROM (VALUES {full}) f(licence, kind, digest)) k GROUP BY kind, digest),
doc AS (SELECT doc_id, {_canonical_sql('text')} AS t FROM documents),
unit AS (SELECT doc_id, sha256(replace(t, chr(10), ' ')) AS digest, t FROM doc),
line AS (SELECT DISTINCT doc_id, sha256(l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc)),
found AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS notices
  FROM (SELECT DISTINCT doc_id, licence FROM line JOIN known ON d = digest AND kind = 'notice') GROUP BY doc_id)
SELECT u.doc_id, u.digest, w.licence, coalesce(f.notices, '') AS notices
FROM unit u LEFT JOIN (SELECT digest, min(licence) AS licence FROM known GROUP BY digest) w USING (digest)
LEFT JOIN found f USING (doc_id)
"""


@_query("op4_licenses", _op4_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a whole, and the notices among its lines."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard_documents(_table(spark, sf_dir, "documents"), 16)


@_query("op6_chat")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations repaired and rendered, piece by piece."""
    return repair_chats(_table(spark, sf_dir, "conversations"))


_OP7_SQL = """
WITH RECURSIVE per AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY source),
total AS (SELECT sum(n) AS all_n, CAST(sum(CAST(w AS DECIMAL(38,12))) AS DOUBLE) AS all_w FROM per),
rate AS (SELECT source, w / all_w * CAST(all_n AS DOUBLE) / CAST(n AS DOUBLE) AS rate FROM per, total),
piece AS (SELECT source, CAST(ceil(rate / 8.0) AS INT) AS pieces, rate / CAST(ceil(rate / 8.0) AS INT) AS mean FROM rate),
pmf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM piece
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM pmf WHERE k < 64),
draw AS (SELECT d.doc_id, d.source, u.i,
    CAST(CAST('0x' || substr(sha256('mix|' || d.doc_id || '|' || u.i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d JOIN piece ON d.source IS NOT DISTINCT FROM piece.source, unnest(range(1, pieces + 1)) u(i)),
hit AS (SELECT doc_id, i, coalesce(min(k) FILTER (WHERE u < c), 64) AS n
  FROM draw JOIN pmf ON draw.source IS NOT DISTINCT FROM pmf.source GROUP BY doc_id, i),
times AS (SELECT doc_id, sum(n) AS n FROM hit GROUP BY doc_id)
SELECT d.*, CAST(r.c AS INT) AS copy,
  CAST('0x' || substr(sha256('mix|order|' || d.doc_id || '|' || r.c), 1, 13) AS BIGINT) AS mix_order
FROM documents d JOIN times USING (doc_id), unnest(range(0, CAST(n AS BIGINT))) r(c)
"""


@_query("op7_mixing", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights that grow with the square root of a source's size."""
    return mix(_table(spark, sf_dir, "documents"), copy_col="copy", order_col="mix_order")


#: The rules the task states.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_OP8_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
part AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER_ASCII}) AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part)
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict
FROM page LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh) - length(replace(rh, '.', '')) DESC NULLS LAST,
  length(rp) DESC, v = 'block' DESC) = 1
"""


@_query("op8_url_filter", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def responses(pages: DataFrame) -> DataFrame:
    """Stand-in response records around the pages: WARC and HTTP headers, then the page."""
    text = lambda *lines: F.concat(*[F.concat(x if not isinstance(x, str) else F.lit(x), F.lit("\r\n")) for x in lines])
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    return pages.select(
        "page_id",
        text("WARC-Type: response", F.concat(F.lit("WARC-Record-ID: "), warc.record_id(F.lit("page"), F.col("page_id").cast("string"))),
             F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit(""))), "WARC-Date: 2024-01-01T00:00:00Z",
             "Content-Type: application/http; msgtype=response").alias("warc_headers"),
        F.concat(text("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), length), ""),
                 F.coalesce("html", F.lit(""))).alias("block"))


@_query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    return warc.derivatives(responses(_table(spark, sf_dir, "pages")))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


@_query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.fit(docs, labels)
    return (toxicity.score_toxicity(docs, model)
            .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a hash of its id, repeats from some word on.

    With h = crc32(doc_id), g = h / 10 and n words, where 10 divides h each word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (F.floor((n - a) / (3 + F.col("g") % 8)) + 1).cast("int")
    often = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), often)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


#: Unsigned crc32 of a decimal number; the constants are the checksum's fixed values.
_CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length({x}) + 1), lambda k: ascii(substr({x}, k, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_OP11_SQL = rf"""
WITH word AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w,
    {_CRC32_SQL.format(x="CAST(doc_id AS VARCHAR)")} AS h FROM documents),
part AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM word),
said AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(0, n - a),
    lambda i: w[a + i % (1 + (n - a) // (3 + (h // 10) % 8)) + 1])) END AS w FROM part),
five AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS k FROM said, unnest(range(0, n - 4)) u(i)),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM five a JOIN five b
  ON a.doc_id = b.doc_id AND a.k = b.k AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(start + period, start + length)) u(i)),
left_ AS (SELECT s.doc_id, string_agg(w[u.i + 1], ' ' ORDER BY u.i) AS t FROM said s, unnest(range(0, n)) u(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.i = u.i) GROUP BY s.doc_id)
SELECT s.doc_id, coalesce(p.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(p.runs, '')) AS runs_sha256, sha256(coalesce(l.t, '')) AS collapsed_sha256
FROM said s LEFT JOIN per p USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN left_ l USING (doc_id)
"""


@_query("op11_periodic_runs", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs of every document, the longest one, and the text without their repeats."""
    found = periodic_runs(planted_runs(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    found = found.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(text: str) -> str:
    value = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in value) + ")"


_OP12_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC32_SQL.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
tree AS (
  SELECT 0 AS l, source, pos, n, leaf AS digest FROM leaf
  UNION ALL SELECT l + 1, source, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY l, source, pos // 3),
sub AS (SELECT source, l AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
  count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS l, pos, n, subroot AS digest FROM sub
  UNION ALL SELECT l + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY l, pos // 3),
step AS (
  SELECT a.l, a.source, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM tree a JOIN tree b ON a.l = b.l AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.l, a.source, a.pos),
top_step AS (
  SELECT a.l, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM top a JOIN top b ON a.l = b.l AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.l, a.pos),
path AS (
  SELECT f.doc_id, s.l, before, after FROM leaf f JOIN step s ON f.source IS NOT DISTINCT FROM s.source AND s.pos = f.pos // CAST(pow(3, s.l) AS BIGINT)
  UNION ALL SELECT f.doc_id, u.height + t.l, before, after FROM leaf f JOIN sub u ON f.source IS NOT DISTINCT FROM u.source
  JOIN top_step t ON t.pos = u.pos // CAST(pow(3, t.l) AS BIGINT)),
fold AS (
  SELECT doc_id, 0 AS l, other AS h FROM leaf
  UNION ALL SELECT f.doc_id, f.l + 1, sha256(p.before || f.h || p.after) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.l = f.l),
proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY l)) AS proof FROM path GROUP BY doc_id),
ended AS (SELECT doc_id, arg_max(h, l) AS folded_root FROM fold GROUP BY doc_id)
SELECT f.doc_id, f.leaf, u.subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = r.digest AS verified
FROM leaf f JOIN sub u ON f.source IS NOT DISTINCT FROM u.source JOIN ended e USING (doc_id) LEFT JOIN proof p USING (doc_id),
  (SELECT digest FROM top WHERE n = 1) r
"""


@_query("op12_merkle", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with every second row, by a hash, tampered and checked."""
    docs = _table(spark, sf_dir, "documents")
    other = merkle.leaf_digest([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else c for c in _FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, other)
    leaves = docs.select("doc_id", "source", merkle.leaf_digest(_FIELDS).alias("leaf"), tampered.alias("tampered"))
    out = merkle.manifest(leaves, keep=("tampered",))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), "witness")
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("witness").alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@_query("op13_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))
