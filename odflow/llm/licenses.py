"""Licence scan by canonical digests; DataFrame functions only.

A text is made canonical (copyright lines dropped, lower case, punctuation and white space
to single blanks within a line, equivalent spellings unified) and its SHA-256 is joined
with the digests of known licences made the same way.  Two units are looked up, each as an
entire text: the whole document, against licence texts and notices, and each of its lines,
against notices.

The whole document is also looked up without the lines of rights holders that name no year
(``HOLDER``), and without an all-rights-reserved line that follows a holder's line.  An
all-rights-reserved notice at the end of a holder's line counts as a line of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm._licence_texts import FULL, KNOWN, TITLED
from odflow.llm._store import written

#: Fixed values: (words that must occur, pattern, replacement) over canonical words.
SPELLINGS: list[tuple[tuple[str, ...], str, str]] = [
    (("licenc",), r"\blicenc(e|es|ed|ing)\b", "licens$1"),
    (("sub licens",), r"\bsub licens(e|es|ed|ing)\b", "sublicens$1"),
    (("organis", "authoris", "utilis", "recognis"),
     r"\b(organi|authori|utili|recogni)s(e|ed|es|ing|ation|ations)\b", "$1z$2"),
    (("copyright holder",), r"\bcopyright holder(s?)\b", "copyright owner$1"),
    (("non infringement", "non commercial"), r"\bnon (infringement|commercial)\b", "non$1"),
    (("whilst",), r"\bwhilst\b", "while"),
]
#: A line that names who holds the rights: a copyright word or sign, then a year or the sign.
COPYRIGHT = r"(?imd)^[ \t]*(copyright|\(c\)|©)[ \t]+(\(c\)|©|[0-9]{4})[^\n]*"
#: Such a line, or one of the word "Copyright" and a name; no phrase of a licence's own text.
HOLDER = (r"(?md)^[ \t]*(?:(?i:copyright|\(c\)|©)[ \t]+(?:(?i:\(c\))|©|[0-9]{4})|Copyright[ \t]+(?:by[ \t]+)?"
          r"(?!(?i:licen[cs]es?|holders?|owners?|notices?|laws?|acts?|office|statements?|and|or)\b)\p{Lu})[^\n]*")
_RESERVED = r"(?i:all rights reserved)[ \t\r.]*$"


def _holderless(text: Column) -> Column:
    return F.regexp_replace(text, HOLDER + rf"(?:\s+{_RESERVED})?", "")


def canonical(text: Column) -> Column:
    """The canonical form; lines stay apart by LF, lines without words vanish."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, ""))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    t = F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))

    def respelled(words: tuple[str, ...], pattern: str, to: str):
        # The words are sought first: few texts hold one, and only those are rewritten.
        def one(x: Column) -> Column:
            holds = F.contains(x, F.lit(words[0]))
            for w in words[1:]:
                holds |= F.contains(x, F.lit(w))
            return F.when(holds, F.regexp_replace(x, pattern, to)).otherwise(x)
        return one

    for rule in SPELLINGS:
        # Through an array of one, so that the text stands only once in the expression.
        t = F.transform(F.array(t), respelled(*rule))[0]
    return t


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """licence, kind, digest of the known texts, one row for each kind and digest.

    Without a list all that this subpackage knows: ``KNOWN``, ``TITLED`` and ``FULL``.
    """
    rows = spark.createDataFrame(KNOWN + TITLED if known is None else known, "licence string, kind string, text string")
    rows = rows.select("licence", "kind", canonical(F.col("text")).alias("t")).select("licence", "kind", _digest("t").alias("digest"))
    if known is None:
        rows = rows.unionByName(spark.createDataFrame([(n, "text", d) for n, d in FULL], "licence string, kind string, digest string"))
    return rows.groupBy("kind", "digest").agg(F.min("licence").alias("licence"))


def _digest(canonical: str) -> Column:
    return F.sha2(F.replace(F.col(canonical), F.lit("\n"), F.lit(" ")), 256)


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, licence, notices.

    ``digest`` is the SHA-256 of the canonical whole text, ``licence`` the known licence or
    notice that the whole text is, with or without its holders' lines (else null), ``notices``
    the licences whose notices are lines of the text or stand at the end of a holder's line,
    sorted and joined by commas (empty if none).  A null text counts as empty; the empty text
    matches nothing, a very long one is looked up whole.  Repeated rows stay repeated.  An empty
    table gives an empty result.  Lines are looked up where they are read: only the known ones
    move, and a row of digests for each document.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    lookup = (known.groupBy("digest").agg(F.min("licence").alias("found")).withColumn("whole", F.lit(True))
              .unionByName(known.where("kind = 'notice'").select("digest", F.col("licence").alias("found"),
                                                                 F.lit(False).alias("whole"))))
    # Written, so that the planner knows its size before it plans the lines' join.
    lookup = written(lookup, "licences")
    text = F.col(text_col)
    t = docs.select(F.col(id_col).alias("id"), canonical(text).alias("t"),
                    F.when(text.rlike(HOLDER), canonical(_holderless(text))).alias("u"),
                    F.coalesce(text.rlike(HOLDER + r"(?<=\W)" + _RESERVED), F.lit(False)).alias("reserved"))
    unit = lambda digest, whole, row=False: F.struct(
        digest.alias("digest"), F.lit(whole).alias("whole"), F.lit(row).alias("row"))
    # One pass over the texts: units for the whole and one for each line, of which only
    # those that are known travel on; a document's few units are then put together again.
    keys = ["id", "text_digest", "bare_digest", "reserved"]
    units = t.select("id", _digest("t").alias("text_digest"), _digest("u").alias("bare_digest"), "reserved", "t").select(
        *keys, F.inline_outer(F.concat(
            F.array(unit(F.col("text_digest"), True, True)),
            F.when(F.col("bare_digest") != F.col("text_digest"), F.array(unit(F.col("bare_digest"), True))).otherwise(F.array()),
            F.when(F.col("reserved"), F.array(unit(F.sha2(F.lit("all rights reserved"), 256), False))).otherwise(F.array()),
            F.transform(F.split("t", "\n"), lambda x: unit(F.sha2(x, 256), False)))))
    one = F.col("whole")
    docs = (units.join(lookup, ["digest", "whole"], "left").where(F.col("row") | F.col("found").isNotNull())
            .groupBy(*keys)
            .agg(F.min(F.when(one, F.col("found"))).alias("licence"),
                 F.array_join(F.array_sort(F.collect_set(F.when(~one, F.col("found")))), ",").alias("notices"),
                 F.sum(F.col("row").cast("int")).alias("rows")))
    # As many rows as came in with this id and text.
    return (docs.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select(F.col("id").alias(id_col), F.col("text_digest").alias("digest"), "licence", "notices"))
