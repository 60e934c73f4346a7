"""Allow and block rules for URLs: a trie over reversed host labels and path segments.

A rule is (host, path, verdict).  It fits a URL whose host is the rule's host or a subdomain
of it and whose path starts with the rule's path; a path need not end at a segment, so
``/en/1`` fits ``/en/17/x``.  Of the rules that fit, the one with most host labels wins,
then the longest path, then the one that blocks.

Rules are counted first and go into as many tries as hold ``TRIE_BYTES`` of rule text each
(equal rules into one); the usual list is a single trie.  Each trie is broadcast alone and
every URL walks it, keeping the better of its winner and the one so far, so no list is too
long and no worker holds more than one trie.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm._store import written

TRIE_BYTES = 8 << 20


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = _lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dictionaries: host labels from the right, then whole path segments.

    A host node keeps its subdomains under ``h`` and its path tree under ``p``; a path node
    keeps sub-segments under ``s`` and, under ``r``, its rules as (rest of the path within
    the next segment, rule, verdict, length of the path), longest rest first and blocks before
    allows.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("h", {}).setdefault(label, {})
        node = node.setdefault("p", {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault("s", {}).setdefault(segment, {})
        node.setdefault("r", []).append((rest, host + path, verdict, len(path)))
        node["r"].sort(key=lambda x: (-len(x[0]), x[2] != "block"))
    return root


def _winner(trie: dict, host: str, path: str) -> tuple[int, int, str | None, str | None]:
    """(host labels, path length, rule, verdict) of the winning rule; (0, 0, None, None) without one."""
    best: tuple[int, int, str | None, str | None] = (0, 0, None, None)
    node = trie
    for labels, label in enumerate(reversed(host.split(".")), 1):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        tree, segments, i = node.get("p"), path.split("/"), 0
        while tree is not None:
            for rest, rule, verdict, length in tree.get("r", ()):
                if segments[i].startswith(rest):
                    best = (labels, length, rule, verdict)
                    break
            # The last segment is not followed by a slash, so it is no whole one.
            tree = tree.get("s", {}).get(segments[i]) if i + 1 < len(segments) else None
            i += 1
    return best


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the winning rule, or (None, None)."""
    return _winner(trie, host, path)[2:]


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per URL: id, host, path, rule (host + path of the winner, else null), verdict.

    ``rules`` has the columns host, path and verdict (allow or block).  A URL no rule fits
    gets ``default``.  A null url or one without ``://`` has an empty host and path, which no
    rule fits.  Rules with a null host or verdict are left out, a null path is empty; A to Z in
    hosts of rules are lower-cased, as in URLs.  Repeated rows and ids are judged row by row, a
    very long url like any other; an empty table gives an empty result and an empty rule list
    gives every URL the default.
    """
    rules = (rules.where("host IS NOT NULL AND verdict IS NOT NULL")
             .select(_lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct())
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    parts = max(1, -(-size // trie_bytes))
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.lit(0).alias("labels"),
                        F.lit(0).alias("length"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for part in range(parts):
        own = rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part).collect()
        urls = _walked(urls, pages.sparkSession.sparkContext.broadcast(build_trie(own)))
        if part + 1 < parts:
            urls = written(urls, "urls")
    return urls.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _walked(urls: DataFrame, trie) -> DataFrame:
    """``urls`` with the winner of this trie where it is better than the one so far."""
    def run(batches):
        for batch in batches:
            seen: dict = {}
            found = []
            for h, p, *before in zip(*[batch.column(i).to_pylist() for i in range(1, 7)]):
                if (h, p) not in seen:
                    seen[h, p] = _winner(trie.value, h, p)
                # Equal lengths of one URL's fitting rules mean equal rules, which lie in one trie.
                found.append(seen[h, p] if seen[h, p][:2] > tuple(before[:2]) else before)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array([f[i] for f in found], kind)
                                       for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]],
                names=batch.schema.names)

    return urls.mapInArrow(run, urls.schema)
