"""Licences, mixing and URL rules: edge cases, brute force, and plans without Python."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import pytest

from odflow.llm import licenses, url_filter
from odflow.llm._licence_texts import KNOWN
from odflow.llm.licenses import scan_licenses
from odflow.llm.mixing import MOST, PIECE, mix, rates
from odflow.llm.queries import URL_RULES
from odflow.llm.url_filter import build_trie, filter_urls, longest


def plan(df):
    return df._jdf.queryExecution().toString()


# ------------------------------------------------------------------------ licences
def test_whole_texts_and_notices(docs):
    mit = next(t for n, k, t in KNOWN if n == "MIT" and k == "text")
    changed = "Copyright (c) 2019 Some One\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence")
    rows = [(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (6, "...\n"),
            (7, "Some text.\nReleased under the MIT  licence\nAll rights reserved."), (8, "Released under the MIT License."),
            (9, "x " * 30000 + "\nAll Rights Reserved\n" + "y " * 30000), (7, "other"), (None, "all rights reserved"),
            (8, "Released under the MIT License.")]
    got = {(r.doc_id, r.licence, r.notices) for r in scan_licenses(docs(rows)).collect()}
    assert got == {(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, ""),
                   (7, None, "MIT,all-rights-reserved"), (8, "MIT", "MIT"), (9, None, "all-rights-reserved"),
                   (7, None, ""), (None, "all-rights-reserved", "all-rights-reserved")}
    assert scan_licenses(docs(rows)).count() == len(rows)
    assert scan_licenses(docs([])).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.digest for r in scan_licenses(docs([(4, None)])).collect()} == {empty}


def test_known_texts_are_found_by_their_own_digest(spark, docs):
    rows = [(i, t) for i, (_, _, t) in enumerate(KNOWN)]
    got = {r.doc_id: r.licence for r in scan_licenses(docs(rows)).collect()}
    assert got == {i: KNOWN[i][0] for i in got}


def test_published_forms_and_holders_lines(docs):
    body = {n: t for n, k, t in KNOWN if k == "text"}
    rows = [("BSD-3-Clause", "all-rights-reserved", "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + body["BSD-3-Clause"]),
            ("BSD-2-Clause", "all-rights-reserved", "Copyright (c) 2020, Some One\r\nCopyright (c) 2021 An Other\r\nAll rights reserved.\r\n" + body["BSD-2-Clause"]),
            ("BSD-3-Clause", "all-rights-reserved", "Copyright (c) The Regents.\nAll rights reserved.\n\n" + body["BSD-3-Clause"]),
            ("ISC", "", "ISC License\n\nCopyright (c) Isaac, 2022\n\n" + body["ISC"]),
            ("ISC", "", "The ISC License\n\nCopyright Isaac and Contributors\n\n" + body["ISC"].replace("and/or", "and")),
            ("0BSD", "", "BSD Zero Clause License\n\n" + body["0BSD"]),
            ("MIT", "", "The MIT License (MIT)\n\nCopyright (c) 2014 X\n\n" + body["MIT"]),
            ("MIT", "all-rights-reserved", "Copyright Node.js contributors. All rights reserved.\n\n" + body["MIT"]),
            (None, "all-rights-reserved", "Prose.\nCopyright (c) 2020 X. All rights reserved.\nMore prose."),
            (None, "", "Copyright (c) 2020 X. All rights reserved by X.\nMore prose."),
            (None, "", "Copyright Notice\n" + body["MIT"]), (None, "", "Copyright laws apply.\n" + body["ISC"]),
            (None, "", "Copyright 2020 X"), (None, "", body["ISC"] + "\nand one more line")]
    # Rows that repeat an id and a digest keep their own answers.
    rows += [("MIT", "", body["MIT"]), ("MIT", "all-rights-reserved", "(c) 2020 X. All rights reserved.\n" + body["MIT"])]
    found = scan_licenses(docs([(min(i, 14), t) for i, (_, _, t) in enumerate(rows)])).collect()
    assert sorted(((r.doc_id, r.licence, r.notices) for r in found), key=repr) == \
        sorted(((min(i, 14), w, n) for i, (w, n, _) in enumerate(rows)), key=repr)


PUBLISHED = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"),
             ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]


def test_full_texts_as_published(docs):
    folder = Path("/usr/share/common-licenses")
    texts = [(i, (folder / f).read_text()) for i, (f, _) in enumerate(PUBLISHED) if (folder / f).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    got = {r.doc_id: r.licence for r in scan_licenses(docs([*texts, *[(100 + i, t + "\nmore") for i, t in texts]])).collect()}
    assert got == {i: PUBLISHED[i][1] if i < 100 else None for i in got}


def test_licences_and_mixing_are_native(docs):
    rows = docs([(1, "a"), (2, "b")])
    for df in (scan_licenses(rows), mix(rows)):
        assert not any(w in plan(df) for w in ("Python", "Pandas", "Arrow"))


def test_lines_are_looked_up_where_they_are_read(docs):
    text = plan(scan_licenses(docs([(1, "a\nb")])))
    # The lookup is broadcast by its written size; one exchange puts each document's found units together.
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


# -------------------------------------------------------------------------- mixing
def uniform(*key):
    return int(hashlib.sha256("|".join(key).encode()).hexdigest()[:13], 16) / 2 ** 52


def poisson(rate, *key):
    if rate <= 0:
        return 0
    pieces = math.ceil(rate / PIECE)
    mean, total = rate / pieces, 0
    for i in range(1, pieces + 1):
        u, k, p = uniform(*key, str(i)), 0, math.exp(-rate / pieces)
        c = p
        while u >= c and k < MOST:
            k += 1
            p = p * mean / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("weights", [None, {"big": 1.0, "small": 3.0, None: 2.0}])
def test_counts_against_brute_force(spark, weights):
    rows = [(i, "t", "big") for i in range(400)] + [(1000 + i, None, "small") for i in range(20)] + \
           [(2000 + i, "", None) for i in range(3)] + [(None, "n", "big"), (1, "again", "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = Counter(r[2] for r in rows)
    w = {s: (math.sqrt(n[s]) if weights is None else weights[s]) for s in n}
    rate = {s: w[s] / sum(w.values()) * len(rows) / n[s] for s in n}
    assert {r.source: r.rate for r in rates(df, weights=weights).collect()} == pytest.approx(rate)
    want = Counter()
    for i, t, s in rows:
        want[i, t, s] += poisson(rate[s], "mix", "" if i is None else str(i))
    out = mix(df, weights=weights)
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == +want
    assert [r["__order"] for r in got] == sorted(r["__order"] for r in got)
    share = Counter(r.source for r in got)
    for s in n:
        mean = rate[s] * n[s]
        assert abs(share[s] - mean) < 6 * math.sqrt(mean) + 1


def test_mixing_edges(spark):
    schema = "doc_id bigint, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "a", "x")], schema)
    assert mix(one, weights={"y": 1.0}).count() == 0
    assert mix(one).columns == ["doc_id", "text", "source", "__copy", "__order"]


# ----------------------------------------------------------------------- URL rules
URLS = ["http://example.org/", "https://Sub.EXAMPLE.org/es/x", "https://example.org/es", "http://a.example.org/en/17?x#y",
        "http://example.org/en/2", "http://notexample.org/es/", "http://org/es/", "http://shop.com/fr/a", "http://shop.com/de/",
        "http://shop.com/de", "http://shop.com?/fr/", "http://shop.com#/fr/", "ftp://x.com/fr/#a?b", "http://example.org:80/es/",
        "mailto:a@b.org", "", None, "://org/", "http://", "http:///path", "x://y://org/", "http://.org/a", "http://example.org./es/",
        "http://é.org/É", "http://a..org/z"]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, default)))


@pytest.mark.parametrize("trie_bytes", [1 << 20, 300])
def test_urls_against_brute_force(spark, trie_bytes):
    rules = URL_RULES + [("example.org", "", "block"), ("a.example.org", "/en/", "allow"), ("org", "/a", "block"),
                         ("org", "/a", "allow"), ("com", "/fr/a/b", "block"), ("com", "/fr/a", "block"),
                         ("é.org", "/", "block"), ("com", "/fr/a", "block")]
    urls = URLS + [f"http://{h}/{p}" for h in ("a.example.org", "b.com", "com") for p in ("en/1/2", "fr/a/b/c", "fr/a", "a", "de/")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1]), (None, urls[0])], "page_id bigint, url string")
    pages = pages.selectExpr("page_id", "url", "'h' host", "'p' path", "'r' rule")
    table = spark.createDataFrame(rules + [("a.EXAMPLE.org", "/en/", "allow"), (None, "/", "block"), ("x", "/", None)], "host string, path string, verdict string")
    got = Counter(tuple(r) for r in filter_urls(pages, table, trie_bytes=trie_bytes).collect())
    want = Counter((i, *brute(u, rules)) for i, u in [*enumerate(urls), (1, urls[1]), (None, urls[0])])
    assert got == want


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    table = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert filter_urls(none, table).count() == 0
    page = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert filter_urls(page, table.where("false"), default="block").first().verdict == "block"
    trie = build_trie(URL_RULES)
    assert longest(trie, "www.example.org", "/en/12/x") == ("example.org/en/1", "block")
    assert url_filter.TRIE_BYTES > 0 and licenses.SPELLINGS


def test_mixing_with_clashing_names(spark):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], i, "r", "s", 1, 2) for i in range(40)],
                               "doc_id int, text string, source string, copy int, __rate string, __Source string, __copies int, mix_order int")
    out = mix(df, copy_col="copy", order_col="mix_order")
    assert out.columns == [*df.columns, "copy_", "mix_order_"]
    rows = out.collect()
    assert rows and all(r["copy"] == r["doc_id"] and r["__copies"] == 1 and r["mix_order"] == 2 for r in rows)
    assert [r["mix_order_"] for r in rows] == sorted(r["mix_order_"] for r in rows)
