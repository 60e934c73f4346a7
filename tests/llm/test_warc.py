import base64
import hashlib
import html
import json
import re
from html.parser import HTMLParser

from odflow.llm import warc
from odflow.llm.queries import responses

BLOCK = set("p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr table article section header footer nav main aside title "
            "body blockquote pre hr form head html".split())


class Text(HTMLParser):
    """The same text by a parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
            self.out.append(" ")
        elif tag in BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.skip -= 1
        elif tag in BLOCK:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"[ \t\r\n\f\x0b]+", " ", data))


def by_parser(page):
    p = Text()
    p.feed(page or "")
    p.close()
    t = re.sub(r"[ \xa0]+", " ", "".join(p.out))
    return re.sub(r"^\n|\n$", "", re.sub(r" ?\n[ \n]*", "\n", t)).strip(" ")


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def rows(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in pages],
                               "page_id bigint, url string, html string, id string, record string")
    return warc.derivatives(responses(df)).collect()


def test_pages_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    out = rows(spark, [tuple(p) for p in pages])
    assert len(out) == 2 * len(pages)
    page = {p.page_id: p for p in pages}
    for r in out:
        raw = (page[r.page_id].html or "").encode()
        assert r.digest == digest(r.content.encode()) and r.source_digest == digest(raw)
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.record and f"WARC-Record-ID: {r.record_id}\r\n" in r.record
        head, _, body = r.record.partition("\r\n\r\n")
        size = int(re.search(r"Content-Length: (\d+)", head)[1])
        assert body.encode() == r.content.encode() + b"\r\n\r\n" and size == len(r.content.encode())
        if r.type == "conversion":
            assert r.content == by_parser(page[r.page_id].html)
        else:
            about = json.loads(r.content)
            assert {h["name"]: h["value"] for h in about["source"]["http"]}["Content-Length"] == str(len(raw))
            assert about["source"]["status"] == "HTTP/1.1 200 OK" and about["payload_length"] == len(raw)
            assert about["links"] == [html.unescape(x) for x in re.findall(r'<a\s[^>]*?href="([^"]*)"', page[r.page_id].html)]
    assert len({r.record_id for r in out}) == len(out)


def test_entities_and_markup(spark):
    cases = ["a &lt;b&gt; &amp;lt; &#65;&#x42;&#x1F600; &#xD800; &#0; &#999999999; &unknown; &copy;", "<p>one<br>two</p>three",
             "<script>var x='<p>'</script>a<!-- b --> c<style>p{}</style>", "x<script>never closed", "a&nbsp;&nbsp;b\t\n c",
             "1 < 2 and 3 > 2", "<b>bo</b>ld", "", None, "é" * 100000]
    want = ["a <b> &lt; AB\U0001f600 &#xD800; &#0; &#999999999; &unknown; ©", "one\ntwo\nthree", "a c", "x", "a b c",
            "1 < 2 and 3 > 2", "bold", "", "", "é" * 100000]
    got = {r.page_id: r.content for r in rows(spark, [(i, "u", c) for i, c in enumerate(cases)]) if r.type == "conversion"}
    assert [got[i] for i in range(len(cases))] == want


def test_headers_and_missing_parts(spark):
    src = [(1, "WARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha1:BAD\r\n",
            "HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX-Long: one\r\n two\r\n\r\n<title> T &amp;\n t </title>body"),
           (2, None, None), (2, None, None), (None, "WARC-Target-URI: http://b/", "no header at all"), (3, "junk", "HTTP/1.1 204\r\n\r\n")]
    out = warc.derivatives(spark.createDataFrame(src, "page_id bigint, warc_headers string, block string")).collect()
    assert len(out) == 10
    one = {r.type: r for r in out if r.page_id == 1}
    about = json.loads(one["metadata"].content)
    assert [h["value"] for h in about["source"]["http"]] == ["a", "b", "one two"] and about["title"] == "T & t"
    assert one["conversion"].refers_to == "<urn:uuid:1>" and one["conversion"].source_digest == "sha1:BAD"
    assert one["conversion"].source_digest_ok is False and one["conversion"].content == "T & t\nbody"
    two = [r for r in out if r.page_id == 2]
    assert len(two) == 4 and {r.content for r in two if r.type == "conversion"} == {""} and two[0].target_uri is None
    assert two[0].source_digest_ok is None and re.match(r"<urn:uuid:[0-9a-f-]{36}>$", two[0].refers_to)
    assert next(r for r in out if r.page_id is None and r.type == "conversion").content == "no header at all"
    empty = spark.createDataFrame([], "page_id bigint, warc_headers string, block string")
    assert warc.derivatives(empty).count() == 0


def test_bytes_and_charsets(spark):
    head = lambda kind: f"HTTP/1.1 200 OK\r\nContent-Type: text/html{kind}\r\n\r\n".encode()
    bodies = [(head("; charset=ISO-8859-1"), b"caf\xe9 \x80 \x93x\x94"), (head(""), "caf\u00e9 \u4e2d".encode()), (head('; charset="utf-8"'), b"a\xffb"),
              (b"", b"\x00\x01no header"), (b"HTTP/1.1 200 OK\nX: y\n\n", "<p>\u00e9</p>\r\n\r\nz".encode()), (head("; charset=latin1"), b"")]
    want = ["caf\u00e9 \u20ac \u201cx\u201d", "caf\u00e9 \u4e2d", "a\ufffdb", "\x00\x01no header", "\u00e9\nz", ""]
    src = [(i, f"WARC-Payload-Digest: {digest(b)}\r\n", bytearray(h + b)) for i, (h, b) in enumerate(bodies)] + [(9, None, None)]
    out = warc.derivatives(spark.createDataFrame(src, "page_id bigint, warc_headers string, block binary")).collect()
    for r in out:
        if r.page_id == 9:
            assert r.source_digest == digest(b"") and r.source_digest_ok is None
            continue
        body = bodies[r.page_id][1]
        assert r.source_digest == digest(body) and r.source_digest_ok is True
        if r.type == "conversion":
            assert r.content == want[r.page_id]
        else:
            assert json.loads(r.content)["payload_length"] == len(body)
    about = next(json.loads(r.content) for r in out if r.page_id == 4 and r.type == "metadata")
    assert about["source"] == {"warc": [{"name": "WARC-Payload-Digest", "value": digest(bodies[4][1])}], "status": "HTTP/1.1 200 OK",
                               "http": [{"name": "X", "value": "y"}]}


def test_line_feeds_and_links(spark):
    page = ("<a href='one?a=1&amp;b=2'>1</a> <A class=x HREF = two >2</A> <a\nhref=\"three's\">3</a> <a data-href=no>4</a> "
            "<a name=n>5</a> <a title='t' href=''>6</a> <a href=last>7</a>\n\n<p>end")
    src = [(1, "", "HTTP/1.0 200 OK\nServer: s\n\n" + page), (2, "", "HTTP/1.0 200 OK\r\nServer: s\r\n\r\n" + page),
           (3, "", "no header\n\nbut text")]
    out = warc.derivatives(spark.createDataFrame(src, "page_id bigint, warc_headers string, block string")).collect()
    about = {r.page_id: json.loads(r.content) for r in out if r.type == "metadata"}
    text = {r.page_id: r.content for r in out if r.type == "conversion"}
    assert about[1] == about[2] and text[1] == text[2] == "1 2 3 4 5 6 7\nend" and text[3] == "no header but text"
    assert about[1]["links"] == ["one?a=1&b=2", "two", "three's", "", "last"]
    assert about[1]["source"]["status"] == "HTTP/1.0 200 OK" and about[3]["source"]["http"] == []
