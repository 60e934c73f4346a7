"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response gives two records that point to it with WARC-Refers-To: a ``metadata`` record
whose block is JSON with the source's WARC and HTTP headers (in order, repeats kept), title,
links and digests, and a ``conversion`` record whose block is the page's plain text.  All
of it is DataFrame functions; a record is made from one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements whose content is not text.
SKIPPED = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(
    rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template"))
BLOCKS = (r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|"
          r"title|body|blockquote|pre|hr|form|head|html)\b[^>]*>")
TAGS = r"<[A-Za-z/!?][^>]*>"
#: The named entities that are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]

#: Names of the charsets read as windows-1252, and its characters for the bytes 0x80 to 0x9F.
LATIN = ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii", "windows-1252", "cp1252")
_WINDOWS = {chr(b): c for b, c in zip(
    (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F), "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")}


def sha1_base32(data: Column) -> Column:
    """``sha1:`` and the base-32 digest, as WARC digests are written."""
    digest = F.sha1(data)
    five = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.upper(F.concat(*five)), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                                                "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_id(*parts: Column) -> Column:
    """``<urn:uuid:...>`` fixed by the parts (a name-based identifier of version 8)."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"),
                    cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def headers(block: Column) -> Column:
    """array<struct<name, value>> of the ``Name: value`` lines, in order; folded lines are joined."""
    lines = F.split(F.regexp_replace(F.coalesce(block, F.lit("")), r"\r?\n[ \t]+", " "), r"\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("name"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return pairs


def header(pairs: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name; null if missing."""
    found = F.filter(pairs, lambda p: F.lower(p["name"]) == name.lower())
    return F.when(F.size(found) > 0, F.element_at(found, 1)["value"])


def decoded(text: Column) -> Column:
    """Numeric and the usual named entities as characters; others stay as they are.

    The text is cut at its ampersands and each piece is looked at once, so what an entity
    gives is not decoded again.
    """
    named = F.create_map(*[F.lit(x) for entity, value in ENTITIES for x in (entity[1:-1], value)])

    def char(name: Column) -> Column:
        hexed = F.substring(name, 2, 1).isin("x", "X")
        code = F.when(hexed, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        return F.transform(F.array(code), lambda c: F.when(
            c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))[0]

    def replaced(x: Column, name: Column) -> Column:
        found = F.when(F.startswith(name, F.lit("#")), char(name)).otherwise(F.try_element_at(named, name))
        return F.coalesce(F.concat(found, F.substring(x, F.length(name) + 2, F.length(x))), F.concat(F.lit("&"), x))

    def one(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]{2,8});", 1)
        # Bound through an array of one, so that the pattern is matched once a piece.
        return F.when(i == 0, x).otherwise(F.transform(F.array(name), lambda n: replaced(x, n))[0])

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def plain_text(html: Column) -> Column:
    """The text of a page: block elements end lines, white space is collapsed, entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), SKIPPED, " ")
    t = F.regexp_replace(t, r"[ \t\r\n\f\x0B]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), TAGS, "")
    t = F.regexp_replace(decoded(t), r"[ \x{A0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^\n|\n$", ""))


def _charset(pairs: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(header(pairs, "Content-Type"), F.lit("")), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))


def body_text(body: Column, charset: Column) -> Column:
    """Text of a body's bytes; what is not valid UTF-8 becomes U+FFFD.

    ISO-8859-1, US-ASCII and windows-1252 are read as windows-1252, as browsers do; any other
    charset or none as UTF-8.
    """
    latin = F.translate(F.decode(body, "ISO-8859-1"), "".join(_WINDOWS), "".join(_WINDOWS.values()))
    return F.when(charset.isin(*LATIN), latin).otherwise(F.make_valid_utf8(body.cast("string")))


def links_of(html: Column) -> Column:
    """Targets of ``<a href>`` in order: in double quotes, in single quotes or bare; entities decoded."""
    quoted = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""))
    bare = lambda x: F.when(F.substring(x, 1, 1).isin('"', "'"), F.substring(x, 2, F.length(x) - 2)).otherwise(x)
    return F.transform(quoted, lambda x: decoded(bare(x)))


def derivatives(responses: DataFrame, id_col: str = "page_id", header_col: str = "warc_headers",
                block_col: str = "block") -> DataFrame:
    """Two rows per response: id, type, record_id, refers_to, target_uri, date, digest, source_digest,
    source_digest_ok, content, record.

    ``warc_headers`` is the response record's header block and ``block`` its HTTP response
    (status line, headers, empty line, body), as bytes or as text that has been decoded.  Of
    bytes the digest and length are those of the payload as it came, and its text follows the
    charset of the Content-Type (``body_text``).  Lines of a block that starts with ``HTTP/``
    may end in LF alone; without an empty line all of a block is body.  ``digest`` is the derived block's,
    ``source_digest`` the payload digest that the source states or, without one, the
    computed; ``source_digest_ok`` tells whether a stated one is right (null if none is
    stated).  ``record`` is the whole record as it stands in a file.  A null block counts as
    empty; a response without a record id gets one from its target and date.  Missing headers
    are left out.  Rows that repeat a response repeat its records; an empty table gives an empty
    result, and a body of any length is read whole.  Other columns are not looked at.
    """
    raw = responses.schema[block_col].dataType.simpleString() == "binary"
    # Bytes as characters of their own, so that positions are positions of bytes.
    block = F.coalesce(F.decode(F.col(block_col), "ISO-8859-1") if raw else F.col(block_col), F.lit(""))
    blocks = responses.select(F.col(id_col).alias("id"), F.col(header_col).alias("head"), block.alias("block"),
                              *([F.col(block_col).alias("bytes")] if raw else []))
    block = F.col("block")
    crlf, lf = F.instr(block, CRLF + CRLF), F.instr(block, "\n\n")
    by_lf = F.startswith(block, F.lit("HTTP/")) & (lf > 0) & ((crlf == 0) | (lf < crlf))
    end = F.when(by_lf, lf).otherwise(crlf)
    at = F.when(by_lf, lf + 2).when(crlf > 0, crlf + 4).otherwise(1)
    # A generator over an array of one: the parts are made once, not in each of their uses.
    once = lambda *cols: F.inline(F.array(F.struct(*cols)))
    r = blocks.select("id", once(
        headers(F.col("head")).alias("w"), F.when(end > 0, F.substring(block, F.lit(1), end - 1)).otherwise("").alias("h"),
        F.substring(F.coalesce(F.col("bytes"), F.lit(b"")) if raw else block, at, F.lit(1 << 30)).alias("payload")))
    r = r.select("id", "w", F.regexp_extract("h", r"^[^\r\n]*", 0).alias("status"), headers(F.col("h")).alias("http"), "payload",
                 header(F.col("w"), "WARC-Target-URI").alias("target_uri"), header(F.col("w"), "WARC-Date").alias("date"),
                 header(F.col("w"), "WARC-Payload-Digest").alias("stated"),
                 sha1_base32(F.col("payload")).alias("computed"),
                 header(F.col("w"), "WARC-Record-ID").alias("own"))
    r = r.withColumn("body", body_text(F.col("payload"), _charset(F.col("http"))) if raw else F.col("payload"))
    r = r.withColumn("refers_to", F.coalesce("own", record_id(F.lit("response"), F.coalesce("target_uri", F.lit("")),
                                                              F.coalesce("date", F.lit("")))))
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract("body", r"(?is)<title\b[^>]*>(.*?)</title", 1)), r"\s+", " "))
    about = F.to_json(F.struct(
        F.struct(F.col("w").alias("warc"), F.col("status"), F.col("http")).alias("source"),
        F.coalesce("stated", "computed").alias("payload_digest"), F.octet_length("payload").alias("payload_length"),
        title.alias("title"), links_of(F.col("body")).alias("links")))
    two = r.select("id", "refers_to", "target_uri", "date", F.coalesce("stated", "computed").alias("source_digest"),
                   (F.col("stated") == F.col("computed")).alias("source_digest_ok"), F.explode(F.array(
                       F.struct(F.lit("metadata").alias("type"), F.lit("application/json").alias("kind"), about.alias("content")),
                       F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("kind"),
                                plain_text(F.col("body")).alias("content")))).alias("d"))
    two = two.select("*", "d.*").withColumn("digest", sha1_base32(F.col("content"))) \
        .withColumn("record_id", record_id(F.col("type"), F.col("refers_to")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
        F.coalesce(line("WARC-Date", F.col("date")), F.lit("")), line("WARC-Block-Digest", F.col("digest")),
        line("Content-Type", F.col("kind")), line("Content-Length", F.octet_length("content").cast("string")),
        F.lit(CRLF), F.col("content"), F.lit(CRLF + CRLF))
    return two.select(F.col("id").alias(id_col), "type", "record_id", "refers_to", "target_uri", "date", "digest",
                      "source_digest", "source_digest_ok", "content", record.alias("record"))
