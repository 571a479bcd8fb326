"""WARC derivatives: from each response record a metadata record and a plain-text conversion record.

A response record is a row (record_id, target_uri, date, block), block being the HTTP message: status
line, header lines, an empty line, payload. For each response two records come out, linked to it:

* ``metadata``: WARC-Refers-To names the response; the block (application/warc-fields) keeps the status
  line and every source header, the payload's length and digest, the title, the outgoing links and
  their number.
* ``conversion``: WARC-Refers-To names the response; the block (text/plain) is the payload's text.

Both carry the digests of the source payload and of their own block. Record ids are UUIDs derived from
the response's id, the record's type and the block's digest, so reruns give the same records.

Plain text: comments, scripts, styles and templates go; block-level tags end a line; other tags go;
character references are decoded once; runs of blanks become one, empty lines go. A payload whose
Content-Type isn't HTML or XHTML is text as it is, but for blanks; without a Content-Type it counts as HTML.

Header values (ids, URIs, dates, source header lines) can't begin lines of their own: line breaks in them become
blanks. Links are the ``href`` of ``a`` tags in any quoting (``outlinks``), as they stand there. Character references are those of HTML 5 that end in a semicolon, and numeric ones; others stay as they
are. Blocks are text already: a charset isn't looked at. A tag holds no ``<`` and ends with its first ``>``, but for ``a`` tags' links; what looks like one and isn't closed before the next ``<`` is text. Digests are SHA-256 in
hexadecimal (``sha256:``), where many writers use SHA-1 in base 32.

Everything is a column expression: one scan, no shuffle, whatever the number or size of the pages. Patterns
take time in proportion to a page's length.

Defined cases: a null block is an empty one, which gives records with empty text and an empty status;
a block without an empty line is all headers; null ids, URIs and dates are empty header values.
Repeated rows give repeated records; an empty table gives an empty result; other columns are ignored. There are no ties.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.llm.common import table

# HTML elements that begin or end a line.
BLOCK_TAGS = (
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"
).split()
DROPPED = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b[^<>]*+>.*?(?:</(?:script|style|template|noscript)\s*+>|\z)"
LINE = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/][^<>]*+)?+>"
TAG = r"<[/!?a-zA-Z][^<>]*+>"
#: An ``a`` tag, whose quoted values may hold ``>``; its attributes from the left: names, and values with their quotes.
ANCHOR = r"""(?i)<a[\s/](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>"""
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?"""
TITLE = r"(?is)<title[^<>]*+>([^<]*)"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
OTHER_REFERENCE = REFERENCE.replace("[a-zA-Z][", "(?!amp;)[a-zA-Z][")
CRLF = "\r\n"
#: What HTML's names stand for; the commonest are looked at first, as looking one up costs their number.
NAMES = {k[:-1]: " " if v == "\xa0" else v for k, v in sorted(html5.items()) if k.endswith(";")}
COMMON = ("amp", "nbsp", "quot", "lt", "gt", "apos", "copy", "middot", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "bull", "raquo", "laquo", "reg", "trade")


def _decoded(ref: Column) -> Column:
    """What a reference stands for, itself if that isn't known."""
    # one literal text that Spark folds into a map: thousands of literals would be slow to plan
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in NAMES.items())), F.lit("\x01"), F.lit("\x02"))
    body = F.substring(ref, 2, F.length(ref) - 2)
    point = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("long")).otherwise(F.substring(body, F.lit(2), F.length(body)).cast("long"))
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    char = F.when(point == 160, " ").when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(ref)
    out = F.when(body.startswith("#"), char)
    for name in COMMON:
        out = out.when(body == name, NAMES[name])
    return out.otherwise(F.coalesce(F.try_element_at(names, body), ref))


def unescape(text: Column) -> Column:
    """Decode every character reference once; a no-break space becomes a blank. text should be a stored
    column: it is read more than once. Most texts have no reference, or none but &amp;."""
    pieces, refs = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    decoded = F.concat(F.transform(refs, _decoded), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, decoded, lambda a, b: F.concat(a, b)), "")
    return F.when(~F.contains(text, F.lit("&")), text).when(~text.rlike(OTHER_REFERENCE), F.replace(text, F.lit("&amp;"), F.lit("&"))).otherwise(joined)


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def bare_text(html: Column) -> Column:
    """A page without markup, character references still in place."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, " "), LINE, "\n"), TAG, "")


def outlinks(html: Column) -> Column:
    """The ``href`` of each ``a`` tag that has one: in double quotes, single quotes or none, with or without white space around ``=``. Of
    several in one tag the first counts; what stands within other attributes' values isn't one."""

    def of(tag: Column) -> Column:
        rest = F.substring(tag, F.lit(3), F.length(tag))
        both = F.arrays_zip(F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(1)).alias("name"), F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(2)).alias("value"))
        value = F.get(F.filter(both, lambda x: F.lower(x["name"]) == "href"), 0)["value"]
        quoted = value.startswith('"') | value.startswith("'")
        return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), of), lambda x: x.isNotNull())


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _octets(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def derive(responses: DataFrame) -> DataFrame:
    """Two rows a response: record_id, record_type, refers_to, target_uri, date, content_type, block,
    content_length, block_digest, source_payload_digest, record (the record as it stands in a file)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    r = responses.select(one_line(text("record_id")).alias("rid"), one_line(text("target_uri")).alias("uri"), one_line(text("date")).alias("date"), text("block").alias("raw"))
    cut = F.instr("raw", CRLF + CRLF)
    r = r.select(
        "rid", "uri", "date",
        F.when(cut > 0, F.substring(F.col("raw"), F.lit(1), cut - 1)).otherwise(F.col("raw")).alias("head"),
        F.when(cut > 0, F.substring(F.col("raw"), cut + 4, F.length("raw"))).otherwise("").alias("payload"),
    )
    r = r.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))
    kind = F.lower(F.regexp_extract("head", r"(?i)\r\ncontent-type:[ \t]*([^;\r\n]*)", 1))
    is_html = (F.trim(kind) == "") | F.contains(kind, F.lit("html"))
    r = r.withColumn("html", is_html)
    is_html = F.col("html")
    # each step is a column of its own, so that what is read twice is computed once
    r = r.withColumn("bare", F.when(is_html, bare_text(F.col("payload"))).otherwise(F.col("payload")))
    r = r.withColumn("bare_title", F.when(is_html, F.regexp_extract("payload", TITLE, 1)).otherwise(""))
    r = r.withColumn("text", _tidy(F.when(is_html, unescape(F.col("bare"))).otherwise(F.col("bare"))))
    links = F.when(is_html, outlinks(F.col("payload"))).otherwise(F.array().cast("array<string>"))
    title = _tidy(unescape(F.col("bare_title")))
    r = r.withColumn("links", links).withColumn("lines", F.split("head", CRLF))
    links, lines = F.col("links"), F.col("lines")
    headers = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda h: F.concat(F.lit("http-header: "), one_line(h), F.lit(CRLF))), "")
    fields = F.concat(
        F.lit("http-status: "), one_line(F.element_at(lines, 1)), F.lit(CRLF), headers,
        F.lit("payload-length: "), _octets(F.col("payload")).cast("string"), F.lit(CRLF),
        F.lit("payload-digest: "), F.col("digest"), F.lit(CRLF), F.lit("title: "), F.replace(title, F.lit("\n"), F.lit(" ")), F.lit(CRLF),
        F.lit("n-outlinks: "), F.size(links).cast("string"), F.lit(CRLF),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), one_line(u), F.lit(CRLF))), ""),
    )
    one = lambda t, mime, block: F.struct(F.lit(t).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    r = r.withColumn("made", F.explode(F.array(one("metadata", "application/warc-fields", fields), one("conversion", "text/plain", F.col("text")))))
    r = r.select("rid", "uri", "date", "digest", "made.*")
    r = r.withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))).withColumn("content_length", _octets(F.col("block")))
    r = r.withColumn("record_id", _uuid(F.col("rid"), F.col("record_type"), F.col("block_digest")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("rid")), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("X-Source-Payload-Digest", F.col("digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF),
    )
    return r.select(
        "record_id", "record_type", F.col("rid").alias("refers_to"), F.col("uri").alias("target_uri"), "date", "content_type",
        "block", "content_length", "block_digest", F.col("digest").alias("source_payload_digest"), record.alias("record"),
    )


def page_responses(pages: DataFrame) -> DataFrame:
    """Pages as HTTP response records, as a crawler would have stored them."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), _octets(html).cast("string"),
        F.lit("\r\nX-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF + CRLF),
    )
    rid = _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    return pages.select(rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(head, html).alias("block"))


def op1_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derive(page_responses(table(spark, sf_dir, "pages"))).drop("date")


def _sql_uuid(h: str) -> str:
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-8' || {h}[18:20] || '-' || {h}[21:32] || '>'"


def _re2(pattern: str) -> str:
    """The pattern without possessive marks, which DuckDB's engine lacks and doesn't need."""
    return pattern.replace("*+", "*").replace("?+", "?")


def _sql_unescape(x: str) -> str:
    # DuckDB has no split by expression: references are marked off by a private character first
    parts = rf"string_split(regexp_replace({x}, '({REFERENCE})', chr(57345) || '\1' || chr(57345), 'g'), chr(57345))"
    cp = r"CASE WHEN regexp_matches(s, '^&#[xX]') THEN ('0x' || s[4:-2])::BIGINT ELSE s[3:-2]::BIGINT END"
    one = (
        rf"CASE WHEN NOT regexp_full_match(s, '{REFERENCE}') THEN s WHEN NOT s LIKE '&#%' THEN coalesce(names[s[2:-2]], s) WHEN ({cp}) = 160 THEN ' ' "
        rf"WHEN ({cp}) BETWEEN 1 AND 1114111 AND NOT ({cp}) BETWEEN 55296 AND 57343 THEN chr(({cp})::INT) ELSE s END"
    )
    return f"array_to_string(list_transform({parts}, lambda s: {one}), '')"


def _sql_tidy(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')"


def _sql_text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


_quoted = lambda pattern: pattern.replace("'", "''")
_attributes = f"list_zip(regexp_extract_all(t[3:], '{_quoted(ATTRIBUTE)}', 1), regexp_extract_all(t[3:], '{_quoted(ATTRIBUTE)}', 2))"
_first = f"list_filter({_attributes}, lambda a: lower(a[1]) = 'href')[1]"
#: Values are unquoted by cutting quotes off both ends.
SQL_LINKS = rf"""list_filter(list_transform(regexp_extract_all(payload, '{_quoted(_re2(ANCHOR))}'), lambda t: CASE WHEN ({_first}) IS NOT NULL THEN regexp_replace(coalesce(({_first})[2], ''), '^["''](.*)["'']$', '\1', 's') END), lambda u: u IS NOT NULL)"""
_NL = "chr(13) || chr(10)"
OP1_SQL = rf"""
WITH n AS (SELECT MAP {{{", ".join(f"'{k}': {_sql_text(v)}" for k, v in NAMES.items())}}} AS names),
p AS (SELECT coalesce(page_id::VARCHAR, '') AS id, coalesce(url, '') AS uri, coalesce(html, '') AS payload,
             sha256('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS h, names FROM pages, n),
q AS (SELECT *, {_sql_uuid('h')} AS rid, 'sha256:' || sha256(payload) AS digest,
        {SQL_LINKS} AS links,
        {_sql_tidy(_sql_unescape(rf"regexp_extract(payload, '{_re2(TITLE)}', 1)"))} AS title,
        regexp_replace(regexp_replace(regexp_replace(payload, '{_re2(DROPPED)}', ' ', 'g'), '{_re2(LINE)}', chr(10), 'g'), '{_re2(TAG)}', '', 'g') AS bare FROM p),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
        'http-status: HTTP/1.1 200 OK' || {_NL} || 'http-header: Content-Type: text/html; charset=utf-8' || {_NL}
        || 'http-header: Content-Length: ' || strlen(payload) || {_NL} || 'http-header: X-Page: ' || id || {_NL}
        || 'payload-length: ' || strlen(payload) || {_NL} || 'payload-digest: ' || digest || {_NL} || 'title: ' || replace(title, chr(10), ' ') || {_NL}
        || 'n-outlinks: ' || len(links) || {_NL}
        || array_to_string(list_transform(links, lambda u: 'outlink: ' || regexp_replace(u, '[\r\n]+', ' ', 'g') || {_NL}), '') AS block FROM q
      UNION ALL SELECT *, 'conversion', 'text/plain', {_sql_tidy(_sql_unescape('bare'))} FROM q),
d AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM b),
i AS (SELECT *, sha256(rid || '|' || record_type || '|' || block_digest) AS g FROM d),
r AS (SELECT *, {_sql_uuid('g')} AS record_id FROM i)
SELECT record_id, record_type, rid AS refers_to, uri AS target_uri, content_type, block, content_length, block_digest, digest AS source_payload_digest,
       'WARC/1.1' || {_NL} || 'WARC-Type: ' || record_type || {_NL} || 'WARC-Record-ID: ' || record_id || {_NL} || 'WARC-Refers-To: ' || rid || {_NL}
       || 'WARC-Target-URI: ' || uri || {_NL} || 'WARC-Date: 2024-01-01T00:00:00Z' || {_NL} || 'WARC-Block-Digest: ' || block_digest || {_NL}
       || 'X-Source-Payload-Digest: ' || digest || {_NL} || 'Content-Type: ' || content_type || {_NL} || 'Content-Length: ' || content_length || {_NL}
       || {_NL} || block || {_NL} || {_NL} AS record
FROM r
"""
