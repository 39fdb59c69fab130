"""WARC derivatives: from each response a metadata and a conversion record that refer to it.

Everything is DataFrame functions. Digests are ``sha256:`` with lower-case hex, record ids UUIDs cut from a SHA-256
of what the record is about, so building the derivatives again gives the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record types, media types and header names of WARC 1.1.
VERSION = "WARC/1.1"
METADATA, CONVERSION = "metadata", "conversion"
FIELDS_TYPE, TEXT_TYPE = "application/warc-fields", "text/plain; charset=UTF-8"

#: Elements that never hold text, block elements, and the character references that are decoded.
SILENT = ("script", "style", "head", "template", "noscript")
BLOCKS = ("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul").split()
REFERENCES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&"))

_COMMENT = r"(?s)<!--.*?-->"
_SILENT = rf"(?is)<({'|'.join(SILENT)})\b[^>]*>.*?</\1\s*>"
_BLOCK = rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?/?>"
_TAG = r"(?s)<[/!?a-zA-Z][^>]*>"


def uuid_of(*parts: Column) -> Column:
    """A record id that depends on ``parts`` alone."""
    h = F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def plain_text(html: Column) -> Column:
    """Text of a page: no silent elements, comments or tags; blocks on lines of their own, white space in a line as one space."""
    text = F.regexp_replace(html, _COMMENT, "")
    text = F.regexp_replace(text, _SILENT, "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), _TAG, "")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    text = F.regexp_replace(text, r" +", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: record_id, target_uri, date, http_headers, payload.

    The table knows no capture date; ``date`` stands in. Null columns become empty. Ids depend on the row's id,
    address and payload: only rows that agree in all three share one.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    uri = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select(
        uuid_of(F.lit("response"), F.col(id_col), uri, digest(payload)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def _record(kind: str, media: str, block: str, extra: dict[str, str]) -> Column:
    """A record of the columns ``{kind}_id``, ``block`` and ``{block}_digest``."""
    columns = {"WARC-Record-ID": f"{kind}_id", "WARC-Refers-To": "record_id", "WARC-Target-URI": "target_uri", "WARC-Date": "date", **extra, "WARC-Block-Digest": f"{block}_digest"}
    named = [("WARC-Type", F.lit(kind)), *((name, F.col(c)) for name, c in columns.items())]
    named += [("Content-Type", F.lit(media)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in named]
    return F.struct(
        F.lit(kind).alias("warc_type"),
        F.col(f"{kind}_id").alias("record_id"),
        F.concat(F.lit(VERSION + "\r\n"), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("header"),
        F.col(block).alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: warc_type, record_id, refers_to, target_uri, header, block.

    ``records`` has record_id, target_uri, date, http_headers and payload (text). The metadata block has the source's
    status line, its headers with ``source-`` before their names, its payload digest and the conversion's id; the
    conversion block is the plain text. Both headers name the response in WARC-Refers-To and the digest of its
    payload. Null columns count as empty; a page without text has an empty conversion. Repeated responses give
    repeated records; other columns are ignored.
    """
    source = records.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("record_id", "target_uri", "date", "http_headers", "payload")))
    head = F.regexp_replace("http_headers", r"\r\n\r\n$", "")
    kept = F.regexp_replace(F.regexp_replace(head, r"^HTTP[^\r\n]*", "status: $0"), r"\r\n", "\r\nsource-")
    outlinks = F.size(F.regexp_extract_all(F.col("payload"), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).cast("string")
    # Each step is a projection of its own: a column that the next step names more than once is computed once.
    texts = source.select(
        "record_id",
        "target_uri",
        "date",
        kept.alias("kept"),
        digest(F.col("payload")).alias("payload_digest"),
        outlinks.alias("outlinks"),
        plain_text(F.col("payload")).alias("text"),
        *(uuid_of(F.lit(kind), F.col("record_id")).alias(f"{kind}_id") for kind in (METADATA, CONVERSION)),
    ).withColumn("text_digest", digest(F.col("text")))
    block = F.concat(
        F.col("kept"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nconversion-id: "), F.col(f"{CONVERSION}_id"),
        F.lit("\r\nconversion-digest: "), F.col("text_digest"),
        F.lit("\r\noutlinks: "), F.col("outlinks"),
        F.lit("\r\n"),
    )
    full = texts.withColumn("fields", block).withColumn("fields_digest", digest(F.col("fields")))
    extra = {"WARC-Source-Payload-Digest": "payload_digest"}
    both = F.array(_record(METADATA, FIELDS_TYPE, "fields", extra), _record(CONVERSION, TEXT_TYPE, "text", extra))
    rows = full.select(F.col("record_id").alias("refers_to"), "target_uri", F.explode(both).alias("r"))
    return rows.select("r.warc_type", "r.record_id", "refers_to", "target_uri", "r.header", "r.block")


def serialized(records: DataFrame) -> DataFrame:
    """The bytes of each record as they stand in a WARC file, in a column ``record``."""
    return records.withColumn("record", F.encode(F.concat("header", "block", F.lit("\r\n\r\n")), "UTF-8"))


def derivative_report(pages: DataFrame) -> DataFrame:
    """The derivative records of all pages."""
    return derivatives(responses(pages))
