"""DuckDB SQL for those queries of this package that SQL can express, by plainer ways than the operators take."""

from __future__ import annotations

from revtide.llm import warc

_WHITE_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Links by the exact sets; what a document reaches is closed by recursion.
NEAR_DEDUP = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_lower("text")}, '{_WHITE_WORDS}') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach(doc_id, other) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
    SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
       doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: All windows of both tables as text, joined by equality.
DECONTAMINATION = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all({_lower("text")}, '{_ALNUM_WORDS}') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all({_lower("text")}, '{_ALNUM_WORDS}') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)] END) AS s
    FROM item_words
), lengths AS (
    SELECT DISTINCT least(len(w), 13) AS n FROM item_words WHERE len(w) > 0
), places AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM words, lengths WHERE len(w) >= n
), found AS (
    SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) JOIN windows USING (s)
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The first document of each window text, then the windows over each word.
SUBSTRING_DEDUP = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WHITE_WORDS}') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), repeated AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM windows
), placed AS (
    SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), covered AS (
    SELECT doc_id, i, word, count(*) FILTER (WHERE again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
    FROM placed LEFT JOIN repeated USING (doc_id, i)
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text
    FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def _uuid(*parts: str) -> str:
    h = f"sha256(concat_ws(E'\\n', {', '.join(parts)}))"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"


def _plain_text() -> str:
    """Nested calls that strip a page; RE2 has no back reference, so each silent element is an alternative of its own."""
    space = r"[ \t\n\x0B\f\r]"
    silent = "|".join(rf"<{name}\b[^>]*>.*?</{name}{space}*>" for name in warc.SILENT)
    blocks = "|".join(warc.BLOCKS)

    def swap(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', {by}, 'g')"

    text = swap(swap(swap("payload", "(?s)<!--.*?-->", "''"), f"(?is){silent}", "''"), f"{space}+", "' '")
    text = swap(swap(text, rf"(?i)</?(?:{blocks})(?:{space}[^>]*)?/?>", r"E'\n'"), "(?s)<[/!?a-zA-Z][^>]*>", "''")
    for name, char in warc.REFERENCES:
        char = char.replace("'", "''")
        text = f"replace({text}, '&{name};', '{char}')"
    return swap(swap(swap(text, " +", "' '"), r" ?\n[ \n]*", r"E'\n'"), r"^[ \n]+|[ \n]+$", "''")


def _header(kind: str, media: str, block: str) -> str:
    return f"""E'WARC/1.1\\r\\nWARC-Type: {kind}\\r\\nWARC-Record-ID: ' || {kind}_id || E'\\r\\nWARC-Refers-To: ' || refers_to
        || E'\\r\\nWARC-Target-URI: ' || target_uri || E'\\r\\nWARC-Date: 1970-01-01T00:00:00Z' || E'\\r\\nWARC-Source-Payload-Digest: ' || payload_digest
        || E'\\r\\nWARC-Block-Digest: sha256:' || sha256({block})
        || E'\\r\\nContent-Type: {media}\\r\\nContent-Length: ' || strlen({block}) || E'\\r\\n\\r\\n'"""


WARC_DERIVATIVES = rf"""
WITH sources AS (
    SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), responses AS (
    SELECT {_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "'sha256:' || sha256(payload)")} AS refers_to,
           target_uri, payload, 'sha256:' || sha256(payload) AS payload_digest, {_plain_text()} AS text,
           len(regexp_extract_all(payload, '(?i)<a[ \t\n\x0B\f\r][^>]*href="([^"]*)"')) AS outlinks
    FROM sources
), named AS (
    SELECT *, {_uuid("'metadata'", "refers_to")} AS metadata_id, {_uuid("'conversion'", "refers_to")} AS conversion_id FROM responses
), blocks AS (
    SELECT *, E'status: HTTP/1.1 200 OK\r\nsource-Content-Type: text/html; charset=utf-8\r\nsource-Content-Length: ' || strlen(payload)
        || E'\r\nsource-payload-digest: ' || payload_digest || E'\r\nconversion-id: ' || conversion_id
        || E'\r\nconversion-digest: sha256:' || sha256(text) || E'\r\noutlinks: ' || outlinks || E'\r\n' AS fields
    FROM named
)
SELECT 'metadata' AS warc_type, metadata_id AS record_id, refers_to, target_uri,
       {_header("metadata", "application/warc-fields", "fields")} AS header, fields AS block
FROM blocks
UNION ALL
SELECT 'conversion', conversion_id, refers_to, target_uri, {_header("conversion", "text/plain; charset=UTF-8", "text")}, text
FROM blocks
"""

#: Products of every hundredth row with all others; windows and ranks by window functions.
HARD_NEGATIVES = """
WITH cut AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, x -> floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM (SELECT * FROM cut WHERE vec_id % 100 = 0) a JOIN cut r ON r.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_near_dedup": NEAR_DEDUP,
    "op3_warc_derivatives": WARC_DERIVATIVES,
    "op4_decontamination": DECONTAMINATION,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op12_hard_negatives": HARD_NEGATIVES,
}
