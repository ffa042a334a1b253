"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from classatlas.llm import quality

URL_FILTER = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES
    ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
best AS (
    SELECT host, path, max_by(struct_pack(rule := r_host || r_path, verdict := r_verdict),
                              length(r_host) + length(r_path)) AS b
    FROM (SELECT DISTINCT host, path FROM parsed)
    JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best USING (host, path)
"""

WARC = """
WITH digested AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
    FROM pages)
SELECT page_id, payload_bytes,
    array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)
        FOR k IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM digested
"""


def quality_rules() -> str:
    """The rule table as SQL conditions over measures of every text."""
    bounds = []
    for rule in quality.RULES:
        free = f"NOT {rule.where} OR " if rule.where else ""
        bounds += [f"({free}{rule.measure} >= {rule.least})"] if rule.least is not None else []
        bounds += [f"({free}{rule.measure} <= {rule.most})"] if rule.most is not None else []
    listed = ", ".join(f"'{lang}'" for lang in quality.STOP_LANGUAGES)
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        coalesce(lower(lang) IN ({listed}), true)
        AND strlen(coalesce(text, '')) <= {quality.MOST_BYTES} * length(coalesce(text, '')) AS stop_words_known
    FROM documents),
words AS (
    SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
    FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
ordered AS (
    SELECT r, i, w, lag(w) OVER o AS before, count(*) OVER (PARTITION BY r) AS n,
        list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS run
    FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS times FROM ordered WHERE len(run) = 8)
    WHERE times > 1),
covered AS (
    SELECT r, count(DISTINCT j) AS n_repeat_words
    FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM repeated) GROUP BY r),
counted AS (
    SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
        sum(length(w) - length(regexp_replace(w, '{quality.SYMBOLS}', '', 'g'))) AS n_symbols,
        count(*) FILTER (WHERE lower(w) IN ({stop})) AS n_stop_words,
        count(*) FILTER (WHERE w = before) AS n_stutters
    FROM ordered GROUP BY r),
lines AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
    SELECT doc_id, stop_words_known, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_stutters, 0) AS n_stutters
    FROM d LEFT JOIN counted USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
measured AS (
    SELECT *, 100 * (n_repeat_words / greatest(n_words, 1)) AS repeat_percent,
        word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
        n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_stutters / greatest(n_words, 1) AS stutter_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio
    FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    {' AND '.join(bounds)} AS kept
FROM measured
"""


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

IMPORTANCE = f"""
WITH bytes(b, c) AS (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
    FROM (SELECT unnest(range(256)) AS b)),
crc(tab) AS (SELECT list(c ORDER BY b) FROM bytes),
d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents),
t AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM benchmark),
runs AS (
    SELECT r, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS f
    FROM (SELECT r, ws, unnest([1, 2, 3]) AS n FROM (SELECT r, ws FROM d UNION ALL SELECT 0, ws FROM t)) WHERE len(ws) >= n),
hashed AS (
    SELECT f, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, strlen(f) * 2, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
        lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) % 10000 AS bucket
    FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM runs)), crc),
counts AS (SELECT r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY r, bucket),
sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE r = 0), 0)::BIGINT AS t, coalesce(sum(n) FILTER (WHERE r > 0), 0)::BIGINT AS s
    FROM counts GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
    FROM sums),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM counts JOIN gains USING (bucket) GROUP BY r),
scored AS (
    SELECT r, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((
            ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""

LEXICAL_SEARCH = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents),
sizes AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS terms FROM d WHERE len(ws) > 0),
q AS (
    SELECT i, item_id, w, count(*) AS times
    FROM (SELECT row_number() OVER () AS i, item_id,
            unnest(regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w
        FROM benchmark)
    GROUP BY i, item_id, w),
tf AS (
    SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d)
    WHERE w IN (SELECT w FROM q) GROUP BY r, w),
weights AS (
    SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
    FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), sizes),
scored AS (
    SELECT i, item_id, r, doc_id,
        sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * docs) // terms))))::BIGINT AS score
    FROM tf JOIN q USING (w) JOIN weights USING (w) JOIN d USING (r), sizes
    GROUP BY i, item_id, r, doc_id),
placed AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": URL_FILTER, "op6_quality_rules": quality_rules(), "op7_warc": WARC,
            "op11_importance": IMPORTANCE, "op12_lexical_search": LEXICAL_SEARCH}
