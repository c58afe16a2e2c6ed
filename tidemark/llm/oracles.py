"""DuckDB SQL with the rows of the registered queries."""

op1_near_dedup = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh
    FROM w
), e AS (
    SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), l AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id
"""

op2_mixing = r"""
WITH n AS (
    SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
        (CAST(('0x' || substr(md5('0/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents
), d AS (
    SELECT *, CAST(length(bin(size + 1)) AS BIGINT) AS digits FROM n
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), f AS (
    SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS l,
        CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
    FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
), t AS (
    SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE),
        weight * max(CASE WHEN l * weight <= 4 * source_size * rest THEN CAST(l AS DOUBLE) / CAST(2 * rest AS DOUBLE) END) OVER ()) AS target FROM f
), b AS (
    SELECT source, digits, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, digits HAVING sum(size) > 0
), p AS (
    SELECT b.*, t.source_size, t.target,
        (t.target - CAST(2 * coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(words * digits) OVER (PARTITION BY b.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
), v AS (
    SELECT source, max(CASE WHEN level * digits <= 2 THEN level END) AS level FROM p GROUP BY source
), x AS (
    SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE WHEN t.target >= CAST(2 * t.source_size AS DOUBLE) THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, v.level * d.digits) END AS expected
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source
), q AS (
    SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM x
), r AS (
    SELECT *, target - CAST(sum(whole * size) OVER (PARTITION BY source) AS DOUBLE) AS rest,
        CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds
    FROM q
), k AS (
    SELECT *, CAST(floor(odds / (1 + odds) * 281474976710656.0::DOUBLE) AS BIGINT) AS rank FROM r
), c AS (
    SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS taken_in_order FROM k
), g AS (
    SELECT *, rest - sum(CASE WHEN taken_in_order THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c
), e AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rank IS NOT NULL AND NOT taken_in_order AND abs(gap - size) < gap THEN abs(gap - size) END NULLS LAST, rank, doc_id) = 1
        AND rank IS NOT NULL AND NOT taken_in_order AND abs(gap - size) < gap AS closes FROM g
)
SELECT doc_id, size, source_size, target, size * (whole + CAST(taken_in_order AS BIGINT) + CAST(closes AS BIGINT)) AS taken FROM e
"""

op3_url_filter = r"""
WITH c AS (
    SELECT page_id, nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''), '\.$', '')), '') AS host,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id % 525600 * 7919 % 525600) AS fetched_at
    FROM pages
), h AS (
    SELECT DISTINCT host, md5(host) AS m FROM c WHERE host IS NOT NULL
), n AS (
    SELECT host, CAST('0x' || substr(m, 1, 4) AS INT) AS a, CAST('0x' || substr(m, 5, 4) AS INT) % 180 AS d1, CAST('0x' || substr(m, 9, 4) AS INT) % 60 AS d2,
        regexp_extract(host, '^[^.]+\.([^.]+\.[^.]+\..+)$', 1) AS parent FROM h
), l AS (
    SELECT CASE WHEN a % 3 = 0 THEN host WHEN a % 3 = 1 AND parent <> '' THEN parent END AS pattern, unnest([d1, d1 + 30 + d2, d1 + 90 + d2]) AS day, unnest([true, false, true]) AS added FROM n
), g AS (
    SELECT pattern, TIMESTAMP '2024-01-01 00:00:00' + to_days(day) AS since, bool_or(added) AS added FROM l WHERE pattern IS NOT NULL GROUP BY pattern, day
), v AS (
    SELECT pattern, added, since AS valid_from, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS valid_to FROM g
)
SELECT c.page_id, c.host, c.fetched_at, max(v.pattern) IS NOT NULL AS listed, arg_max(v.pattern, len(v.pattern)) AS pattern, arg_max(v.valid_from, len(v.pattern)) AS valid_from
FROM c LEFT JOIN v ON v.added AND c.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to) AND (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern))
GROUP BY c.page_id, c.host, c.fetched_at
"""

op4_va_file = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

op8_warc = r"""
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
