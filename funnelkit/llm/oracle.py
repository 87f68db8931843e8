"""DuckDB SQL for the dealt operators that SQL can express."""

OP12 = """
SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha256(t) AS payload_digest,
       CASE WHEN octet_length(encode(t)) < 100 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN octet_length(encode(t)) >= 100 AND place > 1 THEN first_id END AS refers_to, url
FROM (SELECT page_id, url, t, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS place,
             first_value(page_id) OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS first_id
      FROM (SELECT page_id, url, coalesce(html, '') AS t FROM pages))
"""

OP13 = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
one AS (SELECT lang, w[i] AS x, count(*) AS f FROM places GROUP BY ALL),
two AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL),
three AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
inside AS (
    SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
cuts AS (
    SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
    FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
    LEFT JOIN inside i ON i.lang = t.lang AND i.x = t.x AND i.y = t.y
    WHERE t.f >= 10 AND (i.most IS NULL OR 100 * i.most < 50 * t.f)
    UNION ALL
    SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
    FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
    UNION ALL
    SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
    FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
scored AS (
    SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM weakest)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score
FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= 2000
"""
