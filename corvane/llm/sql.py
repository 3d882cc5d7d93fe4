"""DuckDB statements for the queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(sha256(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 16) AS at
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM sums
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
  FROM ranked
), targets AS (
  SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN x * w <= cap THEN x END) OVER (), 'infinity'::DOUBLE)) AS target FROM levels
), run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.at, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END - (upto - size))))::BIGINT AS taken
FROM run
"""

ORACLES = {"op3_mixing": MIXING}

URLS = r"""
WITH captures AS (
  SELECT page_id, TIMESTAMP '2024-01-01 12:00:00' + to_days((page_id * 37 % 366)::INT) AS fetched_at,
         nullif(regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host
  FROM pages
), keys AS (
  SELECT host, array_to_string(l[i:], '.') AS domain, len(l) - i + 1 AS labels
  FROM (SELECT host, l, unnest(range(1, greatest(1, len(l) - 1) + 1)) AS i
        FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM captures WHERE host IS NOT NULL))
), listed AS (
  SELECT domain, concat('0x', substr(md5(domain), 1, 6))::UBIGINT::BIGINT AS d FROM (SELECT DISTINCT domain FROM keys)
), spans AS (
  SELECT domain, d, d % 200 AS a, CASE WHEN d % 4 < 2 THEN d % 200 + 30 + d % 70 END AS b FROM listed WHERE d % 6 < 3
  UNION ALL SELECT domain, d, d % 200 + 130 + d % 70, NULL FROM listed WHERE d % 6 < 3 AND d % 4 < 1
), hits AS (
  SELECT c.page_id, k.labels, d % 6 = 2 AS allows, s.domain, 'list-' || d % 3 AS list
  FROM captures c JOIN keys k USING (host) JOIN spans s USING (domain)
  WHERE TIMESTAMP '2024-01-01' + to_days(a::INT) <= fetched_at AND (b IS NULL OR fetched_at < TIMESTAMP '2024-01-01' + to_days(b::INT))
), best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM hits
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY labels DESC, allows DESC, domain DESC, list DESC) = 1
)
SELECT c.page_id, c.host, c.fetched_at, coalesce(n, 0)::BIGINT AS n_active, domain, list,
       CASE WHEN domain IS NULL THEN 'kept' WHEN allows THEN 'allowed' ELSE 'blocked' END AS verdict
FROM captures c LEFT JOIN best USING (page_id)
"""

TOOLCALLS = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, concat('0x', substr(md5(coalesce(text, '')), 1, 6))::UBIGINT::BIGINT AS d FROM conversations
), calls AS (
  SELECT *, 'call_' || turn AS call_id, ['search', 'lookup', 'other'][1 + d % 3] AS name, to_json(text)::VARCHAR AS q,
         CASE WHEN d % 11 = 0 THEN 'bad' WHEN d % 7 = 0 THEN 'many' WHEN d % 5 = 0 THEN 'limit' ELSE 'whole' END AS shape
  FROM turns WHERE role = 'assistant'
), results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, text AS content, 1::BIGINT AS n FROM turns WHERE role = 'user' AND turn > 0
), levels AS (
  SELECT conv_id, turn, 0 AS level FROM calls c WHERE d % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2 AND c.d % 3 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) AS position FROM levels
), linked AS (
  SELECT c.*, r.content, r.n, p.level, p.position, coalesce(c.conv_id, r.conv_id) AS conv, coalesce(c.call_id, r.call_id) AS id,
         c.d % 3 = 0 AND NOT EXISTS (SELECT 1 FROM calls x WHERE x.conv_id = c.conv_id AND x.turn = c.turn - 2) AS missing
  FROM calls c LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
)
SELECT conv AS conv_id, id AS call_id, level, position, name, coalesce(n, 0)::BIGINT AS n_results,
  CASE WHEN call_id IS NULL THEN 'no call' ELSE concat_ws(',', CASE WHEN n IS NULL THEN 'no result' END, CASE WHEN missing THEN 'missing dependency' END,
    CASE WHEN shape = 'bad' THEN 'invalid arguments' END, CASE WHEN name = 'other' THEN 'unknown tool' END,
    CASE WHEN name <> 'other' AND shape = 'limit' THEN 'missing field' END, CASE WHEN name <> 'other' AND shape = 'many' THEN 'wrong type' END,
    CASE WHEN name = 'lookup' AND shape = 'whole' THEN 'unknown field' END) END AS problems,
  '{' || concat_ws(',',
    CASE shape WHEN 'many' THEN '"arguments":{"limit":"many","query":' || q || '}' WHEN 'limit' THEN '"arguments":{"limit":' || d % 50 || '}'
      WHEN 'whole' THEN '"arguments":{"deep":{"a":null,"b":[1,true]},"limit":' || d % 50 || ',"query":' || q || '}' END,
    CASE WHEN content IS NOT NULL THEN '"content":' || to_json(content)::VARCHAR END, '"id":"' || id || '"', CASE WHEN name IS NOT NULL THEN '"name":"' || name || '"' END) || '}' AS message
FROM linked
"""

ORACLES |= {"op2_urls": URLS, "op8_toolcalls": TOOLCALLS}
