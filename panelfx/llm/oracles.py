"""DuckDB SQL of the queries that SQL can express."""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

# Sources fill to a water level; seats go to the highest of all quotients that can win.
OP6 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes) * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
            / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
seats AS (SELECT round(sum(target) / 16)::BIGINT AS seats, sum(target) AS total, count(*) AS n FROM targets),
source_quota AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, seat, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, source NULLS LAST, seat) AS place
    FROM targets, seats, unnest(range(0, ceil(target * (seats + n / 2) / nullif(total, 0) + 0.5)::BIGINT)) AS u(seat)
    WHERE target > 0)
  WHERE place <= (SELECT seats FROM seats) GROUP BY source),
placed AS (
  SELECT d.*, t.source_size, t.target, coalesce(q.quota, 0) AS source_quota,
         ('0x' || substr(place, 1, 12))::BIGINT % greatest(1, ceil(t.source_size / 1000000)::BIGINT, ceil(r.source_rows / 500000)::BIGINT) AS shard
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN sizes r ON d.source IS NOT DISTINCT FROM r.source
  LEFT JOIN source_quota q ON d.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, shard, source_quota, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL),
shard_quota AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * seat + 1) DESC, shard, seat) AS place
    FROM (SELECT *, sum(shard_size) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM shards),
         unnest(range(0, ceil(shard_size * (source_quota + n / 2) / nullif(total, 0) + 0.5)::BIGINT)) AS u(seat)
    WHERE shard_size > 0)
  WHERE place <= source_quota GROUP BY source, shard),
ahead AS (
  SELECT p.*, s.shard_size, least(coalesce(q.quota, 0) * 16, s.shard_size * 2) AS words,
         sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM placed p JOIN shards s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard
  LEFT JOIN shard_quota q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, size, source_size, target,
       (CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(0, least(size, words - words // shard_size * shard_size - before))
             ELSE 0 END)::BIGINT AS taken
FROM ahead
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
r AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(tokens) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(tokens) + 1) AS y,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
parts AS (
  SELECT doc_id, body, n, form, array_to_string(tokens[1:least(x, y)], '') AS prefix, array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(tokens[greatest(x, y) + 1:n], '') AS suffix
  FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
