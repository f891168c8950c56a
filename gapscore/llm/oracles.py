"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, line, n, total, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (
    SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n, len(l) AS total
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  )
), starts AS (
  SELECT *, CASE WHEN n < 3 THEN 0
    WHEN (lag(h) OVER w + 31 * lag(h, 2) OVER w) % 2 = 0
      AND (lag(h, 2) OVER w + 31 * coalesce(lag(h, 3) OVER w, 0)) % 2 <> 0 THEN 1 ELSE 0 END AS starts
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM starts
), chunks AS (
  SELECT doc_id, k, any_value(total) AS total, string_agg(line, chr(10) ORDER BY n) AS body, count(*) AS n_lines,
         count(*) FILTER (trim(line, ' ') <> '') AS solid
  FROM numbered GROUP BY doc_id, k
), judged AS (
  SELECT *, solid >= 2 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, k) > 1 AS gone FROM chunks
), kept AS (
  SELECT doc_id, any_value(total)::INT AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0)::INT AS n_removed,
         string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone) AS body
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(body, '') END AS text, n_lines, n_removed
FROM kept JOIN documents d ON d.doc_id = kept.doc_id
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:row:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS source_rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, (source_rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
         (3 * source_size)::DOUBLE / ((source_rank - 1) % 3 + 1)::DOUBLE AS ratio,
         sum(source_size) OVER () AS total, sum((source_rank - 1) % 3 + 1) OVER () AS weights
  FROM ranked
), filling AS (
  SELECT *, ratio <= (total - coalesce(sum(cap) OVER f, 0))::DOUBLE / (weights - coalesce(sum(weight) OVER f, 0))::DOUBLE AS is_full
  FROM weighed
  WINDOW f AS (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_rank, source_size,
         CASE WHEN is_full THEN cap::DOUBLE ELSE
           (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE
           / (weights - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ())::DOUBLE * weight::DOUBLE END AS target,
         ((source_size + 63) // 64)::BIGINT AS blocks
  FROM filling
), drawn AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target * blocks / source_size + 0.5) END::BIGINT AS draws FROM targets
), slots AS (
  SELECT source_rank, draw % blocks AS index,
         (((('0x' || substr(md5('mix:draw:' || source_rank || ':' || draw), 1, 15))::BIGINT >> 30)
          * (SELECT greatest(1, (sum(draws) + 4095) // 4096) FROM drawn)::BIGINT) >> 30)::BIGINT AS shard
  FROM (SELECT source_rank, blocks, unnest(range(draws)) AS draw FROM drawn)
), permuted AS (
  SELECT source_rank, block,
         row_number() OVER (PARTITION BY source_rank ORDER BY md5('mix:block:' || source_rank || ':' || block)[1:15], block) - 1 AS index
  FROM (SELECT source_rank, unnest(range(blocks)) AS block FROM drawn)
), mixed AS (
  SELECT source_rank, block, count(*) AS n, min(shard) AS shard FROM slots JOIN permuted USING (source_rank, index) GROUP BY ALL
), placed AS (
  SELECT doc_id, size, source_rank,
         (sum(size) OVER (PARTITION BY source_rank ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), pieces AS (
  SELECT doc_id, size, source_rank, start, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block
  FROM placed WHERE size > 0
), taken AS (
  SELECT p.source_rank, p.start, p.size, min(shard) AS first_shard,
         sum(n * (least((p.block + 1) * 64, start + size) - greatest(p.block * 64, start)))::BIGINT AS taken
  FROM pieces p JOIN mixed t ON p.source_rank = t.source_rank AND p.block = t.block
  GROUP BY ALL
)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken, first_shard
FROM placed p JOIN targets t USING (source_rank)
LEFT JOIN taken k ON p.source_rank = k.source_rank AND p.start = k.start AND p.size = k.size AND p.size > 0
"""
