WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || '0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (SELECT source, source_size, least(most, weight * (SELECT max(level) FROM levels)) AS target FROM levels),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets),
odds AS (SELECT *, floor(ratio)::BIGINT AS certain, ratio - floor(ratio) AS odd, target - floor(ratio) * source_size AS need FROM shares),
ranked AS (
  SELECT d.*, o.source_size, o.target, o.certain, o.odd, o.need, CASE WHEN o.odd > 0 AND d.size > 0 THEN
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto
  FROM sized d JOIN odds o ON d.source IS NOT DISTINCT FROM o.source),
cut AS (
  SELECT *, odd > 0 AND size > 0 AND coalesce(upto < need, FALSE) AS below FROM ranked),
gaps AS (
  SELECT source, need, need - coalesce(sum(size) FILTER (WHERE below), 0) AS gap FROM cut GROUP BY source, need),
ends AS (
  SELECT c.source, c.doc_id, abs(g.gap - c.size) < g.gap AS fits,
         row_number() OVER (PARTITION BY c.source ORDER BY abs(g.gap - c.size), c.u, c.doc_id) AS n
  FROM cut c JOIN gaps g ON c.source IS NOT DISTINCT FROM g.source WHERE NOT c.below AND c.odd > 0 AND c.size > 0)
SELECT c.doc_id, c.size, c.source_size, c.target,
       c.size * (c.certain + CASE WHEN c.below OR e.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS taken
FROM cut c LEFT JOIN ends e ON e.n = 1 AND e.fits AND e.source IS NOT DISTINCT FROM c.source AND e.doc_id = c.doc_id
