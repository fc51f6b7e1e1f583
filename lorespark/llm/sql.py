"""SQL for operators whose definition is easier to state than their method."""

WORDS = r"""words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

SUBSTRING_DEDUP = f"""
WITH {WORDS}, windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM words, unnest(range(1, len(ws) - 48)) u(i)
), found AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM found, unnest(range(0, 50)) r(k)
), each_word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM each_word e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

NGRAM_JOIN = f"""
WITH RECURSIVE {WORDS}, grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(ws) - 3, 2))) u(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= 0.8::DOUBLE
  UNION ALL SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON len(x.ws) = 0 AND len(y.ws) = 0 AND x.doc_id < y.doc_id
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), classes AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY 1
), degrees AS (
  SELECT a, count(*) AS n FROM links GROUP BY 1
)
SELECT doc_id, class_id, min(doc_id) OVER (PARTITION BY ws) AS copy_id, coalesce(n, 0) AS n_links
FROM words JOIN classes c ON c.a = doc_id LEFT JOIN degrees d ON d.a = doc_id
"""
