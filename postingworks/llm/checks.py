"""SQL that gives the rows of the queries on near-duplicates and substrings, by comparing all that share anything."""

from __future__ import annotations

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                               WHEN len(words) = 1 THEN words ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
                    GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

# repeated windows of a document, merged to islands; what lies between islands is kept
_ISLANDS = """
again AS (SELECT doc_id, i FROM wins WHERE win IN (SELECT win FROM wins GROUP BY win HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {size} THEN 1 ELSE 0 END AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
islands AS (SELECT doc_id, island, min(i) AS a, max(i) + {size} AS b FROM numbered GROUP BY ALL),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM islands
  UNION ALL SELECT t.doc_id, coalesce(max(islands.b), 0), t.n FROM t LEFT JOIN islands USING (doc_id) GROUP BY t.doc_id, t.n),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM islands GROUP BY doc_id)"""

SUBSTRINGS = r"""
WITH t AS (
  SELECT doc_id, words, len(words) AS n FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
wins AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 35], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(greatest(n - 34, 0))) AS i FROM t)),""" + _ISLANDS.format(size=35) + r""",
kept AS (
  SELECT doc_id, string_agg(array_to_string(words[a + 1:b], ' '), ' ' ORDER BY a) AS words
  FROM gaps JOIN t USING (doc_id) WHERE b > a GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SUFFIXES = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
wins AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS win
  FROM (SELECT doc_id, h, unnest(range(greatest(n - 199, 0))) AS i FROM t)),""" + _ISLANDS.format(size=200) + r""",
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h
  FROM (SELECT gaps.doc_id, h, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM gaps JOIN t USING (doc_id)) WHERE b > a GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
