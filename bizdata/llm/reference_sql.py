"""DuckDB SQL of operators that it can express, over the tables `documents` and `benchmark`."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f'translate({text}, {UPPER!r}, {LOWER!r})' if lower else text}, '{pattern}')"


#: Words covered by a window of 50 that also starts in a document with a smaller id; the rest kept.
SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {words('text', SPACED, False)} AS words FROM documents),
starts AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
firsts AS (SELECT run, min(doc_id) AS first_id FROM starts GROUP BY run),
hit AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS p FROM (SELECT s.doc_id, s.i FROM starts s JOIN firsts f ON f.run = s.run WHERE f.first_id < s.doc_id)),
places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
kept AS (SELECT l.doc_id, count(h.p) AS n_removed, string_agg(word, ' ' ORDER BY l.p) FILTER (h.p IS NULL) AS text FROM places l LEFT JOIN hit h ON h.doc_id = l.doc_id AND h.p = l.p GROUP BY l.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

#: Document words inside any occurrence of an item's window of ten words, or of the whole of a shorter item.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {words('text', LETTERS, True)} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words('text', LETTERS, True)} AS words FROM benchmark),
cut AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS run FROM (
  SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
starts AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS run FROM (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM cut) WHERE len(words) >= size)),
found AS (SELECT s.doc_id, s.i, s.size, c.item_id FROM starts s JOIN cut c ON c.size = s.size AND c.run = s.run),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

#: Documents linked by 100 * intersection >= 80 * union of their four-word shingles, and what links connect.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words('text', SPACED, True)} AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, key) AS rep FROM (
  SELECT s.doc_id, n, string_agg(run, chr(0) ORDER BY run) AS key FROM sets s JOIN sizes z ON z.doc_id = s.doc_id GROUP BY s.doc_id, n)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM (SELECT s.* FROM sets s JOIN classes c ON c.doc_id = s.doc_id AND c.rep = s.doc_id) a
  JOIN (SELECT s.* FROM sets s JOIN classes c ON c.doc_id = s.doc_id AND c.rep = s.doc_id) b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT rep AS id, rep AS root FROM classes UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.id WHERE r.root < e.y),
named AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN classes c ON c.doc_id = w.doc_id LEFT JOIN named m ON m.id = c.rep
"""
