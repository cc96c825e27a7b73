"""op2: documents linked at Jaccard 0.9 of their three-word shingles.

The SQL joins all documents that share a shingle, which is fit for small tables alone; tests compare with brute force too.
"""

from loamwork.llm.jaccard import jaccard_groups
from loamwork.llm.shared import table


def query(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS shingles
  FROM words),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, ends.y FROM reach JOIN ends ON reach.other = ends.x)
SELECT s.doc_id, len(s.shingles) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c ON s.doc_id = c.doc_id
"""
