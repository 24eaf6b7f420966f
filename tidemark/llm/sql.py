"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import licences

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
x AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS win FROM p),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM x),
g AS (SELECT doc_id, i, word, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w WHERE len(ws) > 0),
c AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN t x ON a = x.doc_id JOIN t y ON b = y.doc_id WHERE shared >= 0.8 * (x.n + y.n - shared)
  UNION ALL SELECT min(doc_id) OVER (), doc_id FROM w WHERE len(ws) = 0),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a)
SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id
"""


def _licences() -> str:
    """Sentences, identifiers and one step for each rule, as in the operator."""
    names = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{k}'" for k, p in licences.SENTENCES)
    hint = f"(?i){licences.HINT}"
    sql = f"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;:])\\s+', E'\\\\1\\n', 'g'), '[\\r\\n]+'), lambda s: regexp_matches(s, '{hint}')) AS hinted FROM documents),
b AS (SELECT doc_id, list_transform(hinted, lambda s: trim(regexp_replace(replace(lower(s), 'licence', 'license'), '[^a-z0-9]+', ' ', 'g'))) AS n FROM a),
c AS (SELECT doc_id, list_filter(list_transform(n, lambda s: CASE {names} END), lambda x: x IS NOT NULL) AS ids FROM b),
r0 AS (SELECT doc_id, ids, ',' || array_to_string(list_transform(ids, lambda x: x || ','), '') AS l, CAST([] AS VARCHAR[]) AS f FROM c)"""
    for i, (name, rule) in enumerate(licences.RULES, 1):
        sql += f",\nr{i} AS (SELECT doc_id, ids, regexp_replace(l, ',(?:{rule})+', ',', 'g') AS l, CASE WHEN regexp_matches(l, ',{rule}') THEN list_append(f, '{name}') ELSE f END AS f FROM r{i - 1})"
    return sql + f"\nSELECT doc_id, array_to_string(list_sort(list_distinct(f)), ',') AS licences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_filter(string_split(l, ','), lambda x: x <> ''), ',') AS unmatched FROM r{len(licences.RULES)}"


LICENCES = _licences()
