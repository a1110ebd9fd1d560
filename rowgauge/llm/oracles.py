"""SQL that gives the rows of registered queries, for those that SQL can say."""

from __future__ import annotations

from .licenses import AGREEMENT, BASE, GAP, NOTICES


def _linked(size: int, percent: int) -> str:
    """Sets of shingles, links and what they reach, as tables `sizes` and `reach`."""
    return _LINKED.replace("{size}", str(size)).replace("{percent}", str(percent))


_LINKED = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) + 2 - {size}), lambda i: array_to_string(ws[i:i + {size} - 1], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= {percent} * (x.n_shingles + y.n_shingles - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
"""

NEAR_DUP = _linked(5, 85) + """
SELECT doc_id, n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n_shingles
"""
SET_JOIN = _linked(4, 85) + """
SELECT doc_id, n_shingles, min(other) AS component_id
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n_shingles
"""


def _grams() -> str:
    rows = []
    for number, template in enumerate(BASE + NOTICES):
        words = template.words.split()
        for k in range(len(words) - 1):
            rows.append(f"({number}, '{template.label}', {template.base}, {len(words) - 1}, {k}, '{words[k]}', '{words[k + 1]}')")
    return ", ".join(rows)


LICENSES = rf"""
WITH grams(template, label, base, grams, place, t1, t2) AS (VALUES {_grams()}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
pairs AS (
  SELECT doc_id, unnest(range(len(ws) - 1)) AS pos, unnest(ws[1:len(ws) - 1]) AS a, unnest(ws[2:]) AS b
  FROM words WHERE len(ws) >= 2),
votes AS (
  SELECT doc_id, template, label, base, grams, pos - place AS diagonal,
    bit_or(CAST(1 AS BIGINT) << place) AS bits, min(pos) AS first, max(pos) AS last
  FROM pairs JOIN grams ON a = t1 AND b = t2 GROUP BY ALL),
marked AS (
  SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER near > {GAP} AS INTEGER), 0) AS new
  FROM votes WHERE NOT base WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal)),
clustered AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM marked),
placed AS (
  SELECT doc_id, label, bit_count(bit_or(bits)) / greatest(any_value(grams), max(last) - min(first) + 1) AS score
  FROM clustered GROUP BY doc_id, template, label, cluster),
places AS (
  SELECT doc_id, label, true AS base, diagonal AS first, CAST(1 AS DOUBLE) AS score
  FROM votes WHERE base AND bit_count(bits) = grams
  UNION ALL SELECT doc_id, label, false, NULL, score FROM placed WHERE score >= {AGREEMENT}),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word,
    max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words LEFT JOIN found USING (doc_id)
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')))
  FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
  FROM words),
counts AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= 10),
inside AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, f FROM candidates WHERE k = 3
  UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM candidates WHERE k = 3),
reach AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN reach USING (lang, phrase)
  WHERE c.k = 3 OR longer IS NULL OR 100 * longer < 50 * c.f),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
