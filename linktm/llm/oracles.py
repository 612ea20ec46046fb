"""DuckDB SQL for the queries whose rows SQL can state. Patterns and limits are those of the
operators, written out."""

from __future__ import annotations

# Words, lines and lower-casing as SQL macros would be views of their own; each statement is whole.
OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8
), hashed AS (
  SELECT win.doc_id, win.i, array_to_string(d.w[win.i:win.i + 7], ' ') AS g FROM win JOIN d USING (doc_id)
), twice AS (
  SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1
), base AS (
  SELECT d.doc_id, d.source, d.text, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), line AS (
  SELECT doc_id, source, text, k FROM (
    SELECT doc_id, source, text,
      regexp_replace(
        translate(trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g') AS k
    FROM base) WHERE k <> ''
), limits AS (
  SELECT source, k FROM line GROUP BY source, k
  HAVING count(DISTINCT text) > 20
), lost AS (
  SELECT doc_id, sum(len(string_split(line.k, ' ')))::BIGINT AS n
  FROM line JOIN limits ON line.k = limits.k AND line.source IS NOT DISTINCT FROM limits.source GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       coalesce(lost.n, 0)::BIGINT AS n_boilerplate_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT (100 * (n_words - coalesce(lost.n, 0)) < 30 * n_words) AS kept
FROM base LEFT JOIN lost USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common c JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b
  WHERE 100 * c.n >= 75 * (s.n + t.n - c.n)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(node, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b, low FROM reach JOIN edge ON node = a
)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, min(low) AS component_id, d.doc_id = min(low) AS kept
FROM d LEFT JOIN size USING (doc_id) JOIN reach ON node = d.doc_id GROUP BY 1, 2
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), corpus AS (
  SELECT count(*) FILTER (len(t) > 0)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d
), item AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), held AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, corpus GROUP BY term, docs
), scored AS (
  SELECT item_id, text, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM item JOIN held USING (term) JOIN weight USING (term), corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op6_minhash_hamming": OP6, "op9_line_dedup": OP9, "op13_dual_tree_search": OP13}
