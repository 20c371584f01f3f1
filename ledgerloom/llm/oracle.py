"""SQL twins of the text operators, for the checking engine."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {}

ORACLE["op2_decontaminate"] = f"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {PLAIN} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN} AS w FROM documents),
grams AS (
  SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, size, item FROM grams JOIN windows USING (size, gram)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

ORACLE["op3_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, '-'))), 1, 9) AS draw
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(source_size) OVER before, 0) * 2 AS DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, least(coalesce((SELECT min_by(level, (source_size / weight)) FROM levels
      WHERE level * weight < source_size * 2) * weight, CAST(source_size * 2 AS DOUBLE)), CAST(source_size * 2 AS DOUBLE)) AS target
  FROM levels),
plan AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS copies FROM goal),
cells AS (SELECT source, draw, sum(size) AS cell FROM sized GROUP BY source, draw),
summed AS (
  SELECT *, CAST(coalesce(sum(cell) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before
  FROM cells),
more AS (
  SELECT s.source, draw, before + cell / 2 <= target - copies * source_size AS more
  FROM summed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST((p.copies + CAST(m.more AS INT)) * d.size AS BIGINT) AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN more m ON d.source IS NOT DISTINCT FROM m.source AND d.draw = m.draw"""

ORACLE["op7_quality_rules"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM grams),
repeated AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM twice WHERE n > 1) GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(list_distinct(w)) AS n_distinct_words, len(regexp_extract_all(text, '\p{L}')) AS n_letters,
    len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeated USING (r)),
bits AS (
  SELECT *,
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words >= 50 AND 20 * n_distinct_words < n_words THEN 64 ELSE 0 END
    + CASE WHEN n_letters >= 40 AND 2 * n_upper > n_letters THEN 128 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 256 ELSE 0 END AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
  (failed & 463) = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM bits"""

ORACLE["op12_divergence"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT lang, source, r, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS source_n FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(source_n, 0) AS source_n, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sums USING (lang, source) LEFT JOIN langs USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // CAST(source_n + 5 * v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (CAST(total AS HUGEINT) + 5) // CAST(lang_n + 5 * v AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50"""

ORACLE["op13_prefix_tree"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps),
turns AS (
  SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS place FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS leader, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
used AS (
  SELECT c.conv_id, 0 AS part, place, key, words FROM convs c JOIN placed p ON p.conv_id = c.leader AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, key, words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND place > h),
made AS (
  SELECT conv_id, coalesce(keys, []) AS keys, coalesce(words, []) AS words
  FROM convs LEFT JOIN (
    SELECT conv_id, list(key ORDER BY part, place) AS keys, list(words ORDER BY part, place) AS words FROM used GROUP BY conv_id) USING (conv_id)),
members AS (
  SELECT conv_id, depth, len(keys) = depth AS ends, array_to_string(list_slice(keys, 1, depth), '') AS path,
    CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words
  FROM (SELECT conv_id, keys, words, unnest(generate_series(0, len(keys))) AS depth FROM made)),
nodes AS (
  SELECT path, depth, left(path, 64 * (depth - 1)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
children AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
sized AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children ON children.up = nodes.path),
below AS (
  SELECT left(path, 64 * d) AS path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(generate_series(0, depth)) AS d FROM sized) GROUP BY ALL)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM sized s JOIN below USING (path) LEFT JOIN nodes p ON s.depth > 0 AND p.path = s.up"""
