"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from tidewatch.llm import mixing, quality, shards

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH texts AS (SELECT doc_id, {WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM texts, unnest(generate_series(1, len(ws) - 19)) AS x(i)
),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM windows, unnest(generate_series(0, 19)) AS y(j) WHERE nth > 1),
words AS (SELECT doc_id, i, ws[i] AS word FROM texts, unnest(generate_series(1, len(ws))) AS z(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

CRC = """
crc_bits AS (
  SELECT b, list_reduce([b::UBIGINT] || generate_series(1, 8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM generate_series(0, 255) AS x(b)
),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits)
"""

SCORES = rf"""
WITH {CRC},
texts AS (
  SELECT doc_id, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda h: ord(h)::UBIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295) % 7 = 2 AS held_out,
    [' begin', ' begin'] || regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') || [' end'] AS ws
  FROM documents, crc_table
),
tokens AS (SELECT doc_id, held_out, ws[i] AS w, ws[i - 1] AS h, ws[i - 2] AS g FROM texts, unnest(generate_series(3, len(ws))) AS z(i)),
training AS (SELECT w, h, g FROM tokens WHERE NOT held_out),
ones AS (SELECT w, count(*) AS c FROM training GROUP BY w),
states AS (SELECT h, count(*) AS c FROM training GROUP BY h),
arcs AS (SELECT h, w, count(*) AS c FROM training GROUP BY h, w),
states2 AS (SELECT g, h, count(*) AS c FROM training GROUP BY g, h),
arcs2 AS (SELECT g, h, w, count(*) AS c FROM training GROUP BY g, h, w),
size AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM ones),
counted AS (
  SELECT doc_id, held_out, n, coalesce(ones.c, 0) AS c, (coalesce(ones.c, 0) + 1) / (n + v + 1)::DOUBLE AS p,
    coalesce(arcs.c, 0) AS ca, coalesce(states.c, 0) AS cs, coalesce(arcs2.c, 0) AS ca2, coalesce(states2.c, 0) AS cs2
  FROM tokens CROSS JOIN size LEFT JOIN ones USING (w) LEFT JOIN states USING (h) LEFT JOIN arcs USING (h, w)
    LEFT JOIN states2 USING (g, h) LEFT JOIN arcs2 USING (g, h, w)
),
scored AS (SELECT *, (ca2 + 100 * ((ca + 100 * p) / (cs + 100))) / (cs2 + 100) AS q FROM counted)
SELECT doc_id, held_out, count(*) AS n_tokens, (count(*) FILTER (WHERE c > 0)) AS n_known, n::BIGINT AS train_tokens,
  round(sum(log10(p)), 6) AS base_score, round(sum(log10(q)), 6) AS score
FROM scored GROUP BY doc_id, held_out, n
"""

STOPS = ", ".join(f"'{w}'" for w in sorted(set().union(*quality.STOP_WORDS.values())))


def _rules(rules: tuple[quality.Rule, ...]) -> str:
    """The threshold table as SQL, restated from its numbers."""
    tests = []
    for rule in rules:
        top, below, factor = quality.MEASURES[rule.measure]
        unit = f"greatest({below}, 1)" if below else "1"
        tests += [f"{factor} * {top} < {unit} * {rule.low}"] * (rule.low is not None)
        tests += [f"{factor} * {top} > {unit} * {rule.high}"] * (rule.high is not None)
    return " OR ".join(tests)


QUALITY = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n
  FROM texts, unnest(generate_series(1, len(ws) - 7)) AS x(i)
),
repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, unnest(generate_series(0, 7)) AS y(j) WHERE n > 1 GROUP BY doc_id
),
measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda w: list_contains([{STOPS}], lower(w))))::BIGINT AS n_stop_words
  FROM texts LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({_rules(quality.BASE)}) AS base_failed, NOT ({_rules(quality.RULES)}) AS kept
FROM measured
"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
  FROM items, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS x(i) WHERE len(ws) > 0
),
windows AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM texts, (SELECT DISTINCT n FROM grams) AS sizes, unnest(generate_series(1, len(ws) - n + 1)) AS y(i)
),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, unnest(generate_series(0, n - 1)) AS z(j) GROUP BY doc_id),
found AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM texts LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
INFILL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS us,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex
  FROM documents
),
draws AS (
  SELECT doc_id, text, us, len(us)::BIGINT AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(hex, i, 8))::BIGINT) AS h
  FROM texts
),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
),
pieces AS (
  SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle,
    array_to_string(us[b + 1:], '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""

TRIE = f"""
WITH {CRC},
turns AS (
  SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
  )
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda h: ord(h)::UBIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
),
rebuilt AS (
  SELECT c.conv_id, pos, k, size FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, pos, k, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos > h
),
places AS (
  SELECT conv_id, 0::BIGINT AS d, 0::BIGINT AS size, '' AS path FROM convs
  UNION ALL SELECT conv_id, row_number() OVER w, size, string_agg(k, '') OVER w FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
),
longest AS (SELECT conv_id, max(d) AS d FROM places GROUP BY conv_id),
nodes AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM places GROUP BY d, path),
ending AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM places JOIN longest USING (conv_id, d) GROUP BY path
),
above AS (
  SELECT nodes.d, nodes.path, p.path AS up FROM nodes JOIN places p ON p.conv_id = nodes.conv_id AND p.d = nodes.d - 1
),
kids AS (SELECT up AS path, count(*) AS n FROM above GROUP BY up),
below AS (
  SELECT p.path, sum((nodes.n - 1) * nodes.size)::BIGINT AS saved, (count(*) FILTER (WHERE kids.n IS NULL))::BIGINT AS leaves
  FROM nodes LEFT JOIN kids USING (path) JOIN places p ON p.conv_id = nodes.conv_id AND p.d <= nodes.d GROUP BY p.path
)
SELECT nodes.conv_id, nodes.d AS depth, parents.conv_id AS parent_conv_id, nodes.n::BIGINT AS n_convs,
  coalesce(kids.n, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ending USING (path)
  LEFT JOIN above ON above.path = nodes.path LEFT JOIN nodes AS parents ON parents.path = above.up
"""

ORACLE = {
    "op1_substring_dedup": SUBSTRINGS,
    "op2_backoff_scores": SCORES,
    "op3_poisson_mixing": mixing.ORACLE,
    "op5_quality_rules": QUALITY,
    "op6_benchmark_decontamination": CONTAMINATION,
    "op9_interleaved_shards": shards.ORACLE,
    "op12_fill_in_middle": INFILL,
    "op13_prefix_trie": TRIE,
}
