"""DuckDB SQL for the corpus queries that SQL can express."""

from .license_scan import COVER, LONG, MERGE, SHORT, listed

WORD = r"'[^\x20\x09-\x0D]+'"

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, {WORD}) AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, lower(trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM d),
own AS (SELECT doc_id, source, line, count(*) * (length(line) - length(replace(line, ' ', '')) + 1) AS words FROM ln WHERE length(line) > 0 GROUP BY doc_id, source, line),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
often AS (SELECT o.source, line FROM own o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source GROUP BY o.source, line, docs HAVING count(*) > 20 AND count(*) > least(docs * 0.01, 100)),
lost AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS words FROM own o JOIN often f ON o.source IS NOT DISTINCT FROM f.source AND o.line = f.line GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w.words) AS n_words, length(array_to_string(w.words, '')) AS word_chars,
  length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(w.lines) - len(list_distinct(w.lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.words, 0) AS n_lost
  FROM w LEFT JOIN rep r USING (doc_id) LEFT JOIN lost l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_lost >= n_words * 0.2 AS kept FROM s
"""

MIXING = rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD})) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM s1),
level AS (SELECT rest, heavy FROM s2 WHERE NOT cap * heavy <= w * rest ORDER BY cap / w, source NULLS LAST LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN cap * heavy <= w * rest THEN CAST(cap AS DOUBLE) ELSE CAST(w * (SELECT rest FROM level) AS DOUBLE) / CAST((SELECT heavy FROM level) AS DOUBLE) END AS target FROM s2),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / CAST(source_size AS DOUBLE)), 3) ELSE 0 END AS passes FROM goal),
budgets AS (SELECT *, CAST(floor(target - passes * CAST(source_size AS DOUBLE)) AS BIGINT) AS budget FROM plan),
r1 AS (SELECT o.*, b.source_size, b.target, b.passes, b.budget, sum(size) OVER (PARTITION BY o.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source),
e1 AS (SELECT source, budget, min(h) FILTER (upto > budget) AS edge, coalesce(max(upto) FILTER (upto <= budget), 0) AS under FROM r1 GROUP BY source, budget),
r2 AS (SELECT o.doc_id, o.source, o.h, o.size, e.budget - e.under AS gap, sum(o.size) OVER (PARTITION BY o.source ORDER BY o.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized o JOIN e1 e ON o.source IS NOT DISTINCT FROM e.source WHERE o.h > e.edge AND o.size <= e.budget - e.under),
e2 AS (SELECT source, gap, min(h) FILTER (upto > gap) AS edge, coalesce(max(upto) FILTER (upto <= gap), 0) AS under, min(upto) FILTER (upto > gap) AS over FROM r2 GROUP BY source, gap)
SELECT r1.doc_id, r1.size, CAST(r1.source_size AS BIGINT) AS source_size, r1.target, CAST(least(r1.passes + CASE WHEN e1.edge IS NULL OR r1.h < e1.edge OR (r1.h > e1.edge AND r1.size <= e2.gap AND (e2.edge IS NULL OR r1.h < e2.edge OR (r1.h = e2.edge AND e2.over - e2.gap < e2.gap - e2.under))) THEN 1 ELSE 0 END, 3) * r1.size AS BIGINT) AS taken
FROM r1 JOIN e1 ON r1.source IS NOT DISTINCT FROM e1.source LEFT JOIN e2 ON r1.source IS NOT DISTINCT FROM e2.source
"""

_TEMPLATES = ", ".join(f"({i}, '{x}', '{label}', {base}, {k})" for i, x, label, base, k in listed())

LICENSE = rf"""
WITH t0 AS (SELECT template, string_split(phrase, ' ') AS w, label, base, k FROM (VALUES {_TEMPLATES}) v(template, phrase, label, base, k)),
t1 AS (SELECT *, unnest(range(len(w) - k + 1)) AS tpos FROM t0),
t AS (SELECT template, k, tpos, array_to_string(w[tpos + 1:tpos + k], ' ') AS gram FROM t1),
d AS (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(57344))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS pos FROM d, (SELECT unnest([{SHORT}, {LONG}]) AS k) WHERE len(w) >= k),
g AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS gram FROM p),
l AS (SELECT DISTINCT doc_id, template, pos - tpos AS diagonal FROM g JOIN t USING (k, gram)),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {MERGE} THEN 0 ELSE 1 END AS fresh FROM l),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM m),
e AS (SELECT n.doc_id, n.template, grp, diagonal, i, t0.base, t0.label, len(t0.w) AS size, diagonal + i >= 0 AND d.w[CASE WHEN diagonal + i >= 0 THEN diagonal + i + 1 END] IS NOT DISTINCT FROM t0.w[i + 1] AS hit
  FROM (SELECT *, unnest(range((SELECT max(len(w)) FROM t0))) AS i FROM n) n JOIN t0 USING (template) JOIN d USING (doc_id) WHERE i < len(t0.w)),
c AS (SELECT doc_id, template, grp, count(DISTINCT i) FILTER (hit) AS covered FROM e GROUP BY ALL),
o0 AS (SELECT doc_id, template, grp, diagonal, base, label, size, bool_and(hit) AS whole FROM e GROUP BY ALL),
s AS (SELECT o0.doc_id, template, grp, any_value(label) AS label, bool_or(base) AS base, any_value(size) AS size, any_value(covered) AS covered, count(*) FILTER (whole AND base) AS places, min(diagonal) FILTER (whole AND base) AS a, max(diagonal) FILTER (whole AND base) AS b FROM o0 JOIN c USING (doc_id, template, grp) GROUP BY ALL),
o AS (SELECT doc_id, CAST(sum(places) AS BIGINT) AS n_base, min(a) AS first_word, max(b) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (places > 0)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN base THEN places > 0 ELSE covered / size >= {COVER} END)), ',') AS labels, max(covered / size) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN o USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS words FROM p) QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(20)) AS k)),
one AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, as SQL."""
    rounds = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: {rounds}), 4294967295)"


TRIE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, turn, substr(sha256(strlen(role) || ':' || role || text), 1, 32) AS step, len(regexp_extract_all(text, {WORD})) AS words FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, step) AS i FROM x),
c AS (SELECT conv_id, {crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT conv_id, i, step, words FROM o JOIN c USING (conv_id) WHERE i > h UNION ALL SELECT c.conv_id, i - 4, step, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 WHERE i <= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(step, '') OVER w) AS prefix, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
q AS (SELECT *, lag(prefix) OVER w AS parent, lead(prefix) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
e AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM q WHERE last GROUP BY prefix),
n0 AS (SELECT prefix, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own FROM q GROUP BY prefix),
n AS (SELECT n0.*, coalesce(k.n, 0) AS n_children FROM n0 LEFT JOIN (SELECT parent, count(*) AS n FROM n0 GROUP BY parent) k ON k.parent = n0.prefix),
b AS (SELECT q.prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.prefix)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN b USING (prefix) LEFT JOIN n u ON u.prefix = n.parent LEFT JOIN e ON e.prefix = n.prefix
"""

#: Levels that the SQL writes out for each tree, one after the other.
_LEVELS = 9


def _tree(name: str, nodes: str, leaves: str) -> str:
    """CTEs that reduce nodes (g, i, h) and fold leaves (g, i, cur, path, more) up to their group's root, ``name_top`` and ``name_out``."""
    out = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM {nodes})", f"{name}_f0 AS (SELECT * FROM {leaves})"]
    for k in range(_LEVELS):
        out.append(f"{name}{k + 1} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM (SELECT g, i // 3 AS i, CASE WHEN c > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, i // 3, c))")
        out.append(f"{name}_s{k} AS (SELECT a.g, a.i, a.c, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3 GROUP BY a.g, a.i, a.c)")
        out.append(f"{name}_f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN c > 1 THEN sha256(l || cur || r) ELSE cur END AS cur, path || l || r AS path) FROM {name}_f{k} f JOIN {name}_s{k} s ON f.g = s.g AND f.i // {3**k} = s.i)")
    return ", ".join([*out, f"{name}_top AS (SELECT g, h FROM {name}{_LEVELS})", f"{name}_out AS (SELECT * FROM {name}_f{_LEVELS})"])


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

MANIFEST = rf"""
WITH d AS (SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf, sha256({_LEAF} || {_FIELD.format("(CASE WHEN " + crc32("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")}) AS cur FROM documents),
l AS (SELECT doc_id, leaf, cur, '' AS path, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n AS (SELECT g, i, leaf AS h FROM l), {_tree("a", "n", "l")},
m AS (SELECT 0 AS g, g AS i, h FROM a_top), k AS (SELECT o.doc_id, o.leaf, o.cur, o.path, 0 AS g, o.g AS i, t.h AS subroot FROM a_out o JOIN a_top t ON o.g = t.g), {_tree("b", "m", "k")}
SELECT doc_id, leaf, subroot, h AS root, sha256(path) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM b_out, b_top
"""

URLS = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM (SELECT DISTINCT host, path FROM p) u JOIN p USING (host, path)
LEFT JOIN (SELECT DISTINCT p.host, p.path, r.h, r.p, r.v, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) AS k FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) f ON f.host = p.host AND f.path = p.path AND k = 1
"""

ORACLE = {"op2_license_scan": LICENSE, "op5_substring_dedup": SUBSTRINGS, "op6_mixing": MIXING, "op7_quality_rules": QUALITY, "op11_prefix_trie": TRIE, "op12_manifest": MANIFEST, "op13_url_rules": URLS}
