"""SQL for DuckDB that gives the rows of the queries SQL can express."""

from __future__ import annotations

from codequarry.llm.licenses import TEMPLATES

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP9 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS run
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT DISTINCT doc_id, s.n, i, list_slice(w, i, i + s.n - 1) AS run
  FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - s.n + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.run = bw.run),
word AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(n)) AS t(j) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""

_WORDS = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{_WORDS}') GROUP BY doc_id),
run AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 7)) AS n
  FROM d, unnest(range(1, len(w) - 6)) AS r(i)),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM run, unnest(range(8)) AS r(j) WHERE run.n > 1 GROUP BY doc_id),
word AS (
  SELECT doc_id, count(*) AS n_words, sum(len(x)) AS chars FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id),
stutter AS (
  SELECT doc_id, count(*) AS n FROM d, unnest(range(2, len(w) + 1)) AS r(i) WHERE w[i] = w[i - 1] GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(stutter.n, 0) AS n_stutters,
    len(regexp_extract_all(t, '[!?]')) AS n_loud, len(regexp_extract_all(t, '[A-ZÀ-Þ×]')) AS n_upper,
    len(regexp_extract_all(t, '[a-zß-ÿ÷]')) AS n_lower
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN word USING (doc_id)
    LEFT JOIN stutter USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_loud > 3 * n_words OR n_upper > n_lower
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_stutters > n_words
    OR 2 * n_dup_lines > n_lines) AS kept
FROM g
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
run AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY list_slice(w, i, i + 49)) AS least
  FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM run, unnest(range(50)) AS r(j) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS line FROM word ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
t AS (
  SELECT *, '### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
      ELSE role END || ': ' || CASE WHEN regexp_matches(text, '#{3}|</turn>')
      THEN regexp_replace(text, '(\\*(?:#{3,}|</turn>))', '\\\1', 'g') ELSE text END || ' </turn>' || chr(10) AS shown
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, shown)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, shown) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(shown)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP6 = rf"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {_ASCII}) AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(rule_host, rule_path, verdict)),
m AS (
  SELECT page_id, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule,
    arg_max(verdict, len(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP10 = rf"""
WITH tpl AS (
  SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT license, regexp_extract_all(translate(text, {_ASCII}), '{_LICENSE_WORD}') AS w
        FROM (VALUES {_TEMPLATE_ROWS}) AS v(license, text))),
unit AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)),
    string_split_regex(text, '\n[ \t\r]*\n'), [text])) AS unit FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT *, regexp_extract_all(translate(unit, {_ASCII}), '{_LICENSE_WORD}') AS w FROM unit)),
best AS (
  SELECT doc_id, license, max(round(2 * n / (lu + lt), 6)) AS dice
  FROM (SELECT doc_id, license, len(u.g) AS lu, len(tpl.g) AS lt, len(list_intersect(u.g, tpl.g)) AS n
        FROM u JOIN tpl ON len(u.g) * 120 >= len(tpl.g) * 80 AND len(tpl.g) * 120 >= len(u.g) * 80)
  WHERE 200 * n >= 80 * (lu + lt) GROUP BY doc_id, license),
top AS (
  SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses,
    first(license ORDER BY dice DESC, license) AS best_license, max(dice) AS best_dice
  FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, best_license,
  coalesce(best_dice, 0) AS best_dice
FROM documents d LEFT JOIN top ON d.doc_id = top.doc_id
"""

#: crc(v): lists of CRC-32 steps by byte; crc32 of a decimal text d is then _CRC.
_CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text, with the column crc_of at hand."""
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, len({text}) + 1), "
            f"lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), "
            "lambda c, b: xor(crc_of[xor(c, b) % 256 + 1], c // 256)), 4294967295)")


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_ID = "CAST(doc_id AS VARCHAR)"

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf,
    sha256({_LEAF} || CASE WHEN doc_id IS NOT NULL AND {_crc(_ID)} % 3 = 0
      THEN {_field(f"translate(text, {_ASCII})")} ELSE {_field("text")} END) AS changed
  FROM documents, crc),
leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
up AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY idx) AS h FROM leaf GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, len(h), 8), lambda i: sha256(array_to_string(h[i + 1:i + 8], '')))
  FROM up WHERE len(h) > 1),
sub AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up WHERE len(h) = 1),
over_ AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS h FROM sub
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(h), 8), lambda i: sha256(array_to_string(h[i + 1:i + 8], '')))
  FROM over_ WHERE len(h) > 1),
step AS (
  SELECT leaf.lang, idx, lvl, h, CAST(floor(idx / 8 ** lvl) AS BIGINT) AS spot FROM leaf JOIN up ON leaf.lang IS NOT DISTINCT FROM up.lang
  WHERE len(h) > 1
  UNION ALL
  SELECT leaf.lang, idx, 100 + lvl, h, CAST(floor(place / 8 ** lvl) AS BIGINT) FROM leaf
    JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, over_ WHERE len(h) > 1),
path AS (
  SELECT lang, idx, row_number() OVER (PARTITION BY lang, idx ORDER BY lvl) AS k,
    array_to_string(h[spot // 8 * 8 + 1:spot], '') AS before, array_to_string(h[spot + 2:spot // 8 * 8 + 8], '') AS after
  FROM step),
proof AS (SELECT lang, idx, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM path GROUP BY lang, idx),
fold AS (
  SELECT lang, idx, CAST(0 AS BIGINT) AS k, changed AS h FROM leaf
  UNION ALL
  SELECT fold.lang, fold.idx, path.k, sha256(before || h || after) FROM fold
    JOIN path ON fold.lang IS NOT DISTINCT FROM path.lang AND fold.idx = path.idx AND path.k = fold.k + 1),
folded AS (SELECT lang, idx, arg_max(h, k) AS h FROM fold GROUP BY lang, idx),
root AS (SELECT h[1] AS root FROM over_ WHERE len(h) = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded.h AS folded_root,
  folded.h = root AS verified
FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang
  JOIN folded ON leaf.lang IS NOT DISTINCT FROM folded.lang AND leaf.idx = folded.idx
  LEFT JOIN proof ON leaf.lang IS NOT DISTINCT FROM proof.lang AND leaf.idx = proof.idx, root
"""

_CONV = "CAST(conv_id AS VARCHAR)"

OP13 = rf"""
WITH {_CRC_TABLE},
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS idx
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {_crc(_CONV)} % 4 AS h, conv_id - conv_id % 20 AS base FROM t, crc),
r AS (
  SELECT c.conv_id, 0 AS part, idx, role, text FROM c JOIN t ON t.conv_id = c.base WHERE idx < h
  UNION ALL
  SELECT c.conv_id, 1, idx, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE idx >= h),
p AS (
  SELECT conv_id, list(role || chr(10) || text) OVER w AS node, row_number() OVER w AS depth,
    count(*) OVER (PARTITION BY conv_id) AS size, len(regexp_extract_all(text, '{_WORDS}')) AS words
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, idx ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, [], 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id), 0 FROM c),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM p GROUP BY node, depth),
kid AS (SELECT node[:depth - 1] AS node, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
one AS (SELECT n.*, coalesce(kid.n, 0) AS n_children FROM n LEFT JOIN kid ON n.node = kid.node),
under AS (
  SELECT node[:k] AS node, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM one, unnest(range(depth + 1)) AS u(k) GROUP BY ALL)
SELECT one.conv_id, one.depth, up.conv_id AS parent_conv_id, one.n_convs, one.n_children, n_leaves,
  CAST(under.saved AS BIGINT) AS saved_tokens, sha256(one.ends) AS ends_sha256
FROM one JOIN under ON one.node = under.node LEFT JOIN n AS up ON one.depth > 0 AND up.node = one.node[:one.depth - 1]
"""

#: Bytes as pairs of hexadecimal digits: strings of 50 bytes have 100, here told apart by their MD5.
OP12 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part_of AS (SELECT doc_id, k, x[2 * k + 1:2 * k + 2098] AS y FROM d, unnest(range(0, len(x) // 2, 1000)) AS r(k)),
win AS (SELECT doc_id, k + i AS i, md5_number(y[2 * i + 1:2 * i + 100]) AS w
  FROM part_of, unnest(range(0, least(1000, len(y) // 2 - 49))) AS r(i)),
first_of AS (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM win GROUP BY w),
run AS (SELECT doc_id, i, least FROM win JOIN first_of USING (w) WHERE least < most),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM run WHERE least < doc_id),
span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, count(*) FILTER (last IS NULL OR i > last + 50) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone)
  GROUP BY doc_id, k),
part AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS since, lead(a) OVER w IS NULL AS final
  FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(x[2 * since + 1:2 * a] || CASE WHEN final THEN x[2 * b + 1:] ELSE '' END, '' ORDER BY a) AS x
  FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
