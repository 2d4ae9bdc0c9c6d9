"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

#: crc32 of a decimal number, a bit at a time over its digits.
_CRC = """(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
 lambda acc, b: list_reduce(list_prepend(xor(acc, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda v, one: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT))"""


def crc32(x: str) -> str:
    return _CRC.format(x=x)


def near_duplicates(words: int, kept: bool) -> str:
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
named AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id{", s.doc_id = coalesce(c, s.doc_id) AS kept" if kept else ""} FROM s LEFT JOIN named ON s.doc_id = named.a"""


_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + ")"
_BESIDE = "coalesce(string_agg(h, '') OVER (PARTITION BY {t}, level, pos // 3 ORDER BY pos ROWS BETWEEN {a} AND {b}), '')"


def _levels(name: str, tree: str, base: str) -> str:
    """Nodes of all levels of some trees, with the siblings before and after each."""
    before, after = _BESIDE.format(t=tree, a="UNBOUNDED PRECEDING", b="1 PRECEDING"), _BESIDE.format(t=tree, a="1 FOLLOWING", b="UNBOUNDED FOLLOWING")
    return f"""{name} AS ({base} UNION ALL SELECT {tree}, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM
 (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {name}) WHERE n > 1 GROUP BY {tree}, level, pos // 3),
{name}_nodes AS (SELECT {tree}, level, pos, {before} AS l, {after} AS r, max(level) OVER (PARTITION BY {tree}) AS top FROM {name})"""


MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, chr(1)) AS tree, {_LEAF.format(t="text")} AS leaf,
  CASE WHEN {crc32("doc_id")} % 2 = 0 THEN {_LEAF.format(t="replace(text, chr(10), '')")} ELSE {_LEAF.format(t="text")} END AS start,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
{_levels("low", "tree", "SELECT tree, 0 AS level, place AS pos, leaf AS h FROM d")},
subs AS (SELECT tree, arg_max(h, level) AS subroot FROM low GROUP BY tree),
ranked AS (SELECT tree, 'all' AS one, subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM subs),
{_levels("high", "one", "SELECT one, 0 AS level, place AS pos, subroot AS h FROM ranked")},
climb AS (SELECT doc_id, tree, 0 AS level, place AS pos, start AS h, '' AS siblings FROM d
 UNION ALL SELECT c.doc_id, c.tree, c.level + 1, c.pos // 3, sha256(n.l || c.h || n.r), c.siblings || n.l || n.r
 FROM climb c JOIN low_nodes n ON n.tree = c.tree AND n.level = c.level AND n.pos = c.pos WHERE c.level < n.top),
half AS (SELECT doc_id, tree, arg_max(h, level) AS h, arg_max(siblings, level) AS siblings FROM climb GROUP BY doc_id, tree),
above AS (SELECT h.doc_id, 0 AS level, r.place AS pos, h.h, h.siblings FROM half h JOIN ranked r ON r.tree = h.tree
 UNION ALL SELECT c.doc_id, c.level + 1, c.pos // 3, sha256(n.l || c.h || n.r), c.siblings || n.l || n.r
 FROM above c JOIN high_nodes n ON n.level = c.level AND n.pos = c.pos WHERE c.level < n.top),
whole AS (SELECT doc_id, arg_max(h, level) AS folded_root, sha256(arg_max(siblings, level)) AS proof_sha256 FROM above GROUP BY doc_id),
root AS (SELECT arg_max(h, level) AS root FROM high)
SELECT d.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM d JOIN subs USING (tree) JOIN whole USING (doc_id) CROSS JOIN root"""

PREFIXES = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
one AS (SELECT c, count(*) AS n, c - c % 5 AS base, {crc32("c")} % 9 AS h FROM t GROUP BY c),
cv AS (SELECT one.*, least(one.h, coalesce(b.n, 0)) AS taken FROM one LEFT JOIN one b ON b.c = one.base),
seq AS (SELECT cv.c, taken + p - h + 1 AS d, role, x FROM cv JOIN t ON t.c = cv.c WHERE p >= h UNION ALL SELECT cv.c, p + 1, role, x FROM cv JOIN t ON t.c = cv.base WHERE p < h),
m AS (SELECT c, 0 AS d, '' AS k, 0 AS bytes FROM cv UNION ALL
  SELECT c, d, sha256(string_agg(sha256(strlen(role) || ':' || role || x), '') OVER (PARTITION BY c ORDER BY d)), strlen(x) FROM seq),
len AS (SELECT c, max(d) AS last FROM m GROUP BY c),
up AS (SELECT m.*, lag(k) OVER (PARTITION BY m.c ORDER BY d) AS pk, last FROM m JOIN len ON len.c = m.c),
node AS (SELECT d, k, max(pk) AS pk, min(c) AS conv, count(*) AS n, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends FROM up GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k),
below AS (SELECT DISTINCT a.d, a.k, b.d AS d2, b.k AS k2 FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
total AS (SELECT b.d, b.k, count(*) FILTER (WHERE o.kids = 0) AS leaves, sum((o.n - 1) * o.bytes) AS saved FROM below b JOIN own o ON o.d = b.d2 AND o.k = b.k2 GROUP BY b.d, b.k)
SELECT o.conv AS conv_id, CAST(o.d AS BIGINT) AS depth, p.conv AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN total t ON t.d = o.d AND t.k = o.k LEFT JOIN own p ON p.d = o.d - 1 AND p.k = o.pk"""

ORACLES = {
    "op7_jaccard": near_duplicates(5, False),
    "op11_minhash": near_duplicates(4, True),
    "op12_prefixes": PREFIXES,
    "op13_manifest": MANIFEST,
}
