"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LINE_BAD = r"""(
    2 * (length(l) - length(regexp_replace(l, '[#*$%&|<>!]', '', 'g'))) > w
    OR 4 * (length(l) - length(regexp_replace(l, '[|>»•·]', '', 'g'))) >= w
    OR NOT regexp_matches(l, '[.!?…。][''")\]”’»]*([ \t\n\x0B\f\r]|$)')
    OR (w <= 25 AND regexp_matches(l, '(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|licensed under|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|share this|powered by)\b'))
)"""

_QUALITY = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT r, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d
), win AS (
    SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r
), lines AS (
    SELECT r, n, l, length(trim(l, ' ')) - length(replace(trim(l, ' '), ' ', '')) + 1 AS w,
           length(regexp_replace(l, '[ \t\n\x0B\f\r]', '', 'g')) AS c
    FROM (SELECT r, generate_subscripts(string_split(t, chr(10)), 1) AS n, unnest(string_split(t, chr(10))) AS l FROM d)
), lost AS (
    SELECT r, count(*) FILTER (c > 0) - count(DISTINCT l) FILTER (c > 0) AS dup,
           coalesce(sum(c) FILTER (c > 0 AND NOT {_LINE_BAD}), 0) AS kept_chars
    FROM lines GROUP BY r
), base AS (
    SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           lost.dup AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, lost.kept_chars
    FROM d JOIN w USING (r) JOIN lost USING (r) LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)"""

_CHAT = r"""
WITH said AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), safe AS (
    SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + length(role) + 24)::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id"""

# Links given as whole addresses; the pages of the test tables hold no others.
_URLS = r"""
WITH RECURSIVE p AS (
    SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM p
), rules(verdict, rule, rhost, rpath) AS (
    VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
           ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
           ('block', 'net/fr/', 'net', '/fr/')
), ruled AS (
    SELECT page_id, url, html, host, path,
           (SELECT max_by(struct_pack(verdict := r.verdict, rule := r.rule), length(r.rule)) FROM rules r
            WHERE (parts.host = r.rhost OR ends_with(parts.host, '.' || r.rhost)) AND starts_with(parts.path, r.rpath)) AS own
    FROM parts
), tags AS (
    SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
                                          '(?is)<(?:link|meta)\b[^>]*>')) AS tag
    FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')
), hrefs AS (
    SELECT url, CASE
        WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
        THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]*)', 1)
        WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
        THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*\d+\s*[;,]\s*url\s*=\s*["'']?\s*([^"''\s>]*)', 1) END AS href
    FROM tags
), pairs AS (
    SELECT regexp_replace(url, '^[^:]*://|#.*$', '', 'g') AS a, regexp_replace(href, '^[^:]*://|#.*$', '', 'g') AS b
    FROM hrefs WHERE contains(href, '://')
), reach(k, c) AS (
    SELECT a, a FROM pairs UNION SELECT b, b FROM pairs
    UNION
    SELECT CASE WHEN reach.k = pairs.a THEN pairs.b ELSE pairs.a END, reach.c
    FROM reach JOIN pairs ON reach.k IN (pairs.a, pairs.b)
), bad AS (
    SELECT DISTINCT reach.k FROM reach JOIN ruled
    ON regexp_replace(ruled.url, '^[^:]*://|#.*$', '', 'g') = reach.c WHERE ruled.own.verdict = 'block'
)
SELECT page_id, host, path, own.rule AS rule,
       coalesce(own.verdict, CASE WHEN regexp_replace(url, '^[^:]*://|#.*$', '', 'g') IN (SELECT k FROM bad) THEN 'block' END, 'allow') AS verdict
FROM ruled"""

# crc32 of a number's decimal digits, four bits at a time.
_CRC_TABLE = [0]
for _i in range(1, 16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC_TABLE.append(_c)
_NIBBLE = f"xor({_CRC_TABLE}[(({{x}}) & 15) + 1], ({{x}}) >> 4)"


def _crc32(text: str) -> str:
    step = _NIBBLE.format(x=_NIBBLE.format(x="xor(c, b)"))
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(f) for f in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _above(nodes: str) -> str:
    """The rows of the next level of trees of ``nodes`` (tree, level, place, total, node)."""
    return f"""
    SELECT tree, level + 1, place // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
    FROM {nodes} WHERE total > 1 GROUP BY tree, level, place // 2, total"""


_MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
           CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS claimed
    FROM documents
), first AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY tree) AS total
    FROM leaves
), inner_nodes(tree, level, place, total, node) AS (
    SELECT tree, 0, place, total, leaf FROM first UNION ALL {_above('inner_nodes')}
), subroots AS (
    SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total
    FROM inner_nodes WHERE total = 1
), outer_nodes(tree, level, place, total, node) AS (
    SELECT 'all', 0, place, total, subroot FROM subroots UNION ALL {_above('outer_nodes')}
), steps AS (
    -- Level by level: the node next to the row's own, if there is one.
    SELECT f.doc_id, f.leaf AS row_leaf, f.tree AS t, f.place AS row_place, 0 AS part, m.level, s.node AS sibling, s.place < m.place AS is_left
    FROM first f JOIN inner_nodes m ON m.tree = f.tree AND m.place = f.place // (1::BIGINT << m.level) AND m.total > 1
    LEFT JOIN inner_nodes s ON s.tree = m.tree AND s.level = m.level AND s.place = xor(m.place, 1::BIGINT)
    UNION ALL
    SELECT f.doc_id, f.leaf, f.tree, f.place, 1, m.level, s.node, s.place < m.place
    FROM first f JOIN subroots r ON r.tree = f.tree
    JOIN outer_nodes m ON m.place = r.place // (1::BIGINT << m.level) AND m.total > 1
    LEFT JOIN outer_nodes s ON s.level = m.level AND s.place = xor(m.place, 1::BIGINT)
), proofs AS (
    SELECT t, row_place, list(struct_pack(sibling, is_left) ORDER BY part, level) AS proof FROM steps GROUP BY t, row_place
), folded(t, row_place, n, node, proof) AS (
    SELECT f.tree, f.place, 1, coalesce(f.claimed, f.leaf), coalesce(p.proof, [])
    FROM first f LEFT JOIN proofs p ON p.t = f.tree AND p.row_place = f.place
    UNION ALL
    SELECT t, row_place, n + 1, sha256(CASE WHEN proof[n].is_left THEN proof[n].sibling || node ELSE node || coalesce(proof[n].sibling, '') END), proof
    FROM folded WHERE n <= len(proof)
)
SELECT f.doc_id, f.leaf, r.subroot, top.node AS root,
       sha256(coalesce(array_to_string(list_transform(d.proof, lambda p: p.sibling), ''), '')) AS proof_sha256,
       d.node AS folded_root, d.node = top.node AS verified
FROM first f JOIN subroots r ON r.tree = f.tree JOIN outer_nodes top ON top.total = 1
JOIN folded d ON d.t = f.tree AND d.row_place = f.place AND d.n = len(d.proof) + 1"""

ORACLE = {
    "op11_merkle_manifest": _MERKLE,
    "op4_chat_formatting": _CHAT,
    "op8_url_filters": _URLS,
    "op5_quality_rules": _QUALITY
    + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * (word_chars - kept_chars) <= 60 * word_chars AS kept,
       kept_chars::BIGINT AS kept_chars
FROM judged""",
}
