"""DuckDB SQL for the queries that SQL can express, in its plainest form."""

from __future__ import annotations

#: op6: rules of the contract and the constants of the method, spelled out.
_URL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest[length(regexp_extract(rest, '^[^/?#]*')) + 1:], '^[^?#]*') AS path
    FROM cut
), u AS (
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM split
), h AS (
    SELECT host, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '[^.]*(\.[^.]*)?$') AS domain,
        count(quality) AS n, count(*) FILTER (quality = 0) AS bad
    FROM u LEFT JOIN labels ON doc_id = page_id GROUP BY host
), d AS (
    SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain
), s AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM h) AS m FROM d GROUP BY suffix
), s_rho AS (
    SELECT greatest(0.001, least(0.999, coalesce((sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - count(*)) / nullif(sum(n) - count(*), 0), 0.001))) AS rho
    FROM s WHERE n > 0 AND m > 0 AND m < 1
), s_post AS (
    SELECT suffix, (bad + (1 / rho - 1) * m) / (n + (1 / rho - 1)) AS m FROM s, s_rho
), d_prior AS (
    SELECT d.*, s_post.m FROM d JOIN s_post USING (suffix)
), d_rho AS (
    SELECT greatest(0.001, least(0.999, coalesce((sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - count(*)) / nullif(sum(n) - count(*), 0), 0.001))) AS rho
    FROM d_prior WHERE n > 0 AND m > 0 AND m < 1
), d_post AS (
    SELECT domain, (bad + (1 / rho - 1) * m) / (n + (1 / rho - 1)) AS m FROM d_prior, d_rho
), h_prior AS (
    SELECT h.*, d_post.m FROM h JOIN d_post USING (domain)
), h_rho AS (
    SELECT greatest(0.001, least(0.999, coalesce((sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - count(*)) / nullif(sum(n) - count(*), 0), 0.001))) AS rho
    FROM h_prior WHERE n > 0 AND m > 0 AND m < 1
), h_post AS (
    SELECT host, bad + (1 / rho - 1) * m AS a, n - bad + (1 / rho - 1) * (1 - m) AS b FROM h_prior, h_rho
), rules(rule, verdict) AS (
    VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')
), fits AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM u), rules
    WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, rule[length(split_part(rule, '/', 1)) + 1:])
    GROUP BY page_id
)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / (a + b + 1)) / (a + b) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN h_post USING (host) LEFT JOIN fits USING (page_id)
"""

#: op10: the texts and roles as they are, the length from the template and its escapes.
_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(text) + length(role)
        + length(text || role) - length(replace(text || role, '\', ''))
        - (length(text || chr(1) || role) - length(replace(text || chr(1) || role, '<s>', '')))  / 3
        - (length(text || chr(1) || role) - length(replace(text || chr(1) || role, '</s>', ''))) / 4 * 2
        - (length(text || chr(1) || role) - length(replace(text || chr(1) || role, '[INST]', ''))) / 6 * 4
        - (length(text || chr(1) || role) - length(replace(text || chr(1) || role, '[/INST]', ''))) / 7 * 5
        - (length(text || chr(1) || role) - length(replace(text || chr(1) || role, '<<SYS>>', ''))) / 7 * 5
        - (length(text || chr(1) || role) - length(replace(text || chr(1) || role, '<</SYS>>', ''))) / 8 * 6
        + length(role) - length(replace(role, chr(10), ''))
        + length('<s>') + 1 + length('</s>') AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: op11: a source is clamped if all sources, at the level that fills it, take no more than there is.
_MIX = r"""
WITH s AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), d AS (
    SELECT *, substr(md5(concat('11:', coalesce(doc_id::VARCHAR, '-'), ':', size)), 1, 15) AS place FROM s
), t AS (
    SELECT source, sum(size) AS size, 3 * sum(size) AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source
), c AS (
    SELECT *, (SELECT sum(least(o.cap * t.weight, t.cap * o.weight)) FROM t o) <= (SELECT sum(size) FROM t) * weight AS clamped FROM t
), g AS (
    SELECT *, CASE WHEN clamped THEN cap::DOUBLE ELSE
        (weight * ((SELECT sum(size) FROM c) - (SELECT coalesce(sum(cap), 0) FROM c WHERE clamped)))::DOUBLE
        / (SELECT sum(weight) FROM c WHERE NOT clamped)::DOUBLE END AS target
    FROM c
), n AS (
    SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM g
), p AS (
    SELECT source, place, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto
    FROM d GROUP BY source, place
), e AS (
    SELECT p.source, p.place, n.size AS source_size, n.target,
        n.whole + CASE WHEN target > whole * n.size AND 2 * upto - p.size <= 2 * (target - whole * n.size) THEN 1 ELSE 0 END AS repeats
    FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, d.size, source_size::BIGINT AS source_size, target, (d.size * repeats)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.place = e.place
"""

#: op12: every anchor with every row.
_NEGATIVES = r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""

#: op13: all levels of all trees by recursion, then each leaf folded up over the nodes beside its path.
_MERKLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, text,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))) AS crc
    FROM documents
), tampered AS (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN
            sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS found
    FROM d
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
    FROM tampered
), nodes AS (
    SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
    SELECT 0 AS level, pos, digest, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
    FROM crown WHERE n > 1 GROUP BY level, pos // 8, n
), height AS (
    SELECT tree, max(level) AS top FROM nodes GROUP BY tree
), beside AS (
    SELECT l.tree, l.pos, k.level,
        coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos < l.pos // (8 ** k.level)::BIGINT), '') AS before,
        coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos > l.pos // (8 ** k.level)::BIGINT), '') AS after
    FROM leaves l JOIN nodes k ON k.tree = l.tree AND k.n > 1 AND k.pos // 8 = l.pos // (8 ** (k.level + 1))::BIGINT
    GROUP BY l.tree, l.pos, k.level
    UNION ALL
    SELECT l.tree, l.pos, h.top + k.level,
        coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos < s.pos // (8 ** k.level)::BIGINT), ''),
        coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos > s.pos // (8 ** k.level)::BIGINT), '')
    FROM leaves l JOIN subroots s USING (tree) JOIN height h USING (tree)
        JOIN crown k ON k.n > 1 AND k.pos // 8 = s.pos // (8 ** (k.level + 1))::BIGINT
    GROUP BY l.tree, l.pos, h.top, k.level
), folded AS (
    SELECT tree, pos, 0 AS level, coalesce(found, leaf) AS digest FROM leaves
    UNION ALL
    SELECT f.tree, f.pos, f.level + 1, sha256(before || digest || after) FROM folded f JOIN beside USING (tree, pos, level)
), proofs AS (
    SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM beside GROUP BY tree, pos
), last AS (
    SELECT tree, pos, arg_max(digest, level) AS digest FROM folded GROUP BY tree, pos
)
SELECT doc_id, leaf, s.digest AS subroot, c.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
    f.digest AS folded_root, f.digest = c.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN last f ON f.tree = l.tree AND f.pos = l.pos
    LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos, crown c
WHERE c.n = 1
"""

#: op1: every 400-byte string of every text, in hex, grouped by MD5; what none of the repeated ones covers.
_SUFFIX = """
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), t AS (SELECT *, length(h) // 2 AS n FROM raw),
starts AS (SELECT r, i, md5(substring(h, 2 * i + 1, 800)) AS m FROM t, range(n - 399) x(i)),
again AS (SELECT m FROM starts GROUP BY m HAVING count(*) > 1),
hits AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM starts WHERE m IN (SELECT m FROM again)),
runs AS (SELECT r, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits),
spans AS (SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT t.r, coalesce(max(s.b), 0), any_value(t.n) FROM t LEFT JOIN spans s USING (r) GROUP BY t.r
),
kept AS (
  SELECT r, string_agg(substring(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS k
  FROM gaps JOIN t USING (r) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(k) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM spans s WHERE s.r = t.r) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM t JOIN kept USING (r)
"""

#: op9: all pairs, then everything that links reach.
_VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS sound,
        list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN x::DOUBLE ELSE 0 END) AS e
    FROM embeddings
), u AS (
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
    WHERE sound AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), n AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n ON n.a = v.vec_id
"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": _SUFFIX,
    "op9_embedding_dedup": _VECTORS,
    "op6_url_reputation": _URL,
    "op10_chat_format": _CHAT,
    "op11_mixing": _MIX,
    "op12_hard_negatives": _NEGATIVES,
    "op13_merkle_manifest": _MERKLE,
}
