"""SQL counterparts of the operators' queries, where SQL can express them."""

from __future__ import annotations

#: One round of op12: every vector against every centroid, then floors of the means; an empty centroid stays.
_ROUND = r"""
), a{n} AS (
    SELECT vec_id, r, arg_min(k, (far, k)) AS k FROM (
        SELECT x.vec_id, x.r, c.k, sum((x.x - c.x) * (x.x - c.x)) AS far FROM x JOIN c{n} c USING (d) GROUP BY ALL) GROUP BY vec_id, r
), c{m} AS (
    SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
        SELECT k, d, CASE WHEN t < 0 AND t % n <> 0 THEN t // n - 1 ELSE t // n END AS x FROM (
            SELECT a.k, x.d, sum(x.x) AS t, count(*) AS n FROM a{n} a JOIN x USING (r) GROUP BY ALL)) m USING (k, d)
"""

ORACLE: dict[str, str] = {
    # Targets by the level at which limited and sharing sources balance; a document's share of a source's slots in
    # closed form: whole passes, and the words of the last pass.
    "op5_source_mixing": r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
    SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS most, (3 * source_size)::DOUBLE / ((sid - 1) % 3 + 1)::DOUBLE AS ratio FROM s
), l AS (
    SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS step FROM w
), v AS (
    SELECT (SELECT step FROM l WHERE ratio > step ORDER BY ratio, sid LIMIT 1) AS level
), t AS (
    SELECT source, sid, source_size, CASE WHEN ratio > level THEN weight * level ELSE most::DOUBLE END AS target,
        greatest(1, least(65536, source_size // 1024)) AS block FROM w, v
), n AS (
    SELECT *, floor(target / block + 0.5)::BIGINT AS slots, (source_size + block - 1) // block AS blocks FROM t
), c AS (
    SELECT *, (sum(slots) OVER (ORDER BY sid))::BIGINT AS hi FROM n
), p AS (
    SELECT ((i % 2147483648) * 1327217885 % 2147483648) * total // 2147483648 AS place
    FROM (SELECT total, unnest(range(total)) AS i FROM (SELECT sum(slots)::BIGINT AS total FROM n))
), r AS (
    SELECT c.sid, count(place) AS drawn FROM c LEFT JOIN p ON place >= hi - slots AND place < hi GROUP BY c.sid
), f AS (
    SELECT c.*, least(drawn, 3 * blocks) // greatest(blocks, 1) AS passes,
        least(source_size, least(drawn, 3 * blocks) % greatest(blocks, 1) * block) AS more FROM c JOIN r USING (sid)
), o AS (
    SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM d
)
SELECT doc_id, o.source, size, source_size, target, (passes * size + greatest(0, least(start + size, more) - start))::BIGINT AS taken
FROM o JOIN f ON o.source IS NOT DISTINCT FROM f.source
""",
    # A turn is <s> role [INST] text </s>; escaping adds a character to each control string and each escape sign.
    "op10_chat_formatting": r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), m AS (
    SELECT *, '\\|<s>|\[INST\]|</s>|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>' AS marks FROM c
), e AS (
    SELECT *, length(role) + len(regexp_extract_all(role, marks)) + length(text) + len(regexp_extract_all(text, marks)) + length('<s>[INST]</s>') AS chars FROM m
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_line_dedup": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
    SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
    SELECT k.r, k.doc_id, k.line, k.pos, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
""",
    "op12_centroid_clustering": r"""
WITH e AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x), false) for x in embedding])
), x AS (
    SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e
), f AS (
    SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS k FROM e QUALIFY k < 16
), c0 AS (
    SELECT f.k, x.d, x.x FROM f JOIN x USING (r)
"""
    + "".join(_ROUND.format(n=i, m=i + 1) for i in range(3))
    + r"""
), s AS (
    SELECT x.vec_id, x.r, c.k, sum((x.x - c.x) * (x.x - c.x)) AS far FROM x JOIN c3 c USING (d) GROUP BY ALL
), w AS (
    SELECT vec_id, r, arg_min(k, (far, k)) AS k, min(far) AS far FROM s GROUP BY vec_id, r
), h AS (
    SELECT k, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY k
)
SELECT vec_id, k::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
    (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256 FROM w JOIN h USING (k)
""",
    # The plain sum over all kept terms of every pair.
    "op13_source_divergence": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
    SELECT r, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
    SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT g.lang, g.source, k.term, k.total, count(t.term) AS n
    FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL
), w AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source) AS big, count(*) OVER (PARTITION BY lang, source) AS v,
        sum(total) OVER (PARTITION BY lang, source) AS whole FROM c
), p AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)::HUGEINT) // (big + v) AS p, 1 + (1000000000 * (total + 1)::HUGEINT) // (whole + v) AS q FROM w
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM o
QUALIFY part = 'pair' OR rank <= 200
""",
}
