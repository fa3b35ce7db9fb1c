"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quillmill.llm import decontaminate, exact_search, hard_negatives, language_id, line_dedup, media, merkle, mixing, near_dedup, sharding, suffix_dedup, token_files, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_mixing": mixing.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_token_files": token_files.query,
    "op5_language_id": language_id.query,
    "op6_media": media.query,
    "op7_warc": warc.query,
    "op8_near_dedup": near_dedup.query,
    "op9_decontaminate": decontaminate.query,
    "op10_sharding": sharding.query,
    "op11_merkle": merkle.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_exact_top_k": exact_search.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, line, place, regexp_replace(lower_key, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place,
                   translate(unnest(string_split(coalesce(text, ''), chr(10))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
            FROM documents)),
        hot AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT l.doc_id, count(*)::BIGINT AS n_lines,
               count(*) FILTER (h.key IS NOT NULL AND l.doc_id <> h.keeper)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (NOT (h.key IS NOT NULL AND l.doc_id <> h.keeper)), '')) AS kept_sha256
        FROM lines l LEFT JOIN hot h USING (key) GROUP BY l.doc_id""",
    "op11_merkle": r"""
        WITH RECURSIVE docs AS (
          SELECT row_number() OVER () AS rid, doc_id, lang, source, n_chars, text,
                 list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ord(substr(doc_id::VARCHAR, j, 1))::BIGINT)),
                   lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc
          FROM documents),
        framed AS (
          SELECT rid, doc_id, lang, crc, text,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
          FROM docs),
        hashed AS (
          SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN xor(crc, 4294967295) % 3 = 0
                   THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
          FROM framed),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
        nodes(lang, level, i, h) AS (
          SELECT lang, 0, i, leaf FROM leaves
          UNION ALL
          SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM nodes) WHERE c > 1 GROUP BY lang, level, i // 8),
        subroots AS (
          SELECT lang, arg_max(h, level) AS subroot, max(level) AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes GROUP BY lang),
        upper(level, i, h) AS (
          SELECT 0, place, subroot FROM subroots
          UNION ALL
          SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY level, i // 8),
        sides AS (
          SELECT a.lang, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY ALL),
        upper_sides AS (
          SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM upper a JOIN upper b ON a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY ALL),
        steps AS (
          SELECT d.rid, s.level, s.l, s.r FROM leaves d JOIN subroots t ON d.lang IS NOT DISTINCT FROM t.lang
            JOIN sides s ON s.lang IS NOT DISTINCT FROM d.lang AND s.level < t.top AND s.i = d.i // (8 ** s.level)::BIGINT
          UNION ALL
          SELECT d.rid, 100 + s.level, s.l, s.r FROM leaves d JOIN subroots t ON d.lang IS NOT DISTINCT FROM t.lang
            JOIN upper_sides s ON s.level < (SELECT max(level) FROM upper) AND s.i = t.place // (8 ** s.level)::BIGINT),
        proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY level) AS siblings, list({'l': l, 'r': r} ORDER BY level) AS path FROM steps GROUP BY rid),
        done AS (
          SELECT d.doc_id, d.leaf, t.subroot, (SELECT arg_max(h, level) FROM upper) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
                 list_reduce(list_prepend({'l': '', 'r': coalesce(d.tampered, d.leaf)}, coalesce(p.path, [])), lambda acc, x: {'l': '', 'r': sha256(x.l || acc.r || x.r)}).r AS folded_root
          FROM leaves d JOIN subroots t ON d.lang IS NOT DISTINCT FROM t.lang LEFT JOIN proofs p ON p.rid = d.rid)
        SELECT *, folded_root = root AS verified FROM done""",
    "op12_hard_negatives": r"""
        WITH v AS (
          SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_dot_product(a.e, o.e)::BIGINT AS score
          FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
               s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        QUALIFY rank <= 10""",
    "op13_exact_top_k": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        QUALIFY rank <= 20""",
}
