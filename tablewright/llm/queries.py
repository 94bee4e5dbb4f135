"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from .bpe import op8_bpe_round_trip
from .conversations import op12_conversation_repair
from .curves import op3_nearest_neighbours
from .embedding_dedup import op2_embedding_dedup
from .importance import op13_importance_resampling
from .language_id import op1_language_id
from .line_dedup import op10_line_dedup
from .packing import op7_packing
from .pii import op9_personal_data
from .quality import op4_quality
from .sharding import op11_sharding
from .simhash import op5_simhash_dedup
from .token_counts import op6_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_quality": op4_quality,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_sharding": op11_sharding,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
}

#: CRC-32 in SQL: the table of 256 remainders, then one step a byte of the hexadecimal digits of a text.
CRC_TABLE = """
        crc AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)
        )"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; ``crc`` must be in the FROM clause."""
    digits = f"hex(encode({text}))"
    return f"xor(list_reduce(list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
            FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM v
            UNION
            SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), classes AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
        SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM classes c
    """,
    "op12_conversation_repair": f"""
        WITH RECURSIVE {CRC_TABLE}, damaged AS (
            SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                CASE WHEN m = 1 THEN '' WHEN m = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
                unnest(CASE WHEN m = 0 THEN [] WHEN m = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM (SELECT *, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS m FROM conversations, crc)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
        ), marked AS (
            SELECT *, left(role, 1) AS s, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last_one,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior
            FROM placed
        ), judged AS (
            SELECT *, CASE WHEN last_one = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_one NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (prior IS NOT NULL AND prior || s NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        ), moves(q, nxt, said) AS (
            VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
        ), ways(q, to_q, cost, edits, lines) AS (
            -- up to two rows put in
            SELECT q, q, 0, '', CAST([] AS VARCHAR[]) FROM moves
            UNION ALL SELECT q, nxt, 3, 'I', [said || ':'] FROM moves
            UNION ALL SELECT m.q, k.nxt, 6, 'II', [m.said || ':', k.said || ':'] FROM moves m JOIN moves k ON k.q = m.nxt
        ), walk(conv_id, i, q, best) AS (
            SELECT conv_id, 0::BIGINT, '', {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'lines': lines}}) FROM (
                SELECT w.conv_id, j.i,
                    CASE WHEN e.edit = 'D' THEN y.to_q WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN e.edit = 'R' THEN m.nxt WHEN j.s = 's' AND y.to_q = '' THEN 's' WHEN j.s = m.nxt THEN m.nxt END AS q,
                    w.best.cost + y.cost + e.cost + CASE WHEN fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost, w.best.audit || y.edits || e.edit AS audit,
                    w.best.lines || y.lines || CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [j.role || ':' || j.text] ELSE [m.said || ':' || j.text] END AS lines
                FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ways y ON y.q = w.q JOIN moves m ON m.q = y.to_q
                    CROSS JOIN (VALUES ('D', 4), ('K', 0), ('R', 3)) e(edit, cost)
            ) WHERE q IS NOT NULL GROUP BY conv_id, i, q
        ), ended AS (
            SELECT w.conv_id, min({{'cost': w.best.cost + y.cost, 'audit': w.best.audit || y.edits, 'lines': w.best.lines || y.lines}}) AS best
            FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ways y ON y.q = w.q AND y.to_q IN ('', 'a')
            WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(array_to_string(e.best.lines, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op13_importance_resampling": f"""
        WITH {CRC_TABLE}, words AS (
            SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
        ), placed AS (
            SELECT w, {crc32_sql("w")} % 10000 AS b FROM (SELECT DISTINCT w FROM words), crc
        ), counts AS (
            SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN placed USING (w) GROUP BY b
        ), gain AS (
            SELECT b, floor(1000 * ln(((t + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS g
            FROM counts, (SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM counts)
        ), weighed AS (
            SELECT doc_id, count(g) AS n_features, coalesce(floor(sum(g)::DOUBLE / count(g)), 0)::BIGINT AS weight
            FROM documents LEFT JOIN (SELECT id, g FROM words JOIN placed USING (w) JOIN gain USING (b) WHERE side = 'd') ON id = doc_id GROUP BY doc_id
        ), scored AS (
            SELECT *, weight + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
        ), ordered AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN r END AS rank FROM ordered
    """,
}
