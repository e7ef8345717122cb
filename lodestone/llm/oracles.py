"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op5_preferences": """
        WITH base AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ),
        last AS (
            SELECT conv_id, turn, text FROM base WHERE role = 'assistant'
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) = 1
        ),
        swap AS (
            SELECT a.conv_id, a.turn, a.text, coalesce(b.text, '') AS other FROM last a LEFT JOIN last b ON b.conv_id = a.conv_id + 1
        ),
        sides AS (
            SELECT conv_id, false AS side, turn, role, text FROM base
            UNION ALL
            SELECT b.conv_id, true, b.turn, b.role,
                   CASE WHEN b.role = 'assistant' AND b.turn IS NOT DISTINCT FROM s.turn AND b.text = s.text THEN s.other ELSE b.text END
            FROM base b LEFT JOIN swap s ON s.conv_id = b.conv_id
        ),
        t AS (
            SELECT conv_id AS pair_id, side, conv_id, role, text,
                   row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) AS n
            FROM sides
        ),
        ids AS (
            SELECT pair_id,
                   min(conv_id) FILTER (WHERE NOT side) AS chosen_id,
                   min(conv_id) FILTER (WHERE side) AS rejected_id,
                   coalesce(max(n) FILTER (WHERE NOT side), 0) AS size_a,
                   coalesce(max(n) FILTER (WHERE side), 0) AS size_b
            FROM t GROUP BY pair_id
        ),
        differ AS (
            SELECT a.pair_id, min(a.n) AS n
            FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.n = b.n AND NOT a.side AND b.side
            WHERE a.role <> b.role OR a.text <> b.text
            GROUP BY a.pair_id
        ),
        cut AS (
            SELECT ids.*, coalesce(differ.n - 1, least(size_a, size_b)) AS n_common
            FROM ids LEFT JOIN differ USING (pair_id)
        ),
        drawn AS (
            SELECT t.pair_id, side, t.n, n_common, role,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said
            FROM t JOIN cut USING (pair_id)
        ),
        joined AS (
            SELECT pair_id,
                   string_agg(said, '' ORDER BY n) FILTER (WHERE NOT side AND n <= n_common) AS prompt,
                   string_agg(said, '' ORDER BY n) FILTER (WHERE NOT side AND n > n_common) AS chosen,
                   string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY n) FILTER (WHERE NOT side AND n > n_common) AS chosen_mask,
                   string_agg(said, '' ORDER BY n) FILTER (WHERE side AND n > n_common) AS rejected,
                   string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY n) FILTER (WHERE side AND n > n_common) AS rejected_mask
            FROM drawn GROUP BY pair_id
        )
        SELECT pair_id, chosen_id, rejected_id, n_common,
               coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(chosen_mask, '') AS chosen_mask,
               coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
        FROM cut JOIN joined USING (pair_id)
    """,
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages
        ),
        bits AS (
            SELECT page_id, first, strlen(payload) AS payload_bytes,
                   array_to_string(list_transform(string_split(sha1(payload), ''), lambda c:
                       ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                       [strpos('0123456789abcdef', c)]), '') AS b
            FROM p
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * substr(b, 5 * i + 1, 1)::BIGINT + 8 * substr(b, 5 * i + 2, 1)::BIGINT + 4 * substr(b, 5 * i + 3, 1)::BIGINT
                     + 2 * substr(b, 5 * i + 4, 1)::BIGINT + substr(b, 5 * i + 5, 1)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM bits
    """,
    "op12_fill_in_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents
        ),
        drawn AS (
            SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                   text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain,
                   ('0x' || h[25:32])::BIGINT % 100 < 50 AS suffix_first
            FROM cut
        ),
        pieces AS (
            SELECT doc_id, text, n, plain, suffix_first,
                   array_to_string(u[1:least(a, b)], '') AS prefix,
                   array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
                   array_to_string(u[greatest(a, b) + 1:], '') AS suffix
            FROM drawn
        )
        SELECT doc_id, n::BIGINT AS n,
               CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars,
               CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
               sha256(CASE WHEN plain THEN text WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                           ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM pieces
    """,
}
