"""SQL for DuckDB of those queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL
        )
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
    "op12_vector_codes": """
        WITH k AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (
            SELECT vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x
            FROM k, (SELECT unnest(range(16)) AS part)
        ), seeds AS MATERIALIZED (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64
        ), c0 AS MATERIALIZED (
            SELECT part, entry, x AS c FROM seeds JOIN p USING (vec_id)
        ), {rounds}
        a2 AS MATERIALIZED ({assign_2}),
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
            FROM a2 GROUP BY vec_id
        ), digest AS (
            SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
            FROM c2, (SELECT unnest(range(1, 1 + (SELECT max(len(c)) FROM c2))) AS i)
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN k USING (vec_id), digest
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM documents
        ), f AS MATERIALIZED (
            SELECT lang, words, phrase, count(*) AS f FROM (
                SELECT lang, words, array_to_string(w[i : i + words - 1], ' ') AS phrase
                FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS words))
            ) GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
        ), c AS MATERIALIZED (
            SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 100
        ), cuts AS (
            SELECT c.lang, c.phrase, a, n, k, l.f AS l, r.f AS r,
                   1000 * a::HUGEINT * n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS score
            FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.words], ' ')
            JOIN totals t ON t.lang = c.lang
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, phrase, max(a) AS most FROM (
                SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
                FROM (SELECT lang, a, w, m, unnest(range(1, words - m + 2)) AS i
                      FROM (SELECT *, unnest(range(2, words)) AS m FROM c)))
            GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score::BIGINT AS score
        FROM best LEFT JOIN longer USING (lang, phrase)
        WHERE most IS NULL OR 100 * most < 100 * a
        QUALIFY rank <= 2000
    """,
}


def _assigned(codebook: str) -> str:
    """Each part's least (distance, entry)."""
    return f"""
        SELECT vec_id, part, min([list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry]) AS best
        FROM p JOIN {codebook} USING (part) GROUP BY vec_id, part"""


def _moved(k: int) -> str:
    """The codebook after a round, from that before it."""
    floored = "((s - ((s % n) + n) % n) // n)::BIGINT"
    return f"""
        a{k} AS MATERIALIZED ({_assigned(f"c{k}")}),
        m{k} AS (
            SELECT part, entry, list({floored} ORDER BY i) AS c FROM (
                SELECT a.part, best[2] AS entry, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
                FROM a{k} a JOIN (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p) p USING (vec_id, part) GROUP BY ALL
            ) GROUP BY ALL
        ), c{k + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.c, b.c) AS c FROM c{k} b LEFT JOIN m{k} m USING (part, entry)
        ),"""


ORACLES["op12_vector_codes"] = ORACLES["op12_vector_codes"].format(rounds=_moved(0) + _moved(1), assign_2=_assigned("c2"))
