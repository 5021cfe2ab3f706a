"""Registered queries of the training-data operators, over whole tables.

Top-k search is compared with SQL. The others learn models, hash in ways that SQL
does not have, or build on a tokenizer; their tests compare with brute force, direct
sums, exact round trips or held-out labels.
"""

from pyspark.sql import functions as F

from watchlake.llm import (
    collocations,
    decontaminate,
    hmm_lm,
    lang_id,
    packing,
    pii_crf,
    simhash,
    suffix_dedup,
    token_align,
    topk,
    toxicity,
    url_filter,
    warc,
)
from watchlake.llm.common import table


def op1_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_language(spark, sf_dir):
    return lang_id.identify_languages(table(spark, sf_dir, "documents"))


def op4_hmm(spark, sf_dir):
    return hmm_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    """Each row is a document and a benchmark item it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii_crf.find_personal_data(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_align(spark, sf_dir):
    return token_align.align_tokens(table(spark, sf_dir, "documents"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_url_filter": op2_url_filter,
    "op3_language": op3_language,
    "op4_hmm": op4_hmm,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_align": op11_token_align,
    "op12_collocations": op12_collocations,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op1_topk": """
        WITH usable AS (
            SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, vec_id, score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\n\x0B\f\r]')) AS piece
            FROM documents
        ), runs AS (
            SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
        ), grams AS (
            SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: list_slice(ws, i, i + k - 1))) AS ws
            FROM runs, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(ws) >= k
        ), f AS (
            SELECT lang, ws, count(*) AS n FROM grams GROUP BY lang, ws HAVING count(*) >= 30
        ), totals AS (
            SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM runs GROUP BY lang
        ), cuts AS (
            SELECT lang, ws, n AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) >= 2
        ), scored AS (
            SELECT c.lang, c.ws, c.a, c.k, x.n AS l, y.n AS r,
                   CAST((2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n) AS BIGINT) AS score
            FROM cuts c
            JOIN f x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, c.k)
            JOIN f y ON y.lang = c.lang AND y.ws = list_slice(c.ws, c.k + 1, len(c.ws))
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
        ), parts AS (
            SELECT lang, n, ws, unnest(range(2, len(ws))) AS m FROM f WHERE len(ws) >= 3
        ), inside AS (
            SELECT lang, ws, max(n) AS longer FROM (
                SELECT lang, n, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: list_slice(ws, i, i + m - 1))) AS ws FROM parts
            ) GROUP BY lang, ws
        ), kept AS (
            SELECT s.*, array_to_string(s.ws, ' ') AS phrase FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.ws = s.ws
            WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * s.a::HUGEINT
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM kept
        )
        SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
    """,
    "op13_warc": """
        WITH payloads AS (
            SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), ranked AS (
            SELECT page_id, html, hex,
                   row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS place,
                   first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id
            FROM payloads
        ), bits AS (
            SELECT *, list_transform(range(40), lambda i: instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS d FROM ranked
        )
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
                   (d[1 + (5 * k) // 4] * 16 + coalesce(d[2 + (5 * k) // 4], 0)) // (CASE (5 * k) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)
               ) % 32 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN first_id END AS refers_to
        FROM bits
    """,
}
