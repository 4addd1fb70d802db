"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_bpe, html_extract, langid, mixing, ngram_join, packing, pii, prefix_trie, structure_repair, suffix_dedup, tiff, token_counts, topk
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.store(table(spark, sf_dir, "documents")))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "pii_spans")
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(pii.joined_spans(base).cast("binary"), 256).alias("base_sha256"), pii.joined_spans(F.col("pii_spans")).alias("spans"), pii.joined_scores(F.col("pii_spans")).alias("scores"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_counts, op3_tiff_pages, op4_exact_topk, op5_suffix_dedup, op6_pii, op7_best_fit_packing, op8_language_id, op9_html_extraction, op10_mixing, op11_prefix_trie, op12_chunk_bpe, op13_structure_repair)}


ORACLE_SQL = {
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
        ), e AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
        ), k AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), r(a, b) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a
        ), c AS (
            SELECT a, min(b) AS component_id FROM r GROUP BY a
        ) SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c ON s.doc_id = c.a
    """,
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_mixing": """
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
        ), o AS (
            SELECT *, cap / weight AS level, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
                   coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                   sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
            FROM w
        ), c AS (
            SELECT arg_min((budget - capped) / left_over, level) AS common FROM o WHERE (budget - capped) / left_over <= level
        ), t AS (
            SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target FROM o LEFT JOIN c ON true
        ), r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   ('0x' || substr(md5('mix' || chr(31) || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ) SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INTEGER))::BIGINT AS taken FROM r
    """,
    "op11_prefix_trie": """
        WITH crc AS (
            SELECT list(v ORDER BY i) AS crc FROM (
                SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)
            )
        ), t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id
        ), h AS (
            SELECT conv_id, l, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                lambda a, b: xor(a >> 8, crc[(xor(a, b) % 256 + 1)::INTEGER])), 4294967295::UBIGINT) % 4)::INTEGER AS h FROM own, crc
        ), s AS (
            SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS s FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
        ), x AS (
            SELECT conv_id, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)
        ), n AS (
            SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM x GROUP BY p, d
        ), k AS (
            SELECT p[1:d - 1] AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY 1
        ), m AS (
            SELECT n.*, coalesce(k.k, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.p[n.d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.p = n.p
        ), u AS (
            SELECT p[1:a] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1
        ) SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
                 u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(m.e) AS ends_sha256
        FROM m JOIN u ON u.p = m.p LEFT JOIN m q ON m.d > 0 AND q.p = m.p[1:m.d - 1]
    """,
    "op13_structure_repair": """
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY i) AS crc FROM (
                SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)
            )
        ), o AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, (xor(list_reduce(list_prepend(4294967295::UBIGINT,
                list_transform(string_split(conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) % 256 + 1)::INTEGER])), 4294967295::UBIGINT) % 20)::INTEGER AS k
            FROM conversations, crc WHERE conv_id IS NOT NULL
        ), t AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, o.role, o.text, c) AS i
            FROM (SELECT *, unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM o) o
        ), f AS (
            SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
                WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS f,
                lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_r FROM t
        ), n AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
                   count(*) FILTER (f = 't') AS truncated, count(*) FILTER (next_r IS NOT NULL AND (r || next_r) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
        ), w AS (  -- from the last row to the first: the least (cost, audit) to the end from each state 0 nothing, 1 s, 2 u, 3 pair
            SELECT conv_id, n AS i, [{'c': 0::BIGINT, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] AS v FROM n
            UNION ALL
            SELECT conv_id, i - 1, list_transform(range(1, 5), lambda s: list_min([v[s], {'c': v[to_[s]].c + 2, 'a': 'I' || v[to_[s]].a}, {'c': v[to_[to_[s]]].c + 4, 'a': 'II' || v[to_[to_[s]]].a}])) FROM (
                SELECT w.conv_id, w.i, to_, list_transform(range(1, 5), lambda s: list_min([
                    {'c': w.v[s].c + 3, 'a': 'D' || w.v[s].a},
                    {'c': CASE WHEN f.f IN ('b', 'd') THEN 1000000000 ELSE w.v[to_[s]].c + 2 + (f.f = 't')::BIGINT END, 'a': 'R' || w.v[to_[s]].a},
                    CASE WHEN f.r = 's' AND s = 1 AND f.f NOT IN ('b', 'd') THEN {'c': w.v[2].c + (f.f = 't')::BIGINT, 'a': 'K' || w.v[2].a}
                         WHEN f.r = CASE s WHEN 3 THEN 'a' ELSE 'u' END AND f.f NOT IN ('b', 'd') THEN {'c': w.v[to_[s]].c + (f.f = 't')::BIGINT, 'a': 'K' || w.v[to_[s]].a}
                         ELSE {'c': 1000000000, 'a': ''} END])) AS v
                FROM w JOIN f ON f.conv_id = w.conv_id AND f.i = w.i, (SELECT [3, 3, 4, 3] AS to_))
        ), a AS (
            SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM w WHERE i = 0
        ), l AS (  -- along the audit: rows used, role expected next, repaired lines
            SELECT conv_id, 0 AS p, 0::BIGINT AS i, 'u' AS expected, []::VARCHAR[] AS lines FROM a
            UNION ALL
            SELECT conv_id, p + 1, i, CASE WHEN letter = 'D' THEN expected WHEN left(given, 1) = 'u' THEN 'a' ELSE 'u' END,
                   CASE WHEN letter = 'D' THEN lines ELSE list_append(lines, given || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END) END
            FROM (
                SELECT l.conv_id, l.p, a.audit[l.p + 1] AS letter, l.i + (a.audit[l.p + 1] <> 'I')::BIGINT AS i, l.expected, l.lines, f.text,
                       CASE WHEN a.audit[l.p + 1] = 'K' THEN f.role WHEN l.expected = 'u' THEN 'user' ELSE 'assistant' END AS given
                FROM l JOIN a ON a.conv_id = l.conv_id LEFT JOIN f ON f.conv_id = l.conv_id AND f.i = l.i + 1 WHERE l.p < length(a.audit))
        ), h AS (
            SELECT l.conv_id, sha256(array_to_string(l.lines, chr(10))) AS repaired_sha256 FROM l JOIN a ON a.conv_id = l.conv_id AND l.p = length(a.audit)
        ) SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
                 coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM o) c LEFT JOIN n ON n.conv_id = c.conv_id LEFT JOIN a ON a.conv_id = c.conv_id LEFT JOIN h ON h.conv_id = c.conv_id
    """,
}
