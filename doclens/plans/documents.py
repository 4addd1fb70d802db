"""Queries over the structure of documents and over catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S
from ..sources.corpus import SPEC_SQL, spec_chunks, spec_markdown, spec_tables, table
from .registry import query
from .retrieval import TOKEN_SQL

MD_SQL = "md AS (SELECT 'ORD-' || (pos // 10) AS doc, (row_number() OVER (PARTITION BY pos // 10 ORDER BY pos))::INTEGER AS section, ((pos % 10) % 3 + 1)::INTEGER AS level, section_number AS number, section_title AS title, text AS content FROM spec)"


@query(f"WITH {SPEC_SQL}, {MD_SQL} SELECT * FROM md")
def markdown_sections(spark, sf_dir):
    return S.sections(spec_markdown(spark, sf_dir)).filter("level > 0")


PATH_SQL = """
    pa AS (SELECT doc, section, level, title,
        (SELECT p.title FROM md p WHERE p.doc = md.doc AND p.section <= md.section AND p.level = 1 ORDER BY p.section DESC LIMIT 1) AS t1,
        CASE WHEN level >= 2 THEN (SELECT p.title FROM md p WHERE p.doc = md.doc AND p.section <= md.section AND p.level <= 2 ORDER BY p.section DESC LIMIT 1) END AS t2,
        CASE WHEN level >= 2 THEN (SELECT p.level FROM md p WHERE p.doc = md.doc AND p.section <= md.section AND p.level <= 2 ORDER BY p.section DESC LIMIT 1) END AS l2 FROM md),
    paths AS (SELECT doc, section, level, concat_ws(' > ', t1, CASE WHEN l2 = 2 THEN t2 END, CASE WHEN level = 3 THEN title END) AS path FROM pa)"""


@query(f"WITH {SPEC_SQL}, {MD_SQL}, {PATH_SQL} SELECT * FROM paths")
def section_paths(spark, sf_dir):
    return S.section_paths(S.sections(spec_markdown(spark, sf_dir))).select("doc", "section", "level", "path")


@query(f"WITH {SPEC_SQL}, {MD_SQL}, {PATH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY level DESC, section) AS rn, count(*) OVER (PARTITION BY doc) AS n_sections FROM paths) SELECT doc, path, level, n_sections FROM r WHERE rn = 1")
def deepest_sections(spark, sf_dir):
    return S.deepest(S.section_paths(S.sections(spec_markdown(spark, sf_dir))))


@query(f"WITH {SPEC_SQL}, p AS (SELECT chunk_id, file_name, pos, CASE WHEN text LIKE 'Conductor%' THEN section_number END AS own FROM spec) SELECT chunk_id, file_name, last_value(own IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY pos, chunk_id ROWS UNBOUNDED PRECEDING) AS section FROM p")
def section_carried_forward(spark, sf_dir):
    rows = spec_chunks(spark, sf_dir).withColumn("own", F.when(F.col("text").startswith("Conductor"), F.col("section_number")))
    return rows.select("chunk_id", "file_name", S.carried_forward(rows, "own", "file_name", "pos").alias("section"))


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 16) / 112.0)::BIGINT, 1)))::INTEGER AS chunk FROM w WHERE len(w) > 0) SELECT doc_id, chunk, (chunk * 112)::INTEGER AS begin, len(w[chunk * 112 + 1:chunk * 112 + 128])::INTEGER AS n_tokens, array_to_string(w[chunk * 112 + 1:chunk * 112 + 128], ' ') AS text, (chunk * 112 // 512)::INTEGER AS parent_512 FROM c")
def chunks(spark, sf_dir):
    return S.chunks(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {SPEC_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY pos) AS i, count(*) OVER (PARTITION BY file_name) AS n FROM spec), p AS (SELECT chunk_id, 'Document: ' || file_name AS d, 'Section: ' || section_number || ' ' || section_title AS s, 'Page: ' || page_number AS g, 'Position: ' || CASE WHEN i = 1 THEN 'beginning' WHEN i = n THEN 'end' ELSE 'part ' || i || ' of ' || n END AS o FROM n) SELECT chunk_id, CASE WHEN len(concat_ws(' | ', d, s, g, o)) > 200 THEN concat_ws(' | ', d, s, g) ELSE concat_ws(' | ', d, s, g, o) END AS prefix FROM p")
def context_prefixes(spark, sf_dir):
    own = Window.partitionBy("file_name")
    rows = spec_chunks(spark, sf_dir).withColumn("i", F.row_number().over(own.orderBy("pos"))).withColumn("n", F.count(F.lit(1)).over(own))
    return rows.select("chunk_id", S.context_prefix(F.col("file_name"), F.concat_ws(" ", "section_number", "section_title"), F.col("page_number"), F.col("i"), F.col("n")).alias("prefix"))


_OVERLAP_SQL = "CASE WHEN greatest(len(w), len(pw)) > 0 THEN len(list_intersect(w, pw)) / greatest(len(w), len(pw)) ELSE 0 END"


@query(f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS text FROM p), w AS (SELECT *, list_distinct({TOKEN_SQL}) AS w FROM s),
    l AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS pw FROM w), d AS (SELECT *, CASE WHEN i > 1 THEN round(1 - {_OVERLAP_SQL}, 6) END AS distance FROM l),
    q AS (SELECT *, round(quantile_cont(distance, 0.95) OVER (PARTITION BY doc_id), 9) AS lim FROM d), c AS (SELECT *, sum(CASE WHEN distance > lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS chunk FROM q)
    SELECT doc_id, chunk, count(*) AS n_sentences, string_agg(text, ' ' ORDER BY i) AS text FROM c GROUP BY doc_id, chunk""")
def semantic_chunks(spark, sf_dir):
    return S.semantic_breaks(table(spark, sf_dir, "documents"), "doc_id")


TABLES_SQL = "tl AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ALL), tr AS (SELECT 'ORD-' || l_orderkey AS doc, l_orderkey % 9 + 1 AS cap, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INTEGER AS row_no, pk, qty FROM tl)"


@query(f"WITH {TABLES_SQL} SELECT doc, 1::INTEGER AS table_no, 'Table ' || cap || ': Ratings' AS caption, 'electrical' AS table_type, count(*)::INTEGER AS n_rows, 3::INTEGER AS n_columns, 'Current: ' || min(qty) || '-' || max(qty) || '; Code: ' || min(pk % 50) || '-' || max(pk % 50) AS ranges FROM tr GROUP BY doc, cap")
def markdown_table_summaries(spark, sf_dir):
    return S.table_summary(S.markdown_tables(spec_tables(spark, sf_dir)))


@query(f"WITH {TABLES_SQL} SELECT doc, 1::INTEGER AS table_no, row_no, 0::INTEGER AS column_no, 'Item' AS header, 'Part ' || pk AS cell, 'text' AS data_type, NULL::DOUBLE AS value, NULL AS unit FROM tr UNION ALL SELECT doc, 1, row_no, 1, 'Current', qty || ' A', 'quantity', qty, 'A' FROM tr UNION ALL SELECT doc, 1, row_no, 2, 'Code', (pk % 50)::VARCHAR, 'number', pk % 50, NULL FROM tr")
def markdown_table_cells(spark, sf_dir):
    return S.table_cells(S.markdown_tables(spec_tables(spark, sf_dir)))


@query(f"WITH {TABLES_SQL} SELECT doc, 1::INTEGER AS table_no, row_no, 'Part ' || pk || ': Current = ' || qty || ' A, Code = ' || (pk % 50) AS sentence, '{{\"Item\":\"Part ' || pk || '\",\"Current\":\"' || qty || ' A\",\"Code\":\"' || (pk % 50) || '\"}}' AS json FROM tr")
def markdown_table_sentences(spark, sf_dir):
    return S.table_sentences(S.markdown_tables(spec_tables(spark, sf_dir)))


@query("SELECT p_partkey, 'EN ' || (50000 + p_partkey) AS standard_no, CASE WHEN p_partkey % 2 = 0 THEN (1990 + p_size % 30)::VARCHAR END AS year, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS description FROM part")
def file_name_metadata(spark, sf_dir):
    year = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), (1990 + F.col("p_size") % 30).cast("string"))).otherwise("")
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("EN_"), (50000 + F.col("p_partkey")).cast("string"), year, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("file_name"))
    return S.name_metadata(files).select("p_partkey", "standard_no", "year", "description")


def _toc_pages(spark, sf_dir):
    """A contents page for each supplier nation's corpus and pages of text behind it."""
    rows = spec_chunks(spark, sf_dir).groupBy("file_name", "section_number").agg(F.min("section_title").alias("title"), F.min("page_number").alias("page"))
    line = F.concat("section_number", F.lit(" "), "title", F.lit(" ..... "), F.col("page").cast("string"))
    return rows.groupBy(F.col("file_name").alias("doc")).agg(F.concat(F.lit("Table of contents\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("text")).withColumn("page_number", F.lit(1))


@query(f"WITH {SPEC_SQL} SELECT file_name AS doc, section_number AS identifier, min(section_title) AS title, min(page_number)::INTEGER AS page_number FROM spec GROUP BY ALL")
def toc_elements(spark, sf_dir):
    return S.toc_elements(S.index_pages(_toc_pages(spark, sf_dir)))


@query(f"WITH {SPEC_SQL} SELECT file_name, count(*) AS chunks, count(DISTINCT page_number) AS pages, count(DISTINCT section_number) AS sections, arg_min(section_title, pos) AS first_title FROM spec GROUP BY file_name")
def document_catalog(spark, sf_dir):
    return S.catalog(spec_chunks(spark, sf_dir))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) AS title, len(regexp_extract_all(html, '<p>'))::INTEGER AS n_paragraphs, len(regexp_extract_all(html, '<a href'))::INTEGER AS n_links FROM pages")
def page_headings(spark, sf_dir):
    return S.html_headings(table(spark, sf_dir, "pages"))


@query(f"WITH {SPEC_SQL}, c AS (SELECT 'SPEC-' || n_nationkey AS file_name, r_name AS category, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS project FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0) SELECT coalesce(category, 'Uncategorized') AS category, coalesce(project, 'N/A') AS project, count(*) AS chunks, count(DISTINCT file_name) AS documents FROM spec LEFT JOIN c USING (file_name) GROUP BY ALL")
def category_facets(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    stored = n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter("n_nationkey % 5 <> 0").select(F.concat(F.lit("SPEC-"), F.col("n_nationkey").cast("string")).alias("file_name"), F.col("r_name").alias("category"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("project"))
    return S.with_facets(spec_chunks(spark, sf_dir), stored).groupBy("category", "project").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_name").alias("documents"))


@query(f"WITH {SPEC_SQL} SELECT chunk_id, file_name, section_number FROM spec WHERE section_number LIKE '3.%' AND (lower(text) LIKE '%conductor%' OR lower(text) LIKE '%wire%' OR lower(text) LIKE '%cable%')")
def focus_filter(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("cable", "conductor", "wire")])
    rows = spec_chunks(spark, sf_dir).filter(F.col("section_number").startswith("3."))
    return rows.filter(F.exists(words, lambda w: F.contains(F.lower("text"), w))).select("chunk_id", "file_name", "section_number")


@query("SELECT conv_id, turn, len(text) AS n_chars, text[:300] AS preview FROM conversations WHERE lower(text) LIKE '%the%' AND len(trim(text)) BETWEEN 1 AND 5000")
def history_search(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter(F.contains(F.lower("text"), F.lit("the")))
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 300).alias("preview"))


@query("WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9_à-öø-ÿğışœ]+'), lambda x: x NOT IN ('what', 'which', 'how', 'where', 'when', 'why', 'who', 'is', 'are', 'the', 'a', 'an', 'of', 'for', 'in')) AS w FROM conversations WHERE role = 'user') SELECT array_to_string(w[1:4], ' ') AS pattern, count(*) AS n FROM w GROUP BY ALL")
def query_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.groupBy(T.query_pattern(F.col("text")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
